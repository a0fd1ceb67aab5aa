"""Exact removal of repeated byte strings by parsing into phrases, in the manner of prefix-free parsing, spread over shards.

A document is parsed at triggers: in each window of LENGTH bytes the k-gram
with the smallest hash.  Consecutive windows with the same trigger form
a phrase, the bytes from the start of the first to the end of the last.  Equal
windows have equal triggers at equal places, so whatever repeats is found
within the phrases of one trigger, and the parse is shift-resistant.

* The dictionary has each distinct phrase once, with its first place in the
  corpus; of the parse, only where a phrase occurs again matters.  A phrase
  that occurred earlier has nothing but repeated windows, so repetitive text is
  done with here, at a few bytes a phrase.
* A window whose string also begins in another phrase of the same trigger is
  found by sorting the suffixes of the dictionary: the suffixes of that
  trigger's phrases, to the depth of LENGTH bytes.  Equal ones are next to each
  other, and the first places of their phrases put them into corpus order.

Each task first replaces repeats among its own phrases, so a phrase has at most
one row a task, however often it occurs.  Triggers with more than
TRIGGER_PHRASES different phrases are not sorted in one place: their windows
are grouped by 128-bit hashes instead.  Phrases are told apart by trigger hash
and phrase hash, 128 bits in all.

Nulls and edge cases: a null text is an empty one; texts of fewer than LENGTH
bytes lose nothing; texts are taken whole, of any length; rows with equal
doc_id are ordered by text, and a row that is there twice counts as repeated
by the second; a null doc_id comes first; an empty table gives no rows; other
columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import Tables, ids_and_text

LENGTH = 100
GRAM = 16
TRIGGER_PHRASES = 50_000
STEP = 1 << 19
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
PHRASES = "trigger long, phrase long, doc long, start int, windows int"


def _hashes(data: bytes, at: int, n: int) -> np.ndarray:
    """Hashes of the n k-grams from byte at on."""
    a = np.ndarray((n,), "<u8", data, at, (1,))
    b = np.ndarray((n,), "<u8", data, at + 8, (1,))
    h = a * _A
    h ^= (b + _C) * _B
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def parse(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """trigger hash, first window and number of windows of each phrase, in order."""
    total = len(data) - length + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = length - GRAM + 1
    triggers, starts = [], []
    low = np.uint64((1 << 20) - 1)
    for at in range(0, total, STEP):
        n = min(STEP, total - at)
        h = _hashes(data, at, n + span - 1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < span:
            m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
        place = (m & low).astype(np.int64)
        new = np.concatenate([[True], place[1:] != place[:-1]])
        starts.append(np.flatnonzero(new) + at)
        triggers.append((h[place[new]], place[new] + at))
    start = np.concatenate(starts)
    hashes, places = (np.concatenate(x) for x in zip(*triggers, strict=True))
    first = np.concatenate([[True], places[1:] != places[:-1]])  # a phrase may go on across steps
    start, hashes = start[first], hashes[first]
    return hashes, start, np.diff(np.append(start, total))


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes in [start, end)."""
    order = np.argsort(start, kind="stable")
    start, upto = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > upto[:-1]])
    return start[new], upto[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def _spans_batch(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc", "start", "end"])


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    base = np.cumsum(first).astype(np.int64) << 33  # documents apart from each other
    s, e = merge(base + start, base + end)
    at = np.searchsorted(base, s >> 33 << 33)
    return doc[at], s & ((1 << 33) - 1), e & ((1 << 33) - 1)


def _phrases(docs: DataFrame, length: int) -> DataFrame:
    """A row for the first of each task's equal phrases; the others as spans with null trigger, merged: start and end in start, windows."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        h64 = xxhash.xxh3_64_intdigest
        for b in batches:
            for doc, data in zip(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if data is None or len(data) < length:
                    continue
                t, s, n = parse(data, length)
                p = np.fromiter((h64(data[i:j]) for i, j in zip(s.tolist(), (s + n + length - 1).tolist(), strict=True)), np.uint64, len(s))
                parts.append((t.view(np.int64), p.view(np.int64), np.full(len(s), doc, np.int64), s.astype(np.int32), n.astype(np.int32)))
        if not parts:
            return
        t, p, d, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((s, d, p, t))
        t, p, d, s, n = (x[order] for x in (t, p, d, s, n))
        again = np.concatenate([[False], (t[1:] == t[:-1]) & (p[1:] == p[:-1])])
        names = ["trigger", "phrase", "doc", "start", "windows"]
        keep = ~again
        for at in range(0, int(keep.sum()), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[keep][at : at + 200_000]) for x in (t, p, d, s, n)], names=names)
        d, a, e = _runs(d[again], s[again].astype(np.int64), s[again].astype(np.int64) + n[again] + length - 1)
        if len(d):
            null = pa.nulls(len(d), pa.int64())
            yield pa.RecordBatch.from_arrays([null, null, pa.array(d), pa.array(a.astype(np.int32)), pa.array(e.astype(np.int32))], names=names)

    return docs.mapInArrow(run, PHRASES)


def _numbered(docs: DataFrame, t: Tables) -> DataFrame:
    """(doc, doc_id, text) with doc in the order of documents: doc_id itself where that is unique, else a number."""
    slim = ids_and_text(docs)
    rows, ids = slim.agg(F.count("*"), F.count("doc_id")).first()
    unique = rows == ids and slim.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if unique:
        return slim.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    ordered = slim.withColumn("h", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    return t.write(ordered.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "numbered")


def _first_and_again(rows: DataFrame, length: int) -> DataFrame:
    """rows sorted by trigger, phrase, doc, start: phrases that occurred before as spans (kind 0), first ones of triggers with several phrases (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "trigger", "doc", "start", "windows", "phrases"]

        def out(t, p, d, s, n):
            again = np.concatenate([[False], (t[1:] == t[:-1]) & (p[1:] == p[:-1])])
            ad, a, e = _runs(d[again], s[again].astype(np.int64), s[again].astype(np.int64) + n[again] + length - 1)
            if len(ad):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ad), np.int32)), pa.nulls(len(ad), pa.int64()), pa.array(ad), pa.array(a.astype(np.int32)), pa.array(e.astype(np.int32)), pa.nulls(len(ad), pa.int64())], names=names)
            t, d, s, n = t[~again], d[~again], s[~again], n[~again]
            new = np.concatenate([[True], t[1:] != t[:-1]])
            count = np.diff(np.append(np.flatnonzero(new), len(t)))
            each = np.repeat(count, count)
            m = each > 1
            if m.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(m.sum()), np.int32)), pa.array(t[m]), pa.array(d[m]), pa.array(s[m]), pa.array(n[m]), pa.array(each[m].astype(np.int64))], names=names)

        kept = None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("trigger", "phrase", "doc", "start", "windows")]
            cols = cols if kept is None else [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if cols[0][0] != cols[0][-1] else 0
            kept = [c[cut:] for c in cols]
            if cut:
                yield from out(*[c[:cut] for c in cols])
        if kept is not None:
            yield from out(*kept)

    return rows.mapInArrow(run, "kind int, trigger long, doc long, start int, windows int, phrases long")


def _cut_out(rows: DataFrame, length: int) -> DataFrame:
    """rows: text, doc and wanted, a list of (trigger, start, windows, phrases); gives the bytes of each phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, data, wanted in zip(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("wanted").to_pylist(), strict=True):
                out += [(w["trigger"], doc, w["start"], data[w["start"] : w["start"] + w["windows"] + length - 1], w["phrases"]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["trigger", "doc", "start", "bytes", "phrases"])

    return rows.mapInArrow(run, "trigger long, doc long, start int, bytes binary, phrases long")


def _windows(start: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of phrases: row of the phrase, place in the document, and the strings as an array over one buffer."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    count = size - length + 1
    row = np.repeat(np.arange(len(parts)), count)
    off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    buf = b"".join(parts)
    view = np.ndarray((len(buf) - length + 1,), f"S{length}", buf, 0, (1,))
    return row, start[row] + off, view[(np.cumsum(size) - size)[row] + off]


def _sorted_repeats(rows: DataFrame, length: int) -> DataFrame:
    """rows of whole triggers: spans of the windows that begin earlier elsewhere, by suffix order."""

    def out(doc, start, parts):
        row, place, text = _windows(start, parts, length)
        suffixes = np.argsort(text, kind="stable")
        text = text[suffixes]
        new = np.concatenate([[True], text[1:] != text[:-1]])
        rank = np.empty(len(row), np.int64)  # corpus order
        rank[np.lexsort((place, doc[row]))] = np.arange(len(row))
        rank = rank[suffixes]
        first = np.minimum.reduceat(rank, np.flatnonzero(new))
        again = suffixes[rank != first[np.cumsum(new) - 1]]
        return _spans_batch(*_runs(doc[row[again]], place[again], place[again] + length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: list = []
        d: list = []
        s: list = []
        x: list = []
        for b in batches:
            t += b.column("trigger").to_pylist()
            d += b.column("doc").to_pylist()
            s += b.column("start").to_pylist()
            x += b.column("bytes").to_pylist()
            while len(t) > 4000 and t[0] != t[-1]:
                cut = len(t) - 1
                while t[cut - 1] == t[-1]:
                    cut -= 1
                yield out(np.asarray(d[:cut]), np.asarray(s[:cut], np.int64), x[:cut])
                t, d, s, x = t[cut:], d[cut:], s[cut:], x[cut:]
        if t:
            yield out(np.asarray(d), np.asarray(s, np.int64), x)

    return rows.mapInArrow(run, "doc long, start int, end int")


def _hashed_windows(rows: DataFrame, length: int) -> DataFrame:
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, start, data in zip(b.column("doc").to_pylist(), b.column("start").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                n = len(data) - length + 1
                h = [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(np.full(n, doc)), pa.array(np.arange(start, start + n, dtype=np.int32))], names=["window", "doc", "start"])

    return rows.mapInArrow(run, "window binary, doc long, start int")


def repeats(docs: DataFrame, t: Tables, length: int = LENGTH) -> DataFrame:
    """docs: doc, text.  Spans (doc, start, end) that together cover the repeated bytes of each document."""
    phrases = t.write(_phrases(docs.select("doc", "text"), length), "phrases")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["trigger", "phrase", "doc", "start"]
    shards = phrases.where("trigger is not null").repartition(parts, "trigger").sortWithinPartitions(*order)
    told = t.write(_first_and_again(shards, length), "told")
    spans = phrases.where("trigger is null").select("doc", "start", F.col("windows").alias("end"))
    spans = spans.unionByName(told.where("kind = 0").select("doc", "start", F.col("windows").alias("end")))
    wanted = told.where("kind = 1").groupBy("doc").agg(F.collect_list(F.struct("trigger", "start", "windows", "phrases")).alias("wanted"))
    cut = t.write(_cut_out(docs.select("doc", "text").join(wanted, "doc"), length), "cut")
    light = cut.where(F.col("phrases") <= TRIGGER_PHRASES).repartition(parts, "trigger").sortWithinPartitions("trigger")
    spans = spans.unionByName(_sorted_repeats(light, length))
    if not (heavy := cut.where(F.col("phrases") > TRIGGER_PHRASES)).isEmpty():
        win = t.write(_hashed_windows(heavy, length), "windows")
        first = win.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        spans = spans.unionByName(win.join(first, "window").where(F.struct("doc", "start") != F.col("first")).select("doc", "start", (F.col("start") + length).alias("end")))
    out = t.write(spans.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "spans")
    t.drop(phrases, told, cut)
    return out


def dedup(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """What each document loses and keeps; with texts, also the kept bytes and the removed runs."""
    t = Tables(docs.sparkSession)
    numbered = _numbered(docs, t)
    joined = numbered.join(repeats(numbered, t, length), "doc", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<start:int,end:int>>" if texts else "")
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, data, starts, ends in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True):
                data, runs = data or b"", []
                if starts:
                    s, e = merge(np.asarray(starts, np.int64), np.asarray(ends, np.int64))
                    runs = list(zip(s.tolist(), e.tolist(), strict=True))
                at, kept = 0, []
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                rest = b"".join([*kept, data[at:]])
                row = (doc_id, len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest())
                out.append((*row, rest, [{"start": s, "end": e} for s, e in runs]) if texts else row)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary(), spans_type] if texts else [])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if texts else [])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[i]) for i in range(len(names))], names=names)

    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(run, schema)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
