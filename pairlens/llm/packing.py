"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are whole numbers up to the capacity, so the whole plan depends on
their histogram alone: at most ``capacity`` counts reach the driver, however
many documents there are.  The plan is a list of patterns, each a multiset of
lengths that one sequence holds and how often it is used.  For the largest
length that is left, an index of available single, pair and triple sums tells
which combinations fill the gap exactly; a combination is consumed as often as
the counts allow.  Where no combination fits exactly, the largest piece that
fits goes in and the smaller gap is tried again.

Pieces find their places by rank: the k-th piece of a length takes the k-th
slot of that length.  Ranks come from counts by task and length, so no task
sees more than its own pieces, and a length that a third of all pieces have is
no hot spot.

Nulls and edge cases: a null text is an empty one and so a piece of one token
(the end); only texts of more than ``capacity`` tokens are cut; repeated rows
are packed as often as they occur; a null doc_id stays null; an empty table
gives no pieces; other columns of the input are not looked at.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from string import ascii_letters, digits, punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import Tables, ids_and_text, tidy

CAPACITY = 4096
END = 1
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a task keeps, about 40 bytes each.
CACHED_WORDS = 250_000
#: A mark behind a letter or digit; apostrophes may begin an ending.
MARK = r"([A-Za-z0-9])([!-&(-/:-@\[-`{-~])"
#: Bytes of text that are split into words at once, or one text.
SLICE_BYTES = 4 << 20


@lru_cache(1)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _parts_marks(path: str) -> bool:
    """Whether the tokenizer parts a letter or digit from a mark behind it, whichever they are."""
    tokenizer = _tokenizer(path)
    parts = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer else lambda x: [x]
    return all(len(parts(a + b)) == 2 for a in ascii_letters + digits for b in punctuation if b != "'")


class Encoder:
    """The ids of texts.  The tokenizer drops white space and never joins what it separates, so a
    text's ids are those of its words in order; a test compares the two.  Where the tokenizer also
    parts words from marks behind them, they are looked up apart: fewer strings are distinct.

    Arrow splits texts into words, numbers the distinct ones and finds those that are known, so
    that Python sees new words only.  When too many are known, those that were met again stay.
    """

    def __init__(self, path: str, end: int = END):
        self.tokenizer, self.end = _tokenizer(path), array("I", [end]).tobytes()
        self.parts_marks = _parts_marks(path)
        self.words, self.ids, self.again = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, bool)

    def _encoded(self, words: pa.Array) -> pa.Array:
        texts = [w.decode("utf-8", "replace") for w in words.cast(pa.binary()).to_pylist()]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = 4 * np.cumsum([0, *map(len, ids)], dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(ids), "<u4", int(ends[-1]) // 4)
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(flat)])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where distinct words stand in self.words, of which they become a part."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        self.again[at.drop_null().to_numpy()] = True
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words, self.ids = self.words.filter(pa.array(self.again)), self.ids.filter(pa.array(self.again))
            self.again = np.zeros(len(self.words), bool)
            at = pc.index_in(words, value_set=self.words)
        first = len(self.words)
        self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, self._encoded(new)])
        self.again = np.append(self.again, np.zeros(len(new), bool))
        out = at.fill_null(-1).to_numpy().astype(np.int64)
        out[out < 0] = first + np.arange(len(new))
        return out

    def ids_of(self, texts: pa.Array) -> list[memoryview]:
        """The ids of each text and the end id, little-endian 32 bits each."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.parts_marks:
            texts = pc.replace_substring_regex(texts, MARK, r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ends = np.diff(split.offsets.to_numpy()).cumsum()
        places = np.append(self._places(coded.dictionary), len(self.words))
        word = np.insert(coded.indices.to_numpy(), ends, len(places) - 1)  # the end after the last word of each text
        ids = pa.concat_arrays([self.ids, pa.array([self.end], pa.large_binary())])
        joined = ids.take(pa.array(places[word]))
        _, offsets, data = joined.buffers()
        upto = np.frombuffer(offsets, np.int64)[joined.offset :]
        out, cuts = memoryview(data), [int(upto[0]), *upto[ends + np.arange(1, len(ends) + 1)].tolist()]
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def _short(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """b in slices of about SLICE_BYTES of text."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)), 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield b.slice(at, to - at)
        at = to


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document; with keep_ids, the ids too, as bytes."""
    schema = PIECE + ", task int, place long" + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encoder = TaskContext.get().partitionId(), Encoder(tokenizer_path)
        seen = np.zeros(capacity + 1, np.int64)
        for b in (x for batch in batches for x in _short(batch)):
            rows: list[tuple] = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.ids_of(b.column("text")), strict=True):
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s : s + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc_id, k, s // 4, n, zlib.crc32(part), task, int(seen[n]), *([bytes(part)] if keep_ids else [])))
                    seen[n] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", "ids"][: len(types) - (not keep_ids)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names=names)

    return ids_and_text(docs).mapInArrow(tidy(run), schema)


class Complements:
    """What is left of each length, and by sum the combinations of one, two or three lengths that may still be had.

    A sum's combinations are listed when it is first asked for, largest
    members first, and lose those that are used up: counts only fall.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.pairs: dict[int, np.ndarray] = {}  # the larger members, by sum
        self.triples: dict[int, np.ndarray] = {}  # the largest members, by sum

    def free(self, length: int, used: dict[int, int]) -> bool:
        return self.left[length] > used.get(length, 0)

    def pairs_of(self, total: int) -> np.ndarray:
        a = self.pairs.get(total)
        if a is None:
            a = np.arange(total - 1, (total - 1) // 2, -1)
        if len(a):
            a = a[(self.left[a] > 0) & (self.left[total - a] > 0)]
        self.pairs[total] = a
        return a

    def triples_of(self, total: int) -> np.ndarray:
        a = self.triples.get(total)
        if a is None:
            a = np.arange(total - 2, (total - 1) // 3, -1)
        if len(a):
            a = a[self.left[a] > 0]
        self.triples[total] = a
        return a

    def find_pair(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        for x in self.pairs_of(gap).tolist():
            if self.free(x, used) and self.free(gap - x, used | {x: used.get(x, 0) + 1}):
                return x, gap - x
        return None

    def find_triple(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        none = []
        for x in self.triples_of(gap).tolist():
            if not len(self.pairs_of(gap - x)):
                none.append(x)  # and never again
            elif self.free(x, used) and (more := self.find_pair(gap - x, used | {x: used.get(x, 0) + 1})):
                return x, *more
        if none:
            self.triples[gap] = np.setdiff1d(self.triples[gap], none)[::-1]
        return None

    def find(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        if self.free(gap, used):
            return (gap,)
        return self.find_pair(gap, used) or self.find_triple(gap, used)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; counts[n]: pieces of length n."""
    index, out = Complements(counts), []
    for length in range(capacity, 0, -1):
        while index.left[length]:
            used, items, gap = {length: 1}, [length], capacity - length
            while gap:
                found = index.find(gap, used)
                if not found:
                    fits = np.flatnonzero(index.left[1 : gap + 1])[::-1] + 1
                    found = next(((int(x),) for x in fits if index.free(int(x), used)), None)
                if not found:
                    break
                for x in found:
                    used[x] = used.get(x, 0) + 1
                    items.append(x)
                    gap -= x
            times = min(int(index.left[x]) // n for x, n in used.items())
            for x, n in used.items():
                index.left[x] -= n * times
            out.append((tuple(items), times))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, first sequence, offset): rank k in a row's run has the sequence that many on."""
    ranks: dict[int, int] = {}
    out: dict[int, list] = {}
    first = 0
    for items, times in patterns:
        at = 0
        for x in items:
            k = ranks.get(x, 0)
            out.setdefault(x, []).append((k, first, at))
            ranks[x] = k + times
            at += x
        first += times
    return {x: np.asarray(rows, np.int64) for x, rows in out.items()}


def place(spark: SparkSession, table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The written pieces with sequence_id and offset."""
    by_task = table.groupBy("task", "length").count()
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect():  # a row for each length
        counts[r.length] = r.n
    where = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = table.join(by_task.select("task", "length", before.alias("before")), ["task", "length"]).withColumn("place", F.col("place") + F.col("before"))
    keep = [c for c in table.columns if c not in ("task", "place")]
    schema = ranked.select(*keep).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("place").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                rows = where.value[int(x)]
                run_ = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                seq[at], off[at] = run_[:, 1] + rank[at] - run_[:, 0], run_[:, 2]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    return ranked.select(*keep, "place").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Each document's pieces with the sequence and the place in it where they go."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    return place(spark, Tables(spark).write(pieces(docs, str(tokenizer_path), capacity, keep_ids), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
