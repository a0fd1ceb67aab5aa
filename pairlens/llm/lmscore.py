"""Scores texts with a gated recurrent language model that is trained on the corpus itself.

1. All training documents are counted, word by word.
2. Words of LEAST_COUNT or more occurrences, FEWEST_WORDS of them at least and
   MOST_WORDS at most, are entries of the network, dealt over about as many
   classes as their number's root.  The other words of the table that tasks hold share an
   entry with those of like counts (an octave), and the words that the table lacks share
   the last; within such an entry, counts divide: the model is a proper
   distribution over known words and one unknown, and it grows with the corpus.
3. Texts are turned into entry numbers once, and a written table has them.
4. Training reads every training document, in rounds: a warm-up on about
   WARM_DOCS documents starts all tasks at the same point, then each task
   learns from its documents of the round, and parameters are averaged by
   tokens in a tree, as large as FAN models at every step.
5. Scoring runs each whole text through the network.  Words that are too rare
   for the table are joined to the counts by a shuffle, so every count is exact.

Nulls and edge cases: a null or empty text is the end token alone; a null
doc_id counts as empty text in the fold's checksum, which makes the document a
training one; repeated rows are scored, and learnt from, as often as they
occur; texts are taken whole; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import gru
from pairlens.llm.common import Tables, ids_and_text

FOLDS, HELD = 7, 2
#: The end of a text; words hold no white space, so none is like it.
END = b"\n"
#: Words that every task holds a table of, at most: the counts that are left are joined.
TABLE_WORDS = 1 << 18
#: Words that are entries of the network: those with so many occurrences, and bounds of their number (a model of MOST_WORDS has 9 MB).
LEAST_COUNT, FEWEST_WORDS, MOST_WORDS = 8192, 1023, 16_384
#: Documents of the warm-up, on average; and the shares of the documents, in sixteenths, that the rounds after it learn from.
WARM_DOCS, ROUNDS = 2048, ((0, 4), (4, 16))
#: Tokens that are put into lanes at once; models that are added at once.
CHUNK, FAN = 1_000_000, 8
#: Documents of more tokens are scored together at the end of a task, so that each lane is in use for long.
LONG = 2048


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def words_of(text: bytes | None) -> list[bytes]:
    out = (text or b"").lower().split()
    out.append(END)
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if not held_out(doc_id):
                    seen.update(words_of(text))
                    if len(seen) > 500_000:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    return ids_and_text(docs).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Counts of the frequent words, and the network's entry of each."""

    def __init__(self, frequent: list[tuple[bytes, int]], tokens: int, distinct: int):
        frequent = sorted(frequent, key=lambda x: (-x[1], x[0]))
        self.tokens, self.distinct = tokens, distinct
        self.rank = {w: i for i, (w, _) in enumerate(frequent)}
        count = np.asarray([c for _, c in frequent], np.int64)
        top = int(np.clip((count >= LEAST_COUNT).sum(), FEWEST_WORDS, MOST_WORDS))
        top = min(top, len(count))
        octave = np.floor(np.log2(np.maximum(count[top:], 1))).astype(np.int64)
        _, tail = np.unique(-octave, return_inverse=True)  # frequent ones first
        self.tails = int(tail.max() + 2) if len(tail) else 1  # and the entry of the words that the table lacks
        # the last place of each array, number -1, stands for a word that the table lacks
        self.entry = np.concatenate([np.arange(top), top + tail, [top + self.tails - 1]]).astype(np.int32)
        self.count = np.append(count, 0)
        beyond = tokens - int(count.sum())
        self.counts = np.concatenate([count[:top], np.bincount(tail, weights=count[top:], minlength=self.tails - 1), [beyond]])
        mass = np.bincount(tail, weights=count[top:] + 1.0, minlength=max(self.tails - 1, 1))
        self.share_log = np.concatenate([np.zeros(top), np.log10((count[top:] + 1) / mass[tail]), [0.0]])  # of a word within its entry
        #: log10 of what divides the counts, each one more than it is, of the words that the table lacks.
        self.beyond_log = math.log10(beyond + distinct - len(count) + 1)
        self.base_log = math.log10(tokens + distinct + 1)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """By frequency from 0 on; -1 for words that the table lacks."""
        get = self.rank.get
        return np.fromiter([get(w, -1) for w in words], np.int32, len(words))


def _encoded(docs: DataFrame, vocabulary) -> DataFrame:
    """A row for each document with its entry numbers, and one for each of its words that the table lacks (with word)."""
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, share_logs double, n_beyond long, entries binary, word binary, times long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = vocabulary.value
        number = TaskContext.get().partitionId() << 33
        log = np.log10(v.count + 1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                ids, stats, entries, rows, words, times = b.column("doc_id").to_pylist(), [], [], [], [], []
                for k, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                    ws = words_of(text)
                    ranks = v.ranks(ws)
                    missing = Counter(ws[i] for i in np.flatnonzero(ranks < 0).tolist())
                    stats.append((len(ws), int((v.count[ranks] > 0).sum()), float(log[ranks].sum()), float(v.share_log[ranks].sum()), missing.total()))
                    entries.append(v.entry[ranks].astype("<i4").tobytes())
                    rows += [number + k] * len(missing)
                    words += missing.keys()
                    times += missing.values()
                n, m = len(ids), len(rows)
                own = [pa.array([*(s[i] for s in stats), *[None] * m], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))]
                held = [held_out(i) for i in ids]
                cols = [pa.array([*range(number, number + n), *rows], pa.int64()), pa.array([*ids, *[None] * m], pa.int64()), pa.array([*held, *[None] * m], pa.bool_()), *own]
                cols += [pa.array([*entries, *[None] * m], pa.binary()), pa.array([None] * n + words, pa.binary()), pa.array([None] * n + times, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                number += n

    return docs.mapInArrow(run, schema)


def _train(texts: DataFrame, start) -> DataFrame:
    """texts: entries.  A row of parameters, and of the tokens they were learnt from, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gru.Trainer(start.value)
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for x in b.column("entries").to_pylist():
                held.append(np.frombuffer(x, "<i4"))
                size += len(held[-1])
                if size >= CHUNK:
                    t.learn(held)
                    held, size = [], 0
        t.learn(held)
        if t.tokens:
            yield pa.RecordBatch.from_arrays([pa.array([t.tokens], pa.int64()), pa.array([gru.pack(t.p).tobytes()], pa.binary())], names=["tokens", "model"])

    return texts.mapInArrow(run, "tokens long, model binary")


def _merged(rows: DataFrame) -> DataFrame:
    """The mean of each task's models, by tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0, None
        for b in batches:
            for n, x in zip(b.column("tokens").to_pylist(), b.column("model").to_pylist(), strict=True):
                v = np.frombuffer(x, np.float32).astype(np.float64) * n
                tokens, total = tokens + n, v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], names=["tokens", "model"])

    return rows.mapInArrow(run, "tokens long, model binary")


def _averaged(rows: DataFrame, t: Tables, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean of the parameters, by tokens: of at most FAN rows at a time, until one is left; like where there is none."""
    rows = t.write(rows, "models")
    while (n := rows.count()) > 1:
        old, rows = rows, t.write(_merged(rows.repartition(-(-n // FAN))), "models")
        t.drop(old)
    last = rows.first()
    t.drop(rows)
    return gru.unpack(np.frombuffer(bytes(last.model), np.float32), like) if last else like


def _network(texts: DataFrame, model) -> DataFrame:
    """Rows with the network's log10 probability of the entries instead of these."""
    keep = [c for c in texts.columns if c != "entries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        later: list[pa.RecordBatch] = []

        def out(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Of about CHUNK tokens at a time."""
            at, upto = 0, np.cumsum([len(x.as_buffer()) // 4 for x in b.column("entries")])
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK)))
                part = b.slice(at, end - at)
                found = gru.log_likelihoods(p, [np.frombuffer(x, "<i4") for x in part.column("entries").to_pylist()]) / math.log(10)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(found)], names=[*keep, "network"])
                at = end

        def joined() -> pa.RecordBatch:
            whole = pa.Table.from_batches(later).combine_chunks().to_batches()[0]
            later.clear()
            return whole

        for b in batches:
            long = pa.compute.greater(b.column("n_tokens"), LONG)
            yield from out(b.filter(pa.compute.invert(long)))
            later.append(b.filter(long))
            if sum(pa.compute.sum(x.column("n_tokens")).as_py() or 0 for x in later) > 2 * CHUNK:
                yield from out(joined())
        if sum(x.num_rows for x in later):
            yield from out(joined())

    return texts.mapInArrow(run, texts.select(*keep).withColumn("network", F.lit(0.0)).schema)


def table_of(counts: DataFrame) -> tuple[list[tuple[bytes, int]], int]:
    """The words whose count is so high that TABLE_WORDS words at most have it, and that count."""
    upto, least = 0, 1
    for r in counts.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).limit(TABLE_WORDS + 1).collect():  # each has a word at least
        upto += r.words
        if upto > TABLE_WORDS:
            least = r.c + 1
            break
    return [(bytes(r.word), r.c) for r in counts.where(F.col("c") >= least).collect()], least


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, both in log10."""
    spark = docs.sparkSession
    t = Tables(spark)
    docs = ids_and_text(docs)
    counts = t.write(count_words(docs), "counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent, least = table_of(counts)
    v = Vocabulary(frequent, tokens, distinct)
    encoded = t.write(_encoded(docs, spark.sparkContext.broadcast(v)), "encoded")
    texts = encoded.where("word is null").drop("word", "times")
    model = gru.init(v.counts, v.tails)
    if tokens:
        place = F.xxhash64("doc_id", "n_tokens", "logs")
        learnt = texts.where("not held_out")
        warm = learnt.where(F.pmod(place, F.lit(max(texts.count(), 1))) < WARM_DOCS).repartition(1)
        sixteenth = F.pmod(F.xxhash64(place), F.lit(16))
        for rows in (warm, *[learnt.where((sixteenth >= a) & (sixteenth < b)) for a, b in ROUNDS]):
            model = _averaged(_train(rows.select("entries"), spark.sparkContext.broadcast(model)), t, model)
    scored = _network(texts, spark.sparkContext.broadcast(model))
    rare = encoded.where("word is not null").select("row", "word", "times").join(counts.where(F.col("c") < least), "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(c + F.lit(1.0))).alias("more_logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = scored.join(rare, "row", "left")
    more = F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(v.base_log)).alias("base_score"),
        (F.col("network") + F.col("share_logs") + more - F.col("n_beyond") * F.lit(v.beyond_log)).alias("score"),
    )


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
