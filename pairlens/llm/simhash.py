"""SimHash near-duplicates, found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The binary
Golay code is perfect: every 23-bit word is within 3 bits of exactly one of
4096 codewords.  A segment's keys are the codewords nearest to the words of its
1-bit ball (one or six of them), so two segments that differ in at most 2 bits
share a key.  The third segment's halves are D and E.  By the pigeonhole
principle the at most 3 differing bits leave one of these keys in common:

    (A, code of B)  (code of A, B)    A or B is equal, the other differs in 2 bits at most
    (code of A, code of B, D or E)    neither is equal, so C has 1 differing bit at most
    (A, C)  (B, C)                    all 3 bits are in one segment

and no link is missed.  Every key has 33 bits or more, so that few texts share
one by chance.  Rows of equal fingerprints are one from the start.
Rows of one key are compared with XOR and a bit count, in cells of at most two
blocks of BLOCK fingerprints however many share the key, and a cell gives back
a spanning forest of its links, not its pairs.

Nulls and edge cases: a null or empty text has fingerprint zero and is linked
like any other; a text of fewer words than a shingle is one shingle; repeated
rows get equal rows; a null doc_id stays null and takes part, but is never the
smallest; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import Tables, components, ids_and_text, keyed_join, tidy

BITS, SEED, RADIUS = 64, 42, 3
BLOCK, LOCAL = 2048, 4
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the binary Golay code.
GENERATOR = 0b110001110101


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    set_ = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        set_ += np.unpackbits(h[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * set_ > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return ids_and_text(docs).mapInArrow(tidy(run), "doc_id long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    s = words.astype(np.int64).copy()
    for i in range(22, 10, -1):
        s ^= np.where((s >> i) & 1, GENERATOR << (i - 11), 0)
    return s


@lru_cache(1)
def _leaders() -> np.ndarray:
    """By syndrome, the only error pattern of at most 3 bits that has it."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one)[np.triu_indices(23, 1)]
    three = np.unique(np.concatenate([(two[:, None] | one).ravel()]))
    three = three[np.bitwise_count(three) == 3]
    errors = np.concatenate([[0], one, two, three]).astype(np.int64)
    out = np.zeros(2048, np.int64)
    out[_syndromes(errors)] = errors
    return out


def nearest(words: np.ndarray) -> np.ndarray:
    """The 12-bit numbers of the codewords nearest to 23-bit words."""
    return (words ^ _leaders()[_syndromes(words)]) >> 11


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the distinct codewords near each word's 1-bit ball."""
    flips = np.concatenate([[0], 1 << np.arange(23)])
    k = np.sort(nearest((words[:, None] ^ flips).ravel()).reshape(len(words), 24), axis=1)
    new = np.ones(k.shape, bool)
    new[:, 1:] = k[:, 1:] != k[:, :-1]
    row, col = np.nonzero(new)
    return row, k[row, col]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): two fingerprints within RADIUS bits share at least one key."""
    u = fp.view(np.uint64)
    a, b, c = ((u >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((0, 2**23 - 1), (23, 2**23 - 1), (46, 2**18 - 1)))
    ra, ka = segment_keys(a)
    rb, kb = segment_keys(b)
    na, nb = np.bincount(ra, minlength=len(fp)), np.bincount(rb, minlength=len(fp))
    first = np.concatenate([[0], np.cumsum(nb)[:-1]])
    each = nb[ra]
    i = np.repeat(np.arange(len(ra)), each)
    j = first[ra[i]] + np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
    rows = np.arange(len(fp))
    ab = (ka[i] << 12) | kb[j]
    kinds = [(ra[i], (ab << 9) | (c & 511)[ra[i]]), (ra[i], (ab << 9) | (c >> 9)[ra[i]]), (rb, (a[rb] << 12) | kb), (ra, (b[ra] << 12) | ka), (rows, (a << 18) | c), (rows, (b << 18) | c)]
    return np.concatenate([r for r, _ in kinds]), np.concatenate([(t << 60) | k for t, (_, k) in enumerate(kinds)])


def keys_table(rows: DataFrame, make, schema: str) -> DataFrame:
    """make(batch) yields batches of keyed rows, key first, for each batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from make(b)

    return rows.mapInArrow(tidy(run), schema)


def large_keys(rows: DataFrame, make) -> DataFrame:
    """(key, n) of the keys with more than BLOCK rows, or nearly so, and a lower bound of how many they have.

    Tasks count for themselves and tell only of keys that they saw LOCAL times
    or more, so next to nothing is shuffled.  A key that no task saw so often
    has fewer than LOCAL rows for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[n >= LOCAL].astype(np.int64)), pa.array(n[n >= LOCAL].astype(np.int64))], names=["key", "n"])

        for b in batches:
            held += [x.column(0).to_numpy() for x in make(b)]
            if sum(map(len, held)) > 1_000_000:
                yield out()
        if held:
            yield out()

    return rows.mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)


def _keyed(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    fp = b.column("fp").to_numpy()
    for at in range(0, len(fp), 20_000):
        part = np.ascontiguousarray(fp[at : at + 20_000])
        row, key = keys_of(part)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (a, b) as stars: each node but the smallest of its component, with that smallest."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        np.minimum.at(new, up[x], low)
        np.minimum.at(new, up[y], low)
        new = new[new]
        if (new == up).all():
            break
        up = new
    rest = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[rest], nodes[up[rest]]


def links_within(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows of equal group; rows of a group are next to each other."""
    u = fp.view(np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = np.arange(len(u))
    for d in range(1, len(u)):
        at = at[at < len(u) - d]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        near = at[np.bitwise_count(u[at] ^ u[at + d]) <= radius]
        if len(near):
            found.append((fp[near], fp[near + d]))
            if sum(len(x) for x, _ in found) > 500_000:
                found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
    return forest(*map(np.concatenate, zip(*found, strict=True))) if found else (fp[:0], fp[:0])


def cells(keyed: DataFrame, counts: DataFrame, own: str) -> DataFrame:
    """keyed with i and j: rows of a key with more than BLOCK rows (in counts) are dealt over blocks by a hash of own, and meet in every pair of blocks."""
    few = counts.count()
    if not few:
        return keyed.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    hint = F.broadcast(counts) if few <= 100_000 else counts
    rows = keyed.join(hint, "key", "left").withColumn("g", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(own), F.col("g")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, g - 1)")))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("n", "g", "own", "other")


def by_cell(rows: DataFrame, columns: list[str], found, schema: str, joined=None) -> DataFrame:
    """found(cell, *columns) over whole cells, a batch of them at a time; cell numbers them, rows of a cell are next to each other.

    joined makes one batch of several, so that a task gives what it found as few rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.select(*dict.fromkeys(["key", "i", "j", *columns])).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            return found(np.cumsum(new), *[np.ascontiguousarray(c) for c in cols[3:]])

        kept: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("key", "i", "j", *columns)]
            cols = cols if kept is None else [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.argmax(last))
            kept = [c[cut:] for c in cols]
            if cut:
                yield out([c[:cut] for c in cols])
        if kept is not None and len(kept[0]):
            yield out(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in each(batches):
            held.append(b)
            if joined and sum(x.num_rows for x in held) > 1_000_000:
                held = [joined(held)]
                if held[0].num_rows <= 500_000:
                    continue
            if not joined or held[0].num_rows > 500_000:
                yield from held
                held = []
        if held:
            yield joined(held)

    return grouped.mapInArrow(tidy(run), schema)


def links(spark: SparkSession, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the fingerprints fp as links of at most radius (3 or less) bits do."""
    t = Tables(spark)
    own = fps.select("fp")
    large = t.write(large_keys(own, _keyed), "large")
    keyed = keys_table(own, _keyed, "key long, fp long")

    def found(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = links_within(cell, fp, radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    edges = t.write(by_cell(cells(keyed, large, "fp"), ["fp"], found, "a long, b long"), "links")
    t.drop(large)
    return edges


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that links of at most 3 bits reach."""
    spark = docs.sparkSession
    t = Tables(spark)
    prints = t.write(fingerprints(docs, shingle), "fingerprints")
    groups = t.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups")
    roots = t.write(components(spark, links(spark, groups)), "roots")
    named = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = t.write(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("fps"))
    ids = t.write(named.join(least, "root").select("fp", "n", "component_id"), "ids")
    t.drop(groups, roots, named)
    return keyed_join(prints, ids, "fp", prints.count(), spread=F.xxhash64("doc_id")).select("doc_id", "fp", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
