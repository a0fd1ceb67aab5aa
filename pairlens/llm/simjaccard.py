"""Near-duplicate documents by word shingles: SimHash and Golay keys find candidates, Jaccard similarity decides.

A similarity of 0.8 leaves SimHash fingerprints with about 15 % of differing
bits, too many for keys over all of 64 bits.  Here fingerprints are longer:
eleven segments of 23 bits, each with the codewords near its 1-bit ball as
keys, and the key of a pair of neighbouring segments is a codeword of each.
Two such documents share one of the ten pairs' keys in more than 96 of 100
cases at 0.8 and in 99.9 at 0.9.

Rows travel once for each codeword of the first segment, not for each key: a group
of these finds its keys itself, from the second segment.  Pairs are never listed.  Rows with a key in common whose sketches, 128 bits
beside the key, are close enough (at 0.8 all but 3 in 10,000 are) are joined
into a forest, a row for each but the first of them, and the forests' components
are sets of candidates.  Within these sets all pairs of similarity LEAST or more
are found exactly, by the prefix filter over shingles from rare to frequent, and
again only a forest of them leaves the task.  A set beyond SET_SHINGLES or
SET_TEXTS is cut into blocks, and each two blocks are compared in a task.

Texts with the same words are one from the start.  What a key's group gives is
linear in its size, and groups of more than simhash.BLOCK documents are compared in
cells of two blocks each.

Nulls and edge cases: a null or empty text has no words, and all such
documents are one group; a text of fewer words than a shingle is one shingle;
repeated rows are one document, and a doc_id with several texts stands for as many; documents without a doc_id can't be told apart
and always stay; an empty table gives an empty one; all columns are kept, and
none but doc_id and text are looked at (names that begin with "__" are reserved).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import Tables, components, ids_and_text, keyed_join, tidy
from pairlens.llm.simhash import SEED, by_cell, cells, forest, keys_table, large_keys, segment_keys

SHINGLE, LEAST = 5, 0.8
SEGMENTS, SKETCH_BITS = 11, 34
#: Rows of a group of keys that one task takes.
GROUP_ROWS = 100_000
WORDS64 = 5  # four for the segments, one for sketches alone
#: Shingles and texts of a block of candidates; a task compares two blocks at a time.
SET_SHINGLES, SET_TEXTS = 500_000, 4096
PAIRS, LOOKUPS, BITMAP = 50_000, 2_000_000, 64_000_000
BROADCAST_IDS = 1_000_000


def shingles(text: bytes | None, size: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """The lower-cased words, joined by spaces, and the distinct hashes of their shingles."""
    import xxhash

    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if not words:
        return joined, np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    h64 = xxhash.xxh64_intdigest
    return joined, np.unique(np.fromiter((h64(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n))


def _bits(h: np.ndarray) -> np.ndarray:
    """The majority of each of 64 * WORDS64 bits over the shingles, as that many words."""
    ones = np.zeros(64 * WORDS64, np.int64)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] + np.arange(1, WORDS64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8").astype(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short slices, so that few texts are held as objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            yield b.slice(at, 512)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, uid (a hash of the words), the number of shingles, and the fingerprint and sketch of each document."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            uid, n, words = [], [], np.zeros((b.num_rows, WORDS64), np.uint64)
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                joined, h = shingles(text, size)
                uid.append(xxhash.xxh3_64_intdigest(joined))
                n.append(len(h))
                words[i] = _bits(h)
            cols = [pa.array(np.asarray(uid, np.uint64).view(np.int64)), pa.array(n, pa.int32()), *[pa.array(np.ascontiguousarray(words[:, j]).view(np.int64)) for j in range(WORDS64)]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "uid", "n", *[f"w{j}" for j in range(WORDS64)]])

    return docs.mapInArrow(tidy(run), "doc_id long, uid long, n int, " + ", ".join(f"w{j} long" for j in range(WORDS64)))


def segment(words: np.ndarray, i: int) -> np.ndarray:
    """The 23 bits from bit 23 i on; words: rows of 64-bit words."""
    at, shift = divmod(23 * i, 64)
    out = words[:, at] >> np.uint64(shift)
    if shift > 64 - 23:
        out = out | (words[:, at + 1] << np.uint64(64 - shift))
    return (out & np.uint64(2**23 - 1)).astype(np.int64)


def _near(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment, (row, key) of the codewords near it."""
    return [segment_keys(segment(words, i)) for i in range(SEGMENTS)]


def _paired(rows: np.ndarray, other: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key): each place of rows with each key that other has for its row, of n."""
    r, k = other
    each = np.bincount(r, minlength=n)
    first = np.cumsum(each) - each
    each = each[rows]
    at = np.repeat(np.arange(len(rows)), each)
    return at, k[first[rows[at]] + np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)]


def pair_keys(words: np.ndarray, own: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of each pair of neighbouring segments."""
    own = own or _near(words)
    for i in range(SEGMENTS - 1):
        ra, ka = own[i]
        a, kb = _paired(ra, own[i + 1], len(words))
        yield ra[a], (i << 24) | (ka[a] << 12) | kb


def _parts(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The fingerprints of short slices as words, and uid and the two halves of the sketch for keys of either half.

    The second half of the sketch is a word of the fingerprint that has no bit of the key.
    """
    for at in range(0, b.num_rows, 4096):
        part = b.slice(at, 4096)
        words = np.stack([part.column(f"w{j}").to_numpy() for j in range(WORDS64)], axis=1).view(np.uint64)
        sketch = np.ascontiguousarray(words.T).view(np.int64)
        yield words, [part.column("uid").to_numpy(), sketch[-1], sketch[3], sketch[0]]


def _counted(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All keys, and the groups that keys belong to as -1 and less."""
    for words, _ in _parts(b):
        own = _near(words)
        for i, (_, key) in enumerate(pair_keys(words, own)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, -1 - ((i << 12) | own[i][1])]))], names=["key"])


def _member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


@dataclass
class Grouping:
    """How keys are dealt: rows go to groups, which share the first codeword, and find their keys there.

    large: keys that are not found in groups but dealt as rows; shares: how many tasks share a group,
    each with the keys of one remainder.
    """

    large: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> Grouping:
        """counts: key and n, of large keys and of groups (at most 4,096 for each pair of segments)."""
        shares = np.ones((SEGMENTS - 1) << 12, np.int64)
        for r in counts.where("key < 0").collect():
            shares[-1 - r.key] = -(-r.n // GROUP_ROWS)
        return cls(np.sort(counts.where("key >= 0").select("key").toArrow().column("key").to_numpy()).astype(np.int64), shares)

    def rows(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """key (the group), i (the remainder), the second segment, uid and sketch of each row once a group and remainder."""
        special = self.shares > 1
        special[self.large >> 12] = True
        for words, (uid, sketch, late, early) in _parts(b):
            own = _near(words)
            for i in range(SEGMENTS - 1):
                row, group = own[i][0], (i << 12) | own[i][1]
                part, hot = np.zeros(len(row), np.int64), special[group]
                if hot.any():
                    at, kb = _paired(row[hot], own[i + 1], len(words))
                    at = np.flatnonzero(hot)[at]
                    few = ~_member(self.large, (group[at] << 12) | kb)
                    at, kb = at[few], kb[few]
                    most = int(self.shares.max())
                    once = np.unique(at * most + kb % self.shares[group[at]])
                    at = np.concatenate([np.flatnonzero(~hot), once // most])
                    part = np.concatenate([part[~hot], once % most])
                    row, group = row[at], group[at]
                ints = [group, part, segment(words, i + 1)[row]]
                longs = [uid[row], sketch[row], (late if i < 5 else early)[row]]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in ints], *map(pa.array, longs)], names=["key", "i", "seg", "uid", "sketch", "more"])

    def found(self, cell: np.ndarray, group: np.ndarray, part: np.ndarray, seg: np.ndarray, uid: np.ndarray, sketch: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        """The candidates of whole groups."""
        row, kb = segment_keys(seg)
        g = group[row].astype(np.int64)
        own = (kb % self.shares[g] == part[row]) & ~_member(self.large, (g << 12) | kb)
        row, kb = row[own], kb[own]
        key = (cell[row].astype(np.int64) << 12) | kb
        order = np.argsort(key, kind="stable")
        row = row[order]
        return candidates(key[order], uid[row], sketch[row], more[row])

    def large_rows(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A row for each large key of each row."""
        for words, (uid, sketch, late, early) in _parts(b):
            for i, (row, key) in enumerate(pair_keys(words)):
                m = _member(self.large, key)
                row = row[m]
                yield pa.RecordBatch.from_arrays([pa.array(key[m].astype(np.int32)), *map(pa.array, (uid[row], sketch[row], (late if i < 5 else early)[row]))], names=["key", "uid", "sketch", "more"])


def candidate_pairs(own: DataFrame, counts: DataFrame) -> DataFrame:
    """Forests (a, b) of the rows with a key in common and close sketches; counts: large_keys of _counted."""
    grouping = Grouping.of(counts)
    fields = "uid long, sketch long, more long"
    grouped = keys_table(own, grouping.rows, "key int, i int, seg int, " + fields).withColumn("j", F.lit(0))
    near = by_cell(grouped, ["key", "i", "seg", "uid", "sketch", "more"], grouping.found, "a long, b long", _joined)
    if not len(grouping.large):
        return near
    large = keys_table(own, grouping.large_rows, "key int, " + fields)
    return near.unionByName(by_cell(cells(large, counts.where("key >= 0"), "uid"), ["uid", "sketch", "more"], candidates, "a long, b long", _joined))


def _forest(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = forest(*map(np.concatenate, zip(*parts, strict=True)))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def candidates(cell: np.ndarray, uid: np.ndarray, sketch: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """A forest of the pairs of a cell whose sketches differ in SKETCH_BITS or fewer."""
    u, v = sketch.view(np.uint64), more.view(np.uint64)
    found = [(uid[:0], uid[:0])]
    at = np.arange(len(u))
    for d in range(1, len(u)):
        at = at[at < len(u) - d]
        at = at[cell[at] == cell[at + d]]
        if not len(at):
            break
        near = at[np.bitwise_count(u[at] ^ u[at + d]) + np.bitwise_count(v[at] ^ v[at + d]) <= SKETCH_BITS]
        found.append((uid[near], uid[near + d]))
        if sum(len(x) for x, _ in found) > 500_000:
            found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
    return _forest(found)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One forest of several."""
    return _forest([(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches])


def similar_within(cell: np.ndarray, size: np.ndarray, flat: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of rows of one cell whose sets have a similarity of least or more; flat: the sets of all rows, one after another.

    Each set is sorted from rare to frequent elements.  Similar sets share one of the first size - least * size + 1,
    so only rows that meet in these are compared, and only those that no links connect yet.
    """
    n = len(cell)
    row = np.repeat(np.arange(n), size)
    _, code, df = np.unique(flat + cell.astype(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
    by_df = np.argsort(df, kind="stable")
    rank = np.empty(len(df), np.int64)
    rank[by_df] = np.arange(len(df))
    places = np.sort(row * len(df) + rank[code])  # row by row, rare to frequent
    code = places - row * len(df)
    start = np.cumsum(size) - size
    prefix = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
    m = (np.arange(len(row)) - start[row] < prefix[row]) & (df[by_df][code] > 1)
    order = np.argsort(code[m], kind="stable")
    who, what = row[m][order], code[m][order]
    up = np.arange(n)
    held: list[np.ndarray] = []

    def elements(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements of rows, one after another, and where each row's begin."""
        each = size[rows]
        first = np.cumsum(each) - each
        return code[np.repeat(start[rows] - first, each) + np.arange(int(each.sum()))], first

    def bitmaps(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """rows, and for each a bit for every element that two of them have, where that is less work than looking elements up."""
        own, _ = elements(rows)
        _, inv, times = np.unique(own, return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1
        words = int(number[-1]) // 64 + 1
        if words * 64 * len(rows) > BITMAP or words > size[rows].mean():
            return None
        own_row = np.repeat(np.arange(len(rows)), size[rows])[times[inv] > 1]
        dense = np.zeros((len(rows), words * 64), bool)
        dense[own_row, number[inv[times[inv] > 1]]] = True
        return rows, np.packbits(dense, axis=1).view(np.uint64)

    def verify() -> None:
        """The held pairs as links in up."""
        nonlocal up
        pairs = np.unique(np.concatenate(held))
        held.clear()
        x, y = pairs // n, pairs % n
        x, y = (z[up[x] != up[y]] for z in (x, y))
        a, b = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
        if not len(a):
            return
        shared = bitmaps(np.unique(np.concatenate([a, b])))
        cost = np.full(len(a), shared[1].shape[1]) if shared else size[a]
        ends = np.cumsum(cost)
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKUPS, "right")))
            p, q = a[at:to], b[at:to]
            if shared:
                rows, bits = shared
                common = np.bitwise_count(bits[np.searchsorted(rows, p)] & bits[np.searchsorted(rows, q)]).sum(1, dtype=np.int64)
            else:
                own, first = elements(p)
                sought = np.repeat(q, size[p]) * len(df) + own
                found = places[np.minimum(np.searchsorted(places, sought), len(places) - 1)] == sought
                common = np.add.reduceat(found.astype(np.int64), first)
            ok = common >= least * (size[p] + size[q] - common)
            if ok.any():
                rest = np.flatnonzero(up != np.arange(n))
                nodes, roots = forest(np.concatenate([p[ok], rest]), np.concatenate([q[ok], up[rest]]))
                up = np.arange(n)
                up[nodes] = roots
            at = to

    at = np.arange(len(who))
    for d in range(1, len(who)):
        at = at[at < len(who) - d]
        at = at[what[at] == what[at + d]]
        if not len(at):
            break
        x, y = who[at], who[at + d]
        ok = (up[x] != up[y]) & (np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y]) - 1e-9)
        held.append(np.minimum(x, y)[ok] * n + np.maximum(x, y)[ok])
        if sum(map(len, held)) > PAIRS:
            verify()
    if held:
        verify()
    rest = np.flatnonzero(up != np.arange(n))
    return rest, up[rest]


def _linked(rows: DataFrame, least: float) -> DataFrame:
    """rows of root, i, j, uid, set: forests (a, b) of the similar texts of whole cells (root, i, j)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["root", "i", "j", "uid"]
    grouped = rows.select(*names, "set").repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[np.ndarray] = [np.zeros(0, np.int64)] * (len(names) + 1)
        flat: list[np.ndarray] = []

        def out(n: int) -> pa.RecordBatch:
            """Links of the first n rows, which are given up."""
            root, i, j, uid, size = (c[:n] for c in cols)
            new = np.append(True, (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            both = np.concatenate(flat)
            upto = int(size.sum())
            flat[:] = [both[upto:]]
            cols[:] = [c[n:] for c in cols]
            a, b = similar_within(np.cumsum(new), size, both[:upto].view(np.uint64), least)
            return pa.RecordBatch.from_arrays([pa.array(uid[a]), pa.array(uid[b])], names=["a", "b"])

        for b in batches:
            sets = b.column("set")
            more = [*[b.column(c).to_numpy().astype(np.int64) for c in names], np.diff(sets.offsets.to_numpy()).astype(np.int64)]
            cols[:] = [np.concatenate(x) for x in zip(cols, more, strict=True)]
            flat.append(sets.flatten().to_numpy())
            if sum(map(len, flat)) > SET_SHINGLES:
                last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
                if cut := int(np.argmax(last)):
                    yield out(cut)
        if len(cols[0]):
            yield out(len(cols[0]))

    return grouped.mapInArrow(tidy(run), "a long, b long")


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            both = [shingles(t, size) for t in b.column("text").cast(pa.binary()).to_pylist()]
            uid = np.asarray([xxhash.xxh3_64_intdigest(j) for j, _ in both], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array([h.view(np.int64) for _, h in both], pa.list_(pa.int64()))], names=["uid", "set"])

    return docs.select("text").mapInArrow(tidy(run), "uid long, set array<long>")


def groups(docs: DataFrame, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(doc_id, uid, component_id, kept) of the first document of each text, of those with an id.

    component_id is the smallest id that links of least or more reach; one text of a group is kept.
    """
    spark = docs.sparkSession
    t = Tables(spark)
    slim = ids_and_text(docs).where("doc_id is not null")
    prints = t.write(_signatures(slim, size), "signatures")
    words = [f"w{j}" for j in range(WORDS64)]
    reps = t.write(prints.groupBy("uid").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), *[F.first(w).alias(w) for w in words]), "texts")
    own = reps.select("uid", *words)
    counts = t.write(large_keys(own, _counted).withColumn("key", F.col("key").cast("int")), "counts")
    near = t.write(candidate_pairs(own, counts), "candidates")
    t.drop(counts)
    roots = t.write(components(spark, near), "sets_of_candidates")
    t.drop(near)
    wanted = t.write(roots.withColumnRenamed("node", "uid").join(reps.select("uid", "first", F.col("n").alias("size")), "uid"), "wanted")
    t.drop(roots)
    blocks = F.ceil(F.greatest(F.sum("size") / SET_SHINGLES, F.count("*") / SET_TEXTS, F.lit(1))).cast("int")
    per_set = t.write(wanted.groupBy("root").agg(F.count("*").alias("n"), blocks.alias("blocks")), "per_set")
    rows = wanted.count()
    placed = keyed_join(wanted.select("root", "uid"), per_set, "root", rows, "inner", spread=F.col("uid"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("uid"), "blocks").cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, blocks - 1), x -> x != own)"))
    ids = wanted.select(F.col("first").alias("doc_id")).distinct()
    hint = F.broadcast(ids) if rows <= BROADCAST_IDS else ids
    sets = t.write(_shingle_sets(slim.join(hint, "doc_id", "left_semi"), size).dropDuplicates(["uid"]), "sets")
    placed = placed.join(sets, "uid").withColumn("other", F.explode(others))
    edges = t.write(_linked(placed.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "uid", "set"), least), "edges")
    t.drop(wanted, per_set, sets)
    roots = t.write(components(spark, edges), "roots")
    named = t.write(reps.select("uid", F.col("first").alias("doc_id")).join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid")), "named")
    least_id = named.groupBy("root").agg(F.min(F.struct("doc_id", "uid")).alias("kept"))
    # a text's copies may be a third of all rows: only its first copy is looked up again, the others go to it
    firsts = named.join(least_id, "root").select("doc_id", "uid", F.col("kept.doc_id").alias("component_id"), (F.col("uid") == F.col("kept.uid")).alias("kept"))
    firsts = t.write(firsts, "firsts")
    t.drop(prints, reps, edges, roots, named)
    return firsts


def _with_uid(docs: DataFrame) -> DataFrame:
    """docs with __uid, the hash of the words."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            uid = np.asarray([xxhash.xxh3_64_intdigest(b" ".join((t or b"").lower().split())) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(uid)], names=[*b.schema.names, "__uid"])

    return docs.mapInArrow(tidy(run), docs.withColumn("__uid", F.lit(0).cast("long")).schema)


def keep_one(docs: DataFrame, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs with one document of each group, that of the smallest doc_id; all columns are kept.

    Where a doc_id has several texts, each of them is a document of its own, and the words choose among them.
    """
    keep = groups(docs, size, least).where("kept").select(F.col("doc_id").alias("__id"), F.col("uid").alias("__words"))
    known = docs.where("doc_id is not null")
    hint = F.broadcast(keep) if keep.count() <= BROADCAST_IDS else keep
    again = known.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    if not again.isEmpty():  # of these ids, the kept texts, once each
        ids = known.join(hint.select("__id").distinct(), known["doc_id"] == hint["__id"], "left_semi")
        known = _with_uid(ids).join(hint, (F.col("doc_id") == F.col("__id")) & (F.col("__uid") == F.col("__words")), "left_semi")
        return known.dropDuplicates(["doc_id", "__uid"]).drop("__uid").unionByName(docs.where("doc_id is null"))
    return known.join(hint, known["doc_id"] == hint["__id"], "left_semi").unionByName(docs.where("doc_id is null"))
