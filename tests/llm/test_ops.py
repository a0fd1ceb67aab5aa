import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import common, gru, linededup, lmscore, mixing, packing, pii, quality, simhash, simjaccard, suffixdedup, warc


# quality rules
def test_measures():
    assert quality.measure(b"a b c\na b c\n\nx# y$")[:5] == (8, 10, 2, 1, 0)
    words = "a b c d e f a b c d e".split()
    assert quality.repeated_words([w.encode() for w in words]) == 10


def test_repeated_words_like_brute_force():
    rng = np.random.default_rng(0)
    for n in (0, 4, 5, 6, 60, 400):
        words = [str(x).encode() for x in rng.integers(0, 3, n)]
        seen = Counter(tuple(words[i : i + 5]) for i in range(max(0, n - 4)))
        hit = {j for i in range(max(0, n - 4)) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert quality.repeated_words(words) == len(hit)
    many = [str(i).encode() for i in range(5000)]
    assert quality.repeated_words(many + many[:7]) == 14


def test_ledger(docs, nothing):
    table = quality.ledger(docs).collect()
    assert len(table) == 8 and quality.ledger(nothing).count() == 0
    for r in table:
        assert r.failed == quality.failed_bits({m: r[m] for m in quality.MEASURES})
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == quality.apply_policy(quality.ledger(docs)).where("kept").count()
    ab = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(quality.ledger(docs)).collect()}
    assert ab["few_words"][0] == 7


# packing
def test_plan_fills_what_it_can():
    counts = np.zeros(101, np.int64)
    for n, k in ((60, 3), (40, 3), (50, 2), (30, 1), (20, 1), (25, 4), (99, 1), (1, 1), (7, 2)):
        counts[n] = k
    patterns = packing.plan(counts, 100)
    used = Counter()
    for items, times in patterns:
        assert sum(items) <= 100
        for x in items:
            used[x] += times
    assert used == {n: int(c) for n, c in enumerate(counts) if c}
    total = sum(n * int(c) for n, c in enumerate(counts))
    assert sum(t for _, t in patterns) <= -(-total // 100) + 1


def test_packing_round_trip(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = packing.pack(docs, keep_ids=True).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[r.doc_id, k // 4096, k, np.asarray(ids[k : k + 4096], "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096
    assert packing.pack(nothing).count() == 0


def test_encoder_looks_up_each_word_once_and_gives_the_tokenizers_ids(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tok, asked = Tokenizer.from_file(path), []
    rng, signs = random.Random(3), [*"abZé7_,.;'=-", "'s", "'ll", "\u0301", "\u0338", "\u030c", "J", " ", "\n", "\x1c", "\u00a0", "💡"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(3000)] + [None, "", "  ", "word, word. word; (word word"]
    for known in (packing.CACHED_WORDS, 50):  # in the second round most words are given up again
        monkeypatch.setattr(packing, "CACHED_WORDS", known)
        encoder = packing.Encoder(path)
        got = [bytes(x) for at in range(0, len(texts), 500) for x in encoder.ids_of(pa.array(texts[at : at + 500], pa.string()))]
        assert got == [np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]

    class Counting:
        def encode_batch_fast(self, words, **kw):
            asked.extend(words)
            return tok.encode_batch_fast(words, **kw)

    encoder = packing.Encoder(path)
    encoder.tokenizer = Counting()
    for _ in range(2):
        encoder.ids_of(pa.array(texts[-1:], pa.string()))
    assert sorted(asked) == sorted({"word", ",", ".", ";", "(word"})


# WARC
def test_archives(spark):
    pages = spark.createDataFrame([(1, "http://a/ b", "<p>x</p>", 1), (2, None, "<p>x</p>", 1), (3, "u", None, 1), (4, "u", "", 1), (5, "u", "é" * 400_000, 1), (5, "u", "é" * 400_000, 1), (None, "u", "<p>x</p>", 1), (None, "u", "lone", 1)], "page_id long, url string, html string, n int")
    rows = warc.archive(pages).collect()
    by = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows)
    assert by == Counter({(1, 8, "revisit", 2): 1, (2, 8, "response", None): 1, (3, 0, "revisit", 4): 1, (4, 0, "response", None): 1, (5, 800_000, "response", None): 1, (5, 800_000, "revisit", 5): 1, (None, 8, "revisit", 2): 1, (None, 4, "response", None): 1})
    assert {r.payload_digest for r in rows if r.payload_bytes == 8} == {warc.digest_of(b"<p>x</p>")}
    assert Counter(r.record_type for r in warc.archive(pages, min_bytes=9).collect()) == {"response": 7, "revisit": 1}
    assert warc.archive(pages.limit(0)).count() == 0


def test_records_across_chunks():
    import gzip
    import io

    data = b"".join(warc.record([("WARC-Type", "x")], bytes([i]) * (i * 37)) for i in range(50))
    for blob in (gzip.compress(data), gzip.compress(data[:3000]) + gzip.compress(data[3000:])):
        assert b"".join(warc.records_of(io.BytesIO(blob).read, 64)) == data
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(gzip.compress(data[:-9])).read))


# line dedup
def test_line_dedup(spark, docs, nothing):
    block = "\n".join(f"shared line number {i}" for i in range(60))
    df = spark.createDataFrame([(i, f"own {i} a\nown {i} b\n{block}\nend {i}", None, i) for i in range(4)], "doc_id long, text string, h string, pos int")
    out = {r.doc_id: r for r in linededup.dedup_lines(df, counts=True).collect()}
    assert out[0].n_removed_lines == 0 and out[0].text == df.where("doc_id = 0").first().text
    assert all(out[i].n_removed_lines > 40 for i in (1, 2, 3)) and all(f"own {i} a" in out[i].text for i in range(4))
    assert linededup.dedup_lines(df).columns == df.columns
    assert linededup.dedup_lines(nothing).count() == 0
    assert Counter((r.doc_id, r.text) for r in linededup.dedup_lines(docs).collect()) == Counter((r.doc_id, r.text) for r in docs.collect())


# SimHash
def test_golay_keys():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**23, 500)
    near = simhash.nearest(words)
    assert near.max() < 4096 and (np.bitwise_count(simhash._syndromes(simhash._leaders())) >= 0).all()
    x = rng.integers(-(2**63), 2**63 - 1, 2000)
    y = x.copy().view(np.uint64)
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    rx, kx = simhash.keys_of(x)
    ry, ky = simhash.keys_of(y.view(np.int64))
    have = set(zip(rx.tolist(), kx.tolist()))
    assert {r for r, k in zip(ry.tolist(), ky.tolist()) if (r, k) in have} == set(range(2000))


def _reach(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_like_brute_force(spark, docs, nothing, monkeypatch):
    rng = np.random.default_rng(2)
    base = " ".join(f"w{x}" for x in rng.integers(0, 500, 400))
    rows = [(i, " ".join(w if rng.random() > 0.004 else "zz" for w in base.split())) for i in range(60)] + [(100 + i, f"other {i} " * 9) for i in range(9)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    label = _reach(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    want = {r[0]: (rows[label[i]][0]) for i, r in enumerate(rows)}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "LOCAL", 1)  # cells of hot keys give the same
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want
    assert simhash.near_duplicates(docs).count() == docs.count() and simhash.near_duplicates(nothing).count() == 0


def test_simhash_contract_example():
    assert simhash.fingerprint(b"Solo") == __import__("xxhash").xxh64_intdigest(b"solo", 42) and simhash.fingerprint(b" \n") == 0


def test_components(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 200 + i) for i in range(50)] + [(7, 7)], "a long, b long")
    roots = {r.node: r.root for r in common.components(spark, edges).collect()}
    assert len({roots[i] for i in range(n + 1)}) == 1 and len({roots[200 + i] for i in range(50)} | {roots[100]}) == 1 and roots[0] != roots[100]


def test_shingle_groups(spark, docs, nothing):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 500)]
    rows = []
    for i, swaps in enumerate((0, 1, 3, 8, 60, 200)):
        words = list(base)
        for at in rng.choice(500, swaps, replace=False):
            words[at] = f"new{at}"
        rows.append((i, " ".join(words)))
    rows += [(10, rows[0][1].upper()), (11, None), (12, " ")]
    sets = [set(simjaccard.shingles((t or "").encode())[1].tolist()) for _, t in rows]
    close = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    label = _reach(len(rows), close)
    want = {r[0]: rows[label[i]][0] for i, r in enumerate(rows)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simjaccard.groups(df).collect()} == {d: c for d, c in want.items() if d not in (10, 12)}
    assert sorted(r.doc_id for r in simjaccard.keep_one(df).collect()) == sorted(set(want.values()))
    kept = simjaccard.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == {1: 1, 2: 1, None: 1, 4: 1, 6: 1}
    assert simjaccard.keep_one(nothing).count() == 0


def test_ids_with_several_texts(spark):
    a, b, c = ("one two three four five six seven " * 3, "eight nine ten eleven twelve thirteen", "entirely different words are in this one")
    rows = [(1, a, 7), (1, b, 7), (2, b, 7), (2, c, 7), (2, c, 7), (3, a, 7)]
    out = simjaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, a), (1, b), (2, c)]) and out.columns == ["doc_id", "text", "n"]


def test_merges_of_templates(spark):
    """Six templates with 150 copies each, two of a hundred words changed: nearly all merges that exact similarity makes."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(6):
        base = [f"b{k}w{x}" for x in rng.integers(0, 5000, 100)]
        for i in range(150):
            words = list(base)
            for at in rng.choice(100, 2, replace=False):
                words[at] = f"c{k}x{i}x{at}"
            rows.append((len(rows), " ".join(words)))
    sets = [set(simjaccard.shingles(t.encode())[1].tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i // 150 * 150, i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    want = sum(root(i) == i for i in range(len(rows)))
    got = simjaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert want <= got <= want + 0.05 * (len(rows) - want), (want, got)


def test_shingle_groups_in_boilerplate(spark):
    """Near duplicates among many siblings that share keys with them but are not similar enough."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 600)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(600, 22, replace=False):  # two of these: about 0.7
            words[at] = f"s{i}x{at}"
        rows.append(words)
    for i in range(60):  # about 0.85 to the sibling
        words = list(rows[i])
        for at in rng.choice(600, 10, replace=False):
            words[at] = f"c{i}x{at}"
        rows.append(words)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    sets = [set(simjaccard.shingles(t.encode())[1].tolist()) for _, t in rows]
    close = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    label = _reach(len(rows), close)
    got = {r.doc_id: r.component_id for r in simjaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: rows[label[i]][0] for i in range(len(rows))}
    assert sum(got[400 + i] == got[i] for i in range(60)) >= 57


def test_shingle_groups_over_blocks(spark, monkeypatch):
    """Candidates cut into many blocks give the groups that one block gives."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(200, int(rng.integers(1, 8)), replace=False):
            words[at] = f"s{i}x{at}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in simjaccard.groups(df).collect()}
    monkeypatch.setattr(simjaccard, "SET_SHINGLES", 4000)
    assert {r.doc_id: r.component_id for r in simjaccard.groups(df).collect()} == want
    sets = [set(simjaccard.shingles(t.encode())[1].tolist()) for _, t in rows]
    label = _reach(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert want == {i: label[i] for i in range(len(rows))}


def test_rows_travel_by_group_and_meet_as_by_key(spark, monkeypatch):
    """A row for each first codeword, a fifth of the keys, finds the pairs that keys find: also of large keys and shared groups."""
    rng = np.random.default_rng(8)
    words = rng.integers(0, 2**64, (300, simjaccard.WORDS64), dtype=np.uint64)
    words[120:] = words[rng.integers(0, 4, 180)]  # four families
    flips = rng.random((300, simjaccard.WORDS64, 64)) < np.repeat([0.0, 0.06], [120, 180])[:, None, None]
    words ^= np.packbits(flips, axis=2, bitorder="little").view("<u8")[..., 0]
    rows = [(i, *map(int, w)) for i, w in enumerate(words.view(np.int64))]
    own = spark.createDataFrame(rows, "uid long, " + ", ".join(f"w{j} long" for j in range(simjaccard.WORDS64)))
    by_key = {}
    for row, key in simjaccard.pair_keys(words):
        for r, k in zip(row.tolist(), key.tolist(), strict=True):
            by_key.setdefault(k, []).append(r)
    halves = lambda k: (words[:, -1], words[:, 3 if k >> 24 < 5 else 0])
    edges = {(a, b) for k, rs in by_key.items() for a in rs for b in rs if a < b and sum(int(h[a] ^ h[b]).bit_count() for h in halves(k)) <= simjaccard.SKETCH_BITS}
    want = _reach(300, lambda i, j: (j, i) in edges)
    assert 4 < len(set(want)) < 200

    def got():
        counts = simhash.large_keys(own, simjaccard._counted).withColumn("key", F.col("key").cast("int")).cache()
        pairs = {(min(r), max(r)) for r in simjaccard.candidate_pairs(own, counts).collect()}
        return _reach(300, lambda i, j: (j, i) in pairs), simjaccard.Grouping.of(counts)

    label, plain = got()
    assert label == want and not len(plain.large)
    batch = own.toArrow().combine_chunks().to_batches()[0]
    travelling = sum(b.num_rows for b in plain.rows(batch))
    assert 5 * travelling < sum(map(len, by_key.values())) and not any(b.num_rows for b in plain.large_rows(batch))
    monkeypatch.setattr(simhash, "LOCAL", 1)
    monkeypatch.setattr(simhash, "BLOCK", 5)
    monkeypatch.setattr(simjaccard, "GROUP_ROWS", 9)
    label, cut = got()
    assert label == want and len(cut.large) and cut.shares.max() > 1


def test_candidates_of_a_cell():
    rng = np.random.default_rng(1)
    n = 60
    sketch, more = ((rng.integers(0, 2**34, n) << 3).astype(np.int64) for _ in range(2))
    cell = np.repeat([0, 1], n // 2)
    near = lambda i, j: cell[i] == cell[j] and int(sketch[i] ^ sketch[j]).bit_count() + int(more[i] ^ more[j]).bit_count() <= simjaccard.SKETCH_BITS
    label = _reach(n, near)
    got = simjaccard.candidates(cell, np.arange(n), sketch, more).to_pydict()
    assert dict(zip(got["a"], got["b"], strict=True)) == {i: x for i, x in enumerate(label) if i != x}


def test_similar_sets_like_brute_force(monkeypatch):
    monkeypatch.setattr(simjaccard, "PAIRS", 50)
    monkeypatch.setattr(simjaccard, "LOOKUPS", 100)
    rng = np.random.default_rng(3)
    for trial in range(80):
        monkeypatch.setattr(simjaccard, "BITMAP", 64_000_000 if trial % 2 else 0)
        n = int(rng.integers(1, 50))
        bases = [rng.integers(0, 400, 40) for _ in range(3)]
        sets = []
        for _ in range(n):
            x = set(bases[rng.integers(0, 3)][: rng.integers(1, 41)].tolist())
            sets.append({y if rng.random() > 0.06 else int(rng.integers(0, 400)) for y in x} if rng.random() > 0.1 else set())
        cell = np.sort(rng.integers(0, 3, n))
        label = _reach(n, lambda i, j: cell[i] == cell[j] and bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
        flat = np.array([y for x in sets for y in sorted(x)], np.uint64)
        a, b = simjaccard.similar_within(cell, np.array([len(x) for x in sets]), flat)
        assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {i: x for i, x in enumerate(label) if i != x}, trial


# mixing
def test_mixing(spark, docs, nothing):
    rows = [(i, "a", "w " * 10) for i in range(300)] + [(1000 + i, "b", "w " * 10) for i in range(30)] + [(2000, None, "w w"), (2001, "c", None), (2002, "c", " ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.choose(df, max_repeats=3.0).collect()
    tokens = Counter()
    for r in out:
        tokens[r.source] += r["__copies"] * r["__tokens"]
    assert tokens["c"] == 0 and tokens["b"] > 300 and max(r["__copies"] for r in out) <= 4
    total = 3302
    weights = {r.source: r["__weight"] for r in out}
    for s in ("a", "b"):
        assert abs(tokens[s] - weights[s] * total) <= 10 + 1
    assert mixing.mix(df).columns == df.columns
    assert mixing.choose(docs).count() == docs.count() and mixing.mix(nothing).count() == 0 and mixing.choose(nothing).count() == 0
    with pytest.raises(ValueError, match="repeats every source"):
        mixing.choose(df, budget=10 * total, max_repeats=4.0)
    named = spark.createDataFrame([(1, None, "a b"), (2, "", "a b"), (3, "\x00", "a b"), (4, "=", "a b")], "doc_id long, source string, text string")
    assert [r["__weight"] for r in mixing.choose(named).collect()] == [0.25] * 4
    uniform = {r.source: r["__weight"] for r in mixing.choose(df.where("source in ('a', 'b')"), entropy=9.0, max_repeats=None).collect()}
    assert uniform["a"] == pytest.approx(0.5, abs=1e-4)


def test_mixing_by_longer_prefixes(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", "w " * (1 + i % 7)) for i in range(3000)], "doc_id long, source string, text string")
    want = sorted((r.doc_id, r["__copies"]) for r in mixing.choose(df, budget=9000).collect())
    monkeypatch.setattr(mixing, "PREFIX_ROWS", 1)
    monkeypatch.setattr(mixing, "LEVEL_DIGITS", 1)
    assert sorted((r.doc_id, r["__copies"]) for r in mixing.choose(df, budget=9000).collect()) == want


# PII
def test_spans(spark, docs, nothing):
    text = "é mail a@b.c_d@e.f, x@y@z.w 300.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 4111111111111112 +1 (555) 123-4567- +12"
    df = spark.createDataFrame([(1, text), (2, "9" * 40_000), (3, "a" * 60_000), (4, "pay 4111 1111 1111 1111.")], "doc_id long, text string")
    rows = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(df).collect()}
    assert [(k, text[a:b]) for k, a, b in rows[1]] == [("email", "a@b.c"), ("email", "_d@e.f"), ("email", "y@z.w"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("phone", "+1 (555) 123-4567")]
    assert rows[1] == _base(text) and rows[4] == [("card", 4, 23)]
    assert rows[2] == rows[3] == []
    assert pii.find(docs).count() == docs.count() and pii.find(nothing).count() == 0


def test_mixing_sources_without_ids(spark):
    rows = [(None, " ".join(f"w{i}" for _ in range(1 + i % 5)), "a") for i in range(300)] + [(i, "one two three", "b") for i in range(300)] + [(None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.choose(df, budget=1059, max_repeats=None).groupBy("source").agg(F.sum(F.col("__tokens") * F.col("__copies")).alias("used"), F.first("__weight").alias("w")).collect()
    assert all(r.w * 1059 - 6 <= r.used <= r.w * 1059 for r in out) and len(out) == 2


def test_contexts_vouch(spark):
    seeds = [(i, f"text before member id: user{i}@mail.com and more words") for i in range(6)]
    df = spark.createDataFrame([*seeds, (10, "some member id: ZX81-2233 thanks"), (11, "plain words of 20231 things"), (12, "x contact=+1 (555) 123-4567 y"), (13, "x contact=4111111111111111 y"), (14, "x contact=Z-90210-7 y")], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "found"] for r in pii.find(df).collect()}
    assert found[10] == [(16, 25)] and found[11] == [] and found[14] == [(10, 19)] and all(not found[i] for i in range(6))


def _base(text):
    """The contract's expressions, one after the other."""
    import re

    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, e, ok in kinds for m in re.finditer(e, text) if ok(m.group())]


def _found(texts):
    """What the graph of patterns and instances vouches for, by plain loops: (text number, start, end)."""
    import math

    import regex

    def name_of(core):
        m = regex.match(r"(?s)(?:.*[=:#])?+[^\p{L}\p{N}]*+", core)
        return m.group() if regex.search(r"^[^\p{L}\p{N}]|[=:#]", core) else ""

    def patterns(before, one, two):
        before, one, two = (before, one, two) if before else (one, two, None)
        return [] if not before else [before] if not one else [before, f"{one} {before}"]

    seeds, numbers, free, met, own = Counter(), Counter(), Counter(), [], {}
    for k, text in enumerate(texts):
        base = _base(text)
        words = [(m.start(), m.end(), m.group()) for m in regex.finditer(r"[^\x20\x09-\x0D]+", text)]
        at = lambda i: words[i][2].lower() if i >= 0 else ""
        for _, a, b in base:
            j = max(i for i, w in enumerate(words) if w[0] <= a)
            for p in patterns(text[words[j][0] : a].lower(), at(j - 1), at(j - 2)):
                seeds[p, text[a:b].lower()] += 1
        for i, (a, e, w) in enumerate(words):
            core = regex.sub(r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "", w)
            name = name_of(core)
            for p in patterns(name.lower(), at(i - 1), at(i - 2)):
                if sum(c.isascii() and c.isdigit() for c in w) >= pii.DIGITS:
                    numbers[p, w.lower()] += 1
                free[p] += 1
                if len(name) < len(core) and not any(x < e and a < y for _, x, y in base):
                    met.append((p, k, a + len(name), a + len(core), core[len(name) :].lower()))
    known = Counter()
    for (p, _), n in [*seeds.items(), *numbers.items()]:
        known[p] += n
    distinct = lambda c: Counter(p for p, _ in c)
    s, d = distinct(seeds), distinct(numbers)
    likely = {p for p in known if (s[p] >= pii.SUPPORT or s[p] + d[p] >= 2 * pii.SUPPORT) and known[p] >= pii.PRIOR * free[p]}
    graph = Counter({x: n for x, n in seeds.items() if x[0] in likely})
    seeded = {x for _, x in graph}
    for p, *_, x in met:
        graph[p, x] += p in likely
    graph = {x: n for x, n in graph.items() if n}
    mixed = lambda x: bool(regex.fullmatch("[a-z0-9_-]{16,}", x)) and len(regex.findall("[0-9]", x)) >= pii.DIGITS and len(regex.findall("[a-z]", x)) >= pii.DIGITS
    first = {x: 1.0 if x in seeded else pii.WEAK if mixed(x) else 0.0 for _, x in graph}
    belief = dict(first)
    for _ in range(pii.ROUNDS):
        sure = {}
        for p in likely:
            own = [(x, n) for (q, x), n in graph.items() if q == p]
            if own:
                c = sum(n * belief[x] for x, n in own) / sum(n for _, n in own)
                if c >= pii.CONFIDENT and sum(belief[x] >= pii.CONFIDENT for x, _ in own) >= pii.SUPPORT:
                    sure[p] = min(c, 0.999)
        belief = {x: max(first[x], 1 - math.prod(1 - sure.get(p, 0) for p, y in graph if y == x)) for x in belief}
    return {(k, a, b) for p, k, a, b, _ in met if p in sure}


def test_pii_like_brute_force(spark):
    rng = np.random.default_rng(12)
    pick = lambda *x: str(x[rng.integers(0, len(x))])
    texts = []
    for i in range(160):
        mail, phone, code = f"u{rng.integers(0, 40)}@mail.net", f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}", f"K{rng.integers(0, 30)}-{rng.integers(10, 9999)}"
        parts = [
            f"Contact me at: {pick(mail, code, phone)}.",
            f"member id {pick(mail, mail, code, 'jdoe', 'привет')}",
            f'ref="{pick(code, code, "10.0.0.1", mail)}"',
            f"room {rng.integers(1, 9999)} of the house",
            f"contact={pick(phone, code, mail)} и слово: {pick(code, 'дом')}",
            f"the {pick('a', 'b', '12345', mail)} word ({mail})",
            f'key = "{rng.integers(0, 1 << 60):016x}{rng.integers(0, 1 << 60):016x}" or path /{rng.integers(0, 1 << 60):016x} {pick("x", "y")}',
        ]
        texts.append("\n".join(parts[x] for x in rng.permutation(7)[: rng.integers(1, 7)]))
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [(x.kind, x.start, x.end) for x in r.base] for r in rows} == {i: _base(t) for i, t in enumerate(texts)}
    found = {(r.doc_id, x.start, x.end) for r in rows for x in r.spans if x.kind == "found"}
    assert found == _found(texts) and len(found) > 20


def test_a_shape_no_seed_has(spark):
    rng = np.random.default_rng(5)
    secret = lambda: f"{rng.integers(1 << 60, 1 << 62):016x}{rng.integers(1 << 60, 1 << 62):016x}ab12"
    texts = [f'words come first token = "{secret()}" and words after' for _ in range(8)] + [f"a file {secret()} among many files" for _ in range(2)] + [f"a file named{i} among many" for i in range(9)] + ["no token at all, only words"]
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(found[i] == [texts[i].split('"')[1]] for i in range(8)) and not any(found[i] for i in range(8, len(texts)))


def test_pii_in_very_long_texts(spark):
    import time

    rows = [(1, " ".join(str(i) for i in range(100_000, 400_000))), (2, " ".join(f"10.0.{i % 256}.{i % 100}" for i in range(50_000)))]
    began = time.time()
    got = {r.doc_id: len(r.base) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 50_000} and time.time() - began < 150


# suffix arrays
def _brute(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.setdefault(w, 1)
        rest = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(rest).hexdigest())
    return out


def test_suffix_dedup_like_brute_force(spark, docs, nothing, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(300)]
    para = lambda n: " ".join(rng.choice(words, n))
    shared = [para(40) for _ in range(5)]
    rows = [(i, f"{para(20)} {shared[i % 5]} {para(5)} é {shared[(i * 3) % 5][50:]}") for i in range(40)] + [(50, "ab" * 400), (51, "x\0" * 200), (52, None), (53, "short"), (54, "ab" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup(df).collect()}
    want = _brute(rows, 100)
    assert run() == want
    monkeypatch.setattr(suffixdedup, "TRIGGER_PHRASES", 2)  # windows of frequent triggers by hash
    assert run() == want
    assert suffixdedup.dedup(docs).count() == docs.count() and suffixdedup.dedup(nothing).count() == 0


def test_parse_steps(monkeypatch):
    data = np.random.default_rng(5).integers(97, 101, 5000).astype(np.uint8).tobytes()
    whole = suffixdedup.parse(data)
    monkeypatch.setattr(suffixdedup, "STEP", 333)
    assert all((a == b).all() for a, b in zip(whole, suffixdedup.parse(data)))


# language model
def test_gradients():
    rng = np.random.default_rng(6)
    words, tails = 40, 3
    p = {k: v if k == "edges" else v.astype(np.float64) for k, v in gru.init(np.sort(rng.integers(1, 100, words))[::-1], tails).items()}
    assert p["edges"][-1] == words and (np.diff(p["edges"])[-tails:] == 1).all()
    p["ww"] *= 20
    target = rng.integers(0, words, (5, 3))
    previous = np.vstack([[words] * 3, target[:-1]])
    fresh = np.zeros((5, 3), bool)
    fresh[0] = fresh[3, 1] = True
    previous[3, 1] = words
    on = np.ones((5, 3), bool)
    on[4, 2] = False
    run = lambda q: gru.gradients(q, target, previous, fresh, on, np.zeros((gru.HIDDEN, 3)))
    g = run(p)[0]
    scale = gru.WINDOW * gru.LANES
    for k in gru.MATRICES:
        whole = np.zeros_like(p[k])
        for rows, v in g[k]:
            whole[rows] += v
        for i in zip(*[x[:4] for x in np.nonzero(np.abs(whole) > np.abs(whole).max() / 3)], strict=True):
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][i] += 1e-4
            down[k][i] -= 1e-4
            assert -(run(up)[2] - run(down)[2]) / 2e-4 / scale == pytest.approx(float(whole[i]), rel=1e-3), (k, i)


def test_state_is_carried_and_reset():
    rng = np.random.default_rng(7)
    p = gru.init(rng.integers(1, 50, 300), 2)
    p["wc"] *= 50
    docs = [rng.integers(0, 300, n).astype(np.int32) for n in (1, 5, 40, 100, 33)]
    alone = [gru.log_likelihoods(p, [d])[0] for d in docs]
    assert gru.log_likelihoods(p, docs) == pytest.approx(alone, rel=1e-4)
    step = np.concatenate([gru.log_likelihoods(p, [docs[2][: k + 1]]) for k in range(40)])
    assert step[-1] == pytest.approx(alone[2], rel=1e-4) and (np.diff(step) < 0).all()


def test_long_documents_are_learnt_in_parts():
    docs = [np.arange(10, dtype=np.int32), np.arange(3, dtype=np.int32)]
    target, previous, document, fresh = gru.in_lanes(docs, 4, 99, 4)
    seen = sorted((int(d), int(q), int(t)) for t, q, d in zip(target.ravel(), previous.ravel(), document.ravel(), strict=True) if d >= 0)
    assert seen == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 5), (0, 5, 6), (0, 6, 7), (0, 7, 8), (0, 8, 9), (0, 99, 0), (1, 0, 1), (1, 1, 2), (1, 99, 0)]
    assert fresh.sum() == 4 and len(target) == 4


def test_entries_are_a_distribution(monkeypatch):
    """Over all known words and one unknown, probabilities add up to one, whatever the state."""
    monkeypatch.setattr(lmscore, "FEWEST_WORDS", 5)
    monkeypatch.setattr(lmscore, "MOST_WORDS", 5)
    counts = [(b"w%d" % i, c) for i, c in enumerate((90, 70, 50, 33, 20, 19, 17, 9, 8, 3, 1, 1))]
    rest = [2, 2, 1]  # known, but not in the table
    v = lmscore.Vocabulary(counts, sum(c for _, c in counts) + sum(rest), len(counts) + len(rest))
    p = gru.init(v.counts, v.tails)
    total = 0.0
    for w, _ in counts:
        r = v.ranks([w])
        total += np.exp(gru.log_likelihoods(p, [v.entry[r]])[0]) * 10 ** v.share_log[r][0]
    beyond = np.exp(gru.log_likelihoods(p, [v.entry[v.ranks([b"?"])]])[0])
    total += sum(beyond * (c + 1) / 10**v.beyond_log for c in [*rest, 0])
    assert total == pytest.approx(1, rel=1e-4)


def test_lm_scores(spark, docs, nothing, monkeypatch):
    import math

    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"W{x}" if x % 3 else f"w{x}" for x in rng.zipf(1.5, 60) % 4000)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lmscore, "TABLE_WORDS", 400)  # some words go through the join
    out = {r.doc_id: r for r in lmscore.score(df).collect()}
    tok = {i: [*t.lower().split(), None] for i, t in rows}
    c = Counter(w for i, ws in tok.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tok.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)
    assert lmscore.score(docs).count() == docs.count() and lmscore.score(nothing).count() == 0


def test_hot_keys_join(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, -1)], "k long, v long"))
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    out = common.keyed_join(left, right, "k", 20_001).collect()
    assert len(out) == 20_001 and {r.n for r in out if r.k == 7} == {6667 + 1 - (7 % 3 == 0)} and [r.n for r in out if r.k is None] == [None]
