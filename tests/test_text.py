import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.functions import claimgraph, features, graphs, jsontools, keys, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("r")).first().r


def test_pair_groups(spark):
    f = lambda x, **k: one(spark, x, lambda c: keys.pair_group(c, **k))
    assert f("ml_orig/document_7/figure_2") == f("ml_l2_fail/document_7/figure_2") == "ml/document_7/figure_2"
    assert f("juri_orig/document_7/figure_2") != f("ml_orig/document_7/figure_2")
    assert f("a_orig") == "a" and f("a_orig/b", short="keep") == "a_orig/b"
    with pytest.raises(Exception, match="too few segments"):
        f("a_orig/b", short="raise")


def test_fallbacks(spark):
    df = spark.createDataFrame([("", "  block\n", None)], "c string, b string, p string")
    r = df.select(keys.premise_of(F.col("c"), F.col("b"), F.col("p")).alias("p"), keys.caption_of(F.col("c"), F.col("p"), F.col("b")).alias("c")).first()
    assert (r.p, r.c) == ("block", "block")


@pytest.mark.parametrize(("value", "want"), [
    ("", []), ("no numbers", ["no numbers"]), ("1. a\n2. b", ["a", "b"]), ("head\n 1. a b\n c\n2. d", ["a b\n c", "d"]), ("1.\n2. x", ["1.", "x"]), ("1. ", ["1."]),
])
def test_claims(spark, value, want):
    assert one(spark, value, text.claims) == want


@pytest.mark.parametrize(("value", "want"), [("Figure 3b", ("3", "b", False)), ("the graphical abstract", (None, None, True)), ("figure 12", ("12", None, False)), ("table 1", (None, None, False))])
def test_figure_refs(spark, value, want):
    assert tuple(one(spark, value, text.figure_ref)) == want


def test_normalisation(spark):
    assert one(spark, "  Straße ﬁne ", text.normalize_text) == "strasse fine"
    assert one(spark, "Figurе 2", text.normalize_reference) == "figure 2"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_words_like_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", text.words(F.col("x")).alias("w"), text.token_set(F.col("x")).alias("t"), keys.strip(F.col("x")).alias("s"))
    for r in df.collect():
        assert r.w == re.findall(r"[A-Za-z0-9']+", r.x)


def test_features(spark):
    row = spark.createDataFrame([(0.9, 0.25, 0.5, 0.7, 0.1, 0.1, 0.1, 1.0)], "score_sem double, score_struct double, score_obj double, p_byt double, p_video double, p_graph double, p_scheme double, has_numbers double")
    r = features.add_features(row).first()
    assert r.sem_margin == pytest.approx(0.4) and r.ocr_numeric_consistency == 0.25 and 0 <= r.router_entropy <= 1 and r.router_margin == pytest.approx(0.6)
    assert len(features.names()) == 37 and len(features.DERIVED) == 11


@pytest.mark.parametrize(("raw", "verdict", "error"), [
    ('{"verdict": "Pass."}', "pass", None), ("```json\n{'verdict': 'regenerate'}\n```", "regenerate", None), ('x {"a": "}{", "verdict": "PASS"} y', "pass", None),
    ("[1]", None, "no JSON object"), ('{"verdict": "maybe"}', None, "invalid verdict 'maybe'"), ('{"correct things": 3, "verdict": "pass"}', None, "correct_things must be an array"), (None, None, "no JSON object"),
])
def test_answers(spark, raw, verdict, error):
    r = one(spark, raw, jsontools.parse_answer)
    assert (r.parsed and r.parsed.verdict, r.error) == (verdict, error)


def test_canonical_hash(spark):
    flat = spark.range(1).select(jsontools.canonical_hash(b=F.lit(1), a=F.lit("é")).alias("h")).first().h
    assert flat == one(spark, '{"b": 1, "a": "é"}', jsontools.canonical_hash_of_json)


def graphs_of(spark, claims):
    rows = claimgraph.with_graphs(spark.createDataFrame(list(enumerate(claims)), "i int, claim string")).orderBy("i").collect()
    out = []
    for r in rows:
        query = {n.id: n.query for n in r.graph.nodes}
        out.append(([(n.query, n.kind) for n in r.graph.nodes], [(query[e.src], e.rel, query[e.dst], e["class"]) for e in r.graph.edges]))
    return out


def test_graphs_of_claims(spark):
    claims = [
        "A fire symbol on the ControlNet identifies it as trained, whereas a snowflake symbol on the Base DiT identifies it as frozen.",
        "the blue arrow points from the Sampler to the Critic. The end",
        'The legend labeled "Loss terms" is above the Encoder block, and the Decoder below it.',
        "The Fusion block between the Encoder and the Decoder, identifies the Critic Head as trainable.",
        "**Frozen** module and **Note - this** with “quoted words” here",
        "Panel A reads: input image. Panel B is titled output. red denotes frozen weights",
        None, "", "nothing that a rule knows",
        ". ".join(f"Node{i} above Place{i}" for i in range(20)),
    ]
    got = graphs_of(spark, claims)
    assert {("fire symbol", "means", "trained", "sem"), ("fire symbol", "on", "ControlNet", "geo"), ("snowflake symbol", "means", "frozen", "sem"), ("snowflake symbol", "on", "Base DiT", "geo")} <= set(got[0][1])
    assert ("trained", "attr") in got[0][0] and ("fire symbol", "object") in got[0][0] and ("Base DiT", "region") in got[0][0]
    assert ("Sampler", "connects", "Critic", "geo") in got[1][1]
    assert any(e[1] == "labeled" and e[0].lower() == "legend" for e in got[2][1])
    assert {("Fusion block", "between", "Encoder", "geo"), ("Fusion block", "between", "Decoder", "geo"), ("Critic Head", "means", "trainable", "sem")} <= set(got[3][1])
    assert [n for n in got[4][0][:2]] == [("Frozen", "attr"), ("Note - this", "text")] and ("quoted words", "text") in got[4][0]
    assert ("Panel", "labeled", "output", "sem") in got[5][1] and any(e[1:3] == ("means", "frozen weights") for e in got[5][1])
    assert got[6] == got[7] == got[8] == ([], [])
    assert len(got[9][0]) == 12 and all(rel == "above" for _, rel, _, _ in got[9][1])
    edges = claimgraph.claim_edges(spark.createDataFrame([(1, claims[1])], "id int, claim string")).collect()
    assert [tuple(e)[2:] for e in edges] == [x for x in got[1][1]]


def test_graphs_in_sql(spark):
    graphs.register(spark)
    spark.createDataFrame([('{"nodes": [{"id": "a", "query": "Encoder"}, {"id": "b", "query": "Loss"}], "edges": [{"src": "a", "dst": "b", "rel": "on"}]}',), ("none",)], "answer string").createOrReplaceTempView("answers")
    got = spark.sql("SELECT e.* FROM (SELECT to_json(parse_graph(answer)) AS g FROM answers) s, LATERAL graph_edges(s.g) e").collect()
    assert [tuple(r) for r in got] == [("Encoder", "on", "Loss", "geo")]


def test_canonical_graphs():
    twice = {"nodes": [{"id": "a", "query": "X1"}, {"id": "b", "query": "X1"}, {"id": "c", "query": "Y1"}], "edges": [{"src": "b", "dst": "c", "rel": "on"}, {"src": "a", "dst": "c", "rel": "on"}, {"src": "a", "dst": "c", "rel": "on"}, {"src": "a", "dst": "a", "rel": "on"}, {"src": "a", "dst": "c", "rel": "near"}]}
    assert len(graphs.canonical(twice)["edges"]) == 1 and graphs.canonical(twice)["nodes"][1] == {"id": "n2", "query": "Y1", "kind": "region"}
    many = {"nodes": [{"id": f"x{i}", "query": f"Node{i}"} for i in range(13)], "edges": [{"src": f"x{i}", "dst": f"x{j}", "rel": "on"} for i in range(5) for j in range(5) if i != j]}
    g = graphs.canonical(many)
    assert len(g["nodes"]) == 5 and len(g["edges"]) == 16
    assert graphs.parse_graph('```json\n{"nodes": []}\n```') == {"nodes": [], "edges": []} and graphs.parse_graph("none") is None


def test_generation_scores(spark):
    schema = f"predicted {graphs.GRAPH}, gold {graphs.GRAPH}"
    g = ([("n1", "A", "region"), ("n2", "b", "text")], [("n1", "n2", "on", "geo")])
    p = ([("n1", "A", "object")], [])
    rows = {r.part: r for r in graphs.generation_scores(spark.createDataFrame([(g, g), (p, g), (None, g)], schema)).collect()}
    assert (rows["query"].tp, rows["query"].fp, rows["query"].fn) == (3, 0, 3) and (rows["node"].tp, rows["node"].fp) == (2, 1)
    assert (rows["edge"].tp, rows["edge"].fn) == (1, 2) and rows["query"].json_ok == pytest.approx(2 / 3) and rows["query"].kind_agree == pytest.approx(2 / 3)


def test_claim_graph_reads_whole_texts(spark, tmp_path):
    from pairlens.plans import queries

    rows = [(1, 0, "words of a turn, more than twenty of them; the blue arrow points from the Sampler to the Critic. The end"), (1, 1, "short"), (2, 0, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in queries.claim_graph(spark, str(tmp_path)).collect()}
    assert "Sampler" in got[1, 0].graph and "Critic" in got[1, 0].graph and len(got) == 3
    want = graphs_of(spark, [f"A fire symbol on the Encoder identifies it as trained, while the {t} is to the left of the Decoder." for *_, t in rows[:2]])
    for (conv, turn, _), (nodes, edges) in zip(rows, want):
        assert (got[conv, turn].nodes, got[conv, turn].edges) == (len(nodes), len(edges))


def test_record_keys_of_texts_with_escapes(spark, tmp_path):
    import hashlib
    import json

    from pairlens.plans import queries

    texts = ['a "quoted" word', "back\\slash", "tab\there", "return\rhere", "line\nbreak", 'all "\\\t\r\n\\"', "é 💡 / <&>", ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    record = lambda i, t: {"caption": t, "image": f"{i}.png", "model": "m", "protocol": "p", "sample_id": str(i)}
    want = {i: hashlib.sha256(json.dumps(record(i, t), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r.item_id: r.record_key for r in queries.record_keys(spark, str(tmp_path)).collect()} == want


def test_groups_of_a_rule_come_from_one_pass(spark, tmp_path):
    """As from a search for each group, also where a text has the marks, and rows of one file are spread."""
    from pairlens.plans import queries

    texts = ["\ue000 The Encoder\ue001 is above the Decoder, the arrow from the A box to the B box.", "The red arrow from the Encoder to the Decoder, on the left.", "A fire symbol on the Encoder identifies it as trained; the Loss means cost.", "the Fusion block between the Encoder and the Decoder, above the Critic",
             "identifies the Critic Head as frozen, identifies them as fixed.", "points from the A box to the B box;  x is above the Encoder, below the Loss", "nothing here", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = 0
    for rule in claimgraph.RULES:
        for n, g in (("a", rule.a[0]), ("b", rule.b[0])):
            rows = df.select(F.transform(claimgraph._groups("t", rule), lambda x: x[n]).alias("got"), F.regexp_extract_all("t", F.lit(claimgraph.FLAGS + rule.expression), F.lit(g)).alias("want")).collect()  # noqa: B023
            assert [r.got for r in rows] == [r.want for r in rows]
            found += sum(len(r.want) for r in rows)
    assert found > 20
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.claim_graph(spark, str(tmp_path)).rdd.getNumPartitions() > 1
