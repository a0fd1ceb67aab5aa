"""Scene graphs of claims by rules, as column expressions.

A rule is a row of a table: an expression, which of its groups are the two ends
of a relation and how much of each counts, and what relation and kinds they
get.  All rules are matched over the whole claim; their ends, together with
marked and quoted words and named icons, are the nodes, one for each phrase in
the order of appearance, and edges refer to phrases until nodes are numbered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.graphs import CLASS, MAX_EDGES, MAX_NODES
from pairlens.functions.keys import squeeze, strip
from pairlens.functions.text import ATTRIBUTES, guess_kind, normal_query

# Words that are no mention, beginnings of what is none, attributes, icons, and words of place.
NO_MENTION = "the a an its their this that these those and or of to for".split()
NO_START = "which that and or from with whereas while thus".split()
MARKED = [*ATTRIBUTES, "black", "white", "trainable", "fixed"]
ICONS = ["fire symbol", "snowflake symbol", "snowflake", "red outlined arrow", "orange dotted arrow", "blue dotted arrow", "black downward arrow", "dotted arrow", "forward connector", "legend"]
PLACES = {
    "onto": "on", "on": "on", "inside": "in", "within": "in", "in": "in", "contains": "contains", "enclosed by": "contains",
    "to the left of": "left_of", "left of": "left_of", "to the right of": "right_of", "right of": "right_of",
    "above": "above", "over": "above", "below": "below", "beneath": "below", "under": "below",
}
# What ends a phrase, the word that a label belongs to, and the expressions of the rules.
CLAUSE, STOP, END = r"(?=(?:,|;|\.| whereas | while | and |$))", r"(?=[,.;]|$)", r"(?=(?:,|;|\.| whereas | while |$))"
OWNER = r"(legend|panel|block|region|box|title|caption|model|loss)\b[^.]*$"
LABEL = rf"(?:labeled|reads|titled|named)\s+(.{{2,60}}?){STOP}"
#: Unicode for words, spaces and cases; only a line feed ends a line.
FLAGS = "(?iuUd)"
#: Marks around a match and between its groups; texts that have them are searched group by group.
CUT, CELL = "\ue000", "\ue001"
WHOLE, LAST, FIRST = "whole", "last six words", "first six words"
SYMBOL, TOLD = "object, if it is a symbol or an arrow", "attribute or text"


@dataclass(frozen=True)
class Rule:
    expression: str
    a: tuple[int, str]
    b: tuple[int, str]
    relation: str | int  # or the group of a word of place
    kind_a: str | None = None
    kind_b: str | None = None
    also: tuple[int, ...] = ()  # groups that have to be mentions too
    needs: str = ""  # no text without this has a match


_BETWEEN = rf"(.{{3,40}}?)\s+between\s+(?:the |a )?(.{{3,30}}?)\s+and\s+(?:the |a )?(.{{3,30}}?){STOP}"
RULES = [
    Rule(rf"(.{{3,55}}?)\s+({'|'.join(PLACES)})\s+(?:the |a |an )?(.{{3,55}}?){CLAUSE}", (1, LAST), (3, FIRST), 2, SYMBOL, needs="|".join(PLACES)),
    Rule(rf"(?:arrow|connector)\b.{{0,40}}?\bfrom\s+(?:the |a )?(.{{3,40}}?)\s+(?:to|toward|into)\s+(?:the |a )?(.{{3,40}}?){STOP}", (1, WHOLE), (2, WHOLE), "connects", SYMBOL, needs="arrow|connector"),
    Rule(rf"points?\s+from\s+(?:the |a )?(.{{3,40}}?)\s+(?:to|toward)\s+(?:the |a )?(.{{3,40}}?){STOP}", (1, WHOLE), (2, WHOLE), "connects", SYMBOL, needs="point"),
    Rule(rf"(.{{3,50}}?)\s+on\s+(?:the |a )?.{{3,40}}?\s+identifies\s+(?:it|them|this)\s+as\s+(.{{2,40}}?){END}", (1, LAST), (2, WHOLE), "means", None, TOLD, needs="identifies"),
    Rule(rf"identifies\s+(?:it|them|this|the (.{{3,30}}?))\s+as\s+(.{{2,40}}?){STOP}", (1, WHOLE), (2, WHOLE), "means", None, TOLD, needs="identifies"),
    Rule(rf"(.{{3,40}}?)\s+(?:denotes|represents|means|named)\s+(.{{2,40}}?){STOP}", (1, LAST), (2, WHOLE), "means", None, TOLD, needs="denotes|represents|means|named"),
    Rule(_BETWEEN, (1, LAST), (2, WHOLE), "between", also=(3,), needs="between"),
    Rule(_BETWEEN, (1, LAST), (3, WHOLE), "between", also=(2,), needs="between"),
]


def mention(text: Column, part: str = WHOLE) -> Column:
    """What a stretch of text names: no joining word or article before it, nothing from its verb on."""
    m = F.regexp_replace(squeeze(text), r"^[ ,.;:)]+|[ ,.;:)]+$", "")
    m = F.regexp_replace(m, FLAGS + r"^(?:(?:whereas|while|thus|therefore|and|or|but|so)\s+)?(?:(?:the|a|an|its|their)\s+)?", "")
    m = strip(F.regexp_replace(m, r"(?sU)\s+(?:is|are|was|were|that|which|who|identifies|reads|labeled)\b.*$", ""))
    if part == WHOLE:
        return m
    words = F.split(m, " ")
    return F.array_join(F.slice(words, 1, 6) if part == FIRST else F.slice(words, F.greatest(F.size(words) - 5, F.lit(1)), F.lit(6)), " ")


def is_mention(m: Column) -> Column:
    low = F.lower(m)
    return (F.length(m) > 1) & (F.size(F.split(m, " ")) <= 8) & ~low.isin(NO_MENTION) & ~low.rlike(f"^(?:{'|'.join(NO_START)}) ")


def _kind(rule: str | None, m: Column) -> Column:
    none = F.lit(None).cast("string")
    if rule == SYMBOL:
        return F.when(F.lower(m).rlike("symbol|arrow"), "object").otherwise(none)
    if rule == TOLD:
        return F.when(F.lower(normal_query(m)).isin(MARKED), "attr").otherwise("text")
    return none


def _relation(a: Column, b: Column, rel: Column, kind_a: str | None, kind_b: str | None) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), rel.alias("rel"), _kind(kind_a, a).alias("ka"), _kind(kind_b, b).alias("kb"))


def _groups(body: str, rule: Rule) -> Column:
    """The groups of every match of a rule, in the order of the text: one pass writes them between marks, and none is made for a text without the rule's words."""
    groups = {"a": rule.a[0], "b": rule.b[0], **({"rel": rule.relation} if isinstance(rule.relation, int) else {}), **{f"also{g}": g for g in rule.also}}
    text, expression = F.col(body), FLAGS + rule.expression
    marked = F.regexp_replace(text, expression, CUT + CELL.join(f"${g}" for g in groups.values()) + CUT)
    cells = F.transform(F.filter(F.split(marked, CUT, -1), lambda x, i: i % 2 == 1), lambda x: F.split(x, CELL, -1))
    once = F.transform(cells, lambda x: F.struct(*[F.get(x, i).alias(n) for i, n in enumerate(groups)]))
    each = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(expression), F.lit(g)).alias(n) for n, g in groups.items()])
    none = F.array().cast("array<struct<" + ", ".join(f"{n}: string" for n in groups) + ">>")
    return F.when(~text.rlike(FLAGS + f"(?:{rule.needs})"), none).when(text.rlike(f"[{CUT}{CELL}]"), each).otherwise(once)


def _found(body: str, rule: Rule) -> Column:
    """The relations of one rule, in the order of the text."""
    parts = _groups(body, rule)
    places = F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv])
    # the second rule of meaning strips marks around what is meant
    end = (lambda m: F.regexp_replace(m, r'^[*" ]+|[*" ]+$', "")) if rule.kind_b == TOLD else (lambda m: m)

    def relation(x: Column) -> Column:
        rel = F.try_element_at(places, F.lower(x["rel"])) if isinstance(rule.relation, int) else F.lit(rule.relation)
        return _relation(mention(x["a"], rule.a[1]), end(mention(x["b"], rule.b[1])), rel, rule.kind_a, rule.kind_b)

    kept = F.filter(parts, lambda x: _all([is_mention(mention(x[f"also{g}"])) for g in rule.also]))
    return F.filter(F.transform(kept, relation), lambda r: is_mention(r["a"]) & is_mention(r["b"]))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _labels(body: str) -> Column:
    """Labels, of the first owner that the fifty characters before them name."""
    text = F.col(body)
    whole, between = F.regexp_extract_all(text, F.lit(FLAGS + LABEL), F.lit(0)), F.split(text, FLAGS + LABEL, -1)
    length = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    parts = F.transform(F.regexp_extract_all(text, F.lit(FLAGS + LABEL), F.lit(1)), lambda c, i: F.struct(c.alias("c"), (length(between, i + 1) + length(whole, i)).alias("at")))

    def relation(x: Column) -> Column:
        start = F.greatest(x["at"] - 50, F.lit(0))
        owner = F.regexp_extract(F.substring(text, start + 1, x["at"] - start), FLAGS + OWNER, 1)
        label = mention(F.regexp_replace(x["c"], r"^[:* ]+|[:* ]+$", ""))
        return _relation(F.when(owner == "", "label").otherwise(owner), label, F.lit("labeled"), None, TOLD)

    return F.filter(F.transform(parts, relation), lambda r: is_mention(r["b"]))


def with_graphs(df: DataFrame, claim: str = "claim", out: str = "graph") -> DataFrame:
    """df with out, the graph (nodes and edges) that the rules find in a claim; a null claim has an empty one."""
    text = strip(F.coalesce(F.col(claim), F.lit("")))
    node = lambda raw, kind: F.struct(raw.alias("raw"), kind.alias("kind"))
    df = df.withColumn("__text", text)
    df = df.withColumn("__body", F.translate(F.regexp_replace("__text", r"(?d)\*\*(.+?)\*\*", "$1"), "“”", '""'))
    df = df.withColumn("__rel", F.concat(*[_found("__body", r) for r in RULES[:6]], _labels("__body"), _between("__body")))
    inner = F.transform(F.regexp_extract_all("__text", F.lit(r"(?d)\*\*(.+?)\*\*"), F.lit(1)), lambda x: F.regexp_replace(strip(x), '^["“”]+|["“”]+$', ""))
    is_note = lambda x: x.contains(" - ") | x.startswith("🔥") | x.startswith("❄")
    marked = F.transform(inner, lambda x: node(x, F.when(~is_note(x) & F.lower(normal_query(x)).isin(MARKED), "attr").otherwise("text")))
    quoted = F.transform(F.regexp_extract_all("__text", F.lit('(?d)["“](.+?)["”]'), F.lit(1)), strip)
    quoted = F.transform(F.filter(quoted, lambda x: F.size(F.split(squeeze(x), " ")) <= 12), lambda x: node(x, F.lit("text")))
    icons = F.transform(F.filter(F.array(*[F.lit(i) for i in ICONS]), lambda i: F.contains(F.lower(F.col("__text")), i)), lambda i: node(i, F.lit("object")))
    ends = F.flatten(F.transform("__rel", lambda r: F.array(node(r["a"], r["ka"]), node(r["b"], r["kb"]))))
    df = df.withColumn("__raw", F.transform(F.concat(marked, quoted, icons, ends), lambda x: F.struct(normal_query(x["raw"]).alias("query"), x["kind"].alias("kind"))))
    usable = lambda q: (F.length(q) >= 2) & ~F.lower(q).isin(NO_MENTION)
    named = F.transform(F.filter("__raw", lambda x: usable(x["query"])), lambda x: F.struct(x["query"].alias("query"), F.coalesce(x["kind"], guess_kind(x["query"])).alias("kind"), F.lower(x["query"]).alias("low")))
    df = df.withColumn("__named", named).withColumn("__lows", F.col("__named")["low"])
    df = df.withColumn("__nodes", F.filter("__named", lambda x, i: F.array_position("__lows", x["low"]) == i + 1))
    low = lambda m: F.lower(normal_query(m))
    edges = F.array_distinct(F.transform("__rel", lambda r: F.struct(low(r["a"]).alias("a"), low(r["b"]).alias("b"), r["rel"].alias("rel"))))
    df = df.withColumn("__edges", F.filter(edges, lambda e: (e["a"] != e["b"]) & F.array_contains("__lows", e["a"]) & F.array_contains("__lows", e["b"])))
    used = lambda x: F.exists("__edges", lambda e: (e["a"] == x["low"]) | (e["b"] == x["low"]))
    few = F.slice(F.filter("__nodes", lambda x: used(x) | (x["kind"] != "region")), 1, MAX_NODES)
    df = df.withColumn("__listed", F.when(F.size("__nodes") > MAX_NODES, few).otherwise(F.col("__nodes"))).withColumn("__names", F.col("__listed")["low"])
    number = lambda at: F.concat(F.lit("n"), at.cast("string"))
    classes = F.create_map(*[F.lit(x) for kv in CLASS.items() for x in kv])
    nodes = F.transform("__listed", lambda x, i: F.struct(number(i + 1).alias("id"), x["query"].alias("query"), x["kind"].alias("kind")))
    whole = F.filter("__edges", lambda e: F.array_contains("__names", e["a"]) & F.array_contains("__names", e["b"]))
    numbered = F.transform(whole, lambda e: F.struct(number(F.array_position("__names", e["a"])).alias("src"), number(F.array_position("__names", e["b"])).alias("dst"), e["rel"].alias("rel"), F.element_at(classes, e["rel"]).alias("class")))
    df = df.withColumn(out, F.struct(nodes.alias("nodes"), F.slice(numbered, 1, MAX_EDGES).alias("edges")))
    return df.drop("__text", "__body", "__rel", "__raw", "__named", "__lows", "__nodes", "__edges", "__listed", "__names")


def _between(body: str) -> Column:
    """What stands between two others, an edge to either, side by side."""
    one, other = (_found(body, r) for r in RULES[6:])
    return F.flatten(F.transform(F.arrays_zip(one.alias("x"), other.alias("y")), lambda p: F.array(p["x"], p["y"])))


def claim_edges(df: DataFrame, claim: str = "claim") -> DataFrame:
    """A row for each edge of a claim's graph, nodes by phrase: the columns of df, src, rel, dst and class."""
    keep = df.columns
    rows = with_graphs(df, claim, "__graph").withColumn("__by", F.map_from_entries(F.transform("__graph.nodes", lambda n: F.struct(n["id"], n["query"]))))
    rows = rows.select(*keep, "__by", F.explode("__graph.edges").alias("__e"))
    return rows.select(*keep, F.element_at("__by", F.col("__e.src")).alias("src"), F.col("__e.rel").alias("rel"), F.element_at("__by", F.col("__e.dst")).alias("dst"), F.col("__e.class").alias("class"))


def claim_examples(figures: DataFrame, claims: str = "claims", key: str = "figure_key") -> DataFrame:
    """A row for each claim, numbered from 1, with an id of its own and its graph."""
    rows = figures.select("*", F.posexplode(claims).alias("at", "claim")).drop(claims)
    rows = rows.withColumn("claim_id", (F.col("at") + 1).cast("int")).drop("at")
    return with_graphs(rows.withColumn("id", F.concat_ws("#", F.col(key), F.col("claim_id").cast("string"))))
