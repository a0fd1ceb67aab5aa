"""Personal data by seed patterns and bootstrapped contexts, in DataFrame operations only.

Seed entities (e-mail and IP addresses, card and phone numbers) are matched by
regular expressions.  The one or two words before them are lexical patterns,
and so is a name before "=" or ":" within a token; candidates are patterns of
SUPPORT different seeds or more, or of twice as many different numbers.
Whatever follows a candidate anywhere in the corpus is an instance of it,
whatever its shape.  In the bipartite graph of patterns and instances, a
pattern's confidence is the share of what follows it that is believed to be an
identifier, and an instance is believed as far as any of its patterns is (noisy
or), a long token that mixes letters and digits a little from the start; a few
rounds of this let confident patterns vouch for identifiers that no seed
expression knows.  Instances that confident patterns have are spans of the
kind "found".

Positions are running sums of the lengths of a text's pieces, added up by
doubling, so that a text of n matches costs n log n however long it is.

Nulls and edge cases: a null text is an empty one, with no spans; texts are
taken whole, of any length (the expressions are possessive and so need neither
stack nor repeated scans); rows equal in doc_id and text get equal rows and
count as often as they occur; a null doc_id stays null; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import SPACE, WORD, Tables, ids_and_text, keyed_join

#: The contract's expressions, in possessive form; look-behinds keep long runs from being tried at every character.
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(EXPRESSIONS)
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A letter or digit, and what is neither.
LETTER, MARK = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
#: Digits of a number that counts for a pattern no seed has.
DIGITS = 4
CONFIDENT, SUPPORT, ROUNDS = 0.5, 2, 3
#: Long tokens that mix letters and digits are believed so far without any seed: a pattern that only they follow is confident.
MIXED, WEAK = "^[a-z0-9_-]{16,}$", 0.6
#: Seeds and numbers are at least this share of what follows a pattern that may become confident.
PRIOR = 0.1
BROADCAST_ROWS = 100_000
SPAN = "struct<kind:string,start:int,end:int,text:string>"


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The values up to each place of an array, combined by step, which is associative, in as many passes as its size has bits."""

    def double(now: Column, k: Column) -> Column:
        by = F.pow(F.lit(2), k).cast("int")
        rest = F.size(now) - by
        return F.concat(F.slice(now, F.lit(1), by), F.zip_with(F.slice(now, F.lit(1), rest), F.slice(now, by + 1, rest), lambda a, b: step(a, b)))

    passes = lambda v: F.slice(F.expr("sequence(0, 31)"), F.lit(1), F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int"))
    return _let(values, lambda v: F.aggregate(passes(v), v, double))


def matches(text: Column, expression: str, kind: str) -> Column:
    """An array of (kind, start, end, text) of all matches, in code points."""
    none = F.array().cast(f"array<{SPAN}>")

    def spans(found: Column) -> Column:
        before = F.slice(F.split(text, expression, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(before, found, lambda b, m: F.length(b) + F.length(m)))
        return F.zip_with(ends, found, lambda e, m: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("text")))

    return _let(F.regexp_extract_all(text, F.lit(expression), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(none))


def _kept(kind: str) -> Column:
    return F.filter(kind, lambda x: _valid(kind, x["text"]))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), text and spans: (kind, start, end, text) of the seeds, by kind and then start."""
    out = ids_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    for kind, expression in EXPRESSIONS.items():
        out = out.withColumn(kind, matches(F.col("text"), expression, kind))
    kept = [_kept(kind) for kind in KINDS]
    return out.select("doc_id", F.xxhash64("text").alias("hash"), "text", F.concat(*kept).alias("spans"))


def with_words(base: DataFrame) -> DataFrame:
    """base as base_spans has it, with words: (start, end, text, taken) of each word, taken if a seed overlaps it,
    and seeds: (kind, start, end, text, at), at being the number, from 1 on, of the word it begins in.
    """
    most = F.lit(2**31 - 1)
    plain = matches(F.col("text"), WORD, "")
    event = lambda x, seed: F.struct(x["start"].alias("start"), F.lit(seed).alias("seed"), x["end"].alias("end"), x["kind"].alias("kind"), x["text"].alias("text"))
    more = [c for c in base.columns if c not in ("doc_id", "hash", "text", "spans")]
    out = base.withColumn("some", F.size("spans") > 0)
    words = F.transform(matches(F.col("text"), WORD, ""), lambda x: event(x, 0))
    out = out.withColumn("events", F.when(F.col("some"), F.array_sort(F.concat(words, F.transform("spans", lambda x: event(x, 1))))))
    seeds = lambda other, f: F.transform("events", lambda e: F.when(e["seed"] == 1, f(e)).otherwise(other))
    out = out.withColumn("until", running(seeds(F.lit(0), lambda e: e["end"]), F.greatest))
    out = out.withColumn("next", F.reverse(running(F.reverse(seeds(most, lambda e: e["start"])), F.least)))
    out = out.withColumn("at", running(F.transform("events", lambda e: 1 - e["seed"])))
    out = out.withColumn("events", F.arrays_zip("events", "until", "next", "at"))
    e = lambda x: x["events"]
    own = F.transform(F.filter("events", lambda x: e(x)["seed"] == 0), lambda x: F.struct(e(x)["start"].alias("start"), e(x)["end"].alias("end"), e(x)["text"].alias("text"), ((x["until"] > e(x)["start"]) | (x["next"] < e(x)["end"])).alias("taken")))
    free = F.transform(plain, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(False).alias("taken")))
    seeded = F.transform(F.filter("events", lambda x: e(x)["seed"] == 1), lambda x: F.struct(e(x)["kind"].alias("kind"), e(x)["start"].alias("start"), e(x)["end"].alias("end"), e(x)["text"].alias("text"), x["at"].alias("at")))
    out = out.select("doc_id", "hash", *more, "some", F.when(F.col("some"), own).otherwise(free).alias("words"), F.when(F.col("some"), seeded).alias("seeds"))
    return out.withColumn("texts", F.col("words")["text"]).withColumn("starts", F.col("words")["start"])  # to be had by number at once


def _word(i: Column) -> Column:
    """The text of the word number i, from 1 on; empty where there is none."""
    return F.when(i >= 1, F.lower(F.get("texts", i - 1))).otherwise(F.lit(""))


def _patterns(before: Column, i: Column) -> Column:
    """What stands before: within word number i, or, if nothing does, the word before it; and this with the word before that."""
    one = F.when(before != "", before).otherwise(_word(i - 1))
    two = F.when(before != "", _word(i - 1)).otherwise(_word(i - 2))
    return F.when(one == "", F.array().cast("array<string>")).when(two == "", F.array(one)).otherwise(F.array(one, F.concat_ws(" ", two, one)))


def _core(word: Column) -> Column:
    """A word without marks at its end."""
    return F.when(word.rlike(f"{LETTER}$"), word).otherwise(F.regexp_replace(word, f"(?<={LETTER}){MARK}++$", ""))


def _name(core: Column) -> Column:
    """Of what _core gives: a name up to the last "=", ":" or "#", and marks after it."""
    return F.when(core.rlike(f"^{MARK}|[=:#]"), F.regexp_extract(core, f"(?s)^(?:.*[=:#])?+{MARK}*+", 0)).otherwise(F.lit(""))


def following(base: DataFrame) -> DataFrame:
    """A row for each word, in small letters: doc_id, hash, i (its number, from 0 on), word, and prev and prev2, what stands before it as _patterns has it."""
    words = base.select("doc_id", "hash", F.filter(F.split(F.lower("text"), f"[{SPACE}]+", -1), lambda x: x != "").alias("w")).where("size(w) > 0")
    none = F.array(F.lit(""))
    ones = F.concat(none, F.slice("w", F.lit(1), F.size("w") - 1))
    words = words.withColumn("b", ones)
    twos = F.concat(none, F.slice("b", F.lit(1), F.size("b") - 1))
    rows = words.select("doc_id", "hash", F.posexplode(F.arrays_zip(twos.alias("b2"), F.col("b").alias("b1"), F.col("w").alias("word"))).alias("i", "x")).select("doc_id", "hash", "i", "x.*")
    rows = rows.withColumn("name", F.when(F.col("word").rlike(f"^{MARK}|[=:#]"), _name(_core(F.col("word")))).otherwise(F.lit("")))
    named = F.col("name") != ""
    return rows.select("doc_id", "hash", "i", "word", F.when(named, F.col("name")).otherwise(F.col("b1")).alias("prev"), F.when(named, F.col("b1")).otherwise(F.col("b2")).alias("prev2"))


def seed_occurrences(words: DataFrame) -> DataFrame:
    """A row for each seed and pattern: pattern, instance."""
    inside = lambda s: F.lower(F.substring(F.get("texts", s["at"] - 1), F.lit(1), s["start"] - F.get("starts", s["at"] - 1)))
    full = F.transform("seeds", lambda s: F.struct(F.lower(s["text"]).alias("instance"), _patterns(inside(s), s["at"]).alias("patterns")))
    return words.where("some").select(F.explode(full).alias("s")).select("s.instance", F.explode("s.patterns").alias("pattern"))


def _few(df: DataFrame) -> DataFrame:
    """A hint to broadcast df where it is counted and small; otherwise it is shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _meeting(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows of following, one for each of their patterns that wanted has.

    Where wanted is too large to broadcast, words are shuffled by what stands before them, but the most frequent of that are broadcast all the same.
    """
    two = F.concat_ws(" ", "prev2", "prev")
    if wanted.count() <= BROADCAST_ROWS:
        hint = F.broadcast(wanted.select("pattern", F.element_at(F.split("pattern", " "), -1).alias("last")))
        return rows.join(hint, (F.col("prev") == F.col("last")) & ((F.col("pattern") == F.col("prev")) | (F.col("pattern") == two))).drop("last")
    own = rows.withColumn("pattern", F.explode(F.array("prev", two)))
    return keyed_join(own, wanted.select("pattern", "n"), "pattern", wanted.agg(F.sum("n")).first()[0], how="inner", spread=F.xxhash64("doc_id", "i")).drop("n")


def _hits(base: DataFrame, met: DataFrame) -> DataFrame:
    """met: doc_id, hash, i and pattern.  A row for each word that no seed overlaps, and pattern: doc_id, hash, pattern, start, end and instance of its core."""
    by = met.groupBy(F.col("doc_id").alias("d"), F.col("hash").alias("h")).agg(F.collect_set(F.struct("i", "pattern")).alias("met"))
    rows = base.join(by, base["doc_id"].eqNullSafe(by["d"]) & (base["hash"] == by["h"])).drop("d", "h")
    rows = with_words(rows).select("doc_id", "hash", "words", F.explode(F.transform("met", lambda m: F.struct(m["pattern"].alias("pattern"), F.get(F.col("words"), m["i"]).alias("w")))).alias("m"))
    rows = rows.select("doc_id", "hash", "m.pattern", "m.w.*").where("not taken").withColumn("core", _core(F.col("text")))
    rows = rows.withColumn("name", _name(F.col("core"))).where("length(name) < length(core)")
    return rows.select("doc_id", "hash", "pattern", (F.col("start") + F.length("name")).alias("start"), (F.col("start") + F.length("core")).alias("end"), F.lower(F.expr("substring(core, length(name) + 1)")).alias("instance"))


def _mixed(instance: Column) -> Column:
    """A long token of DIGITS digits and as many letters at least; instances are in small letters."""
    many = lambda kind: F.length(F.regexp_replace(instance, f"[^{kind}]", "")) >= DIGITS
    return instance.rlike(MIXED) & many("0-9") & many("a-z")


def discover(base: DataFrame, t: Tables) -> DataFrame:
    """(doc_id, hash, start, end) of the spans that confident patterns vouch for."""
    seeds = t.write(seed_occurrences(with_words(base.where("size(spans) > 0"))).groupBy("pattern", "instance").agg(F.count("*").alias("n")), "seeds")
    numbers = following(base.where(F.col("text").rlike("[0-9]"))).where(F.col("word").rlike("[0-9]") & (F.length(F.regexp_replace("word", "[^0-9]", "")) >= DIGITS))
    numbers = numbers.select(F.explode(F.array("prev", F.concat_ws(" ", "prev2", "prev"))).alias("pattern"), F.col("word").alias("instance")).where("pattern != ''")
    known = seeds.withColumn("seed", F.lit(1)).unionByName(numbers.groupBy("pattern", "instance").agg(F.count("*").alias("n")).withColumn("seed", F.lit(0)))
    strong = known.groupBy("pattern").agg(F.sum("seed").alias("seeds"), F.count("*").alias("all"), F.sum("n").alias("n"))
    strong = t.write(strong.where((F.col("seeds") >= SUPPORT) | (F.col("all") >= 2 * SUPPORT)).select("pattern", "n"), "patterns")
    met = t.write(_meeting(following(base), strong).select("doc_id", "hash", "i", "pattern"), "met")
    likely = strong.join(met.groupBy("pattern").agg(F.count("*").alias("words")), "pattern", "left")
    likely = t.write(likely.where(F.col("n") >= PRIOR * F.coalesce("words", F.lit(0))).select("pattern", "n"), "likely")
    hits = t.write(_hits(base, met.join(_few(likely.select("pattern")), "pattern")), "hits")
    edges = hits.groupBy("pattern", "instance").agg(F.count("*").alias("n")).withColumn("seed", F.when(_mixed(F.col("instance")), WEAK).otherwise(0.0))
    edges = edges.unionByName(seeds.join(likely.select("pattern"), "pattern", "left_semi").withColumn("seed", F.lit(1.0)))
    graph = t.write(edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n"), F.max("seed").alias("seed")), "graph")
    belief = t.write(graph.groupBy("instance").agg(F.max("seed").alias("belief")), "belief")
    for _ in range(ROUNDS):
        weighed = graph.join(belief, "instance")
        believed = F.sum((F.col("belief") >= CONFIDENT).cast("int"))
        pattern = weighed.groupBy("pattern").agg((F.sum(F.col("n") * F.col("belief")) / F.sum("n")).alias("c"), believed.alias("support"))
        pattern = pattern.where((F.col("support") >= SUPPORT) & (F.col("c") >= CONFIDENT)).withColumn("c", F.least("c", F.lit(0.999)))
        pattern = t.write(pattern.select("pattern", "c"), "confident")
        noisy = graph.join(_few(pattern), "pattern", "left").groupBy("instance").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(1 - F.coalesce("c", F.lit(0.0)))))).alias("b"))
        old = belief
        belief = t.write(noisy.select("instance", F.greatest("seed", "b").alias("belief")), "belief")
        t.drop(old)
    out = t.write(hits.join(_few(pattern), "pattern", "left_semi").select("doc_id", "hash", "start", "end").distinct(), "found")
    t.drop(seeds, strong, met, likely, hits, graph, belief)
    return out


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans: (kind, start, end), the seeds first and then what was found."""
    t = Tables(docs.sparkSession)
    base = t.write(base_spans(docs), "base")
    span = "struct<kind:string,start:int,end:int>"
    new = discover(base, t).groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(F.struct(F.lit("found").alias("kind"), "start", "end"))).alias("new"))
    slim = base.select("doc_id", "hash", F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("base"))
    new = new.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "new")
    joined = slim.join(new, slim["doc_id"].eqNullSafe(new["d"]) & (slim["hash"] == new["h"]), "left")
    return joined.select("doc_id", "base", F.concat("base", F.coalesce("new", F.array().cast(f"array<{span}>"))).alias("spans"))


def _listed(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
