"""Text features, tokens, claims, references and prompt templates as column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.keys import squeeze, strip

# Function words that the text features leave out.
STOP = """
the a an and or but in on at to for of with by from as is are was were be been this that these those it its we our
they their figure
""".split()
# Words of action.
ACTIONS = """
show shows shown compare compares increase decrease train trained generate predict evaluate measure compute learn
optimize converge improve reduce apply propose
""".split()
# Endings that count as a verb's.
VERB_ENDINGS = ["ed", "ing", "es", "ize", "ise", "ate"]
# Words that say nothing about what a figure shows.
LABEL_STOP = """
the and for with that this from are was were been have has had not but all can our their into over under than then
when which while also using used use based show shown shows figure fig table results method methods model models data
each both between after before through during where what how et al vs via per see left right top bottom panel panels
image images plot plots chart graph graphs schematic diagram illustration
""".split()
# Words that are no objects.
NOUN_STOP = """
the and for with that this from are was were been have has had not but all can our their into over under than then
when which while also using used use based show shown shows figure fig table results method methods model models data
each both between after before through during where what how thus further assess compared performed presented
demonstrates demonstrate investigate investigated study studies analysis approach approaches paper section following
corresponding respectively including via per left right top bottom panel panels image images more here text other same
such these those very high low new old first second third total number
""".split()
NOUN_VERBS = """
did does done make made take took give gave get got see saw find found reveal reveals increase decrease train trained
generate predict evaluate measure compute learn optimize apply propose combine extend provide provides differs differ
""".split()
NOUN_ENDINGS = ["ing", "ized", "ised", "ated"]
# The objects of the prompt templates.
OBJECTS = """
person, bicycle, car, motorcycle, airplane, bus, train, truck, boat, traffic light, fire hydrant, stop sign,
parking meter, bench, bird, cat, dog, horse, sheep, cow, elephant, bear, zebra, giraffe, backpack, umbrella, handbag,
tie, suitcase, frisbee, skis, snowboard, sports ball, kite, baseball bat, baseball glove, skateboard, surfboard,
tennis racket, bottle, wine glass, cup, fork, knife, spoon, bowl, banana, apple, sandwich, orange, broccoli, carrot,
hot dog, pizza, donut, cake, chair, couch, potted plant, bed, dining table, toilet, tv, laptop, computer mouse,
tv remote, computer keyboard, cell phone, microwave, oven, toaster, sink, refrigerator, book, clock, vase, scissors,
teddy bear, hair drier, toothbrush
"""
OBJECTS = [" ".join(x.split()) for x in OBJECTS.split(",")]
COLORS = ["red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "black", "white"]
COUNTS = {"two": 2, "three": 3, "four": 4}
PLACES = ["left of", "right of", "above", "below"]
# Attributes and object words of scene graphs.
ATTRIBUTES = "trained frozen dashed dotted solid red blue orange purple yellow green gray grey".split()
OBJECT_WORDS = ["symbol", "arrow", "icon", "snowflake", "fire", "legend"]
#: What counts as a digit: decimals of every script, and the digits that are written raised, lowered or circled.
DIGIT = r"[\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468]"

WORDS = r"[A-Za-z0-9']+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def _ends(c: Column, endings: list[str]) -> Column:
    return reduce(Column.__or__, [c.endswith(e) for e in endings])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")


TEXT_META = ["len_words", "len_chars", "num_digits", "num_verbs", "num_nouns", "num_entities", "has_numbers", "has_actions", "sentence_complexity", "stopword_ratio", "unique_word_ratio"]


def text_meta(text: Column, w: Column, lower: Column) -> dict[str, Column]:
    """Eleven features by name; w and lower: columns with words(text), and those in lower case."""
    n = F.size(w)
    count = lambda f: F.size(F.filter(lower, f)).cast("double")
    digits = F.regexp_count(text, F.lit(DIGIT)).cast("double")
    return {
        "len_words": n.cast("double"),
        "len_chars": F.length(text).cast("double"),
        "num_digits": digits,
        "num_verbs": count(lambda x: x.isin(ACTIONS) | _ends(x, VERB_ENDINGS)),
        "num_nouns": count(lambda x: ~x.isin(STOP) & (F.length(x) > 3) & ~x.isin(ACTIONS)),
        "num_entities": F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U:\b)[A-Z][a-zA-Z0-9\-]{2,}(?U:\b)"), F.lit(0)))).cast("double"),
        "has_numbers": (digits > 0).cast("double"),
        "has_actions": F.exists(lower, lambda x: x.isin(ACTIONS)).cast("double"),
        "sentence_complexity": _ratio(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), n),
        "stopword_ratio": _ratio(F.size(F.filter(lower, lambda x: x.isin(STOP))), n),
        "unique_word_ratio": _ratio(F.size(F.array_distinct(lower)), n),
    }


def with_text_meta(df, text: str = "text"):
    """df with the eleven features of a text column; null counts as empty."""
    df = df.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumn("__w", words(F.col("__t"))).withColumn("__l", F.transform("__w", F.lower))
    return df.withColumns(text_meta(F.col("__t"), F.col("__w"), F.col("__l"))).drop("__t", "__w", "__l")


def label_tokens(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[a-zA-Z][a-zA-Z0-9\-]{1,}"), F.lit(0)), F.lower)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(x) for x in LABEL_STOP]))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{Nd}+(?:[.]\p{Nd}+)?"), F.lit(0)))


def alignment(text_tokens: Column, other_tokens: Column, text_numbers: Column, other_numbers: Column, other: Column) -> Column:
    """struct(score, confidence) of a text against the text read from its image; arrays as label_tokens and numbers give them."""
    a, b, na, nb = F.size(text_tokens), F.size(other_tokens), F.size(text_numbers), F.size(other_numbers)
    jaccard = F.when((a > 0) & (b > 0), F.size(F.array_intersect(text_tokens, other_tokens)) / F.size(F.array_union(text_tokens, other_tokens))).otherwise(F.lit(0.0))
    score = F.when(na > 0, 0.5 * jaccard + 0.5 * F.size(F.array_intersect(text_numbers, other_numbers)) / na).otherwise(jaccard)
    confidence = 0.35 + 0.65 * F.least(F.lit(1.0), (a + na) / 8.0) * F.least(F.lit(1.0), (b + nb) / 12.0)
    empty = strip(F.coalesce(other, F.lit(""))) == ""
    return F.struct(F.when(empty, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"), F.when(empty, 0.0).otherwise(confidence).alias("confidence"))


def is_bad_noun(word: Column) -> Column:
    return word.isin(NOUN_STOP) | word.isin(NOUN_VERBS) | (F.length(word) < 3) | (_ends(word, NOUN_ENDINGS) & (F.length(word) > 5))


def with_top_nouns(df: DataFrame, text: str, out: str = "nouns", most: int = 12) -> DataFrame:
    """df with out: distinct content words of a text column by length, capitals, hyphens and digits; the first occurrence of a word counts.

    Each array that is used twice is a column of its own, so that it is made once.
    """
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9\-]{2,}"), F.lit(0))
    placed = F.transform(raw, lambda x, i: F.struct(F.lower(x).alias("w"), i.alias("i"), x.rlike("^[A-Z]").alias("capital")))
    df = df.withColumn("__sorted", F.array_sort(placed))  # by word, then place
    firsts = F.filter("__sorted", lambda x, i: (i == 0) | (x["w"] != F.get("__sorted", i - 1)["w"]))
    df = df.withColumn("__kept", F.filter(firsts, lambda x: ~is_bad_noun(x["w"])))
    scored = F.transform("__kept", lambda x: F.struct((-(F.length(x["w"]) + F.when(x["capital"], 3).otherwise(0) + F.when(x["w"].rlike("[-0-9]"), 2).otherwise(0))).alias("s"), x["w"].alias("w")))
    df = df.withColumn("__best", F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: x["w"]))
    return df.withColumn(out, F.when(F.size("__best") > 0, F.col("__best")).otherwise(F.array(F.lit("diagram"), F.lit("scene")))).drop("__sorted", "__kept", "__best")


def claims(text: Column) -> Column:
    """The items of a numbered list; without numbers the text is one claim, and an empty one has none."""
    t = strip(F.coalesce(text, F.lit("")))
    mark = r"(?m)^\s*(\p{Nd}+\.)\s+"
    marks, parts = F.regexp_extract_all(t, F.lit(mark), F.lit(1)), F.split(t, mark, -1)
    bodies = F.slice(parts, F.lit(2), F.size(parts))
    # an item without a body is its number
    items = F.zip_with(marks, bodies, lambda m, b: F.coalesce(F.nullif(strip(b), F.lit("")), m))
    return F.when(t == "", F.array().cast("array<string>")).when(F.size(marks) > 0, items).otherwise(F.array(t))


def figure_ref(reference: Column) -> Column:
    """struct(number, panel, graphical): the figure that a reference names."""
    r = F.translate(F.lower(strip(F.coalesce(reference, F.lit("")))), "асеорху", "aceopxy")
    graphical = r.contains("graphical") & r.contains("abstract")
    part = lambda i: F.when(~graphical, F.nullif(F.regexp_extract(r, r"figure\s*([0-9]+)\s*([a-z])?", i), F.lit("")))
    return F.struct(part(1).alias("number"), part(2).alias("panel"), graphical.alias("graphical"))


def normalize_text(text: Column | str) -> Column:
    """NFKC, case folding and single spaces; Spark has no built-in for either of the first two."""

    def run(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))

    return F.pandas_udf(run, "string")(text)


def normalize_reference(text: Column | str) -> Column:
    """Lower case, NFKC, and Latin letters for the Cyrillic ones that look like them."""

    def run(texts: pd.Series) -> pd.Series:
        import unicodedata

        twins = str.maketrans("асеорху", "aceopxy")
        return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x.strip().lower()).translate(twins))

    return F.pandas_udf(run, "string")(text)


def lower_space(text: Column) -> Column:
    """The normalisation that is native: lower case and single spaces."""
    return squeeze(F.lower(F.coalesce(text, F.lit(""))))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)))


def _forms() -> dict[str, str]:
    """Each plural by its object; a longer object's plural wins."""
    out = {}
    for x in sorted(OBJECTS, key=len):
        out |= {x + "s": x, x + "es": x} | ({x[:-1] + "ies": x} if x.endswith("y") else {})
    return out | {x: x for x in OBJECTS}


def object_phrase(text: Column) -> Column:
    """The object that a phrase names, in the singular; null if it names none."""
    known = F.create_map(*[F.lit(v) for kv in sorted(_forms().items()) for v in kv])
    return F.try_element_at(known, F.regexp_replace(strip(text), r"^(?:a|an)\s+", ""))


def prompt_template(caption: Column) -> Column:
    """struct(tag, objects, detail, reason) of an "a photo of ..." prompt; reason is supported where it is one of the five templates."""
    core = strip(F.lower(F.regexp_extract(strip(F.coalesce(caption, F.lit(""))), r"(?is)^a photo of ([^\n]+?)[.]?$", 1)))
    row = lambda tag, objects, detail, reason: F.struct(F.lit(tag).cast("string").alias("tag"), objects.cast("array<string>").alias("objects"), detail.cast("string").alias("detail"), F.lit(reason).alias("reason"))
    no = F.array()
    none = F.lit(None)
    out = F.when(core == "", row(None, no, none, "not_a_simple_photo_prompt"))
    for place in PLACES:
        subject, reference = object_phrase(F.substring_index(core, f" {place} ", 1)), object_phrase(F.regexp_extract(core, f"^.*? {place} (.*)$", 1))
        good = subject.isNotNull() & reference.isNotNull() & (subject != reference)
        out = out.when(core.contains(f" {place} ") & good, row("position", F.array(reference, subject), F.lit(place), "supported")).when(core.contains(f" {place} "), row(None, no, none, "unsupported_position_objects"))
    number = F.regexp_extract(core, r"^(two|three|four)\s+(.+)$", 1)
    counted = object_phrase(F.regexp_extract(core, r"^(two|three|four)\s+(.+)$", 2))
    amount = F.create_map(*[F.lit(v) for k, n in COUNTS.items() for v in (k, str(n))])
    out = out.when((number != "") & counted.isNotNull(), row("counting", F.array(counted), F.try_element_at(amount, number), "supported")).when(number != "", row(None, no, none, "unsupported_count_object"))
    parts = F.split(core, r"\s+and\s+")
    one, two = object_phrase(F.get(parts, 0)), object_phrase(F.get(parts, 1))
    out = out.when((F.size(parts) == 2) & one.isNotNull() & two.isNotNull() & (one != two), row("two_object", F.array(one, two), none, "supported")).when(F.size(parts) == 2, row(None, no, none, "unsupported_two_object_prompt")).when(F.size(parts) > 2, row(None, no, none, "more_than_two_objects"))
    shade = rf"^(?:a|an)\s+({'|'.join(sorted(COLORS))})\s+(.+)$"
    colour, coloured = F.regexp_extract(core, shade, 1), object_phrase(F.regexp_extract(core, shade, 2))
    out = out.when((colour != "") & coloured.isNotNull(), row("colors", F.array(coloured), colour, "supported")).when(colour != "", row(None, no, none, "unsupported_colored_object"))
    single = object_phrase(core)
    return out.when(single.isNotNull(), row("single_object", F.array(single), none, "supported")).otherwise(row(None, no, none, "not_in_geneval_coco_vocabulary"))


def normal_query(query: Column) -> Column:
    """A node's phrase: without mark-up and brackets, at most 8 words and 80 characters."""
    q = F.regexp_replace(F.coalesce(query, F.lit("")), r"\*+", "")
    q = F.translate(q, "“”’", "\"\"'")
    q = F.regexp_replace(q, r"\\[a-zA-Z]+", " ")
    q = F.regexp_replace(q, r"[{}$\\()\[\]]", " ")
    q = F.regexp_replace(squeeze(q), r"""^[ \t"'`.,;:]+|[ \t"'`.,;:]+$""", "")
    return F.substring(F.array_join(F.slice(F.split(q, " "), 1, 8), " "), 1, 80)


def guess_kind(query: Column) -> Column:
    low = F.lower(query)
    return (
        F.when(low.isin(ATTRIBUTES), "attr")
        .when(low.rlike("|".join(OBJECT_WORDS)), "object")
        .when((F.size(F.split(query, " ")) >= 4) | F.substring(query, 1, 1).rlike(r"^\p{Ll}"), "text")
        .otherwise("region")
    )
