"""Canonical JSON, content hashes, and tolerant parsing of model answers."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PARSED = "struct<parsed:struct<correct_things:array<string>,mistake_things:array<string>,critical_things:array<string>,verdict:string>,error:string>"
# The lists of an answer, and the other spellings of their keys.
LISTS = {"correct_things": ["correct_things", "correct things", "correct_thinks"], "mistake_things": ["mistake_things", "mistake things", "mistake_thinks"], "critical_things": ["critical_things", "critical things", "critical_thinks"]}
VERDICTS = ("pass", "regenerate")


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys, for flat rows of strings, integers and booleans; nulls are written."""
    quoted = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(quoted, 256)


def canonical_hash_of_json(text: Column | str) -> Column:
    """The same for any JSON value, nested or with numbers and escapes of all kinds."""

    def run(texts: pd.Series) -> pd.Series:
        import hashlib

        return texts.map(lambda x: None if x is None else hashlib.sha256(json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest())

    return F.pandas_udf(run, "string")(text)


def record_key(sample_id: Column, image: Column, caption: Column, model: Column, protocol: Column) -> Column:
    return canonical_hash(sample_id=sample_id, image=image, caption=caption, model=model, protocol=protocol)


def balanced_object(text: str) -> str | None:
    """The first {...} with balanced braces, strings and escapes apart."""
    at = text.find("{")
    while at >= 0:
        depth, inside, skip = 0, False, False
        for end, ch in enumerate(text[at:], at + 1):
            if skip:
                skip = False
            elif inside:
                skip, inside = ch == "\\", ch != '"'
            elif ch == '"':
                inside = True
            elif ch in "{}":
                depth += 1 if ch == "{" else -1
                if not depth:
                    return text[at:end]
        at = text.find("{", at + 1)
    return None


def _candidates(text: str):
    import re

    yield text.strip()
    for m in re.finditer(r"```(?:json)?\s*(.*?)```", text, re.I | re.S):
        yield m[1].strip()
    if (found := balanced_object(text)) is not None:
        yield found


def _value(text: str) -> tuple[bool, Any]:
    import ast

    for read in (json.loads, ast.literal_eval):
        try:
            return True, read(text)
        except Exception:  # what the two raise differs by version
            continue
    return False, None


def read_answer(text: str | None) -> dict:
    """An answer's lists and verdict, or why it has none."""
    value = next((v for ok, v in map(_value, _candidates(text or "")) if ok), None)
    if not isinstance(value, dict):
        return {"parsed": None, "error": "no JSON object"}
    fields = {str(k).strip().lower(): v for k, v in value.items()}
    out: dict = {}
    for name, spellings in LISTS.items():
        got = next((fields[s] for s in spellings if s in fields), None) or []
        if isinstance(got, str):
            got = [got]
        if not isinstance(got, list):
            return {"parsed": None, "error": f"{name} must be an array"}
        out[name] = [s for s in (str(x).strip() for x in got) if s]
    out["verdict"] = str(fields.get("verdict", "")).strip().lower().rstrip(".")
    if out["verdict"] not in VERDICTS:
        return {"parsed": None, "error": f"invalid verdict {out['verdict']!r}"}
    return {"parsed": out, "error": None}


def parse_answer(text: Column | str) -> Column:
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_answer(x) for x in texts], columns=["parsed", "error"])

    return F.pandas_udf(run, PARSED)(text)


def score_value(text: Column) -> Column:
    """The first number of a JSON list of any depth, or of a number; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"^[\[\s]*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)", 1), F.lit("")).try_cast("double")
