"""Nested values as flat ones, by their schema."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves(schema: T.StructType, prefix: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    """Path and type of every field that is no struct, in order, structs of any depth entered."""
    for f in schema.fields:
        path = (*prefix, f.name)
        if isinstance(f.dataType, T.StructType):
            yield from leaves(f.dataType, path)
        else:
            yield path, f.dataType


def at(path: tuple[str, ...]) -> Column:
    out = F.col(f"`{path[0]}`")
    for name in path[1:]:
        out = out.getField(name)
    return out


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.BooleanType))


def _names(paths: list[tuple[str, ...]], separator: str, skip: tuple[str, ...]) -> list[str]:
    names = [separator.join(x for x in p if x not in skip) for p in paths]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"fields of one name: {sorted(twice)}")
    return names


def flatten(rows: DataFrame, separator: str = "_", skip: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """A column for each leaf, named by its path; numbers and truth values are doubles, other leaves stay as they are.

    skip: levels that names leave out; keep: columns that are passed on untouched.
    """
    found = [(p, t) for p, t in leaves(rows.schema) if p[0] not in keep]
    names = _names([p for p, _ in found], separator, skip)
    cols = [(at(p).cast("double") if _numeric(t) else at(p)).alias(n) for (p, t), n in zip(found, names, strict=True)]
    return rows.select(*[F.col(f"`{k}`") for k in keep], *cols)


def unpivot(rows: DataFrame, separator: str = "_", skip: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, name and value: a row for each numeric leaf, and for each entry of a map of numbers or of structs, under the map's path and the entry's key.

    A leaf that is null has a row with a null value; a null map has none.
    """
    def entry(path: list[str], inner: tuple[str, ...]):
        def one(e: Column) -> Column:
            value = e["value"]
            for name in inner:
                value = value.getField(name)
            names = [F.lit(x) for x in path], [F.lit(x) for x in inner if x not in skip]
            return F.struct(F.concat_ws(separator, *names[0], e["key"].cast("string"), *names[1]).alias("name"), value.cast("double").alias("value"))

        return one

    parts = []
    for p, t in leaves(rows.schema):
        if p[0] in keep:
            continue
        path = [x for x in p if x not in skip]
        if _numeric(t):
            parts.append(F.array(F.struct(F.lit(separator.join(path)).alias("name"), at(p).cast("double").alias("value"))))
        elif isinstance(t, T.MapType):
            inner = [q for q, kind in leaves(t.valueType) if _numeric(kind)] if isinstance(t.valueType, T.StructType) else [()] if _numeric(t.valueType) else []
            parts += [F.transform(F.map_entries(at(p)), entry(path, q)) for q in inner]
    empty = F.array().cast("array<struct<name:string,value:double>>")
    every = F.concat(*[F.coalesce(x, empty) for x in parts]) if parts else empty
    return rows.select(*[F.col(f"`{k}`") for k in keep], F.inline(every))
