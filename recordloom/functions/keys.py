"""Addressing nested fields by path, and sets of fields by pattern.

Paths: ``a/b`` enters an object, ``#2`` an array, ``\\/`` is a slash in a name.
A leading ``@`` matches loosely: exactly, then by prefix, then by pattern, both
without regard to case. Everything is resolved against the schema, once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parts_of(path: str) -> list[str]:
    return [p.replace("\\/", "/") for p in re.split(r"(?<!\\)/", path)]


def name_of(path: str) -> str:
    """Column name for the value at a path."""
    return path.removeprefix("@").replace("/", "_").replace("#", "")


def _loose(wanted: str, names: list[str]) -> str:
    if wanted in names:
        return wanted
    low = wanted.lower()
    by_prefix = sorted(n for n in names if n.lower().startswith(low))
    if by_prefix:
        return by_prefix[-1]
    try:
        by_pattern = sorted(n for n in names if re.search(wanted, n, re.IGNORECASE))
    except re.error:
        by_pattern = []
    return by_pattern[-1] if by_pattern else wanted


def lookup(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """Column and type at a path, None where the schema has no such field."""
    loose = path.startswith("@")
    column: Column | None = None
    kind: T.DataType = schema
    for part in parts_of(path.removeprefix("@")):
        if isinstance(kind, T.StructType):
            name = _loose(part, kind.names) if loose else part
            if name not in kind.names:
                return None
            column = F.col(f"`{name}`") if column is None else column.getField(name)
            kind = kind[name].dataType
        elif isinstance(kind, T.ArrayType):
            if not re.fullmatch(r"#\d+", part):
                return None
            column, kind = F.get(column, int(part[1:])), kind.elementType
        elif isinstance(kind, T.MapType):
            column, kind = column.getItem(part), kind.valueType
        else:
            return None
    return column, kind


def value(df: DataFrame, path: str) -> Column:
    """The value at a path, null where it is missing."""
    found = lookup(df.schema, path)
    return found[0] if found else F.lit(None).cast("string")


def kind_of(df: DataFrame, path: str) -> T.DataType:
    found = lookup(df.schema, path)
    return found[1] if found else T.StringType()


def assign(df: DataFrame, path: str, new: Column) -> DataFrame:
    """Write a value at a path; missing objects on the way are made."""
    first, *rest = parts_of(path.removeprefix("@"))

    def put(at: Column | None, kind: T.DataType | None, left: list[str]) -> Column:
        if not left:
            return new
        if isinstance(kind, T.StructType):
            inner = kind[left[0]].dataType if left[0] in kind.names else None
            below = at.getField(left[0]) if inner is not None else None
            made = [
                (put(below, inner, left[1:]) if n == left[0] else at.getField(n)).alias(n) for n in kind.names
            ]
            if left[0] not in kind.names:
                made.append(put(None, None, left[1:]).alias(left[0]))
            return F.struct(*made)
        if isinstance(kind, T.ArrayType) and re.fullmatch(r"#\d+", left[0]):
            place = int(left[0][1:])
            return F.transform(at, lambda x, i: F.when(i == place, put(x, kind.elementType, left[1:])).otherwise(x))
        return F.struct(put(None, None, left[1:]).alias(left[0]))

    known = first in df.columns
    start = F.col(f"`{first}`") if known else None
    return df.withColumn(first, put(start, df.schema[first].dataType if known else None, rest))


def _leaves(kind: T.DataType, path: list[str], most: int | None, inner: bool):
    """(path, is a scalar) of the fields down to a depth, parents before children."""
    for field in kind.fields:
        here = [*path, field.name]
        nested = isinstance(field.dataType, T.StructType)
        if not nested or inner:
            yield here
        if nested and (most is None or len(here) < most):
            yield from _leaves(field.dataType, here, most, inner)


def resolve(schema: T.StructType, group: str) -> list[str]:
    """Paths that a comma-separated list of paths and patterns names.

    A pattern is ``!regex!`` with options behind it: ``d=N`` depth, ``f`` every
    depth, ``rr`` objects too, ``s`` sorted. Without options it matches
    top-level scalars.
    """
    found: list[str] = []
    for member in group.split(","):
        if not member.startswith("!"):
            found.append(member)
            continue
        at = member.find("!", 1)
        while at > 0 and member[at - 1] == "\\":
            at = member.find("!", at + 1)
        if at < 0:
            raise ValueError(f"the pattern {member!r} has no end")
        pattern, options = member[1:at].replace("\\!", "!"), {}
        for option in filter(None, member[at + 1 :].split("!")):
            name, _, given = option.partition("=")
            name = {"depth": "d", "full": "f", "returnrefs": "rr", "sort": "s"}.get(name, name)
            if name not in ("d", "f", "rr", "s") or name in options:
                raise ValueError(f"bad option {option!r} in {member!r}")
            options[name] = given
        most = None if "f" in options else int(options.get("d") or 1)
        paths = ["/".join(p) for p in _leaves(schema, [], most, "rr" in options)]
        paths = [p for p in paths if re.search(pattern, p)]
        found += sorted(paths) if "s" in options else paths
    return list(dict.fromkeys(found))
