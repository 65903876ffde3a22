"""Operators that change the shape of records: explode, flatten, pivot."""

from __future__ import annotations

import re
from collections.abc import Sequence
from inspect import signature

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import coerce
from recordloom.functions.keys import kind_of, name_of, resolve, value
from recordloom.operators.ordering import sort_columns


def split_out(df: DataFrame, old: str, delimiter: str, new: str) -> DataFrame:
    """One record for each part of a text field; ``/re/`` or ``/re/i`` is a pattern. Null gives none."""
    found = re.fullmatch(r"/(.*)/(i?)", delimiter)
    pattern = (("(?i)" if found[2] else "") + found[1]) if found else rf"\Q{delimiter}\E"
    return df.withColumn(new, F.explode(F.split(coerce.text(value(df, old), kind_of(df, old)), pattern)))


def unarray(df: DataFrame, old: str, new: str) -> DataFrame:
    """One record for each element of an array; other values give none."""
    return df.withColumn(new, F.explode(value(df, old)))


def unhash(df: DataFrame, old: str, key: str, val: str | None = None) -> DataFrame:
    """One record for each entry of an object (map or struct) with its key and value."""
    column, kind = value(df, old), kind_of(df, old)
    if isinstance(kind, T.StructType):
        pairs = F.filter(
            F.array(*[F.struct(F.lit(n).alias("key"), column.getField(n).alias("value")) for n in sorted(kind.names)]),
            lambda e: e["value"].isNotNull(),
        )
    else:
        pairs = F.array_sort(F.map_entries(column))
    out = df.withColumn("_e", F.explode(pairs)).withColumn(key, F.col("_e.key"))
    return (out.withColumn(val, F.col("_e.value")) if val else out).drop("_e")


#: Names of the deaggregators.
DEAGGREGATORS = {"split": split_out, "unarray": unarray, "unhash": unhash}


def decollate(df: DataFrame, specs: Sequence[str], only: bool = False) -> DataFrame:
    """Apply ``name,argument,…`` deaggregators from left to right; ``only`` keeps the new fields alone."""
    out, made = df, []
    for spec in specs:
        kind, *arguments = spec.split(",")
        out = DEAGGREGATORS[kind](out, *arguments)
        made += arguments[2:] if kind == "split" else arguments[1:]
    return out.select(*dict.fromkeys(made)) if only else out


def flatten(df: DataFrame, keys: Sequence[str], depth: int = 1, separator: str = "-", widest: int = 1000) -> DataFrame:
    """Replace nested fields by one field for each element, named by its path; ``depth`` 0 goes all the way.

    Structs open by their schema. Arrays and maps open to as many columns as
    the data have at most (``widest`` is an error bound), which one aggregate finds.
    """
    paths = [p for key in keys for p in resolve(df.schema, key)]
    level = 0
    todo = [p for p in paths if p in df.columns]
    while todo and (depth == 0 or level < depth):
        after: list[str] = []
        for name in todo:
            kind, column = df.schema[name].dataType, F.col(f"`{name}`")
            if isinstance(kind, T.StructType):
                parts = {f"{name}{separator}{n}": column.getField(n) for n in kind.names}
            elif isinstance(kind, T.ArrayType):
                size = df.agg(F.max(F.array_size(column))).first()[0] or 0
                parts = {f"{name}{separator}{k}": F.get(column, k) for k in range(_bounded(size, widest))}
            elif isinstance(kind, T.MapType):
                found = df.select(F.explode(F.map_keys(column)).alias("k")).distinct().limit(widest + 1).collect()
                _bounded(len(found), widest)
                parts = {f"{name}{separator}{k}": column.getItem(k) for k in sorted(r["k"] for r in found)}
            else:
                continue
            places = [F.col(f"`{c}`") for c in df.columns if c != name]
            df = df.select(*places, *[c.alias(n) for n, c in parts.items()])
            after += parts
        todo, level = after, level + 1
    return df


def _bounded(count: int, most: int) -> int:
    if count > most:
        raise ValueError(f"{count} columns are more than the bound of {most}")
    return count


def stream_to_table(df: DataFrame, field: str, order: list[str]) -> DataFrame:
    """The i-th records of all values of a field side by side, as structs named by the value.

    ``i`` counts from 0. Each struct lacks the field itself.
    """
    column = coerce.key_text(value(df, field), kind_of(df, field))
    rank = F.row_number().over(Window.partitionBy(column).orderBy(*order)) - 1
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != field])
    rows = df.select(rank.alias("i"), column.alias("_g"), rest.alias("_r"))
    return rows.groupBy("i").pivot("_g").agg(F.first("_r"))


def _cells(
    df: DataFrame, x: Sequence[str], y: Sequence[str], values: Sequence[str], order: list[str], pins: dict[str, str] | None
) -> DataFrame:
    """One row for each value of each record: ``_x0…`` and ``_y0…`` as text, ``_v``, and its place ``_o``."""
    for name, wanted in (pins or {}).items():
        if name != "FIELD":
            df = df.filter(coerce.key_text(value(df, name), kind_of(df, name)) == wanted)
        else:
            values = [v for v in values if v == wanted]
    pairs = F.array(*[F.struct(F.lit(v).alias("f"), coerce.text(value(df, v), kind_of(df, v)).alias("v")) for v in values])
    rows = df.select("*", F.explode(pairs).alias("_p")).filter("_p.v is not null")
    named = lambda a: F.col("_p.f") if a == "FIELD" else coerce.key_text(value(df, a), kind_of(df, a))
    axes = [named(a).alias(f"_{axis}{k}") for axis, names in (("x", x), ("y", y)) for k, a in enumerate(names)]
    place = F.struct(*[F.col(c) for c in order])
    return rows.select(*axes, F.col("_p.v").alias("_v"), place.alias("_o"))


def _sorted(rows: DataFrame, names: Sequence[str], specs: Sequence[str]) -> DataFrame:
    """Rows by the sort keys that name one of their columns."""
    wanted = [s for group in specs for s in group.split(",") if s.partition("=")[0] in names]
    return rows.orderBy(*sort_columns(rows, wanted)) if wanted else rows


def pivot(
    df: DataFrame, x: Sequence[str], y: Sequence[str], values: Sequence[str], order: list[str],
    pins: dict[str, str] | None = None, separator: str = "_", sort: Sequence[str] = (), all_last: bool = False,
) -> DataFrame:
    """A grid: one record for each combination of ``y``, one column for each of ``x``.

    ``FIELD`` in either axis stands for the names of the value fields. Each
    cell holds the last value in stream order. ``pins`` keep only records with
    such values (as text). Columns are named by the x values, joined. ``sort``
    keys (as for ``sort``) on fields of the axes order columns and records;
    ``all_last`` does so for every field, with the value ALL last.
    """
    if sort and all_last:
        raise ValueError("sort and all_last exclude each other")
    specs = [f"{a}=*" for a in [*x, *y]] if all_last else sort
    cells = _cells(df, x, y, values, order, pins)
    across = F.concat_ws(separator, *[f"_x{k}" for k in range(len(x))]) if x else F.lit("VALUE")
    down, best = [name_of(a) for a in y], F.max_by("_v", "_o")
    rows = cells.select(*[F.col(f"_y{k}").alias(n) for k, n in enumerate(down)], across.alias("_x"), "_v", "_o")
    columns = None
    if specs and x:
        named = cells.select(*[F.col(f"_x{k}").alias(a) for k, a in enumerate(x)]).distinct()
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        found = _sorted(named, x, specs).limit(most + 1).collect()
        _bounded(len(found), most)
        columns = list(dict.fromkeys(separator.join(r) for r in found))
    return _sorted(rows.groupBy(*down).pivot("_x", columns).agg(best), down, specs)


def pivot_records(
    df: DataFrame, x: Sequence[str], y: Sequence[str], values: Sequence[str], order: list[str], pins: dict[str, str] | None = None
) -> DataFrame:
    """The grid as nested records: ``y`` fields, and under the first ``x`` field a map by its values.

    Each value of the map is the cell, or holds the next ``x`` field's map in
    the same way. Nothing is pivoted, so the values of ``x`` can be many.
    """
    if not x:
        raise ValueError("nested records need a field across")
    by = [f"_y{k}" for k in range(len(y))]
    inner = [f"_x{k}" for k in range(len(x))]
    rows = _cells(df, x, y, values, order, pins).groupBy(*by, *inner).agg(F.max_by("_v", "_o").alias("_v"))
    for k in reversed(range(len(x))):
        pairs = F.map_from_entries(F.collect_list(F.struct(f"_x{k}", "_v")))
        held = pairs if k == 0 else F.struct(pairs.alias(name_of(x[k])))
        rows = rows.groupBy(*by, *inner[:k]).agg(held.alias("_v"))
    return rows.select(*[F.col(c).alias(name_of(a)) for c, a in zip(by, y)], F.col("_v").alias(name_of(x[0])))


#: Operators that look at one record at a time, so that groups make no difference.
RECORD_BY_RECORD = {
    "grep", "xform", "ensure", "rename", "prune", "expand_json", "parse_date", "split_out", "unarray", "unhash", "decollate", "flatten",
}


def by_group(df: DataFrame, groups: Sequence[str], operator, **options) -> DataFrame:
    """Run an operator for each group of records, as if each were a stream of its own.

    Operators on the order of records or on groups take the group as ``by``,
    so that all groups run in the same jobs and a large one spreads over tasks;
    those on single records run as they are. Null, missing and empty text make
    one group.
    """
    names = [p for key in groups for p in resolve(df.schema, key)]
    if "by" in signature(operator).parameters:
        return operator(df, by=names, **options)
    if operator.__name__ in RECORD_BY_RECORD:
        return operator(df, **options)
    raise TypeError(f"{operator.__name__} has no form by group")
