"""Operators about the order of records: sort, first ones, differences, ranges, runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import coerce
from recordloom.functions.keys import kind_of, resolve, value
from recordloom.operators.rows import _condition
from recordloom.plans.order import PLACE, State, by_columns, changed, chunked, in_chunk, numbered, own_rows, running, scan, segmented
from recordloom.plans.store import keep

NUMERIC = {"n", "nat", "natural", "num", "numeric"}
LEXICAL = {"", "l", "lex", "lexical"}


def sort_columns(df: DataFrame, specs: Sequence[str], flip: bool = False) -> list[Column]:
    """Sort expressions for ``field[=[+-]type[*]]``; ``*`` puts the value ALL last (first if descending)."""
    out = []
    for spec in [s for group in specs for s in group.split(",")]:
        path, _, how = spec.partition("=")
        found = re.fullmatch(r"([+-]?)(\w*)(\*?)", how)
        if not found or found[2].lower() not in NUMERIC | LEXICAL:
            raise ValueError(f"bad sort key {spec!r}")
        down = (found[1] == "-") != flip
        raw, kind = value(df, path), kind_of(df, path)
        columns = []
        if found[3]:
            columns.append(F.coalesce(coerce.text(raw, kind) == "ALL", F.lit(False)))
        if found[2].lower() in NUMERIC:
            number = coerce.number(raw, kind)
            number = F.coalesce(number, F.lit(0.0))
            columns += [~F.isnan(number), number]  # what isn't a number comes first
        else:
            columns.append(coerce.key_text(raw, kind))
        out += [c.desc() if down else c.asc() for c in columns]
    return out


def sort(df: DataFrame, keys: Sequence[str], order: list[str], reverse: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Stable sort; ties keep stream order, which ``reverse`` turns round as well. ``by`` sorts group after group."""
    ties = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    return df.orderBy(*by_columns(df, by), *sort_columns(df, keys, reverse), *ties)


def topn(df: DataFrame, n: int = 10, keys: Sequence[str] = (), order: list[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` records in stream order, of each key value if keys are given."""
    paths = [*by, *[p for key in keys for p in resolve(df.schema, key)]]
    if not paths:
        return df.orderBy(*order).limit(n)
    by = [coerce.key_text(value(df, p), kind_of(df, p)) for p in paths]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def head(df: DataFrame, n: int, order: list[str], by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` records, of each group of ``by`` if given.

    By group, tasks keep ``n`` records of a group each before they meet.
    """
    if by:
        rank = F.row_number().over(Window.partitionBy(*by_columns(df, by)).orderBy(*order))
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return df.orderBy(*order).limit(n)


def skip(df: DataFrame, n: int, order: list[str], by: Sequence[str] = ()) -> DataFrame:
    """All but the first ``n`` records, of each group of ``by`` if given."""
    rows, groups = segmented(df, by_columns(df, by), order)
    if groups:
        return running(rows, F.lit(1), "_rank", groups=groups).filter(F.col("_rank") > n).drop("_rank", PLACE, *groups)
    return rows.filter(F.col(PLACE) >= n).drop(PLACE)


def reverse(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order])


def concat(*frames: DataFrame) -> DataFrame:
    """All records of all frames; fields that a frame lacks are null."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def uniq(df: DataFrame, keys: Sequence[str], order: list[str], by: Sequence[str] = ()) -> DataFrame:
    """Drop records whose keys equal those of the record before; without keys one record is left.

    ``by`` makes separate streams.
    """
    paths = [p for key in keys for p in resolve(df.schema, key)]
    rows, groups = segmented(df, by_columns(df, by), order)
    values = [coerce.key_text(value(df, p), kind_of(df, p)) for p in paths]
    rows = chunked(rows, 1, 0).withColumn("_new", changed(values, in_chunk(groups)))
    return own_rows(rows).filter("_new").drop("_new", PLACE, *groups)


def delta(df: DataFrame, keys: Sequence[str], order: list[str], by: Sequence[str] = ()) -> DataFrame:
    """Each record but the last, its keys replaced by the next record's value less its own.

    ``by`` makes separate streams. A stream is cut into chunks that each see one
    record of the next.
    """
    paths = [p for key in keys for p in resolve(df.schema, key)]
    numbers = {p: coerce.number(value(df, p), kind_of(df, p)) for p in paths}
    rows, groups = segmented(df, by_columns(df, by), order)
    over = in_chunk(groups)
    rows = chunked(rows, 0, 1).withColumn("_more", F.lead(F.lit(True)).over(over))
    for k, (path, number) in enumerate(numbers.items()):
        rows = rows.withColumn(f"_d{k}", coerce.storable(F.lead(number).over(over) - number))
    rows = own_rows(rows).filter("_more")
    for k, path in enumerate(paths):
        rows = rows.withColumn(path, F.col(f"_d{k}"))
    return rows.drop("_more", PLACE, *groups, *[f"_d{k}" for k in range(len(paths))])


def substream(
    df: DataFrame, order: list[str], begin: str | Column | None = None, end: str | Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Records from the first that meets ``begin`` to the first from there on that meets ``end``, both included.

    Two minima over the order find the ends; no record moves. ``by`` makes
    separate streams: whether a group has begun and ended runs on through it.
    """
    if by:
        rows, groups = segmented(df, by_columns(df, by), order)
        begun = F.lit(1)
        if begin is not None:
            rows = keep(scan(rows, {"_begun": State("max", _condition(df, begin).cast("int"))}, groups), "begun")
            begun = F.col("_begun")
        if end is not None:
            rows = rows.withColumn("_met", ((begun == 1) & _condition(df, end)).cast("int"))
            rows = scan(rows, {"_ends": State("sum", F.col("_met"))}, groups).filter(F.col("_ends") - F.col("_met") == 0)
        rows = rows.filter(begun == 1).drop("_begun", "_met", "_ends")
        return rows.drop(PLACE, *groups)
    place = F.struct(*[F.col(c) for c in order])
    first = None
    if begin is not None:
        first = df.filter(_condition(df, begin)).agg(F.min(place).alias("p")).first()["p"]
        if first is None:
            return df.limit(0)
        df = df.filter(place >= _literal(df, order, first))
    if end is not None:
        last = df.filter(_condition(df, end)).agg(F.min(place).alias("p")).first()["p"]
        if last is not None:
            df = df.filter(place <= _literal(df, order, last))
    return df


def _literal(df: DataFrame, order: list[str], row) -> Column:
    return F.struct(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in order])
