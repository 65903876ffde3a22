"""Record-by-record operators: filter, compute, annotate, expand, times."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import coerce
from recordloom.functions.keys import assign, kind_of, lookup, name_of, resolve, value
from recordloom.functions.snippets import expression
from recordloom.plans.order import PLACE, State, by_columns, chunked, in_chunk, own_rows, scan, segmented
from recordloom.plans.store import keep


def _condition(df: DataFrame, snippet: str | Column) -> Column:
    column = expression(df, snippet)
    return coerce.truth(column, df.select(column).schema[0].dataType)


def grep(df: DataFrame, condition: str | Column, invert: bool = False) -> DataFrame:
    """Records whose condition is truthy, or the others.

    A boolean condition stays as it is, so that it reaches the scan.
    """
    column = expression(df, condition)
    if not invert and isinstance(df.select(column).schema[0].dataType, T.BooleanType):
        return df.filter(column)
    met = _condition(df, condition)
    return df.filter(~met if invert else met)


def grep_context(
    df: DataFrame, condition: str | Column, order: list[str], before: int = 0, after: int = 0, by: Sequence[str] = ()
) -> DataFrame:
    """Matching records with so many records before and after each, every record once; ``by`` makes separate streams."""
    rows, groups = segmented(df.withColumn("_met", _condition(df, condition).cast("int")), by_columns(df, by), order)
    rows = chunked(rows, after, before)
    near = F.max("_met").over(in_chunk(groups).rowsBetween(-after, before))
    return own_rows(rows.withColumn("_near", near)).filter("_near = 1").drop("_met", "_near", PLACE, *groups)


def xform(df: DataFrame, changes: dict[str, str | Column], remove: Sequence[str] = ()) -> DataFrame:
    """Set fields (paths) to expressions, all read from the record as it came, and drop some."""
    made = {path: expression(df, code) for path, code in changes.items()}
    held = df.select("*", *[c.alias(f"_new{k}") for k, c in enumerate(made.values())])
    for k, path in enumerate(made):
        held = assign(held, path, F.col(f"_new{k}"))
    return held.drop(*[f"_new{k}" for k in range(len(made))], *remove)


def xform_many(df: DataFrame, records: str | Column) -> DataFrame:
    """Replace each record by the structs in an array; an empty array gives none."""
    return df.select(F.explode(expression(df, records)).alias("_r")).select("_r.*")


def xform_neighbours(df: DataFrame, order: list[str], before: int = 0, after: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Add ``B`` (records before, nearest first) and ``A`` (records after) as arrays of structs; ``by`` makes separate streams."""
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows, groups = segmented(df.withColumn("_r", record), by_columns(df, by), order)
    rows, over = chunked(rows, before, after), in_chunk(groups)
    for name, lag, count in (("B", F.lag, before), ("A", F.lead, after)):
        if count:
            rows = rows.withColumn(name, F.array_compact(F.array(*[lag("_r", k).over(over) for k in range(1, count + 1)])))
    return own_rows(rows).drop("_r", PLACE, *groups)


def evaluate(df: DataFrame, snippet: str | Column) -> DataFrame:
    """One line of text a record; null prints as nothing."""
    column = expression(df, snippet)
    return df.select(coerce.key_text(column, df.select(column).schema[0].dataType).alias("value"))


def annotate(df: DataFrame, keys: Sequence[str], changes: dict[str, str | Column], order: list[str], by: Sequence[str] = ()) -> DataFrame:
    """Fields computed from the first record of each key value, on all records of it.

    The first values are aggregated by key and joined back.
    """
    place = F.struct(*[F.col(c) for c in order])
    paths = [*by, *[p for key in keys for p in resolve(df.schema, key)]]
    by = [value(df, p).alias(f"_k{k}") for k, p in enumerate(paths)]
    made = [F.min_by(expression(df, code), place).alias(f"_v{k}") for k, code in enumerate(changes.values())]
    first = df.groupBy(*by).agg(*made)
    match = [value(df, p).eqNullSafe(first[f"_k{k}"]) for k, p in enumerate(paths)]
    joined = df.join(first, match)
    for k, path in enumerate(changes):
        joined = assign(joined, path, F.col(f"_v{k}"))
    return joined.drop(*[f"_k{k}" for k in range(len(paths))], *[f"_v{k}" for k in range(len(changes))])


def ensure(df: DataFrame, condition: str | Column, message: str = "assertion failed") -> DataFrame:
    """The records as they are; the job fails on the first for which the condition doesn't hold."""
    failed = F.when(_condition(df, condition), None).otherwise(F.raise_error(F.lit(message)))
    return df.filter(F.isnull(failed.cast("string")))


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a field; one that isn't there becomes a null field."""
    return df.withColumnRenamed(old, new) if old in df.columns else df.withColumn(new, F.lit(None).cast("string"))


def prune(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in keep])


#: Text that is taken for JSON: an object, array, quoted string, true, false or null.
_SHAPED = r'(?s)^(\{.*\}|\[.*\]|".*"|true|false|null)$'


def _opened(item: Any) -> Any:
    """A JSON value with the JSON texts inside it replaced by their values, all the way down."""
    if isinstance(item, str) and re.match(_SHAPED, item.strip()):
        try:
            return _opened(json.loads(item.strip()))
        except ValueError:
            return item
    if isinstance(item, list):
        return [_opened(e) for e in item]
    return {k: _opened(e) for k, e in item.items()} if isinstance(item, dict) else item


def _opened_json(text: str | None) -> str | None:
    """Nested deeper than Python's own stack, a text stays as it is."""
    try:
        return None if text is None else json.dumps(_opened(text))
    except RecursionError:
        return json.dumps(text)


@F.pandas_udf(T.StringType())
def _opened_text(column: pd.Series) -> pd.Series:
    return column.map(_opened_json)


def expand_json(
    df: DataFrame, keys: Sequence[str] = (), schema: dict[str, str] | None = None, recursive: bool = False
) -> DataFrame:
    """Parse JSON text in fields into values.

    A field with a ``schema`` (DDL) becomes that type; others become VARIANT,
    where text that isn't an object, array, quoted string, true, false or null
    stays text. Without keys all top-level text fields are tried. ``recursive``
    also parses texts inside the parsed values; nested some hundred levels deep, a
    text stays text.
    """
    schema = schema or {}
    paths = [p for key in keys for p in resolve(df.schema, key)]
    paths = paths or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    for path in paths:
        found = lookup(df.schema, path)
        if found is None or not isinstance(found[1], T.StringType):
            continue
        column = found[0]
        if path in schema:
            df = assign(df, path, F.from_json(_opened_text(column) if recursive else column, schema[path]))
        else:
            parsed = F.when(F.trim(column).rlike(_SHAPED), F.try_parse_json(_opened_text(column) if recursive else column))
            df = assign(df, path, F.coalesce(parsed, _text_variant(column)))
    return df


def _text_variant(column: Column) -> Column:
    """A string as a VARIANT string."""
    quoted = F.to_json(F.array(column))
    return F.try_parse_json(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def generate(df: DataFrame, records: str | Column, chain: str = "_chain", passthrough: bool = False) -> DataFrame:
    """New records from an array of structs, the parent record under ``chain``; parents too on request."""
    parent = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    made = df.select(F.explode(expression(df, records)).alias("_r"), parent.alias(chain)).select("_r.*", chain)
    return df.unionByName(made, allowMissingColumns=True) if passthrough else made


UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds_of(span: str | int | float) -> float:
    """Seconds of a number or of a text like ``2d 12h``."""
    if not isinstance(span, str):
        return float(span)
    found = re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]*)", span.lower())
    return sum(float(n) * UNITS[(u or "s")[0]] for n, u in found)


def normalize_time(
    df: DataFrame, key: str, span: str | float, order: list[str] | None = None, strict: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``n_<key>``: the time's bucket start; ``by`` makes separate streams.

    Times are epoch seconds or timestamps. Not strict: a bucket that directly
    follows the previous record's normalised value takes that value on. Let d be
    the step between strict buckets: one bucket flips whether a record is moved
    back, none keeps it, any other resets it; so the state is the parity of
    flips since the last reset, found by running sums instead of a sequential scan.
    """
    width = seconds_of(span)
    name = f"n_{name_of(key)}"
    at = F.floor(coerce.number(value(df, key), kind_of(df, key)) / width) * width
    if strict:
        return df.withColumn(name, at)
    rows, groups = segmented(df.withColumn(name, at), by_columns(df, by), order)
    step = F.col(name) - F.lag(name).over(in_chunk(groups))
    rows = own_rows(chunked(rows, 1, 0).withColumn("_flip", F.coalesce((step == width).cast("long"), F.lit(0)))
                    .withColumn("_reset", F.coalesce(~step.isin(0.0, width), F.lit(True))))
    rows = keep(scan(rows, {"_flips": State("sum", F.col("_flip"))}, groups), "flips")
    rows = scan(rows, {"_from": State("max", F.when(F.col("_reset"), F.col("_flips")))}, groups)
    moved = (F.col("_flips") - F.col("_from")) % 2
    return rows.withColumn(name, F.col(name) - moved * width).drop("_flip", "_reset", "_flips", "_from", PLACE, *groups)


#: How strftime's letters are written as datetime patterns.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM",
    "a": "EEE", "p": "a",
}


def datetime_pattern(text: str) -> str:
    """A Spark datetime pattern for a strftime format."""
    made = []
    for letter, plain in re.findall(r"%(.)|([^%]+)", text):
        literal = "%" if letter == "%" else plain
        made.append(re.sub(r"([A-Za-z%']+(?: +[A-Za-z%']+)*)", lambda m: "'" + m[1].replace("'", "''") + "'", literal) if literal else STRFTIME.get(letter, ""))
    return "".join(made)


def parse_date(
    df: DataFrame, key: str, output: str | None = None, read: str | None = None, write: str | None = None,
    from_epoch: bool = False, to_epoch: bool = False, zone: str = "UTC",
) -> DataFrame:
    """Parse a date field and write it as ISO text (UTC), by a strftime format, or as epoch seconds.

    Null and empty text pass through. A text that can't be parsed fails the job.
    """
    raw, kind = value(df, key), kind_of(df, key)
    as_text = coerce.text(raw, kind)
    if from_epoch:
        moment = F.timestamp_seconds(coerce.number(raw, kind))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        moment = raw.cast("timestamp")
    elif read:
        moment = F.to_timestamp(as_text, datetime_pattern(read))
    else:
        moment = as_text.cast("timestamp")
    if to_epoch:
        done = F.unix_timestamp(moment).cast("long")
        done = F.when(as_text.isNotNull() & (as_text != ""), done)
    else:
        shown = F.date_format(F.from_utc_timestamp(moment, zone), datetime_pattern(write)) if write else F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        done = F.when(as_text.isNull() | (as_text == ""), as_text).otherwise(shown)
    return assign(df, output or key, done)
