"""Coercions of dynamically typed records: numbers, strings and truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity))\s*$"
HEX = r"^\s*0[xX][0-9a-fA-F]+\s*$"


def number(value: Column, kind: T.DataType) -> Column:
    """A value as a double: null stays null, blank text is 0, other text NaN."""
    if isinstance(kind, T.StringType):
        text = F.trim(F.regexp_replace(value, r"\s+", " "))
        hexadecimal = F.conv(F.substring(text, 3, 1000), 16, 10).try_cast("double")
        return (
            F.when(value.isNull(), None)
            .when(text == "", 0.0)
            .when(value.rlike(NUMBER), text.try_cast("double"))
            .when(value.rlike(HEX), hexadecimal)
            .otherwise(F.lit(float("nan")))
        )
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return value.cast("timestamp").cast("double")
    if isinstance(kind, T.DateType):
        return value.cast("timestamp").cast("double")
    return F.when(value.isNull(), None).otherwise(F.lit(float("nan")))


def text(value: Column, kind: T.DataType) -> Column:
    """A value as text: whole doubles without a fraction, few or many digits without an exponent."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        size, shown = F.abs(value), value.cast("string")
        plain = lambda scale: F.regexp_replace(
            shown.cast(f"decimal(38,{scale})").cast("string"), r"(\.\d*?)0+$", "$1"
        )
        exponent = F.regexp_replace(F.regexp_replace(shown, r"\.0E", "E"), r"E(\d)", "e+$1")
        return (
            F.when(F.isnan(value), "NaN")
            .when(value == float("inf"), "Infinity")
            .when(value == float("-inf"), "-Infinity")
            .when((value == F.floor(value)) & (size < 1e18), value.cast("bigint").cast("string"))
            .when((size >= 1e-6) & (size < 1e-3), plain(25))
            .when((size >= 1e7) & (size < 1e21), F.regexp_replace(plain(16), r"\.$", ""))
            .otherwise(F.regexp_replace(exponent, "E-", "e-"))
        )
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return value.cast("string")


def key_text(value: Column, kind: T.DataType) -> Column:
    """Grouping and joining form: null, missing and empty text are one key."""
    return F.coalesce(text(value, kind), F.lit(""))


def truth(value: Column, kind: T.DataType) -> Column:
    """False for null, 0, NaN, empty text and false."""
    if isinstance(kind, T.BooleanType):
        found = value
    elif isinstance(kind, T.StringType):
        found = value != ""
    elif isinstance(kind, T.NumericType):
        found = (value != 0) & ~F.isnan(value.cast("double"))
    else:
        found = value.isNotNull()
    return F.coalesce(found, F.lit(False))


def storable(value: Column) -> Column:
    """NaN and infinities as null, as JSON writes them."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
