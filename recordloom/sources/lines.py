"""Record sources over lines of text.

:func:`read_lines` keeps each line's file and place; the parsers take any frame
with a ``value`` column, keep its other columns, and run as column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.sources.multiline import parse_multi_re as parse_multi_re
from recordloom.sources.splits import CsvCut, JsonCut, records

#: Columns that give lines of files their order.
LINE_ORDER = ["_file", "_block", "_line"]


def read_lines(spark: SparkSession, path: str | list[str], separator: str | None = None, filename_key: str | None = None) -> DataFrame:
    """Lines with ``_file``, ``_block``, ``_line``, which order them as in the files."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    rows = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return rows.withColumn(filename_key, F.col("_file")) if filename_key else rows


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """One object a line; lines that can't be parsed are dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


#: A number as type inference takes it.
_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _inferred(frame: DataFrame) -> DataFrame:
    """Text columns as int, bigint, double, timestamp or boolean where all their values can be such, by one aggregate."""
    tests, kinds = {}, ("int", "bigint", "double", "timestamp", "boolean")
    for k, name in enumerate(frame.columns):
        column = F.col(f"`{name}`")
        for kind in kinds:
            fits = column.try_cast(kind).isNotNull()
            fits = fits & column.rlike(_PLAIN_NUMBER) if kind in ("int", "bigint", "double") else fits & ~column.rlike(_PLAIN_NUMBER)
            tests[f"{kind}{k}"] = F.bool_and(F.when(column.isNotNull(), fits))
    found = frame.agg(*[c.alias(n) for n, c in tests.items()]).first()
    chosen = [next((kind for kind in kinds if found[f"{kind}{k}"]), "string") for k in range(len(frame.columns))]
    return frame.select(*[F.col(f"`{n}`").try_cast(kind).alias(n) if kind != "string" else F.col(f"`{n}`") for n, kind in zip(frame.columns, chosen)])


def read_csv(
    spark: SparkSession, path: str | list[str], fields: Sequence[str] = (), header: bool = False, strict: bool = False,
    delimiter: str = ",", quote: str = '"', escape: str = '"', infer: bool = False, places: bool = False,
) -> DataFrame:
    """CSV with quoted line breaks; values are text (numbers where they look so, with ``infer``).

    Columns without a name are named by their index, as many as the widest
    record has. Not strict: white space around values goes. Strict: an ill-formed
    record fails the job. ``header``: the first record of each file is none, the
    first file's gives the names after ``fields``. ``places`` adds
    ``LINE_ORDER``, which orders the records.

    A file is read in splits, wherever they cut it (``splits.records``).
    """
    trim = str(not strict).lower()
    rows = records(spark, path, CsvCut(delimiter, quote, escape, not strict))
    width = (rows.agg(F.max("width")).first()[0] or 0) + 1
    options = {
        "sep": delimiter, "quote": quote, "escape": escape, "mode": "FAILFAST" if strict else "PERMISSIVE",
        "ignoreLeadingWhiteSpace": trim, "ignoreTrailingWhiteSpace": trim, "maxCharsPerColumn": "-1", "maxColumns": str(max(width, 20_480)),
    }
    parsed = F.from_csv("value", ", ".join(f"c{k} string" for k in range(width)), options)
    names: list[str] = list(fields)
    if header:
        first = (F.col("_block") == 0) & (F.col("_line") == 0)
        found = rows.filter(first).orderBy("_file").select(parsed.alias("r")).first()
        names += [n for n in found["r"] if n is not None] if found else []
        rows = rows.filter(~first)
    names += [str(k) for k in range(len(names), width)]
    frame = rows.select(parsed.alias("r"), *LINE_ORDER)
    out = frame.select(*[F.col(f"r.c{k}").alias(n) for k, n in enumerate(names[:width])], *LINE_ORDER if places else [])
    return _inferred(out) if infer else out


def _inferred_json(rows: DataFrame) -> str:
    """A type that all objects fit, by one aggregate; fields whose values differ in kind become text."""
    found = rows.agg(F.schema_of_variant_agg(F.try_parse_json("value"))).first()[0] or "VOID"
    if not found.startswith("OBJECT<"):
        return "struct<>"
    found = re.sub(r"\bDECIMAL\(\d+,\d+\)", "DOUBLE", found).replace("OBJECT<", "STRUCT<")
    return re.sub(r": ?(VOID|VARIANT)\b", ": STRING", re.sub(r"<(VOID|VARIANT)>", "<STRING>", found))


def read_json_array(
    spark: SparkSession, path: str | list[str], keys: Sequence[str] = (), schema: str | None = None, places: bool = False
) -> DataFrame:
    """The objects of top-level arrays; ``keys`` keeps some fields, a missing one is null.

    A file is read in splits, wherever they cut it (``splits.records``): objects
    are found by their braces, so an array may also be spread over several
    files, as ``write_json_array`` writes it, and objects may stand alone.
    Elements that are no objects are passed over. Without a ``schema`` one more
    pass finds it. ``places`` adds ``LINE_ORDER``, which orders the records.
    """
    rows = records(spark, path, JsonCut())
    kind = T.StructType.fromDDL(schema) if schema else T.DataType.fromDDL(_inferred_json(rows))
    frame = rows.select(F.from_json("value", kind).alias("r"), *LINE_ORDER)
    every = keys or kind.names
    picked = [F.col("r").getField(k).alias(k) if k in kind.names else F.lit(None).cast("string").alias(k) for k in every]
    return frame.select(*picked, *LINE_ORDER if places else [])


def parse_kv(lines: DataFrame, kv: str = " ", entry: str = "\n") -> DataFrame:
    """Key-value records, one a row of ``value``, as a map; entries that aren't a pair are ignored."""
    entries = F.transform(F.split("value", rf"\Q{entry}\E"), lambda e: F.split(e, rf"\Q{kv}\E"))
    pairs = F.filter(entries, lambda p: F.array_size(p) == 2)
    names = F.transform(pairs, lambda p: p[0])
    last = lambda n: F.element_at(F.filter(pairs, lambda p: p[0] == n), -1)[1]
    unique = F.array_distinct(names)
    made = F.map_from_arrays(unique, F.transform(unique, last))
    return lines.withColumn("record", made).filter(F.size("record") > 0).drop("value")


def fields_of_map(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Columns for some keys of a map column."""
    return df.select("*", *[F.col(column).getItem(n).alias(n) for n in names]).drop(column)


def parse_re(lines: DataFrame, pattern: str, names: Sequence[str] = ()) -> DataFrame:
    """Groups of a pattern as fields (named 0, 1, … where names run out); other lines are dropped.

    A group that takes no part in the match is null.
    """
    count = re.compile(pattern).groups
    held = lines.filter(F.col("value").rlike(pattern))
    given = [*names, *[str(k) for k in range(len(names), count)]][:count]
    made = []
    for k in range(1, count + 1):
        found = F.regexp_extract("value", pattern, k)
        # The first match alone (an atomic group), then the group again: that fails where it took no part.
        there = F.col("value").rlike(rf"^(?s:(?>.*?(?:{pattern})))\{k}")
        made.append(F.when((found != "") | there, found))
    return held.select(*[c for c in lines.columns if c != "value"], *[m.alias(n) for m, n in zip(made, given)])


def parse_split(
    lines: DataFrame, delimiter: str = ",", names: Sequence[str] = (), strict: bool = False, width: int | None = None,
    header: bool = False,
) -> DataFrame:
    """Fields of split lines; the delimiter is a pattern unless strict.

    ``header``: the first line of all (by ``LINE_ORDER``, as ``read_lines`` gives
    it) holds the names after ``names`` and is no record itself.

    Without ``width`` the data's largest number of fields, found by one
    aggregate, gives the number of columns; unnamed ones are named by index.
    """
    parts = F.split("value", rf"\Q{delimiter}\E" if strict else delimiter)
    held = lines.withColumn("_p", parts)
    if header and (first := held.orderBy(*LINE_ORDER).first()) is not None:
        names = [*names, *first["_p"]]
        held = held.filter(~reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(first[c])) for c in LINE_ORDER]))
    count = width or held.agg(F.max(F.array_size("_p"))).first()[0] or 0
    given = [*names, *[str(k) for k in range(len(names), count)]]
    return held.select(
        *[c for c in lines.columns if c != "value"], *[F.get("_p", k).alias(n) for k, n in enumerate(given)]
    )


#: The fields of web server log lines, in order, and what each may hold. Quotes within a quoted field follow a backslash.
_QUOTED = r'"((?:[^"\\]++|\\"|\\)*)"'
_COMMON = {
    "rhost": r"(\S+)", "logname": r"(\S+)", "user": r"(\S+)", "date": r"\[(\d{2}/\w{3}/\d{4}):", "time": r"(\d{2}:\d{2}:\d{2})",
    "timezone": r"([^\]]+)\]", "request": _QUOTED, "status": r"(\d{3}|-)", "bytes": r"(\d+|-)",
}
_FORMATS = {
    "combined": {**_COMMON, "referer": _QUOTED, "agent": _QUOTED},
    "common": _COMMON,
    "vhost": {"vhost": r"(\S+)", **_COMMON},
}
_FIELDS = {form: list(fields) for form, fields in _FORMATS.items()}
#: What follows the last field doesn't matter.
APACHE = {form: "^" + " ".join(fields.values()).replace(": (", ":(") for form, fields in _FORMATS.items()}


def parse_apache(lines: DataFrame, formats: Sequence[str] = ("combined", "common")) -> DataFrame:
    """Web server log lines in the first format that fits; values are text, other lines are dropped.

    ``datetime``, ``method``, ``path`` and ``proto`` are derived. Fields a format lacks are null.
    """
    every = list(dict.fromkeys(n for f in formats for n in _FIELDS[f]))
    value = F.col("value")
    columns = []
    for name in every:
        column = F.lit(None).cast("string")
        for form in reversed(formats):
            found = F.regexp_extract(value, APACHE[form], _FIELDS[form].index(name) + 1) if name in _FIELDS[form] else F.lit(None).cast("string")
            column = F.when(value.rlike(APACHE[form]), found).otherwise(column)
        columns.append(column.alias(name))
    fits = F.lit(False)
    for form in formats:
        fits = fits | value.rlike(APACHE[form])
    held = lines.filter(fits).select(*[c for c in lines.columns if c != "value"], *columns)
    request = r"^(\S+)\s+(\S+)(?:\s+(\S+))?$"
    part = lambda k: F.when(F.col("request").rlike(request), F.nullif(F.regexp_extract("request", request, k), F.lit("")))
    moment = F.concat(F.col("date"), F.lit(":"), F.col("time"), F.lit(" "), F.col("timezone"))
    return held.select("*", moment.alias("datetime"), part(1).alias("method"), part(2).alias("path"), part(3).alias("proto"))


#: The fields of an FTP transfer log line, in order, and what each may hold.
_XFERLOG = {
    "day_name": r"\w+", "month": r"\w+", "day": r"\d+", "current_time": r"\d{2}:\d{2}:\d{2}", "year": r"\d{4}", "transfer_time": r"\d+",
    "remote_host": r"\S+", "file_size": r"\d+", "filename": r".*?", "transfer_type": "[abm]", "special_action_flag": r"\S+",
    "direction": "[oidaSm]", "access_mode": "[ragw]", "username": r"\S+", "service_name": r"\S+", "authentication_method": r"\d+",
    "authenticated_user_id": r"\S+", "completion_status": "[ci]",
}
XFERLOG = tuple(_XFERLOG)
XFERLOG_PATTERN = "^" + r"\s+".join(f"({held})" for held in _XFERLOG.values()) + "$"


def parse_xferlog(lines: DataFrame) -> DataFrame:
    """FTP transfer log lines; others are dropped."""
    return parse_re(lines, XFERLOG_PATTERN, XFERLOG)


def parse_lines_as(lines: DataFrame, column: Column, name: str) -> DataFrame:
    """A field computed from the line."""
    return lines.withColumn(name, column).drop("value")
