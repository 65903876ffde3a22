"""Writing records: files, tables, databases."""

from __future__ import annotations

import sqlite3
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.coerce import storable
from recordloom.functions.keys import name_of, resolve, value
from recordloom.plans.store import keep


def json_values(df: DataFrame) -> DataFrame:
    """Top-level NaN and infinite numbers as null, as JSON has none."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(*[storable(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, floats) else F.col(f"`{f.name}`") for f in df.schema])


def json_lines(df: DataFrame) -> DataFrame:
    """One line of JSON a record in ``value``, nulls included."""
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return json_values(df).select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    json_lines(df).write.text(path)


def flat(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chosen fields in the given order, or all by name; nested ones as JSON text."""
    paths = [p for key in keys for p in resolve(df.schema, key)] or sorted(df.columns)
    nested = (T.StructType, T.ArrayType, T.MapType)
    out: list[Column] = []
    for path in paths:
        column = value(df, path) if keys else F.col(f"`{path}`")
        kind = df.select(column).schema[0].dataType
        out.append((F.to_json(column) if isinstance(kind, nested) else column).alias(name_of(path)))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, keys: Sequence[str] = (), header: bool = True, delimiter: str = ",") -> None:
    flat(df, keys).write.csv(path, header=header, sep=delimiter, quote='"', escape='"', emptyValue="")


def csv_lines(df: DataFrame, keys: Sequence[str] = (), delimiter: str = ",") -> DataFrame:
    """CSV text of each record in ``value``; values with the delimiter, quotes or line breaks are quoted."""
    columns = []
    for field in flat(df, keys).schema:
        text = F.coalesce(F.col(f"`{field.name}`").cast("string"), F.lit(""))
        odd = text.contains(delimiter) | text.contains('"') | text.contains("\n")
        columns.append(F.when(odd, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return flat(df, keys).select(F.concat_ws(delimiter, *columns).alias("value"))


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array: the files in ``path``, put together in the order of their names, are it.

    The records are stored first. The smallest and the largest row number, one
    row of a small aggregate, tell which record opens the array and which ends it.
    """
    rows = keep(json_lines(df).withColumn("_at", F.monotonically_increasing_id()), "json-array")
    ends = rows.agg(F.min("_at").alias("a"), F.max("_at").alias("z")).first()
    if ends["a"] is None:
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.text(path)
        return
    begin = F.when(F.col("_at") == ends["a"], "[").otherwise(",")
    end = F.when(F.col("_at") == ends["z"], "]").otherwise("")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "_at").sortWithinPartitions("_at")
    ordered.select(F.concat(begin, "value", end).alias("value")).write.text(path)


def _typed(keys: Sequence[str]) -> tuple[list[str], dict[str, str]]:
    """Paths, and the SQL types by column name, of ``path`` or ``path=TYPE`` keys."""
    pairs = [key.partition("=") for key in keys]
    return [path for path, _, _ in pairs], {name_of(path): kind for path, _, kind in pairs if kind}


def write_jdbc(
    df: DataFrame, url: str, table: str = "recs", drop: bool = False, keys: Sequence[str] = (), **options: str
) -> None:
    """Append flat records to a table; ``keys`` choose fields, each with an SQL type if given as ``field=TYPE``."""
    paths, kinds = _typed(keys)
    if kinds:
        options["createTableColumnTypes"] = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    flat(df, paths).write.mode("overwrite" if drop else "append").format("jdbc").options(url=url, dbtable=table, **options).save()


def write_sqlite(df: DataFrame, file: str, table: str = "recs", drop: bool = False, keys: Sequence[str] = ()) -> None:
    """Append flat records to a database file on the driver, streamed a partition at a time.

    For results that fit in one file; large ones go through ``write_jdbc``.
    ``keys`` choose fields, each with an SQL type if given as ``field=TYPE``.
    """
    paths, given = _typed(keys)
    frame = flat(df, paths)
    known = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "INTEGER", "binary": "BLOB"}
    columns = ", ".join(f'"{n}" {given.get(n) or known.get(k, "VARCHAR(255)")}' for n, k in frame.dtypes)
    shown = [F.col(f"`{n}`") if k in known else F.col(f"`{n}`").cast("string") for n, k in frame.dtypes]
    with sqlite3.connect(file) as base:
        if drop:
            base.execute(f'DROP TABLE IF EXISTS "{table}"')
        base.execute(f'CREATE TABLE IF NOT EXISTS "{table}" (id INTEGER PRIMARY KEY AUTOINCREMENT, {columns})')
        names = ", ".join(f'"{n}"' for n in frame.columns)
        sql = f'INSERT INTO "{table}" ({names}) VALUES ({", ".join("?" * len(frame.columns))})'
        base.executemany(sql, (tuple(r) for r in frame.select(*shown).toLocalIterator()))


def write_by_group(df: DataFrame, path: str, keys: Sequence[str], kind: str = "json") -> None:
    """One folder of files for each value of the keys."""
    df.write.partitionBy(*keys).format(kind).save(path)
