"""Sources in other formats and systems."""

from __future__ import annotations

import sqlite3
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_xml(spark: SparkSession, path: str, elements: Sequence[str], schema: str | None = None) -> DataFrame:
    """Each of the elements as a record; with several, ``element`` names which one it was."""
    frames = []
    for name in elements:
        reader = spark.read.format("xml").option("rowTag", name).option("attributePrefix", "").option("valueTag", "value")
        frame = (reader.schema(schema) if schema else reader).load(path)
        frames.append(frame.withColumn("element", F.lit(name)) if len(elements) > 1 else frame)
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def read_atom(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The entries of Atom feeds that lie in files, without their links."""
    frame = read_xml(spark, path, ["entry"])
    return frame.drop("link")


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, sql: str | None = None, **options: str) -> DataFrame:
    """A table or a query of a database; give ``partitionColumn``, bounds and ``numPartitions`` to read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return (reader.option("dbtable", table) if table else reader.option("query", sql)).load()


class _Slice(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")`` with ``file``, ``sql`` and ``schema``, in ranges of row ids.

    The file must be reachable from the executors. ``table`` in place of ``sql``
    is read in ``parts`` slices.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['file']}?mode=ro", uri=True) as base:
            sql = self.options.get("sql") or f'SELECT * FROM "{self.options["table"]}"'
            cursor = base.execute(f"SELECT * FROM ({sql}) LIMIT 1")
            row = cursor.fetchone() or [None] * len(cursor.description)
        kinds = {int: "bigint", float: "double", bytes: "binary"}
        return ", ".join(f"`{d[0]}` {kinds.get(type(v), 'string')}" for d, v in zip(cursor.description, row))

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.names = dict(options), schema.names

    def partitions(self):
        if self.options.get("sql"):
            return [_Slice(None, None)]
        with sqlite3.connect(f"file:{self.options['file']}?mode=ro", uri=True) as base:
            low, high = base.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        if low is None:
            return [_Slice(0, 0)]
        parts = int(self.options.get("parts", 8))
        step = max(1, -(-(high + 1 - low) // parts))
        return [_Slice(k, k + step) for k in range(low, high + 1, step)]

    def read(self, partition):
        with sqlite3.connect(f"file:{self.options['file']}?mode=ro", uri=True) as base:
            if partition.low is None:
                yield from base.execute(self.options["sql"])
            else:
                sql = f'SELECT * FROM "{self.options["table"]}" WHERE rowid >= ? AND rowid < ?'
                yield from base.execute(sql, (partition.low, partition.high))


def read_sqlite(spark: SparkSession, file: str, table: str | None = None, sql: str | None = None, parts: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("file", file).option("parts", str(parts))
    return (reader.option("table", table) if table else reader.option("sql", sql)).load()


def processes(spark: SparkSession) -> DataFrame:
    """The driver's process table, names in lower case; a report of one machine, so small."""
    lines = subprocess.run(["ps", "aux"], capture_output=True, text=True, check=True).stdout.splitlines()
    names = [n.lower() for n in lines[0].split()]
    rows = [line.split(None, len(names) - 1) for line in lines[1:]]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


#: How tcpdump prints the start of an IPv4 packet.
TCPDUMP = r"^(\d+:\d+:\d+\.\d+) IP (\S+?)\.(\d+) > (\S+?)\.(\d+): (.*?)(?:, length (\d+))?$"


def parse_tcpdump(lines: DataFrame) -> DataFrame:
    """Text of ``tcpdump -n``: time, addresses, ports, flags and length of IPv4 packets."""
    got = lambda k: F.regexp_extract("value", TCPDUMP, k)
    flags = F.regexp_extract("value", r"Flags \[([^\]]*)\]", 1)
    return lines.filter(F.col("value").rlike(TCPDUMP)).select(
        *[c for c in lines.columns if c != "value"],
        got(1).alias("time"), F.struct(got(2).alias("src"), got(4).alias("dest")).alias("ip"),
        F.struct(got(3).cast("int").alias("src_port"), got(5).cast("int").alias("dest_port"), flags.alias("flags")).alias("transport"),
        F.nullif(got(7), F.lit("")).cast("int").alias("length"),
    )
