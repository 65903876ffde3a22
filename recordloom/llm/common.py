"""Pieces shared by the training-data operators: folders, tables, ranges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, as executors share no local disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="recordloom-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts the lineage: a lost executor later costs a re-read, not a re-run
    of everything before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantile_bounds(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` increasing split points of a numeric key column."""
    if parts < 2:
        return []
    wanted = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(key, wanted, max(10_000, 10 * parts)).alias("q")).first()
    return sorted(set(row["q"] or []))


def bucket_of(key: str, bounds: list) -> Column:
    """Index of the range that holds the key: how many bounds are below it.

    A null key lies before all others.
    """
    if not bounds:
        return F.lit(0)
    kind = "bigint" if all(isinstance(b, int) for b in bounds) else "double"
    below = F.array_size(F.filter(F.lit(bounds).cast(f"array<{kind}>"), lambda b: b < F.col(key)))
    return F.coalesce(below, F.lit(0)).cast("int")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
