"""Stream order over all rows, without ever sorting them in one task.

A window without a partition would move every row to one task. Instead rows
are dealt to ranges of the order, numbered within each range, and the ranges'
counts (one number a range) make the numbers global. Operators that look at
neighbours then work on chunks of consecutive numbers, each with a margin of
its neighbours' rows.

Rows of groups are numbered the same way, group after group (``segmented``), and
windows over chunks also part by group. So a group may be as large as it likes:
it lies in many chunks, and no task sees more than a chunk of it. What runs on
through a group (``scan``) is worked out in each chunk; of the chunks whose last
group goes on, one row each passes its state to the next.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import coerce
from recordloom.functions.keys import kind_of, value
from recordloom.plans.store import keep

PLACE = "_place"
CHUNK = "_chunk"
OWN = "_own"
GROUP = "_group"
CHUNK_ROWS = 65_536
#: Columns that the functions here add for a while.
RESERVED = {CHUNK, OWN, "_at", "_range", "_base"}


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``_place``: 0, 1, 2, … in ascending order of ``order``, nulls first.

    Rows are dealt to ranges of all order columns together, so that a frequent
    value in the first one is split like any other, sorted there and stored once
    with their number within the range; the ranges' counts (one row a range)
    make the numbers global. ``order`` must be total for a result without chance.
    """
    spark = df.sparkSession
    if taken := RESERVED & set(df.columns):
        raise ValueError(f"rename the columns {sorted(taken)}: ordered operators use these names")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order]
    sorted_ranges = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    held = keep(sorted_ranges.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    held = held.withColumn("_range", F.shiftright("_at", 33))
    counts = sorted((r["_range"], r["count"]) for r in held.groupBy("_range").count().collect())
    bases, before = [], 0
    for number, count in counts:
        bases.append((number, before - (number << 33)))
        before += count
    based = F.broadcast(spark.createDataFrame(bases, "_range bigint, _base bigint"))  # one row a range
    return held.join(based, "_range").withColumn(PLACE, F.col("_at") + F.col("_base")).drop("_range", "_base", "_at")


def by_columns(df: DataFrame, by: Sequence[str]) -> list[Column]:
    """The values of some fields as grouping text: null, missing and empty text are one group."""
    return [coerce.key_text(value(df, path), kind_of(df, path)) for path in by]


def segmented(df: DataFrame, by: Sequence[Column], order: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows numbered group after group, and the names of the columns that hold the group."""
    groups = [f"{GROUP}{k}" for k in range(len(by))]
    return numbered(df.select("*", *[c.alias(g) for g, c in zip(groups, by)]), [*groups, *order]), groups


def chunked(rows: DataFrame, before: int, after: int, chunk: int | None = None) -> DataFrame:
    """Numbered rows in chunks, each with the last ``before`` rows ahead of it and the first ``after`` behind.

    ``_own`` tells a chunk's own rows from its margins.
    """
    chunk = max(chunk or CHUNK_ROWS, before, after, 1)
    own = F.floor(F.col(PLACE) / chunk).cast("long")
    within = F.col(PLACE) % chunk
    targets = [own]
    if before:
        targets.append(F.when(within >= chunk - before, own + 1))
    if after:
        targets.append(F.when(within < after, own - 1))
    dealt = rows.withColumn(CHUNK, F.explode(F.array_compact(F.array(*targets))))
    return dealt.withColumn(OWN, F.col(CHUNK) == own)


def in_chunk(groups: Sequence[str] = ()) -> "Window":
    """The rows of a chunk, or of a group within it, in order."""
    return Window.partitionBy(CHUNK, *groups).orderBy(PLACE)


def own_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(OWN).drop(OWN, CHUNK)


class State(NamedTuple):
    """A value that runs on: ``sum``, ``min``, ``max``, ``first`` (that isn't null) or ``best`` (of the highest rank, a tie to the first)."""

    kind: str
    value: Column
    rank: Column | None = None


def scan(rows: DataFrame, states: dict[str, State], groups: Sequence[str] = (), chunk: int | None = None) -> DataFrame:
    """Add running states over numbered rows, from the start of the row's group up to the row itself.

    Each chunk works out its own rows. A group that goes on in the next chunk
    fills the end of this one, so at most one row a chunk is carried; the states
    of a group's chunks are merged in order and joined to the chunk behind.
    """
    chunk = chunk or CHUNK_ROWS
    groups = list(groups)
    dealt = rows.select(
        "*", F.floor(F.col(PLACE) / chunk).alias(CHUNK), *[s.value.alias(f"_in_{n}") for n, s in states.items()],
        *[s.rank.alias(f"_rank_{n}") for n, s in states.items() if s.rank is not None],
    )
    inside = in_chunk(groups).rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy(*groups).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    local, total, passed, merged, helpers = {}, [F.max(PLACE).alias("_last")], [], {}, []
    for name, (kind, _, rank) in states.items():
        given, before = F.col(f"_in_{name}"), F.col(f"_before_{name}")
        helpers += [f"_in_{name}", f"_before_{name}"]
        if kind in ("sum", "min", "max"):
            function = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
            local[name] = function(given).over(inside)
            total.append(function(given).alias(f"_total_{name}"))
            passed.append(function(f"_total_{name}").over(upto).alias(f"_before_{name}"))
            own = F.col(name)
            merged[name] = {"sum": F.coalesce(own + before, own, before), "min": F.least(own, before), "max": F.greatest(own, before)}[kind]
        elif kind == "first":
            local[name] = F.first(given, ignorenulls=True).over(inside)
            total.append(F.min_by(given, F.when(given.isNotNull(), F.col(PLACE))).alias(f"_total_{name}"))
            passed.append(F.first(f"_total_{name}", ignorenulls=True).over(upto).alias(f"_before_{name}"))
            merged[name] = F.coalesce(before, F.col(name))
        else:
            ranked, top, high = F.col(f"_rank_{name}"), f"_top_{name}", f"_high_{name}"
            helpers += [f"_rank_{name}", top, high]
            local |= {name: F.max_by(given, ranked).over(inside), top: F.max(ranked).over(inside)}
            total += [F.max_by(given, ranked).alias(f"_total_{name}"), F.max(ranked).alias(f"_totop_{name}")]
            passed += [F.max_by(f"_total_{name}", f"_totop_{name}").over(upto).alias(f"_before_{name}"), F.max(f"_totop_{name}").over(upto).alias(high)]
            held = F.col(high).isNotNull() & (F.col(top).isNull() | (F.col(high) >= F.col(top)))
            merged[name] = F.when(held, before).otherwise(F.col(name))
    ends = dealt.groupBy(CHUNK, *groups).agg(*total).filter(F.col("_last") % chunk == chunk - 1)
    carried = ends.select((F.col(CHUNK) + 1).alias(CHUNK), *groups, *passed)
    return dealt.withColumns(local).join(carried, [CHUNK, *groups], "left").withColumns(merged).drop(CHUNK, *helpers)


def running(rows: DataFrame, step: Column, name: str, chunk: int | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Add the running sum of ``step`` over numbered rows, the row itself included, from its group's start."""
    return scan(rows, {name: State("sum", step)}, groups, chunk)


def changed(columns: list[Column], over) -> Column:
    """True where any value differs from the row before, and on the first row."""
    differs = [~c.eqNullSafe(F.lag(c).over(over)) for c in columns]
    return reduce(lambda a, b: a | b, differs, F.lag(F.lit(1)).over(over).isNull())


def placed(ordered: DataFrame) -> DataFrame:
    """Number the rows of a sorted frame in ``_place``, increasing along its order but not gapless.

    A sorted frame's partitions lie in order, and ids grow along partitions and rows.
    """
    return ordered.drop(PLACE).withColumn(PLACE, F.monotonically_increasing_id())
