"""Sharding by a minimax contiguous partition.

Equal texts form an atomic group. Groups lie in the order of their texts'
digests, and the ordered list is cut into ``shards`` runs so that the largest
run is as small as it can be: the capacity is found by binary search, each
candidate checked greedily, and the cuts follow from the smallest feasible one.

The driver never sees all groups. It starts from the sums of at most 65,536
digest ranges and looks closer, range by range, only where a cut can fall.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import bucket_of, quantile_bounds, shuffle_parts, stored

#: Hexadecimal digits of the digest that the first look tells apart, and by which later looks split a range.
FIRST, FINER = 4, 2
#: Ranges that one later look splits at most; the next look takes the rest.
AT_ONCE = 64


@dataclass(frozen=True)
class Run:
    """Consecutive groups: those whose digests start with ``prefix``."""

    prefix: str
    size: int
    whole: bool  # one group, which can't be cut


def greedy(runs: list[Run], capacity: int) -> list[int] | None:
    """Ends (exclusive indexes) of the shards when each takes runs while they fit; None if one run can't."""
    ends, sums = [], [0, *accumulate(r.size for r in runs)]
    at = 0
    while at < len(runs):
        to = bisect_right(sums, sums[at] + capacity) - 1
        if to == at:
            return None
        ends.append(to)
        at = to
    return ends


def smallest_capacity(runs: list[Run], shards: int) -> int:
    """The least capacity at which ``shards`` greedy shards hold all runs, none of them cut."""
    total = sum(r.size for r in runs)
    lo, hi = max([-(-total // shards), *(r.size for r in runs)]), total
    while lo < hi:
        mid = (lo + hi) // 2
        ends = greedy(runs, mid)
        lo, hi = (lo, mid) if ends is not None and len(ends) <= shards else (mid + 1, hi)
    return lo


def _doubtful(runs: list[Run], shards: int) -> list[int]:
    """Runs of more than one group in which a cut of the best partition can fall.

    The best capacity is at least ``low`` (runs divisible at will) and at most
    ``high`` (no run divisible). The i-th cut then lies between where greedy
    cutting ends for ``low`` without entering a run and i times ``high``.
    """
    total = sum(r.size for r in runs)
    low = max([-(-total // shards), *(r.size for r in runs if r.whole)])
    high = smallest_capacity(runs, shards)
    sums = [0, *accumulate(r.size for r in runs)]
    found, at = set(), 0
    for i in range(1, shards):
        if at < len(runs):
            at = max(at, bisect_right(sums, sums[at] + low) - 1)
        last = bisect_right(sums, i * high) - 1
        found.update(k for k in range(at, min(last + 1, len(runs))) if not runs[k].whole)
    return sorted(found)


def find_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """First digests of shards 1, 2, … and the capacity, from ``groups(digest, bytes)``.

    The first look returns at most 16 ** ``FIRST`` sums, a later one at most
    ``AT_ONCE`` * 16 ** ``FINER``, however many groups there are.
    """

    def look(rows: DataFrame, digits: int) -> list[Run]:
        summed = rows.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(
            F.sum("bytes").alias("size"), F.count(F.lit(1)).alias("n"), F.min("digest").alias("first")
        )
        found = sorted(summed.collect(), key=lambda r: r["prefix"])
        return [Run(r["first"] if r["n"] == 1 else r["prefix"], r["size"], r["n"] == 1) for r in found]

    runs = look(groups, FIRST)
    while doubtful := _doubtful(runs, shards):
        digits = min(len(runs[k].prefix) for k in doubtful)
        near = [runs[k].prefix for k in doubtful if len(runs[k].prefix) == digits][:AT_ONCE]
        finer: dict[str, list[Run]] = {p: [] for p in near}
        for run in look(groups.filter(F.substring("digest", 1, digits).isin(near)), digits + FINER):
            finer[run.prefix[:digits]].append(run)
        runs = [x for r in runs for x in (finer[r.prefix] if not r.whole and r.prefix in finer else [r])]
    capacity = smallest_capacity(runs, shards) if runs else 0
    ends = greedy(runs, capacity) if runs else []
    return [runs[k].prefix for k in ends if k < len(runs)], capacity


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``bytes``: a document's size is its UTF-8 bytes plus 1, and the
    largest shard is as small as contiguous cutting allows, equal texts staying
    together. ``slot`` counts a shard's rows from 0 in ascending id order,
    without gaps. ``grown_shard`` is null under this law.

    A null text has size 1 and the crc32 of an empty text, and shares the empty
    texts' group. Null ids come first in their shard. Very long texts count in
    full; repeated rows keep a slot each. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        _digest(text).alias("digest"),
    )
    rows = stored(rows, "sharding")
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "sharding-groups")
    cuts, _ = find_cuts(groups, shards)
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("digest") >= cut).cast("int")
    placed = with_slots(rows.select("doc_id", "size", "text_crc32", number.alias("shard")))
    return placed.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def with_slots(rows: DataFrame) -> DataFrame:
    """Add ``slot``: the row's place in its shard by ascending id, from 0.

    Rows are dealt by ranges of ids (so one shard is spread over all tasks) and
    sorted by shard and id; a row's slot is its place in its task plus the
    shard's rows in the tasks before, which come from one row a task and shard.
    """
    spark = rows.sparkSession
    bounds = quantile_bounds(rows, "doc_id", shuffle_parts(spark))
    order = ["shard", F.col("doc_id").asc_nulls_first(), "text_crc32"]
    ranged = (
        rows.withColumn("range", bucket_of("doc_id", bounds))
        .repartitionById(len(bounds) + 1, "range")
        .sortWithinPartitions("range", *order)
        .withColumn("place", F.monotonically_increasing_id())
    )
    ranged = stored(ranged, "sharding-ranges")
    parts = ranged.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).collect()
    seen: dict[int, int] = {}
    base = []
    for part in sorted(parts, key=lambda p: (p["shard"], p["range"])):
        base.append((part["range"], part["shard"], seen.get(part["shard"], 0) - part["first"]))
        seen[part["shard"]] = seen.get(part["shard"], 0) + part["n"]
    # One row for each range and shard: ranges are at most the shuffle partitions.
    bases = spark.createDataFrame(base, "range int, shard int, base long")
    return ranged.join(F.broadcast(bases), ["range", "shard"]).withColumn("slot", F.col("place") + F.col("base"))
