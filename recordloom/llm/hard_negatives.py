"""Hard negatives by Kronecker-packed products.

Components become whole numbers. Several candidates' components, made
non-negative by a bias, are packed side by side into the fields of one wide
integer for each dimension, wide enough that sums of products never spill into
the next field. An anchor then multiplies once per component: the sum over
dimensions of (its component x the wide integer) holds the exact scores of all
packed candidates, which are unpacked and freed from the bias.

Anchors meet all rows in cells of (block of anchors, stripe of rows), two
tables dealt by the cell's number: a task never holds more than one cell, no
side is broadcast and no label's rows come together anywhere. Each cell keeps
the best of its rows for each anchor, so what is shuffled on is a few rows an
anchor and stripe. First the anchors' positives are found, in packs of their
own label; then, with the band known, the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import shuffle_parts, stored

#: Rows in one wide integer; numbers of an anchor block and of a stripe of rows.
PACK = 4_096
ANCHOR_NUMBERS = 1 << 20
STRIPE_NUMBERS = 1 << 22


class Packed:
    """Rows of whole numbers, one wide integer a dimension; ``least`` is at most every number, also of anchors."""

    def __init__(self, rows: np.ndarray, least: int, width: int):
        biased = rows.astype(np.int64) - least
        self.count, self.width, self.least = len(rows), width, least
        self.wide = [int.from_bytes(np.ascontiguousarray(biased[:, k]).astype(f"<u{width}").tobytes(), "little") for k in range(rows.shape[1])]
        self.bias = least * biased.sum(axis=1) + rows.shape[1] * least * least

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products with an anchor, whose numbers come less ``least``."""
        total = sum(map(mul, anchor, self.wide))
        fields = np.frombuffer(total.to_bytes(self.count * self.width, "little"), f"<u{self.width}")
        return fields.astype(np.int64) + (self.bias + self.least * sum(anchor))


def field_width(dims: int, least: int, most: int) -> int:
    """Bytes that hold a sum of ``dims`` products of biased numbers: 4 or 8."""
    bits = (max(dims, 1) * (most - least) ** 2).bit_length()
    if bits > 56:
        raise ValueError(f"scores of {dims} components from {least} to {most} may not fit")
    return 4 if bits <= 32 else 8


def best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest scores, ties by smaller id."""
    at = np.arange(len(scores))
    if len(scores) > count:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[-count])
    return at[np.lexsort((ids[at], -scores[at]))[:count]]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks] or [np.zeros(0, np.int32)]).reshape(-1, dims)


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _rows(vectors: DataFrame, is_anchor: Column, id_col: str, label_col: str, vector_col: str, scale: int):
    """Distinct rows (id, label, q, n, h, anchor) of whole numbers, their dimensions and bounds; None without rows."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter("id is not null and label is not null and v is not null").filter(F.forall("v", finite))
    ends = rows.agg(F.max(F.array_size("v")).alias("dims"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    if ends["dims"] is None:
        return None
    low, high = (math.floor(scale * (ends[c] or 0.0)) for c in ("low", "high"))
    dims, least, most = max(ends["dims"], 1), min(low, 0), max(high, 0)
    field_width(dims, least, most)
    whole = F.transform("v", lambda x: F.floor(x * float(scale)).cast("int"))
    padded = F.concat(whole, F.array_repeat(F.lit(0), F.lit(dims) - F.array_size("v")))
    rows = rows.select("id", "label", "anchor", F.when(F.array_size("v") < dims, padded).otherwise(whole).alias("q"))
    alike = rows.groupBy("id", "label", "q").agg(F.count(F.lit(1)).alias("n"), F.max("anchor").alias("anchor"))
    return stored(alike.withColumn("h", F.xxhash64("id", "label", "q")), "negative-rows"), dims, least, most


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90),
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    A component x counts as floor(scale * x); the score of a row is its inner
    product with the anchor. An anchor's positives are the ``positives`` best
    other rows of its label; for each of them come the ``negatives`` best rows of
    other labels whose score lies within ``band`` per cent of the positive's.
    Ties go to the smaller id.

    Rows with a null id, label or vector, or with a null, NaN or infinite
    component take no part. Shorter vectors count as padded with zeros. Repeated
    rows are rows of their own: a copy of the anchor may be its positive, and a
    repeated anchor gives its rows as often. An empty table, or one without
    anchors, gives an empty result; other columns are ignored, whatever their
    names. Where a score could need more than 56 bits the call fails.
    """
    spark = vectors.sparkSession
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    found = _rows(vectors, is_anchor, id_col, label_col, vector_col, scale)
    if found is None:
        return spark.createDataFrame([], kind)
    rows, dims, least, most = found
    width = field_width(dims, least, most)
    sizes = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if("anchor").alias("anchors")).first()
    blocks = max(1, math.ceil(sizes["anchors"] * dims / ANCHOR_NUMBERS))
    parts = shuffle_parts(spark)
    stripes = max(math.ceil(sizes["all"] * dims / STRIPE_NUMBERS), min(parts, math.ceil(sizes["all"] / PACK)), 1)
    tasks = min(blocks * stripes, 8 * parts)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block, stripe = F.pmod("h", F.lit(blocks)).cast("int"), F.pmod(F.shiftright("h", 24), F.lit(stripes)).cast("int")
    met = rows.select(stripe.alias("stripe"), spread(blocks).alias("block"), "id", "label", "h", "n", "q")
    met = met.toDF(*met.columns).repartition(tasks, "block", "stripe")

    def cells(anchors: DataFrame, run, schema: str) -> DataFrame:
        placed = anchors.withColumn("block", block).withColumn("stripe", spread(stripes)).repartition(tasks, "block", "stripe")
        return placed.groupBy("block", "stripe").cogroup(met.groupBy("block", "stripe")).applyInArrow(run, schema)

    def packs(ids: np.ndarray, q: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, Packed]]:
        chosen = chosen[np.argsort(ids[chosen], kind="stable")]
        for lo in range(0, len(chosen), PACK):
            at = chosen[lo : lo + PACK]
            yield at, Packed(q[at], least, width)

    def nearest(anchors: pa.Table, others: pa.Table) -> pa.Table:
        aid, ah, alabel = _numbers(anchors, "id", "h", "label")
        ids, h, label, n = _numbers(others, "id", "h", "label", "n")
        biased, q = _matrix(anchors.column("q"), dims).astype(np.int64) - least, _matrix(others.column("q"), dims)
        made: list[list] = [[] for _ in range(5)]
        for own in np.unique(alabel):
            for at, packed in packs(ids, q, np.flatnonzero(label == own)):
                for k in np.flatnonzero(alabel == own):
                    times = n[at] - ((ids[at] == aid[k]) & (h[at] == ah[k]))  # the anchor itself isn't another row
                    scores = packed.scores(biased[k].tolist())
                    there = np.flatnonzero(times > 0)
                    top = there[best(scores[there], ids[at][there], positives)]
                    for held, new in zip(made, (np.full(len(top), aid[k]), np.full(len(top), ah[k]), ids[at][top], scores[top], times[top])):
                        held.append(new)
        names = ["anchor_id", "h", "positive_id", "score", "times"]
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in zip(names, made)})

    def banded(anchors: pa.Table, others: pa.Table) -> pa.Table:
        aid, ah, alabel = _numbers(anchors, "id", "h", "label")
        ids, label, n = _numbers(others, "id", "label", "n")
        biased, q = _matrix(anchors.column("q"), dims).astype(np.int64) - least, _matrix(others.column("q"), dims)
        wanted = [[(p, -(-band[0] * p // 100), band[1] * p // 100) for p in ps] for ps in anchors.column("scores").to_pylist()]
        held: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for at, packed in packs(ids, q, np.arange(len(ids))):
            for k, bands in enumerate(wanted):
                scores = packed.scores(biased[k].tolist())
                scores[label[at] == alabel[k]] = -1 << 62
                for p, low, high in bands:
                    old = held.get((k, p))
                    if old is not None and len(old[0]) == negatives:
                        low = max(low, int(old[1][-1]))
                    there = np.flatnonzero((scores >= low) & (scores <= high))
                    if not len(there):
                        continue
                    new = ids[at][there], scores[there], n[at][there]
                    if old is not None:
                        new = tuple(np.concatenate(x) for x in zip(old, new))
                    top = best(new[1], new[0], negatives)
                    held[k, p] = tuple(x[top] for x in new)
        columns = {
            "anchor_id": [np.full(len(v[0]), aid[k]) for (k, _), v in held.items()], "h": [np.full(len(v[0]), ah[k]) for (k, _), v in held.items()],
            "positive_score": [np.full(len(v[0]), p) for (_, p), v in held.items()],
            "negative_id": [v[0] for v in held.values()], "score": [v[1] for v in held.values()], "times": [v[2] for v in held.values()],
        }
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in columns.items()})

    def first(found: DataFrame, by: list[str], named: str, count: int) -> DataFrame:
        """The best ``count`` rows, repeated ones as often as they occur, numbered from 1."""
        every = found.select("*", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(count)).cast("int"))).alias("copy"))
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), named))
        return every.withColumn("rank", place).filter(F.col("rank") <= count).drop("copy", "times")

    anchors = rows.filter("anchor").select("id", "label", "h", "q")
    near = cells(anchors, nearest, "anchor_id long, h long, positive_id long, score long, times long")
    near = stored(first(near, ["anchor_id", "h"], "positive_id", positives), "negative-positives")
    scored = near.groupBy(F.col("anchor_id").alias("id"), "h").agg(F.collect_set("score").alias("scores"))  # at most ``positives``
    far = cells(anchors.join(scored, ["id", "h"]), banded, "anchor_id long, h long, positive_score long, negative_id long, score long, times long")
    far = stored(first(far, ["anchor_id", "h", "positive_score"], "negative_id", negatives), "negative-found")
    times = rows.filter("anchor").select(F.col("id").alias("anchor_id"), "h", "n")
    pairs = near.select("anchor_id", "h", "positive_id", F.col("score").alias("positive_score"))
    joined = pairs.join(times, ["anchor_id", "h"]).join(far, ["anchor_id", "h", "positive_score"])
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return repeated.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
