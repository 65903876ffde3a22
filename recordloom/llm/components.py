"""Connected components by repeated contraction, for any number of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for the nodes of ``edges(src, dst)``.

    In each round every node points to the first of its neighbours and itself,
    and the graph is contracted to the nodes pointed at: first by id, which
    folds stars around their smallest node at once, then by the ids' hashes,
    which shrinks paths too by a constant factor, so the rounds grow with the
    logarithm of the nodes. Sums by node are pre-aggregated; in the joins one
    side is a stored table with one row a node, so that Spark can split a hub's
    rows over tasks.

    Links of a node to itself are ignored but keep the node; null ends are
    dropped; an empty table has no nodes.
    """
    graph = stored(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).dropna(), "links")
    pointers: list[DataFrame] = []
    while not graph.isEmpty():
        both = graph.union(graph.select("dst", "src")).toDF("node", "other")
        if pointers:
            rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
            near = both.groupBy("node").agg(F.min(rank("other")).alias("m"))
            to = near.select("node", F.least("m", rank("node"))["v"].alias("to"))
        else:
            to = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("m", "node").alias("to"))
        to = stored(to, "pointers")
        pointers.append(to)
        ends = [to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("src", "dst")]
        graph = stored(
            graph.join(ends[0], "src").join(ends[1], "dst").filter("src_to <> dst_to")
            .select(F.least("src_to", "dst_to").alias("src"), F.greatest("src_to", "dst_to").alias("dst")).distinct(),
            "links",
        )
    if not pointers:
        return graph.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    labels = pointers[0].withColumnRenamed("to", "label")
    for to in pointers[1:]:
        labels = labels.join(to.withColumnRenamed("node", "label"), "label", "left")
        labels = labels.select("node", F.coalesce("to", "label").alias("label"))
    labels = stored(labels, "labels")
    least = stored(labels.groupBy("label").agg(F.min("node").alias("component")), "smallest")
    return labels.join(least, "label").select("node", "component")


class Forest:
    """Union of small whole numbers inside one task."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def linked_groups(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``size`` nodes under links between index arrays."""
    label = np.arange(size)
    while len(left):
        least = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, least)
        np.minimum.at(after, right, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label
