"""Embedding near-duplicates by product quantisation.

1. Vectors equal bit for bit form a class of which one goes on, with its weight.
2. A coarse quantiser (k-means on unit vectors) gives inverted lists; residuals
   to the list's centre are coded by subspace. Both are fitted on a bounded
   sample of classes with the smallest hashes; every class is coded. Each code
   keeps the length of what it loses. Lists grow with the classes at first, then
   with the root of their number, and the sample with the lists.
3. Every class is a query. It probes each list whose bisector with its own
   nearest centre lies within a reach. The reach comes from the data: the sample's
   links, and sampled vectors moved by the threshold's distance as neighbours in
   the sample differ, show how far past a bisector the other end of a link lies; the
   share ``recall`` of them decides. Without ``recall`` the reach is the whole
   difference at the threshold, which provably finds all links but probes most
   lists of evenly spread vectors.
   Lists travel as blocks of bounded size: short near lists share a block, a
   long list is split. A block that more than ``query_block`` queries probe is
   copied once for each such part of its queries; no other is.
4. Within a block the asymmetric distance of query and code comes from lookup
   tables. By the triangle inequality a code farther than the threshold
   distance plus its own loss can't be a link: that drops no link. What is left
   is compared exactly by cosine in double precision.
5. A block returns link counts and, for components, links to the smallest
   member each vector reaches in the block: never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import stored
from recordloom.llm.components import connected_components, linked_groups


def kmeans(points: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    """Centres by Lloyd's rounds from distinct points; fewer if there are fewer points."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.choice(len(points), min(count, len(points)), replace=False))].copy()
    for _ in range(rounds):
        nearest = nearest_of(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=len(centres))
        filled = sizes > 0
        centres[filled] = sums[filled] / sizes[filled, None]
    return centres


def nearest_of(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(axis=1)
    return np.concatenate(
        [(points[lo : lo + 4096] @ centres.T - half).argmax(axis=1) for lo in range(0, len(points), 4096)]
        or [np.zeros(0, np.int64)]
    )


def nested_kmeans(points: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    """Centres for many lists: first groups, then each group's share of the centres."""
    if count <= 2048:
        return kmeans(points, count, rounds, seed)
    groups = kmeans(points, math.isqrt(count), rounds, seed)
    own = nearest_of(points, groups)
    parts = [points[own == g] for g in range(len(groups))]
    return np.concatenate([kmeans(p, max(1, round(count * len(p) / len(points))), rounds, seed) for p in parts if len(p)])


class Quantiser:
    """Coarse centres and residual codebooks, broadcast: centres times components, and codebooks of fixed size."""

    def __init__(self, units: np.ndarray, lists: int, subspaces: int, codewords: int, seed: int = 7):
        self.centres = nested_kmeans(units, lists, 8, seed)
        own = nearest_of(units, self.centres)
        residuals = units - self.centres[own]
        edges = np.linspace(0, units.shape[1], min(subspaces, units.shape[1]) + 1).astype(int)
        self.spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        self.books = [kmeans(residuals[:, a:b], codewords, 8, seed + k) for k, (a, b) in enumerate(self.spans)]

    def _apart(self, own: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Distances of some centres (rows) and others; counted when asked, for all pairs of lists would outgrow the model."""
        a, b = self.centres[own], self.centres[lists]
        squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T
        return np.sqrt(np.maximum(squares, 1e-18))

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and lost length of each vector."""
        own = nearest_of(units, self.centres)
        residuals = units - self.centres[own]
        codes = np.stack([nearest_of(residuals[:, a:b], w) for (a, b), w in zip(self.spans, self.books)], axis=1)
        kept = np.concatenate([w[codes[:, k]] for k, w in enumerate(self.books)], axis=1)
        return own, codes.astype(np.uint8), np.sqrt(((residuals - kept) ** 2).sum(axis=1))

    def probes(self, units: np.ndarray, own: np.ndarray, lists: np.ndarray, reach: float) -> np.ndarray:
        """Which of some lists each vector has to visit: those whose bisector lies within ``reach``."""
        centres = self.centres[lists]
        ahead = ((centres**2).sum(axis=1) - 2 * units @ centres.T) - self._ahead(units, own)[:, None]
        used, at = np.unique(own, return_inverse=True)
        return ahead <= 2 * reach * self._apart(used, lists)[at] + 1e-9

    def reach(self, units: np.ndarray, distance: float, recall: float, seed: int = 3) -> float:
        """How far past bisectors the share ``recall`` of links from these vectors reaches.

        Links are those among the vectors themselves, and made ones: a vector
        moved by ``distance`` the way that one of them lies from a near neighbour,
        so a spread along few directions counts as it is. The larger reach holds.
        """
        rng = np.random.default_rng(seed)
        own = nearest_of(units, self.centres)
        past: list[np.ndarray] = []
        made: list[np.ndarray] = []
        for lo in range(0, len(units), 256):
            here = np.arange(lo, min(lo + 256, len(units)))
            squares = 2 - 2 * units[here] @ units.T
            squares[np.arange(len(here)), here] = np.inf
            q, x = np.nonzero(squares <= distance**2)
            past.append(self._past(units[here[q]], own[here[q]], own[x]))
            if len(units) > 1:
                near = np.argpartition(squares, min(7, len(units) - 2), axis=1)[:, : min(8, len(units) - 1)]
                to = near[np.arange(len(here)), rng.integers(0, near.shape[1], len(here))]
                step = np.roll(units[to] - units[here], 1, axis=0)
                length = np.sqrt((step**2).sum(axis=1))
                moved = units[here] + step * (distance / np.maximum(length, 1e-9))[:, None]
                moved /= np.maximum(np.sqrt((moved**2).sum(axis=1)), 1e-12)[:, None]
                there = nearest_of(moved, self.centres)
                made += [self._past(moved, there, own[here]), self._past(units[here], own[here], there)]
        found = [np.quantile(np.concatenate(x), recall) for x in (past, made) if sum(map(len, x))]
        return float(min(distance, max([0.0, *found])))

    def _past(self, units: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How far each vector lies from the bisector of its own centre and another list's, 0 for its own."""
        gap = self._ahead(units, other) - self._ahead(units, own)
        return np.where(own == other, 0.0, gap / (2 * np.sqrt(np.maximum(((self.centres[own] - self.centres[other]) ** 2).sum(axis=1), 1e-18))))

    def _ahead(self, units: np.ndarray, own: np.ndarray) -> np.ndarray:
        centres = self.centres[own]
        return (centres**2).sum(axis=1) - 2 * np.einsum("ij,ij->i", units, centres)

    def neighbourly(self, per_group: int) -> np.ndarray:
        """The lists in an order that keeps near centres together."""
        groups = kmeans(self.centres, max(1, len(self.centres) // per_group), 5, 1)
        return np.argsort(nearest_of(self.centres, groups), kind="stable")

    def table_distances(self, units: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to codes (both axes), by lookup tables.

        |q - c - r|^2 = |q - c|^2 - 2 (q - c) . r + |r|^2, with the inner
        products of q and the codewords in one table a subspace.
        """
        out = np.zeros((len(units), len(codes)))
        fixed = np.zeros(len(codes))
        for k, ((a, b), words) in enumerate(zip(self.spans, self.books)):
            at = codes[:, k]
            out += (units[:, a:b] @ words.T)[:, at]
            part = words[at]
            fixed += (part**2).sum(axis=1) + 2 * (part * self.centres[lists, a:b]).sum(axis=1)
        out *= -2
        out += fixed
        used, back = np.unique(lists, return_inverse=True)
        centres = self.centres[used]
        squares = (units**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * units @ centres.T
        return out + squares[:, back]


def _units(column: pa.Array, length: int) -> np.ndarray:
    points = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points**2).sum(axis=1))[:, None]


def _usable(embedding: Column) -> Column:
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & sound & F.exists(embedding, lambda x: x != 0)


def _links(
    classes: DataFrame, kind: str, length: int, cosine: float, lists: int | None, subspaces: int, codewords: int,
    sample: int, recall: float | None, block: int, query_block: int,
) -> DataFrame:
    """Rows (node, links, reached) from the blocks, for classes of one vector length."""
    spark = classes.sparkSession
    count = classes.count()
    wanted = lists or max(1, min(count // 50, max(1024, 4 * math.isqrt(count))))
    fitted = classes.orderBy(F.xxhash64("embedding"), "node").limit(max(sample, 8 * wanted)).select("embedding").toArrow()
    points = _units(fitted.column(0).combine_chunks(), length)
    model = Quantiser(points, wanted, subspaces, codewords)
    distance = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    reach = distance if recall is None else model.reach(points[:sample], distance, recall)
    shared = spark.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, codes, lost = shared.value.encode(_units(batch.column(2), length))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lost)],
                ["node", "weight", "embedding", "list", "code", "lost"],
            )

    rows = f"node long, weight long, embedding {kind}"
    coded = stored(classes.select("node", "weight", "embedding").mapInArrow(code, f"{rows}, list int, code binary, lost double"), "pq-codes")
    sizes = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}

    # Blocks: one row a list here. A long list has several blocks, short near ones share one.
    first, many = np.zeros(len(model.centres), np.int64), np.zeros(len(model.centres), np.int64)
    used, filled = 0, block
    for number in model.neighbourly(max(1, block * len(model.centres) // max(1, count))).tolist():
        size = sizes.get(number, 0)
        if size > block:
            first[number], many[number] = used, math.ceil(size / block)
            used, filled = used + math.ceil(size / block), block
        elif size:
            if filled + size > block:
                used, filled = used + 1, 0
            first[number], many[number] = used - 1, 1
            filled += size

    def places(model: Quantiser, units: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each query and a block it probes, each pair once."""
        every = np.nonzero(many)[0]
        row, at = np.nonzero(model.probes(units, own, every, reach))
        times = many[every[at]]
        ends = np.cumsum(times)
        to = np.repeat(first[every[at]], times) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
        pairs = np.unique(np.repeat(row, times) * used + to)
        return pairs // used, pairs % used

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = np.zeros(used, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                piece = batch.slice(lo, 1024)
                asks += np.bincount(places(shared.value, _units(piece.column(0), length), piece.column(1).to_numpy())[1], minlength=used)
        here = np.nonzero(asks)[0]
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(asks[here])], ["block", "n"])

    asks = coded.select("embedding", "list").mapInArrow(probed, "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
    parts = np.ones(used, np.int64)
    for r in asks.collect():  # one row a block
        parts[r["block"]] = math.ceil(r["n"] / query_block)
    begin = np.cumsum(parts) - parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class to its block (once for each part of the block's queries), and as a query to the blocks it probes."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                piece = batch.slice(lo, 1024)
                own = piece.column(3).to_numpy()
                spread = ((piece.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                home = first[own] + spread % many[own]
                stay = np.repeat(np.arange(len(own)), parts[home])
                ends = np.cumsum(parts[home])
                stays = begin[home[stay]] + np.arange(len(stay)) - np.repeat(ends - parts[home], parts[home])
                ask, to = places(shared.value, _units(piece.column(2), length), own)
                goes = begin[to] + (spread[ask] // 64) % parts[to]
                role = np.repeat(np.array([0, 1], np.int32), [len(stay), len(ask)])
                row = pa.array(np.concatenate([stay, ask]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([stays, goes])), pa.array(role), *(c.take(row) for c in piece.columns)],
                    ["block", "role", "node", "weight", "embedding", "list", "code", "lost"],
                )

    dealt = coded.mapInArrow(deal, f"block long, role int, {rows}, list int, code binary, lost double")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        role = table.column("role").to_numpy()
        units = _units(table.column("embedding").combine_chunks(), length)
        nodes = table.column("node").to_numpy()
        here, asks = np.nonzero(role == 0)[0], np.nonzero(role == 1)[0]
        if not len(here) or not len(asks):
            return pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "reached")})
        weight = table.column("weight").to_numpy()
        lists = table.column("list").to_numpy().astype(np.int64)
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(role), -1)
        limit = (distance + table.column("lost").to_numpy()) ** 2 + 1e-9
        links = np.zeros(len(role), np.int64)
        lefts, rights = [], []
        stored_in = np.unique(lists[here])
        for lo in range(0, len(asks), 2048):
            part = asks[lo : lo + 2048]
            wanted = shared.value.probes(units[part], lists[part], stored_in, reach)
            for number, who in zip(stored_in.tolist(), wanted.T):
                queries, held = part[who], here[lists[here] == number]
                if not len(queries):
                    continue
                near = shared.value.table_distances(units[queries], lists[held], codes[held]) <= limit[held]
                q, k = np.nonzero(near & (nodes[queries][:, None] != nodes[held]))
                exact = np.concatenate(
                    [np.einsum("ij,ij->i", units[queries[q[i : i + 65536]]], units[held[k[i : i + 65536]]]) for i in range(0, len(q), 65536)]
                    or [np.zeros(0)]
                )
                q, k = queries[q[exact >= cosine]], held[k[exact >= cosine]]
                if len(q):
                    links += np.bincount(q, weights=weight[k], minlength=len(role)).astype(np.int64)
                    # Pairs become links to the smallest row that each reaches here, so they needn't be held.
                    rows, at = np.unique(np.concatenate([q, k]), return_inverse=True)
                    label = linked_groups(len(rows), at[: len(q)], at[len(q) :])
                    lefts.append(rows)
                    rights.append(rows[label])
        links = links[asks]
        if not lefts:
            return pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "reached")})
        left, right = np.concatenate(lefts), np.concatenate(rights)
        names, at = np.unique(nodes, return_inverse=True)
        label = linked_groups(len(names), at[left], at[right])
        moved = np.nonzero(label != np.arange(len(label)))[0]
        linked = links > 0
        return pa.table(
            {"node": np.concatenate([nodes[asks][linked], names[moved]]),
             "links": np.concatenate([links[linked], np.zeros(len(moved), np.int64)]),
             "reached": np.concatenate([nodes[asks][linked], names[label[moved]]])}
        )

    return dealt.groupBy("block").applyInArrow(compare, "node long, links long, reached long")


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.95,
    lists: int | None = None,
    subspaces: int = 8,
    codewords: int = 256,
    sample: int = 16_384,
    recall: float | None = 0.9999,
    block: int = 2_048,
    query_block: int = 16_384,
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Two vectors are linked when their cosine in double precision is at least
    ``cosine``. Null vectors, zero vectors and those with null or non-finite
    components are linked with nothing; vectors of different lengths are never
    linked. A null id is linked with nothing: its component is null and it is
    kept. Rows of one id and one vector are one vector and each get its result;
    rows of one id with different vectors are vectors of their own. ``n_links``
    counts the ids of equal vectors and those of linked ones. An empty table
    gives an empty result; other columns, the label among them, are ignored.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    usable = F.coalesce(_usable(F.col("embedding")) & F.col("vec_id").isNotNull(), F.lit(False))
    key = [F.when(usable, F.xxhash64(F.lit(k), "embedding")).alias(f"h{k}") for k in (1, 2)]
    rows = stored(rows.select("vec_id", "embedding", *key), "pq-vectors")
    once = rows.filter("h1 is not null").groupBy("h1", "h2", "vec_id").agg(F.first("embedding").alias("embedding"))
    classes = once.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "pq-classes")
    lengths = [r[0] for r in classes.select(F.array_size("embedding").alias("n")).distinct().collect()]
    found = None
    for length in lengths:
        same = classes.filter(F.array_size("embedding") == length)
        part = _links(same, kind, length, cosine, lists, subspaces, codewords, sample, recall, block, query_block)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    found = stored(found, "pq-links")
    edges = found.filter("node <> reached").select(F.col("node").alias("src"), F.col("reached").alias("dst"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = stored(
        classes.select("h1", "h2", "node", "least", "weight").join(counts, "node", "left")
        .join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node")),
        "pq-parts",
    )
    names = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "pq-names")
    named = stored(
        named.join(names, "component")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"),
        "pq-named",
    )
    joined = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
