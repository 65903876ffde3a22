"""Near-duplicate documents by a chosen-path set similarity join.

1. Every text becomes its set of word shingles and a signature of 128 minwise
   values. Documents with equal sets form a class, and one row a class goes on,
   so masses of exact copies cost nothing later.
2. Each of ``trees`` independent trees branches the classes: at a node, the
   node's own hash picks one signature position, sometimes two (1 / similarity
   on average), and a class goes to the child named by its minwise token there.
   Similar sets stay together with high probability, others part. The first
   levels are walked at once; nodes that are still large are branched further,
   level by level. All rows of a node come together by a range sort on (node,
   document), which also splits a huge node over tasks.
3. Small nodes are compared exhaustively on 128-bit sketches (one bit of each
   minwise value), which keeps candidates only. Nodes that stay large at the
   deepest level hold near copies of each other; they are cut into blocks, each
   with the node's ``LEADERS``, which connects most of them cheaply.
4. Candidates are grouped: small groups of candidates as a whole, larger ones
   by their nodes. Each group's full shingle sets are brought together and
   links confirmed exactly, skipping pairs that are connected already.
5. What these blocks left apart in a node that stayed large meets in pairs of
   pieces: all its pairs of documents not connected by then are compared.
6. Connected components over the links give the classes' components.

A pair at the threshold survives the first three levels of one tree with
probability 0.7, so 10 trees miss it with 6e-6. In a node that is still large
after them it has to survive nine levels, with 0.44 a tree, so 10 trees miss it
with 0.003, if no third document connects it. More similar pairs are safer. The
depth stops there because every further level would lose more such pairs; what a
large node still holds then is compared exactly, however large it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import shuffle_parts, stored
from recordloom.llm.components import Forest, connected_components, linked_groups
from recordloom.llm.shingles import mix, shingles
from recordloom.llm.text import texts_of

POSITIONS = 128
LEADERS = 8
PIECE_ROWS = 48
PIECE_SHINGLES = 1_000_000
_RANDOM = np.random.default_rng(20240229)
_XOR = _RANDOM.integers(0, 1 << 32, (POSITIONS, 1), np.uint32)
_ODD = _RANDOM.integers(0, 1 << 31, (POSITIONS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def signature(values: np.ndarray) -> np.ndarray:
    """128 minwise values of a non-empty shingle set, 16 bits of each."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(short), 1024):
        np.minimum(least, ((short[None, lo : lo + 1024] ^ _XOR) * _ODD).min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def sketch(signatures: np.ndarray) -> np.ndarray:
    """Two 64-bit words a row: the lowest bit of each of the 128 values."""
    return np.packbits((signatures & 1).astype(np.uint8), axis=1).view("<u8")


def _set_rows(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``t`` (hash of the text), ``n_shingles``, set digest ``h1``, ``h2``, ``signature``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, found = [], [], []
            for text in texts_of(batch.column(2)):
                values = shingles(text, words)
                counts.append(len(values))
                digests.append(xxhash.xxh3_128_digest(values.tobytes()))
                found.append(signature(values).tobytes() if len(values) else None)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                 pa.array(found, pa.binary())],
                ["doc_id", "t", "n_shingles", "h1", "h2", "signature"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(run, "doc_id long, t long, n_shingles long, h1 long, h2 long, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, POSITIONS)


def _descend(node: np.ndarray, row: np.ndarray, signatures: np.ndarray, extra: float, levels: int):
    """Children of (node, row) pairs after so many levels."""
    for _ in range(levels):
        draw = mix(node ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        first = (draw % np.uint64(POSITIONS)).astype(np.int64)
        second = (first + 1 + (draw >> np.uint64(7)).astype(np.int64) % (POSITIONS - 1)) % POSITIONS
        two = (draw >> np.uint64(40)).astype(np.float64) < extra * (1 << 24)
        node, row, at = np.concatenate([node, node[two]]), np.concatenate([row, row[two]]), np.concatenate([first, second[two]])
        token = signatures[row, at].astype(np.uint64) | (at.astype(np.uint64) << np.uint64(16))
        node = mix(node * np.uint64(0x9E3779B97F4A7C15) + token + np.uint64(1))
    return node, row


NODE_SCHEMA = "node long, doc long, s0 long, s1 long"
NODE_NAMES = ["node", "doc", "s0", "s1"]


def _node_rows(classes: DataFrame, trees: int, levels: int, extra: float) -> DataFrame:
    """Rows (node, doc, sketch) after ``levels`` levels.

    ``classes`` has ``doc``, ``signature`` and, below the first levels, ``node``.
    """
    begun = "node" in classes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                signatures = _matrix(part.column(1))
                docs = part.column(0).to_numpy()
                bits = sketch(signatures).view("<i8")
                rows = np.arange(len(docs))
                if begun:
                    node, row = part.column(2).to_numpy().view(np.uint64), rows
                else:
                    roots = mix(np.arange(1, trees + 1, dtype=np.uint64))
                    node, row = np.repeat(roots, len(docs)), np.tile(rows, trees)
                node, row = _descend(node, row, signatures, extra, levels)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), pa.array(docs[row]), pa.array(bits[row, 0]), pa.array(bits[row, 1])],
                    NODE_NAMES,
                )

    return classes.select("doc", "signature", *["node"] * begun).mapInArrow(run, NODE_SCHEMA)


def _alike(bits: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sketches agree in at least ``cut`` of 128 bits."""
    words = np.ascontiguousarray(bits).view(np.uint64).reshape(-1, 2)
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(words), 256):
        differ = np.bitwise_count(words[lo : lo + 256, None, :] ^ words[None, lo:, :]).sum(axis=2, dtype=np.uint8)
        left, right = np.nonzero(differ <= POSITIONS - cut)
        keep = left < right
        lefts.append(left[keep] + lo)
        rights.append(right[keep] + lo)
    return np.concatenate(lefts), np.concatenate(rights)


def sketch_cut(similarity: float) -> int:
    """Bits that sketches of sets of this similarity share at least, but for 4.5 standard deviations."""
    even = 0.5 + similarity / 2
    return math.floor(POSITIONS * even - 4.5 * math.sqrt(POSITIONS * even * (1 - even)))


def block_name(docs: np.ndarray) -> int:
    """The same number for the same documents, whatever their order."""
    return xxhash.xxh3_64_intdigest(np.sort(docs).tobytes()) - (1 << 63)


CLOSED, OPEN, LARGE, PIECE = 0, 1, 2, 3


def _by_node(rows: DataFrame, limit: int, cut: int, deepest: bool) -> DataFrame:
    """Compare small nodes; rows (kind, block, doc, s0, s1).

    ``CLOSED``: ``block`` names a set of candidates, named by its documents, so
    that the same set from several trees is one block. ``OPEN``: a small run at
    a task's edge, whose node may go on in the next task. ``LARGE``: rows of a
    node beyond ``limit``; at the deepest level they come as ``PIECE`` too, in
    blocks of ``limit`` neighbours in sketch order, with the node in ``s0``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last node so far, at most limit + 1 of them
        first = True
        big = False

        def batch_of(kind, block, rows: np.ndarray) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), pa.array(block if isinstance(block, np.ndarray) else np.full(n, block, np.int64)),
                 *(pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 3))],
                ["kind", "block", "doc", "s0", "s1"],
            )

        def finished(rows: np.ndarray, edge: bool) -> Iterator[pa.RecordBatch]:
            if edge:
                yield batch_of(OPEN, rows[0, 0], rows)
                return
            left, right = _alike(rows[:, 2:4], cut)
            if not len(left):
                return
            label = linked_groups(len(rows), left, right)
            names = np.zeros(len(rows), np.int64)
            count = np.bincount(label, minlength=len(rows))
            for k in np.nonzero(count > 1)[0]:
                inside = label == k
                names[inside] = block_name(rows[inside, 1])
            keep = count[label] > 1
            yield batch_of(CLOSED, names[keep], rows[keep])

        def large(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield batch_of(LARGE, rows[0, 0], rows)
            if deepest:
                for lo in range(0, len(rows), limit):
                    part = rows[lo : lo + limit]
                    named = part.copy()
                    named[:, 2] = part[:, 0]
                    yield batch_of(PIECE, block_name(part[:, 1]), named)

        rest = np.empty((0, 4), np.int64)
        for batch in batches:
            table = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            table = np.concatenate([rest, table]) if len(rest) else table
            starts = np.concatenate([[0], np.nonzero(np.diff(table[:, 0]))[0] + 1])
            ends = np.append(starts[1:], len(table))
            told = np.nonzero((ends - starts)[:-1] > 1)[0].tolist()
            if len(starts) > 1 and told[:1] != [0]:
                told = [0, *told]  # the first run counts even if it is one row
            for at, to in ((int(starts[k]), int(ends[k])) for k in told):
                if to - at > limit or (big and at == 0):
                    yield from large(table[at:to])
                else:
                    yield from finished(table[at:to], first)
                first = big = False
            rest = table[starts[-1] :]
            if len(rest) > 8 * limit:  # a node over many batches goes out in parts
                yield from large(rest[: -limit - 1])
                rest, big = rest[-limit - 1 :], True
        if len(rest):
            if len(rest) > limit or big:
                yield from large(rest)
            else:
                yield from finished(rest, True)

    ordered = rows.repartitionByRange(shuffle_parts(rows.sparkSession), "node", "s0", "doc").sortWithinPartitions(
        "node", "s0", "s1", "doc"
    )
    return ordered.mapInArrow(run, "kind int, block long, doc long, s0 long, s1 long")


def _regrouped(found: DataFrame, limit: int, cut: int) -> tuple[DataFrame, DataFrame]:
    """Blocks from runs at the tasks' edges, and all rows of large nodes.

    There are at most two such runs a task, each of at most ``limit`` rows.
    """
    rows = found.filter(F.col("kind") == OPEN)
    large = found.filter(F.col("kind") == LARGE)
    crowded = large.select("block").distinct().withColumn("crowded", F.lit(True))
    marked = stored(rows.join(crowded, "block", "left"), "near-edges")
    joins = marked.filter("crowded").select("block", "doc", "s0", "s1")

    def run(table: pa.Table) -> pa.Table:
        data = np.stack([table.column(c).to_numpy() for c in ("doc", "s0", "s1")], axis=1)
        left, right = _alike(data[:, 1:], cut)
        label = linked_groups(len(data), left, right)
        names, docs = [], []
        for k in np.nonzero(np.bincount(label, minlength=len(data)) > 1)[0]:
            inside = data[label == k, 0]
            names += [block_name(inside)] * len(inside)
            docs += inside.tolist()
        return pa.table({"block": pa.array(names, pa.int64()), "doc": pa.array(docs, pa.int64())})

    edges = marked.filter("crowded is null").select("block", "doc", "s0", "s1")
    blocks = edges.groupBy("block").applyInArrow(run, "block long, doc long")
    return blocks, large.select("block", "doc", "s0", "s1").unionByName(joins)


def candidate_blocks(
    classes: DataFrame, similarity: float, trees: int, first_levels: int, more_levels: int, limit: int, rounds: int
) -> tuple[DataFrame, DataFrame | None]:
    """``block``, ``doc``: sets of classes that may be linked, from all trees.

    Second, all rows (block, doc, s0, s1) of the nodes that stayed large, those
    at the tasks' edges included; None if there are none.
    """
    extra = 1 / similarity - 1
    cut = sketch_cut(similarity)
    rows = _node_rows(classes, trees, first_levels, extra)
    blocks, crowds = [], None
    for k in range(rounds + 1):
        found = stored(_by_node(rows, limit, cut, k == rounds), "near-nodes")
        blocks.append(found.filter(F.col("kind") == CLOSED).select("block", "doc"))
        edges, large = _regrouped(found, limit, cut)
        blocks.append(edges)
        if found.filter(F.col("kind") == LARGE).isEmpty():
            break
        if k < rounds:
            nodes = large.select(F.col("block").alias("node"), "doc").distinct()
            rows = _node_rows(nodes.join(classes, "doc"), trees, more_levels, extra)
        else:
            crowds = large = stored(large.dropDuplicates(["block", "doc"]), "near-crowds")
            leaders = large.groupBy("block", F.pmod(F.xxhash64("doc"), F.lit(LEADERS)).alias("k")).agg(F.min("doc").alias("lead"))
            piece = found.filter(F.col("kind") == PIECE)
            blocks.append(piece.select("block", "doc"))
            of_node = leaders.select(F.col("block").alias("s0"), F.col("lead").alias("doc"))
            blocks.append(piece.select("block", "s0").distinct().join(of_node, "s0").select("block", "doc"))
    every = blocks[0]
    for more in blocks[1:]:
        every = every.union(more)
    return stored(every.distinct(), "near-blocks"), crowds


def _similar(va: np.ndarray, vb: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach ``percent`` of similarity."""
    na, nb = len(va), len(vb)
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    place = np.searchsorted(vb, va)
    place[place == nb] = nb - 1
    shared = int((vb[place] == va).sum())
    return 100 * shared >= percent * (na + nb - shared)


def _confirmed(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """``src``, ``dst`` (smallest linked document of the block) by exact comparison within blocks."""

    def run(table: pa.Table) -> pa.Table:
        docs = table.column("doc").to_pylist()
        values = [np.frombuffer(x, np.uint64) for x in table.column("values").to_pylist()]
        order = sorted(range(len(docs)), key=lambda k: (len(values[k]), docs[k]))
        forest = Forest(len(docs))
        for i, a in enumerate(order):
            va, na = values[a], len(values[a])
            for b in order[i + 1 :]:
                vb, nb = values[b], len(values[b])
                if 100 * na < percent * nb:
                    break
                if forest.root(a) != forest.root(b) and _similar(va, vb, percent):
                    forest.join(a, b)
        least: dict[int, int] = {}
        for k, doc in enumerate(docs):
            root = forest.root(k)
            least[root] = min(doc, least.get(root, doc))
        pairs = [(doc, least[forest.root(k)]) for k, doc in enumerate(docs)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.table({"src": pa.array([p[0] for p in pairs], pa.int64()), "dst": pa.array([p[1] for p in pairs], pa.int64())})

    return blocks.join(sets, "doc").select("block", "doc", "values").groupBy("block").applyInArrow(run, "src long, dst long")


def _confirmed_wide(sets: DataFrame, wide: DataFrame, members: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links`` and those of large groups, from ``wide`` blocks and ``members`` (node, component, n).

    Their documents are in many blocks each. First every member meets only
    ``LEADERS`` of its group, in pieces of ``PIECE_ROWS``; that connects most. A
    block whose documents are connected by then is left out, as it can't join
    anything; the others are confirmed.
    """
    members = stored(members, "near-members")
    if members.isEmpty():
        return links
    spread = F.xxhash64("node")
    piece = F.xxhash64("component", F.pmod(spread, F.ceil(F.col("n") / PIECE_ROWS)))
    placed = members.select("component", "node", piece.alias("block"))
    leaders = members.groupBy("component", F.pmod(spread, F.lit(LEADERS)).alias("k")).agg(F.min("node").alias("doc"))
    led = placed.select("component", "block").distinct().join(leaders, "component").select("block", "doc")
    found = stored(_confirmed(sets, placed.select("block", F.col("node").alias("doc")).union(led).distinct(), percent), "near-links")
    parts = connected_components(found).withColumnRenamed("node", "doc")
    named = wide.join(parts, "doc", "left").select("block", "doc", F.coalesce("component", "doc").alias("c"))
    named = stored(named, "near-named")
    apart = named.groupBy("block").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b")
    rest = named.join(stored(apart.select("block"), "near-open"), "block").select("block", "doc")
    return links.union(found).union(_confirmed(sets, rest, percent))


def _rooms(crowds: DataFrame, piece_rows: int) -> DataFrame:
    """``room``, ``doc``, ``s0``, ``s1``: where all pairs have to meet.

    Nodes of several trees that share documents are one room if all its pairs
    are no more than those of its nodes one by one, or if its pieces hold fewer
    rows than its nodes do and its pairs are at most 16 times theirs: a sketch
    costs less to compare than a row to ship. Else each is its own.
    """
    sizes = stored(crowds.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lead")), "near-nodes")
    ends = crowds.join(sizes, "block").select(F.col("doc").alias("src"), F.col("lead").alias("dst"))
    parts = stored(connected_components(ends), "near-parts")
    whole = parts.groupBy("component").agg(F.count(F.lit(1)).alias("all"))
    apart = sizes.join(parts.withColumnRenamed("node", "lead"), "lead").select("block", "component", F.col("n").cast("double").alias("n"))
    pairs = apart.groupBy("component").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("pairs"))
    square = F.col("all").cast("double") * F.col("all")
    lighter = (F.col("all") * F.ceil(F.col("all") / piece_rows) <= F.col("rows")) & (square <= 16 * F.col("pairs"))
    joint = pairs.join(whole, "component").filter((square <= F.col("pairs")) | lighter)
    one = stored(apart.join(joint.select("component", F.lit(True).alias("joint")), "component", "left"), "near-joint")
    room = F.when(F.col("joint"), F.xxhash64(F.lit("joint"), "component")).otherwise(F.xxhash64("block"))
    rows = crowds.join(one.select("block", room.alias("room")), "block").select("room", "doc", "s0", "s1")
    return rows.dropDuplicates(["room", "doc"])


def _pieces(rows: DataFrame, piece_rows: int) -> DataFrame:
    """``room``, ``piece``, ``doc``, ``c``, ``s0``, ``s1``: pieces of a room's rows in the order of ``c``.

    A new piece begins with a room and wherever the number of rows before, of
    all rooms, passes a multiple of ``piece_rows`` or that of their shingles one
    of ``PIECE_SHINGLES``. So pieces are the same over any number of tasks: rows
    are counted within ranges, whose totals (one row a range) come on top.
    """
    names = ["room", "doc", "c", "s0", "s1", "part", "n", "held", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = batch.column(5).to_numpy()
            up_to = np.cumsum(size) + held
            at = np.arange(n, n + len(size))
            columns = [np.full(len(size), part), at, up_to - size, size]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(c, pa.int64()) for c in columns]], names)
            n += len(size)
            held = int(up_to[-1]) if len(size) else held

    order = ["room", "c", "doc"]
    ordered = rows.select("room", "doc", "c", "s0", "s1", "size").repartitionByRange(shuffle_parts(rows.sparkSession), *order)
    counted = ordered.sortWithinPartitions(*order).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    counted = stored(counted, "near-counted")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("all"))
    totals = totals.select("part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("rows", "all")])
    by_rows = F.floor((F.col("rows") + F.col("n")) / piece_rows).cast("long")
    by_shingles = F.floor((F.col("all") + F.col("held")) / PIECE_SHINGLES).cast("long")
    piece = F.shiftleft(by_rows, 31).bitwiseOR(by_shingles)
    return counted.join(totals, "part").select("room", piece.alias("piece"), "doc", "c", "s0", "s1")


def _confirmed_apart(
    sets: DataFrame, crowds: DataFrame, links: DataFrame, sizes: DataFrame, percent: int, piece_rows: int
) -> DataFrame:
    """Links among the documents of large nodes that ``links`` leave apart.

    A room's rows are cut into pieces in the order of their components; every
    two pieces meet, unless all their rows are connected, so that one task never
    holds more than two pieces and a huge room spreads over all tasks.
    """
    parts = connected_components(links).withColumnRenamed("node", "doc")
    rows = _rooms(crowds, piece_rows).join(parts, "doc", "left").join(sizes, "doc", "left").withColumn("c", F.coalesce("component", "doc"))
    rows = stored(rows.drop("component"), "near-rooms")
    groups = rows.groupBy("room", "c").agg(F.count(F.lit(1)).alias("n"))
    open_rooms = groups.groupBy("room").agg(F.count(F.lit(1)).alias("cs")).filter("cs > 1").select("room")
    rows = rows.join(stored(open_rooms, "near-open-rooms"), "room", "left_semi")
    rows = stored(_pieces(rows, piece_rows), "near-pieces")
    pieces = stored(rows.groupBy("room", "piece").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "near-spans")
    left, right = (pieces.select("room", *[F.col(c).alias(f"{c}{k}") for c in ("piece", "lo", "hi")]) for k in (0, 1))
    met = left.join(right, "room").filter("piece0 <= piece1 and least(lo0, lo1) <> greatest(hi0, hi1)")
    met = stored(met.select("room", "piece0", "piece1"), "near-met")
    sides = [met.withColumn("side", F.lit(k)).withColumn("piece", F.col(f"piece{k}")) for k in (0, 1)]
    sides[1] = sides[1].filter("piece0 <> piece1")
    placed = sides[0].union(sides[1]).join(rows, ["room", "piece"])
    block, same = F.xxhash64("room", "piece0", "piece1").alias("block"), (F.col("piece0") == F.col("piece1")).alias("same")
    placed = placed.select(block, same, "side", "doc", "c", "s0", "s1")
    cut = sketch_cut(percent / 100)

    def alike(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs of both sides (of one piece: all) that aren't connected and whose sketches agree."""
        i, j = _alike(np.stack([table.column(c).to_numpy() for c in ("s0", "s1")], axis=1), cut)
        c, side = table.column("c").to_numpy(), table.column("side").to_numpy()
        keep = (c[i] != c[j]) & (table.column("same")[0].as_py() | (side[i] != side[j]))
        return i[keep], j[keep]

    kind = "block long, same boolean, side int, doc long, c long, s0 long, s1 long"

    def hopeful(table: pa.Table) -> pa.Table:
        return table.take(pa.array(np.unique(np.concatenate(alike(table)))))

    def run(table: pa.Table) -> pa.Table:
        docs = table.column("doc").to_pylist()
        values = [np.frombuffer(x, np.uint64) for x in table.column("values").to_pylist()]
        _, c = np.unique(table.column("c").to_numpy(), return_inverse=True)
        forest, src, dst = Forest(len(docs)), [], []
        for i, j in zip(*(x.tolist() for x in alike(table))):
            if forest.root(int(c[i])) != forest.root(int(c[j])) and _similar(values[i], values[j], percent):
                forest.join(int(c[i]), int(c[j]))
                src.append(docs[i])
                dst.append(docs[j])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    left = stored(placed.groupBy("block").applyInArrow(hopeful, kind), "near-hopeful")
    full = left.join(sets, "doc").select(*left.columns, "values")
    return links.union(stored(full.groupBy("block").applyInArrow(run, "src long, dst long"), "near-met-links"))


#: Bits of the map of wanted documents: 8 MB at any number of documents.
MAP_BITS = 1 << 26


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``doc``, ``values``: the full sets of the ``wanted`` (doc_id, t, doc) documents.

    A bit map of fixed size keeps most other texts out where they are read; a
    fuller map lets more of them through, which the join then drops. Sets are
    shuffled once.
    """
    spark = docs.sparkSession
    bit = lambda: F.pmod(F.xxhash64(F.lit(11), "doc_id", "t"), F.lit(MAP_BITS))
    marked = wanted.select(bit().alias("bit"))
    marked = marked.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bits"))
    found = marked.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MAP_BITS / 64 rows
    table = np.zeros(MAP_BITS // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(table)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy()
            held = batch.filter(pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1))
            values = [shingles(t, words).tobytes() for t in texts_of(held.column(2))]
            yield pa.RecordBatch.from_arrays([held.column(0), held.column(1), pa.array(values, pa.binary())], ["doc_id", "t", "values"])

    rows = docs.filter("doc_id is not null and text is not null").withColumn("t", F.xxhash64("text"))
    rows = rows.select("doc_id", "t", "text", bit().alias("bit")).mapInArrow(full, "doc_id long, t long, values binary")
    return rows.dropDuplicates(["doc_id", "t"]).join(wanted.select("doc_id", "t", "doc"), ["doc_id", "t"]).select("doc", "values")


#: Shingles of a group that one task may compare as a whole (32 MB); larger groups go by their nodes.
WHOLE_SHINGLES = 4_000_000


def _judged(
    docs: DataFrame, words: int, percent: int, trees: int, first_levels: int, more_levels: int, limit: int, rounds: int, whole: int,
    piece: int,
) -> DataFrame:
    """``doc_id``, ``t`` (hash of the text), ``n_shingles``, ``part`` (number of the component), ``component_id`` of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(_set_rows(docs, words), "near-sets")
    classes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "t")).alias("least"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature")
    )
    # An id may have several texts, so a class has a number of its own.
    classes = stored(classes.select("h1", "h2", "least", "size", "signature", F.monotonically_increasing_id().alias("doc")), "near-classes")
    blocks, crowds = candidate_blocks(classes, percent / 100, trees, first_levels, more_levels, limit, rounds)
    stars = blocks.join(stored(blocks.groupBy("block").agg(F.min("doc").alias("lead")), "near-leads"), "block")
    guess = connected_components(stars.select(F.col("doc").alias("src"), F.col("lead").alias("dst")))
    guess = stored(guess.join(classes.select(F.col("doc").alias("node"), "size"), "node"), "near-guess")
    sizes = stored(guess.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")), "near-sizes")
    sized = stored(guess.join(sizes, "component"), "near-sized")
    small = (F.col("n") <= whole) & (F.col("all") <= WHOLE_SHINGLES)
    groups = sized.filter(small & (F.col("n") > 1)).select(F.col("component").alias("block"), F.col("node").alias("doc"))
    wide_rows = sized.filter(~small & (F.col("n") > 1))
    wide = blocks.join(wide_rows.select(F.col("node").alias("doc")), "doc", "left_semi")
    wanted = stored(
        classes.join(sized.filter("n > 1").select(F.col("node").alias("doc")), "doc", "left_semi")
        .select("doc", F.col("least.doc_id").alias("doc_id"), F.col("least.t").alias("t")),
        "near-wanted",
    )

    sets = stored(_full_sets(docs, wanted, words), "near-full")
    links = stored(_confirmed(sets, groups, percent), "near-links")
    links = _confirmed_wide(sets, wide, wide_rows.select("component", "node", "n"), links, percent)
    if crowds is not None:  # the small groups were compared as a whole above
        crowds = crowds.join(wide_rows.select(F.col("node").alias("doc")), "doc", "left_semi")
        sizes = wide_rows.select(F.col("node").alias("doc"), "size")
        links = _confirmed_apart(sets, crowds, stored(links, "near-links"), sizes, percent, piece)
    parts = connected_components(links).withColumnRenamed("node", "doc")
    labels = stored(
        classes.select("h1", "h2", "doc", "least.doc_id").join(parts, "doc", "left")
        .select("h1", "h2", "doc_id", F.coalesce("component", "doc").alias("component")),
        "near-labels",
    )
    names = stored(labels.groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-names")
    named = stored(labels.join(names, "component").select("h1", "h2", F.col("component").alias("part"), "component_id"), "near-named")
    joined = rows.drop("signature").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "t", "n_shingles", "part", component.alias("component_id"))


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    trees: int = 10,
    first_levels: int = 3,
    more_levels: int = 3,
    limit: int = 64,
    rounds: int = 2,
    whole: int = 256,
    piece: int = 1_024,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked when 100 * |intersection| >= ``percent`` * |union|
    of their sets of ``words``-word shingles; a component is what links reach,
    named by its smallest id, and only that document is kept.

    A text of fewer words is one shingle; a null text or one without words has
    no set, is linked with nothing and is kept. A document with a null id is
    linked with nothing: ``component_id`` is null and it is kept. Repeated rows
    are copies like any others; rows of one id with different texts are
    documents of their own. Very long texts are used whole. An empty table
    gives an empty result; other columns are ignored. ``trees`` and the levels
    set the recall of candidates; confirmation is exact on 64-bit shingle hashes.
    """
    judged = _judged(docs, words, percent, trees, first_levels, more_levels, limit, rounds, whole, piece)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return judged.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(
    docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 10, first_levels: int = 3, more_levels: int = 3,
    limit: int = 64, rounds: int = 2, whole: int = 256, piece: int = 1_024,
) -> DataFrame:
    """``docs`` with one row of each component, one of its smallest id; all columns stay.

    Of several rows of that id in the component one stays: of different texts
    the one of the smallest hash, of equal texts any. Rows that are linked with
    nothing stay: those with a null id and those whose text is null or without
    words, repeated or not. An id whose texts lie in different components keeps
    one row for each component that it names. Very long texts are compared
    whole, an empty table stays empty and clashing columns are only passed on.

    What goes is joined by a hash table a task, so texts aren't sorted; only
    rows whose id and text occur again are grouped.
    """
    judged = _judged(docs, words, percent, trees, first_levels, more_levels, limit, rounds, whole, piece)
    texts = judged.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "part", "component_id", "t")
    texts = stored(texts.agg(F.count(F.lit(1)).alias("n")), "near-texts")
    named = texts.filter("doc_id = component_id")
    first = stored(named.groupBy("doc_id", "part").agg(F.min("t").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "near-first")
    other = named.join(first, ["doc_id", "part"]).filter("t <> first")
    gone = texts.filter("doc_id <> component_id").select("doc_id", "t").union(other.select("doc_id", "t"))
    again = stored(named.filter("n > 1").select("doc_id", "t").join(gone, ["doc_id", "t"], "left_anti"), "near-again")
    marks = gone.withColumn("_gone", F.lit(True)).union(again.withColumn("_gone", F.lit(False)))
    marks = stored(marks.toDF("_id", "_t", "_gone"), "near-marks")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_t", F.xxhash64(F.col("text").cast("string")))
    marked = hashed.join(marks.hint("shuffle_hash"), ["_id", "_t"], "left")
    once = marked.filter("_gone is null").select(*columns)
    if again.isEmpty():
        return once
    repeated = marked.filter("not _gone").dropDuplicates(["_id", "_t"]).select(*columns)
    return once.union(repeated)
