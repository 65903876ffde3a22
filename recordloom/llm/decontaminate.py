"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has next to no Jaccard similarity to
it, so the sketch is taken of the item only and sought in the document's whole
set. Items are partitioned by the size of their shingle sets. The MinHash sketch
of an item of m shingles is its m - ceil(t * m) + 1 shingles with the smallest
hashes: a document that contains at least the share t of the item lacks at most
m - ceil(t * m) shingles, so it holds one of these, and no true pair is missed.
A document looks only into the partitions whose smallest items it could contain
by its own size. Candidates are verified exactly on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import stored
from recordloom.llm.shingles import mix, shingles
from recordloom.llm.text import texts_of

#: Item shingles that are sent to the tasks at once (8 MB); more items go in more passes.
ITEM_BLOCK = 1_000_000


def least_shared(size: int, percent: int) -> int:
    return -(-size * percent // 100)


class ItemIndex:
    """Sketches of the items of one block, merged up to each size partition."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int):
        self.percent = percent
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        self.bounds: list[int] = []  # smallest count of shingles that can hold an item of the partition
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_size: dict[int, list[int]] = {}
        for k, values in enumerate(self.sets):
            by_size.setdefault(int(math.log2(len(values))), []).append(k)
        hashes, owners = [], []
        for level in sorted(by_size):
            for k in by_size[level]:
                values = self.sets[k]
                ranked = values[np.argsort(mix(values), kind="stable")]
                kept = ranked[: len(values) - least_shared(len(values), percent) + 1]
                hashes.append(kept)
                owners.append(np.full(len(kept), k))
            every, owner = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            bits = max(16, int(len(every)).bit_length() + 5)
            seen = np.zeros(1 << bits, bool)
            seen[every & np.uint64((1 << bits) - 1)] = True
            self.bounds.append(least_shared(1 << level, percent))
            self.tables.append((every, owner, seen))

    def found(self, values: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its shingles, shared ones) of the items a sorted distinct set contains."""
        level = np.searchsorted(self.bounds, len(values), side="right") - 1
        if level < 0:
            return []
        every, owner, seen = self.tables[level]
        hit = values[seen[values & np.uint64(len(seen) - 1)]]
        lo, hi = np.searchsorted(every, hit), np.searchsorted(every, hit, side="right")
        items = sorted({int(k) for a, b in zip(lo.tolist(), hi.tolist()) for k in owner[a:b]})
        out = []
        for k in items:
            mine = self.sets[k]
            at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
            shared = int((values[at] == mine).sum())
            if 100 * shared >= self.percent * len(mine):
                out.append((self.ids[k], len(mine), shared))
        return out


def _item_blocks(items: DataFrame, words: int, percent: int) -> Iterator:
    """Broadcast indexes of about ``ITEM_BLOCK`` shingles each, one after another."""
    spark = items.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingles(t, words) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(v) for v in values], pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())],
                ["item_id", "n", "values"],
            )

    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    known = stored(wanted.distinct().mapInArrow(sets, "item_id long, n long, values binary").filter("n > 0"), "items")
    blocks = math.ceil((known.agg(F.sum("n")).first()[0] or 0) / ITEM_BLOCK)
    for k in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("item_id", "values"), F.lit(blocks)) == k).collect()
        pairs = [(r["item_id"], np.frombuffer(bytes(r["values"]), np.uint64)) for r in rows]
        if pairs:
            pairs.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1].tobytes()))
            yield spark.sparkContext.broadcast(ItemIndex(pairs, percent))


def contained_items(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Pairs of a document and a test item in it: ``doc_id``, ``item_id``, ``item_shingles``, ``shared``.

    An item is in a document when the document has at least ``percent`` % of the
    item's distinct ``words``-word shingles (words are cut at ASCII white space,
    A-Z lower-cased). A text with fewer words is one shingle as a whole, so a
    very short item matches only documents that consist of it. Null texts and
    texts without words match nothing, null ids are kept as they are. Repeated
    documents each have their rows; items that share an id and text count once.
    Very long texts are searched whole. An empty table on either side gives an
    empty result; other columns are ignored, whatever their names. Documents are read once for each block of items, without a shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, item_shingles long, shared long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _item_blocks(items, words, percent):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [
                    (doc, *pair)
                    for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)))
                    for pair in index.value.found(shingles(text, words))
                ]
                columns = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "item_shingles", "shared"]
                )

        out = out.union(docs.mapInArrow(search, schema))
    return out


def decontaminated(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that contain a test item; all columns stay.

    Rows are dropped where they are read: nothing is joined or shuffled. Each
    row is judged by its own text, so repeated rows and rows of one id share no
    fate unless their texts do; null and empty texts and null ids stay; exactly
    ``percent`` % is enough; very long texts are searched whole. An empty table
    on either side drops nothing; clashing columns are only passed on.
    """
    at = docs.columns.index("text")
    for index in _item_blocks(items, words, percent):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not index.value.found(shingles(t, words)) for t in texts_of(batch.column(at))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
