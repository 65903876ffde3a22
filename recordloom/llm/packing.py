"""Packing by concatenation and cutting.

All documents, each with its end id, form one stream of ids that is cut every
``length`` ids. Two passes find the cuts: the first encodes every document once,
stores its ids and its place in its partition; the partitions' token totals
(one number a partition) are summed up, and with them each document knows its
global offset. The second pass cuts documents at the multiples of ``length``.
Every sequence but the last is full. Neither pass shuffles a text or its ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import stored
from recordloom.llm.text import chunk_encoder, texts_of


def encode_in_place(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str = "byte") -> DataFrame:
    """Pass 1, stored: ``part``, ``doc_id``, ``before`` (ids before it in the part), ``n_tokens``, ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer_path, kind)
        end = np.array([end_id], encoder.dtype).tobytes()
        before = 0
        for batch in batches:
            ids = [x + end for x in encoder.encode(texts_of(batch.column(2)))]
            counts = np.array([len(x) // encoder.dtype.itemsize for x in ids], np.int64)
            places = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(places), pa.array(counts), pa.array(ids, pa.binary())],
                ["part", "doc_id", "before", "n_tokens", "ids"],
            )

    rows = docs.select(
        F.spark_partition_id().alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    encoded = rows.mapInArrow(run, "part int, doc_id long, before long, n_tokens long, ids binary")
    return stored(encoded, "packing")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    length: int = 2048,
    kind: str = "byte",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document that lies in one sequence.

    ``doc_id``, ``start`` (its document's ids before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence,
    and ``ids`` on request. A document within one sequence has one piece; one
    that crosses a boundary has a boundary record on either side of it.

    A null or empty text is its end id alone. Null ids, repeated rows and ties
    are packed like all others; a very long text is encoded whole and lies in
    many sequences; an empty table has no pieces; other columns are ignored,
    whatever their names.
    """
    encoded = encode_in_place(docs, tokenizer_path, end_id, kind)
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row a partition
    base, at = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        base[row["part"]] = at
        at += row["n"]
    dtype = chunk_encoder(tokenizer_path, kind).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            blobs: list[bytes] = []
            for part, doc, before, count, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(data, dtype).astype("<u4")
                lo, place = 0, base[part] + before
                while lo < count:
                    hi = min(count, lo + length - (place + lo) % length)
                    piece = ids[lo:hi].tobytes()
                    sequence, offset = divmod(place + lo, length)
                    out.append((doc, lo, hi - lo, zlib.crc32(piece), count, sequence, offset))
                    if with_ids:
                        blobs.append(piece)
                    lo = hi
            columns = [pa.array(x, pa.int64()) for x in zip(*out)] or [pa.array([], pa.int64())] * 7
            if with_ids:
                columns.append(pa.array(blobs, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, NAMES[: len(columns)])

    schema = ", ".join(f"{n} long" for n in NAMES[:7]) + ", ids binary" * with_ids
    return encoded.select("part", "doc_id", "before", "n_tokens", "ids").mapInArrow(run, schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """Whole sequences from pieces with ids: ``sequence_id``, ``ids``, ``n_ids``.

    ``ids`` holds little-endian unsigned 32-bit numbers, padded to ``length``
    with ``pad_id``. A sequence has at most ``length`` pieces, so the groups are
    bounded whatever the input.
    """
    joined = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_ids")
    )
    body = F.aggregate("parts", F.lit(b""), lambda held, p: F.concat(held, p["ids"]))
    pad = pad_id.to_bytes(4, "little")
    missing = F.expr(f"cast({length} - n_ids as int)")
    padding = F.unhex(F.repeat(F.lit(pad.hex()), missing))
    return joined.select("sequence_id", F.concat(body, padding).alias("ids"), "n_ids")
