"""Token ids in binary form, compressed document by document.

A store is a folder of Parquet files whose rows are packs: about 1 MiB of
independently compressed frames of consecutive documents, one frame each.
Beside the payload a pack keeps its offset index (ids, frame ends, token
counts), the shard and place it has in the order, and the hash of the shared
dictionary. A reader that wants one short document reads the index columns,
slices one payload and decompresses one frame.

The zstandard dictionary is trained once on the serialized ids of a bounded
sample (``dictionary_docs`` documents of at most ``dictionary_doc_bytes``
bytes, those with the smallest hashes of their ids) and lies in the store as a
one-row table; without it small frames would hardly shrink.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import bucket_of, quantile_bounds, shuffle_parts
from recordloom.llm.text import chunk_encoder, texts_of

PACK_BYTES = 1 << 20

PACK_SCHEMA = (
    "shard int, pack long, first_doc long, last_doc long, shard_start long, n_tokens long, doc_ids array<long>, "
    "ends array<long>, counts array<long>, dictionary_hash long, id_bytes int, payload binary"
)


def _encoded(docs: DataFrame, path: str, kind: str, end_id: int, dictionary: bytes) -> DataFrame:
    """Rows of id, token count and compressed frame; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path, kind)
        end = np.array([end_id], encoder.dtype).tobytes()
        packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(shared.value))
        for batch in batches:
            ids = [x + end for x in encoder.encode(texts_of(batch.column(1)))]
            counts = [len(x) // encoder.dtype.itemsize for x in ids]
            frames = pa.array([packer.compress(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), frames], ["doc_id", "n_tokens", "frame"]
            )

    return docs.mapInArrow(run, "doc_id long, n_tokens long, frame binary")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _train(docs: DataFrame, path: str, kind: str, size: int, docs_most: int, doc_bytes: int) -> bytes:
    """The shared dictionary; empty when there is too little to train on."""
    fitting = docs.filter(F.octet_length("text").between(1, doc_bytes))
    chosen = (
        docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_most)
    )
    sample = fitting.join(F.broadcast(chosen), "doc_id").select("text")  # at most docs_most ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = chunk_encoder(path, kind).encode(texts_of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    ids = sorted(bytes(r["ids"]) for r in sample.mapInArrow(run, "ids binary").limit(docs_most).collect())
    pieces = [x[i : i + 8192] for x in ids for i in range(0, len(x), 8192)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_store(
    docs: DataFrame,
    out: str,
    tokenizer_path: str,
    kind: str = "word",
    end_id: int = 2,
    shards: int | None = None,
    dictionary_bytes: int = 65_536,
    dictionary_docs: int = 1_000,
    dictionary_doc_bytes: int = 32_768,
) -> None:
    """Write every document's ids, ``end_id`` appended, in ascending id order.

    Texts are encoded and compressed where they are read; only the frames are
    shuffled, into ranges of ``doc_id``, and sorted there. Each range becomes a
    shard; a shard's packs are written as they fill up, so memory stays bounded.

    A null text counts as empty. Null ids come first; rows that share an id are
    kept, ordered by their frames. Very long texts are encoded whole, into one
    frame. An empty table gives an empty store. Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = _train(docs, tokenizer_path, kind, dictionary_bytes, dictionary_docs, dictionary_doc_bytes)
    digest = zlib.crc32(dictionary)
    row = [(digest, bytearray(dictionary), tokenizer_path.rsplit("/", 1)[-1], end_id)]
    spark.createDataFrame(row, "dictionary_hash long, dictionary binary, tokenizer string, end_id int").coalesce(
        1
    ).write.parquet(f"{out}/dictionary")
    shards = shards or shuffle_parts(spark)
    bounds = quantile_bounds(docs, "doc_id", shards)
    width = chunk_encoder(tokenizer_path, kind).dtype.itemsize
    frames = (
        _encoded(docs, tokenizer_path, kind, end_id, dictionary)
        .withColumn("shard", bucket_of("doc_id", bounds))
        .repartitionById(len(bounds) + 1, "shard")
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "frame")
        .select("shard", "doc_id", "n_tokens", "frame")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start, held = None, 0, 0, []

        def made() -> pa.RecordBatch:
            ends = np.cumsum([len(f) for _, _, f in held]).tolist()
            counts = [n for _, n, _ in held]
            known = [d for d, _, _ in held if d is not None]
            values = [
                shard, number, min(known, default=None), max(known, default=None), start, sum(counts), [d for d, _, _ in held], ends, counts,
                digest, width, b"".join(f for _, _, f in held),
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, PACK_ARROW)], schema=PACK_ARROW
            )

        size = 0
        for batch in batches:
            for to, doc, count, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (to != shard or size >= PACK_BYTES):
                    yield made()
                    start, number = (start + sum(n for _, n, _ in held), number + 1) if to == shard else (0, 0)
                    held, size = [], 0
                shard = to
                held.append((doc, count, frame))
                size += len(frame)
        if held:
            yield made()

    packs = frames.mapInArrow(pack, PACK_SCHEMA)
    packs.write.option("compression", "uncompressed").parquet(f"{out}/packs")


PACK_ARROW = pa.schema(
    [("shard", pa.int32()), ("pack", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
     ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
     ("ends", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("dictionary_hash", pa.int64()),
     ("id_bytes", pa.int32()), ("payload", pa.binary())]
)


def _store_dictionary(spark: SparkSession, out: str) -> tuple[int, bytes]:
    row = spark.read.parquet(f"{out}/dictionary").first()
    return row["dictionary_hash"], bytes(row["dictionary"])


def read_store(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Decode a store: per document its id, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before it: the shards' totals (one
    row a shard) are summed up on the driver, the rest comes from the packs.
    ``with_ids`` adds the ids themselves as ``array<long>``.
    """
    digest, data = _store_dictionary(spark, out)
    packs = spark.read.parquet(f"{out}/packs")
    totals = {r["shard"]: r["n"] for r in packs.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    base, at = {}, 0
    for shard in sorted(totals):
        base[shard] = at
        at += totals[shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != digest:
                    raise ValueError("a pack was written with another dictionary")
                docs, starts, sums, ids = row["doc_ids"], [], [], []
                start, lo = base[row["shard"]] + row["shard_start"], 0
                for end, count in zip(row["ends"], row["counts"]):
                    found = np.frombuffer(unpacker.decompress(row["payload"][lo:end]), f"<u{row['id_bytes']}")
                    if len(found) != count:
                        raise ValueError("a frame holds another number of ids than its index says")
                    starts.append(start)
                    sums.append(zlib.crc32(found.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(found.astype(np.int64))
                    start, lo = start + count, end
                columns = [pa.array(x, pa.int64()) for x in (docs, starts, row["counts"], sums)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    wanted = ["shard", "shard_start", "doc_ids", "ends", "counts", "dictionary_hash", "id_bytes", "payload"]
    return packs.select(*wanted).mapInArrow(run, schema)


def lookup(spark: SparkSession, out: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of a few documents; only packs whose range holds one of them are read.

    A document that isn't there is missing in the result; of several with one id the
    first counts. A pack of another dictionary is an error, as in :func:`read_store`.
    """
    digest, data = _store_dictionary(spark, out)
    ranges = F.lit(False)
    for doc in doc_ids:
        ranges = ranges | ((F.col("first_doc") <= doc) & (F.col("last_doc") >= doc))
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
    found: dict[int, list[int]] = {}
    for row in spark.read.parquet(f"{out}/packs").filter(ranges).toLocalIterator():
        if row["dictionary_hash"] != digest:
            raise ValueError(f"a pack of {out} was written with another dictionary")
        for k, doc in enumerate(row["doc_ids"]):
            if doc in doc_ids and doc not in found:
                lo = row["ends"][k - 1] if k else 0
                frame = bytes(row["payload"][lo : row["ends"][k]])
                found[doc] = np.frombuffer(unpacker.decompress(frame), f"<u{row['id_bytes']}").tolist()
    return found
