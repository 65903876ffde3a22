"""Byte-level BPE ids of whole texts by the tiktoken library, and back to bytes.

Ranks come from a local file, so nothing is fetched. A long text is cut where
the vocabulary's pattern starts a new match whatever lies around, so its ids
are those of the whole text:

* where white space follows another character: no match goes on from there,
  and all that looks ahead stands in white space;
* inside a run of white space, before its last character where another follows:
  the rest of the run is one match, to its end where the text ends. The library
  can't match very long runs itself; such a run is merged as one piece.

Decoding joins the bytes of the ids, so ids that cut a character are no loss.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.text import WHITE_SPACE, texts_of

#: Fixed value: how the vocabulary cuts a text, the pattern that comes with its file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PART = 1 << 16
RUN = 1 << 10
_BOUNDARY = re.compile(rf"[^{WHITE_SPACE}](?=[{WHITE_SPACE}])").search
_RUNS = re.compile(rf"[{WHITE_SPACE}]{{{RUN},}}").finditer


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.whole = tiktoken.Encoding("text", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids; null counts as empty."""
        if not text:
            return b""
        if len(text) < RUN:
            return np.array(self.whole.encode_ordinary(text), "<u4").tobytes()
        return b"".join(
            np.array((self.piece if run else self.whole).encode_ordinary(part), "<u4").tobytes() for part, run in parts(text)
        )

    def decode(self, ids: bytes | None) -> bytes | None:
        if ids is None:
            return None
        numbers = np.frombuffer(ids, "<u4")
        return b"".join(self.whole.decode_bytes(numbers[lo : lo + PART].tolist()) for lo in range(0, len(numbers), PART))


def parts(text: str, step: int = PART) -> Iterator[tuple[str, bool]]:
    """Parts of a text that encode alone as within it; true for those that are one match."""
    at = 0
    for found in _RUNS(text):
        end = found.end() if found.end() == len(text) else found.end() - 1
        yield from ((p, False) for p in _stretches(text, at, found.start(), step))
        yield text[found.start() : end], True
        at = end
    yield from ((p, False) for p in _stretches(text, at, len(text), step))


def _stretches(text: str, at: int, end: int, step: int) -> Iterator[str]:
    while at < end:
        found = _BOUNDARY(text, at + step - 1, end) if end - at > step else None
        to = found.end() if found else end
        yield text[at:to]
        at = to


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec in each Python worker, kept from task to task."""
    return Codec(path)


def _batches(columns: list[pa.Array], names: list[str], made: Iterator[bytes | None], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows with one more binary column, in batches of about ``most`` of its bytes."""
    lo, held, size, rows = 0, [], 0, len(columns[0])
    for value in made:
        held.append(value)
        size += len(value or b"")
        if size >= most or lo + len(held) == rows:
            yield pa.RecordBatch.from_arrays([*[c.slice(lo, len(held)) for c in columns], pa.array(held, pa.binary())], names)
            lo, held, size = lo + len(held), [], 0


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_tokens`` and ``ids`` (little-endian 32-bit numbers).

    Rows map to rows, with no shuffle. A null or empty text has no ids. Very long
    texts are encoded whole, part by part. Null ids, ties and repeated rows keep
    their rows; an empty table gives an empty result; other columns are ignored,
    whatever their names. Strings of special tokens are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(path)
        for batch in batches:
            yield from _batches([batch.column(0)], ["id", "ids"], map(encoder.encode, texts_of(batch.column(1))))

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(run, f"id {kind}, ids binary")
    return made.select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their ids in place of ``ids_col``.

    Null ids give null, no ids give no bytes; an id that the file doesn't hold
    fails the job. Other columns stay as they are, whatever their names.
    """
    others = [c for c in rows.columns if c not in (ids_col, bytes_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = codec(path)
        for batch in batches:
            ids = (x for lo in range(0, batch.num_rows, 256) for x in batch.column(len(others)).slice(lo, 256).to_pylist())
            names = [f"c{k}" for k in range(len(others))]
            yield from _batches(batch.columns[:-1] or [pa.nulls(batch.num_rows, pa.int8())], [*(names or ["none"]), "bytes"], map(decoder.decode, ids))

    kinds = "".join(f"c{k} {rows.schema[c].dataType.simpleString()}, " for k, c in enumerate(others)) or "none tinyint, "
    held = rows.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)], F.col(f"`{ids_col}`").alias("ids"))
    made = held.mapInArrow(run, f"{kinds}bytes binary")
    return made.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(others)], F.col("bytes").alias(bytes_col))
