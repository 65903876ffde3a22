"""Token counts by the whole-token shortcut.

Most pre-tokens of ordinary text are themselves vocabulary entries. Before the
job starts, :func:`whole_tokens` proves for every vocabulary string whether the
tokenizer encodes it, alone, as exactly that one token. In the tasks each text
is split into pre-tokens; those in the proven set count one each without any
merging, and only the rest go through the byte-pair merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.text import LEADING_SPACE_CHUNK, PLAIN, PRE_TOKEN, Bounded, Merger, load_tokenizer, texts_of


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that encode, alone, as one token which is their own.

    Entries that aren't valid UTF-8 can't stand alone in a text and stay out.
    """
    tokenizer = load_tokenizer(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    strings, ids = [], []
    for entry, number in tokenizer.get_vocab(with_added_tokens=False).items():
        text = tokenizer.decoder.decode([entry])
        if text and "\ufffd" not in text and text not in special:
            strings.append(text)
            ids.append(number)
    found = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, n, e in zip(strings, ids, found) if e.ids == [n])


class _Cost(Bounded):
    """Tokens of a pre-token: 1 for the proven ones, the merges' count for the rest.

    A chunk with characters that Unicode versions class differently is asked
    for as a whole and, unless proven, counted by the library. What had to be
    merged or counted is remembered, in bounded number.
    """

    def __init__(self, path: str, proven: frozenset[str], limit: int = 200_000):
        super().__init__(limit + len(proven))
        self.proven = proven
        self.update(dict.fromkeys(proven, 1))
        self.tokenizer = load_tokenizer(path)
        self.merge = Merger(self.tokenizer)
        added = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(added) or r"(?!)")
        self.plain = PLAIN["byte"].fullmatch
        self.split = regex.compile(PRE_TOKEN["byte"]).findall
        self.chunks = regex.compile(LEADING_SPACE_CHUNK).findall

    def __missing__(self, piece: str) -> int:
        if (count := self.old.get(piece)) is None:
            if piece in self.proven:
                count = 1
            elif self.plain(piece):
                count = len(self.merge(piece))
            else:
                count = len(self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids)
        return self.keep(piece, count)

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.tokens, parts))
        if not self.plain(text):
            return sum(sum(map(self.__getitem__, self.split(c))) if self.plain(c) else self[c] for c in self.chunks(text))
        return sum(map(self.__getitem__, self.split(text)))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    The tokenizer must be a byte-level one.
    No begin, end or padding tokens are added; an added token's string inside a
    text is one token, the library's default. Rows map to rows, with no shuffle.

    A null or empty text has 0 bytes and 0 tokens; very long texts are counted
    whole; a null id, repeated rows and ties keep their rows; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    proven = spark.sparkContext.broadcast(whole_tokens(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = _Cost(tokenizer_path, proven.value)
        for batch in batches:
            counts = [cost.tokens(t) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
