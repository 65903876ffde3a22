"""Helpers that run inside tasks: pre-token splitting and cached encoding."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The characters that Unicode calls white space, as in a regex class.
WHITE_SPACE = "\\x09\\x0a\\x0b\\x0c\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: A run of white space with the run of other characters after it. No pre-token
#: of a byte-level vocabulary crosses the start of such a chunk.
LEADING_SPACE_CHUNK = rf"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+"

_SEPARATORS = re.compile(r"[\x1c-\x1f]").search
_BARE = re.compile(rf"[^{WHITE_SPACE}]+").findall


def words_of(text: str) -> list[str]:
    """Runs without white space, for vocabularies that drop it; Python alone counts four separators as such."""
    return _BARE(text) if _SEPARATORS(text) else text.split()


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: How the two kinds of vocabulary cut a text into pre-tokens.
PRE_TOKEN = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}

#: Marks that end a pre-token of letters and are one themselves.
SENTENCE_MARKS = (".", ",", ";", ":", "!", "?")

#: Chunks whose pre-tokens are found here: their characters have been classed
#: alike by all Unicode versions since 5.0 and, for words, are lower-cased one
#: for one. All other chunks go through the tokenizer as they are.
PLAIN = {
    "byte": regex.compile(r"[\x00-\u02ff\u1e00-\u1e9f\u2000-\u206e\u4e00-\u9fa5\uac00-\ud7a3]*"),
    "word": regex.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"),
}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte, by number."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Bounded(dict):
    """A memory of at most about twice ``limit`` entries.

    When ``limit`` is reached, the entries become the old generation; old ones
    that are asked for again move to the new one, the others are forgotten.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def keep(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Merger:
    """Token numbers of one pre-token by the vocabulary's merges."""

    def __init__(self, tokenizer):
        self.merge, self.letters = tokenizer.model.tokenize, byte_letters()
        self.space = self.letters[0x20]

    def __call__(self, piece: str) -> list:
        if piece.isascii() and piece.isprintable():
            return self.merge(piece.replace(" ", self.space))
        return self.merge(piece.encode().decode("latin-1").translate(self.letters))


class ChunkEncoder(Bounded):
    """Encodes whole texts chunk by chunk and remembers chunks and pre-tokens.

    Cutting a text into chunks doesn't change its ids for the kinds below. A
    plain chunk is cut into pre-tokens here, and the tokenizer's model merges
    each new one; any other chunk is encoded by the tokenizer as a text. A
    pre-token is a chunk too, so both share one memory.

    ``byte``: byte-level vocabularies whose pre-tokens take one leading space.
    ``word``: byte-level ones with word ends that lower-case and drop white space.
    """

    def __init__(self, path: str, kind: str, limit: int = 250_000):
        super().__init__(limit)
        self.tokenizer = load_tokenizer(path)
        self.split = words_of if kind == "word" else re.compile(LEADING_SPACE_CHUNK).findall
        self.plain = PLAIN[kind].fullmatch
        self.cut = regex.compile(PRE_TOKEN[kind]).findall
        self.lower = kind == "word"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(added)  # a chunk without it holds no added token
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u4" if size > 0xFFFF else "<u2")
        self.merge = Merger(self.tokenizer)
        self.tokenize, self.space = self.merge.merge, self.merge.space
        self.numbers = [k.to_bytes(self.dtype.itemsize, "little") for k in range(size)]

    def __missing__(self, chunk: str) -> bytes:
        if (found := self.old.get(chunk)) is None:
            found = self._new(chunk)
        if len(self) >= self.limit:
            return self.keep(chunk, found)
        self[chunk] = found
        return found

    def _new(self, chunk: str) -> bytes:
        spaced = chunk[0] == " "
        body = chunk[1:] if spaced else chunk
        if body.isalpha():
            if body.isascii():  # one pre-token, the commonest case
                numbers = self.numbers
                text = self.space + body if spaced else body.lower() if self.lower else body
                return b"".join([numbers[t.id] for t in self.tokenize(text)])
            if self.plain(chunk):
                return self._merged(chunk.lower() if self.lower else chunk)
        elif body[-1:] in SENTENCE_MARKS and body[:-1].isalpha() and self.plain(chunk):
            return self[chunk[:-1]] + self[chunk[-1]]
        elif (not self.mark or self.mark not in chunk) and self.plain(chunk):
            pieces = self.cut(chunk.lower() if self.lower else chunk)
            return b"".join([self[p] for p in pieces]) if len(pieces) > 1 else self._merged(pieces[0])
        ids = self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids
        return np.array(ids, self.dtype).tobytes()

    def _merged(self, piece: str) -> bytes:
        numbers = self.numbers
        return b"".join([numbers[t.id] for t in self.merge(piece)])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian ids of each text; null counts as empty."""
        return [b"".join(map(self.__getitem__, self.split(t))) if t else b"" for t in texts]


def texts_of(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """Texts of an Arrow column, a few in memory at a time."""
    for lo in range(0, len(column), step):
        yield from column.slice(lo, step).to_pylist()


@lru_cache(maxsize=2)
def chunk_encoder(path: str, kind: str) -> ChunkEncoder:
    """One encoder in each Python worker, kept from task to task."""
    return ChunkEncoder(path, kind)
