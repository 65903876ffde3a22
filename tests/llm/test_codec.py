"""Encoding and decoding against the tiktoken library itself."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from recordloom.llm import bpe_codec, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_the_pattern_is_the_file_s():
    assert bpe_codec.PATTERN == public_tokenizers.PATTERN


def test_ids_are_the_library_s(spark, library, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted((r[0] or -1, np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes()) for r in rows)
    got = bpe_codec.encode(odd_docs, PATH).collect()
    assert sorted((r["doc_id"] or -1, bytes(r["ids"])) for r in got) == want
    assert all(4 * r["n_tokens"] == len(r["ids"]) for r in got)


def test_bytes_come_back(odd_docs):
    held = bpe_codec.encode(odd_docs.withColumn("decoded", F.lit(1)), PATH).join(odd_docs.select("doc_id", "text").distinct(), "doc_id")
    back = bpe_codec.decode(held, PATH)
    assert set(back.columns) == {"doc_id", "n_tokens", "text", "decoded"}
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
    assert [r[0] for r in bpe_codec.decode(held.select("ids").limit(3), PATH).select(F.length("decoded") >= 0).collect()] == [True] * 3


def test_parts_encode_as_the_whole(library):
    odd = ["it's", " a", "  b", "\n\n", " 　 ", "日本", "12 3", "'re", "!?", "\x1c\x1d", " ", "\t", "é" * 9, "x" * 40]
    for k in range(60):
        text = "".join(odd[(k * j * j + j) % len(odd)] for j in range(1, 80))
        made = [p for p, _ in bpe_codec.parts(text, 7)]
        assert "".join(made) == text and len(made) > 3
        assert [i for p in made for i in library.encode_ordinary(p)] == library.encode_ordinary(text)


def test_long_runs_of_white_space(library):
    codec = bpe_codec.codec(PATH)
    for run in (" " * 1023, " " * 1024, " " * 3000, "\n \t" * 900, "　" * 2000):
        for text in (run, f"a{run}", f"{run}b", f"a b{run}c{run}", f"{run}'s d{run}\n"):
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    for text in (" " * 2_000_000 + "x", "y" + " " * 2_000_000, " " * 2_000_000):  # more than the library matches
        ids = codec.encode(text)
        assert codec.decode(ids) == text.encode()


def test_very_long_words(library):
    codec = bpe_codec.codec(PATH)
    for text in ("a" * 200_000, "語" * 70_000, "ab1!" * 40_000, "one two  three\n" * 30_000):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_cut_characters_decode_to_their_bytes(library):
    codec = bpe_codec.codec(PATH)
    ids = np.frombuffer(codec.encode("ԀՠՈ𐍈"), "<u4")
    assert len(ids) > 4 and b"".join(codec.decode(ids[k : k + 1].tobytes()) for k in range(len(ids))) == "ԀՠՈ𐍈".encode()
    assert codec.decode(None) is None and codec.decode(b"") == b""


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r[c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) for r in queries.op12_bpe_codec(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), (r["text"] or "").encode())]
        assert got.pop(r["doc_id"]) == (len(ids), *digests)
    assert not got


def test_no_documents(no_docs):
    assert bpe_codec.decode(bpe_codec.encode(no_docs, PATH), PATH).count() == 0
