"""Token counts, the token store and packing against the tokenizers library itself."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from recordloom.llm import packing, token_counts, token_store
from recordloom.llm.text import PLAIN, WHITE_SPACE, chunk_encoder, load_tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids(path, text):
    return load_tokenizer(path).encode(text or "", add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def test_counts_are_the_library_s(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(ids(BYTE, r[1]))) for r in rows)
    got = token_counts.count_tokens(odd_docs, BYTE, 512).collect()
    assert sorted((r[0] or -1, r[1], r[2]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)


def test_counts_of_mixed_scripts(spark):
    parts = ["it's", " \u044f\u0437\u044b\u043a", "\u0645\u0631\u062d", " \u0939\u093f", "\u3042", "\U0001f600\u200d", "  ", "\u3000", "\n", "42.", "<|endoftext|>", "\u0301"]
    texts = ["".join(parts[(k * j + j) % len(parts)] for j in range(1, 9)) for k in range(300)]
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTE).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: len(ids(BYTE, t)) for k, t in enumerate(texts)}


def test_no_documents(no_docs, tmp_path):
    assert token_counts.count_tokens(no_docs, BYTE).count() == 0
    token_store.write_store(no_docs, f"{tmp_path}/store", WORD)
    assert token_store.read_store(no_docs.sparkSession, f"{tmp_path}/store").count() == 0
    assert packing.pack(no_docs, BYTE).count() == 0


def test_proven_tokens_stand_alone():
    proven = token_counts.whole_tokens(BYTE)
    assert len(proven) > 45_000
    assert all(len(ids(BYTE, t)) == 1 for t in list(proven)[::97])


def test_plain_characters_are_classed_as_by_the_tokenizer():
    cut = load_tokenizer(BYTE).pre_tokenizer.pre_tokenize_str
    encoder = chunk_encoder(BYTE, "byte")
    for code in (c for c in range(0x3100) if PLAIN["byte"].fullmatch(chr(c))):
        text = f"a{chr(code)}1 {chr(code)}a{chr(code)}!"
        assert [len(p) for p in encoder.cut(text)] == [b - a for _, (a, b) in cut(text)], hex(code)


def test_white_space_ends_pre_tokens():
    cut = load_tokenizer(BYTE).pre_tokenizer.pre_tokenize_str
    spaces = re.compile(f"[{WHITE_SPACE}]")
    for code in (c for c in range(0x3100) if PLAIN["byte"].fullmatch(chr(c)) or spaces.fullmatch(chr(c))):
        found = [span for _, span in cut(f"!{chr(code)}!")]
        assert (found[0] == (0, 1) and found[-1][1] == 3) == bool(spaces.fullmatch(chr(code))) or chr(code).isalnum(), hex(code)


def test_encoders_agree_with_the_library(odd_docs):
    texts = [r[0] for r in odd_docs.select("text").collect()]
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        encoder = chunk_encoder(path, kind)
        for text, data in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(data, encoder.dtype).tolist() == ids(path, text)


def test_forgetting_changes_nothing():
    from recordloom.llm.text import ChunkEncoder

    small, texts = ChunkEncoder(BYTE, "byte", limit=5), ["one two three four five six", "seven one, eight two nine"] * 3
    assert [np.frombuffer(x, "<u2").tolist() for x in small.encode(texts)] == [ids(BYTE, t) for t in texts]
    assert len(small) <= 5


def test_store_round_trip(spark, odd_docs, tmp_path):
    out = f"{tmp_path}/store"
    token_store.write_store(odd_docs, out, WORD, "word", 2, shards=3)
    got = token_store.read_store(spark, out, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] or -1 for r in got] == sorted(r[0] or -1 for r in odd_docs.select("doc_id").collect())
    texts = {r[0]: r[1] for r in odd_docs.select("doc_id", "text").collect()}
    start = 0
    for row in got:
        want = [*ids(WORD, texts[row["doc_id"]]), 2]
        assert (row["ids"], row["start"], row["n_tokens"], row["ids_crc32"]) == (want, start, len(want), crc(want))
        start += len(want)
    assert token_store.lookup(spark, out, [5, 9, 999]) == {k: [*ids(WORD, texts[k]), 2] for k in (5, 9)}


def test_store_keeps_the_hash_of_its_dictionary(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("plain words again"), F.sequence(F.lit(1), F.col("id") % 50 + 1)).alias("text"))
    token_store.write_store(docs, f"{tmp_path}/store", WORD)
    (row,) = spark.read.parquet(f"{tmp_path}/store/dictionary").collect()
    assert row["dictionary_hash"] == zlib.crc32(bytes(row["dictionary"])) and len(row["dictionary"]) > 0
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/store/packs").select("dictionary_hash").collect()} == {row["dictionary_hash"]}


def test_packing_covers_every_id_once(odd_docs):
    length = 64
    pieces = packing.pack(odd_docs, BYTE, 1, length, with_ids=True)
    rows = pieces.collect()
    by_doc = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= length
        by_doc[r["doc_id"]].append(r)
    for doc, text in odd_docs.select("doc_id", "text").collect():
        mine = sorted(by_doc[doc], key=lambda r: (r["start"], r["sequence_id"]))
        want = [*ids(BYTE, text), 1]
        if doc != 15:  # three rows share that id
            assert [r["start"] for r in mine] == np.cumsum([0, *[r["length"] for r in mine]])[:-1].tolist()
            assert np.frombuffer(b"".join(r["ids"] for r in mine), "<u4").tolist() == want
            assert {r["doc_tokens"] for r in mine} == {len(want)}
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    total = sum(r["length"] for r in rows)
    assert [s * length + o for s, o, _ in places] == np.cumsum([0, *[n for _, _, n in places]])[:-1].tolist()
    assert max(s for s, _, _ in places) == (total - 1) // length
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces, length, 0).collect()}
    assert len(whole) == (total - 1) // length + 1 and all(len(r["ids"]) == 4 * length for r in whole.values())
    assert sum(r["n_ids"] for r in whole.values()) == total
    first = sorted((r for r in rows if r["sequence_id"] == 0), key=lambda r: r["offset"])
    assert bytes(whole[0]["ids"]) == b"".join(bytes(r["ids"]) for r in first)
