"""The divergence audit against a loop over all groups and terms in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from recordloom.llm import divergence as D
from recordloom.llm import queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def plain(rows, top=200, least=3):
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOWER))
        docs[lang or ""].update(set(found))
        groups[lang or "", source or ""].update(found)
    made = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        mates = {s: c for (other, s), c in groups.items() if other == lang}
        every = sum(mates.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept))  # noqa: B023, E731
        pair = [(-sum((share(own, t) - share(c, t)) ** 2 // share(c, t) for t in kept), s) for s, c in mates.items() if s != source]
        term = [(-((share(own, t) - share(every, t)) ** 2 // share(every, t)), t) for t in kept if own[t] and share(own, t) > share(every, t)]
        for part, found in (("pair", pair), ("term", term)):
            found = sorted(found, key=lambda x: (x[0], x[1].encode()))
            made += [(lang, source, part, item, -v, r) for r, (v, item) in enumerate(found if part == "pair" else found[:top], 1)]
    return sorted(made)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["a", "Be", "café", "CAFÉ", "日本", "x1y", "it's", "ſ", "İ", "z" * 40, *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "fr"]), f"s{rng.randint(0, 8)}") for _ in range(120)]
    rows += [(None, "en", "s1"), ("", "en", "bare"), ("one two", None, None), ("!!! 12", "de", "q"), ("...", "de", None), (" ".join(words * 3000), "en", "s2")]
    return rows + [("be be a", "en", "copy")] * 50


def test_same_as_a_loop(spark, texts):
    wide = [(*r, 1, "t", 2, 0.5) for r in texts]
    docs = spark.createDataFrame(wide, "text string, lang string, source string, n int, term string, value long, p double").repartition(3)
    want = plain(texts)
    assert rows_of(D.divergence(docs)) == want and {r[2] for r in want} == {"pair", "term"} and "de" in {r[0] for r in want}
    assert rows_of(D.divergence(docs, source_block=2, term_block=5)) == want
    assert rows_of(D.divergence(docs, top=3)) == plain(texts, top=3)


def test_counts_pass_on_before_they_grow(spark, texts, monkeypatch):
    monkeypatch.setattr(D, "HELD_TERMS", 7)
    docs = spark.createDataFrame(texts, "text string, lang string, source string").coalesce(1)
    assert rows_of(D.divergence(docs)) == plain(texts)


def test_terms_in_parts(monkeypatch):
    text = "Ab, cdé-" * 20 + "x" * 50 + " 日本語" * 9 + "tail"
    want = [t.translate(LOWER).encode() for t in TERM.findall(text)]
    for size in (1, 3, 16, 64, 1 << 20):
        monkeypatch.setattr(D, "PART", size)
        assert [t for part in D.terms(text.encode()) for t in part] == want
    assert list(D.terms(b"")) == []


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(900_000_000_000_000_000 - 1, 10**17, 3)], "n long, total long, terms long")
    got = df.select(D._share(F.col("n"), "total", "terms", 10**9)).first()[0]
    assert got == 1 + 10**9 * 9 * 10**17 // (10**17 + 3)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = base.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op11_divergence']})").fetchall()
    assert rows_of(queries.op11_divergence(spark, sf)) == sorted(want) and len(want) > 1000


def test_no_documents(no_docs):
    assert D.divergence(no_docs).count() == 0
