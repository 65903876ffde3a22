import random

import pytest

LETTERS = "aeionrstl"


def words(count: int, rng: random.Random) -> str:
    return " ".join("".join(rng.choices(LETTERS, k=rng.randint(2, 8))) for _ in range(count))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and very long texts, copies, repeated rows and clashing extra columns."""
    rng = random.Random(5)
    long = words(20_000, rng)
    base = words(120, rng).split()
    near = " ".join([*base[:60], "other", *base[61:]])
    half = " ".join([*base[:60], *words(60, rng).split()])
    rows = [
        (1, " ".join(base)), (2, None), (3, ""), (4, "   \n\t "), (5, long), (6, long), (7, near), (8, half),
        (9, "two words"), (10, "Two WORDS"), (11, "x"), (12, "<|endoftext|> a  <|endoftext|>\n\n b"),
        (13, "naïve ÄÖ İstanbul ſ ԀՠՈ 日本語テキスト 😀   　x \x1c y"), (14, "a" * 5000), (None, "no id at all here"),
        (15, " ".join(base)), (15, " ".join(base)), (16, words(300, rng)), (17, words(40, rng)),
    ]
    rows += [(100 + k, words(rng.randint(1, 200), rng)) for k in range(60)]
    wide = [(i, t, "en", f"s{i}", len(t or ""), 7, "n", 1.5, False) for i, t in rows]
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, score string, size double, kept boolean"
    return spark.createDataFrame(wide, kind).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
