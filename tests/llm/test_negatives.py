"""Hard negatives against a plain search, packed products against matrix products."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import hard_negatives as N
from recordloom.llm import queries

KIND = "vec_id long, label int, embedding array<float>, n int, h string, q double, id int, rank string"


def plain(rows, every=10, positives=5, negatives=10):
    held = []
    for vec, label, v in rows:
        if None in (vec, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((vec, label, [math.floor(256 * x) for x in v]))
    made = []
    for k, (anchor, label, a) in enumerate(held):
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, q)), vec, own) for j, (vec, own, q) in enumerate(held) if j != k)
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [(s, vec) for s, vec, own in scored if own != label and 30 * -p <= 100 * -s <= 90 * -p]
            made += [(anchor, positive, r, vec, -p, -s) for r, (s, vec) in enumerate(inside[:negatives], 1)]
    return Counter(made)


def frame(spark, rows):
    wide = [(i, label, v, 7, "h", 1.5, 3, "r") for i, label, v in rows]
    return spark.createDataFrame(wide, KIND).repartition(3)


def found(df):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def made_rows(count, seed=3, dims=6):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for k in range(count):
        c = rng.choice(centres)
        rows.append((k, k % 3, [float(np.float32(x + rng.choice([0, 0, 0.004, 0.3]))) for x in c]))  # many ties
    return rows


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for low, high, dims in ((-256, 256, 64), (-5, 0, 3), (0, 9, 1), (-(1 << 20), 1 << 20, 16)):
        rows, anchors = rng.integers(low, high + 1, (300, dims)), rng.integers(low, high + 1, (5, dims))
        least = min(low, 0)
        packed = N.Packed(rows, least, N.field_width(dims, least, max(high, 0)))
        for a in anchors:
            assert packed.scores((a - least).tolist()).tolist() == (rows @ a).tolist()
    with pytest.raises(ValueError):
        N.field_width(64, -(1 << 30), 1 << 30)


def test_best_breaks_ties_by_id():
    scores, ids = np.array([5, 7, 7, 5, 7, 1]), np.array([1, 9, 3, 0, 3, 2])
    assert ids[N.best(scores, ids, 4)].tolist() == [3, 3, 9, 0] and len(N.best(scores[:2], ids[:2], 4)) == 2


@pytest.mark.parametrize("stripe", [1 << 22, 600])
def test_same_as_a_plain_search(spark, monkeypatch, stripe):
    """Also with many small cells, a label with most rows and masses of equal vectors."""
    monkeypatch.setattr(N, "STRIPE_NUMBERS", stripe)
    monkeypatch.setattr(N, "ANCHOR_NUMBERS", stripe // 10)
    monkeypatch.setattr(N, "PACK", 50)
    rows = made_rows(400)
    rows += [(1000 + k, 1, rows[5][2]) for k in range(150)]
    got = found(N.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0))
    want = plain(rows)
    assert got == want and sum(want.values()) > 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made_rows(60) + [(60, 0, None), (70, None, [1.0] * 6), (80, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (90, 1, [nan] * 6), (100, 2, [inf] * 6), (None, 1, [1.0] * 6)]
    rows += [(110, 1, [0.5, 0.25]), (120, 2, []), (121, 1, [0.9])]
    rows += [rows[20]] * 3 + [rows[31]] * 20 + [(20, 0, [0.125] * 6)]  # repeated rows, an anchor of two vectors
    padded = [(i, label, v if v is None else v + [0.0] * (6 - len(v))) for i, label, v in rows]
    got = found(N.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0))
    assert got == plain(padded) and {a[0] for a in got} >= {0, 20, 110}


def test_nothing_to_mine(spark):
    empty = frame(spark, made_rows(20)).limit(0)
    anchor = F.col("vec_id") % 10 == 0
    assert N.hard_negatives(empty, anchor).count() == 0
    assert N.hard_negatives(frame(spark, [(1, 0, [1.0]), (2, 1, [1.0])]), anchor).count() == 0
    assert N.hard_negatives(frame(spark, [(10, 0, [1.0]), (2, 1, [1.0])]), anchor).count() == 0
    with pytest.raises(ValueError):
        N.hard_negatives(frame(spark, [(10, 0, [1e30]), (2, 1, [1.0])]), anchor)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = queries.op13_hard_negatives(spark, sf)
    assert found(got) == Counter(base.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op13_hard_negatives']})").fetchall())
