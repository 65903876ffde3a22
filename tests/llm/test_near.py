"""Similarity joins against brute force."""

import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import embedding_dedup, near_dup
from recordloom.llm.components import connected_components
from recordloom.llm.embedding_dedup import Quantiser
from tests.llm.conftest import words


def smallest_reachable(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 200)]
    links += [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)]
    rng.shuffle(links)
    frame = spark.createDataFrame([*links, (None, 3), *links[:5]], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    nodes = {x for pair in links for x in pair}
    assert got == smallest_reachable(nodes, links)
    assert connected_components(frame.limit(0)).count() == 0


def sets_of(text, size):
    found = (text or "").encode().lower().split()
    if len(found) < size:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + size]) for k in range(len(found) - size + 1)}


def brute(rows, size, percent):
    sets = {i: sets_of(t, size) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                links.append((a, b))
    return {i: (len(sets[i]), c) for i, c in smallest_reachable(sets, links).items()}


def noisy(base, edits, rng):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = words(1, rng)
    return " ".join(out)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd_docs, size, percent):
    rng = random.Random(size)
    rows = {r[0]: r[1] for r in odd_docs.select("doc_id", "text").collect() if r[0] is not None}
    for group in range(12):
        base = words(rng.randint(60, 200), rng).split()
        for k in range(6):
            rows[1000 + 10 * group + k] = noisy(base, rng.randint(0, 6), rng)
    frame = spark.createDataFrame([*rows.items(), (None, "a text without an id"), (None, None)], "doc_id long, text string")
    got = near_dup.near_duplicates(frame, size, percent).collect()
    want = brute(rows.items(), size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert sum(r["doc_id"] is None and r["component_id"] is None and r["kept"] for r in got) == 2


def test_a_large_group_of_near_copies(spark):
    """The group is beyond what a node or a whole comparison takes, so it goes through levels, pieces and turns."""
    rng = random.Random(9)
    base = words(150, rng).split()
    rows = {k: noisy(base, rng.randint(0, 3), rng) for k in range(400)} | {1000 + k: words(80, rng) for k in range(100)}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = near_dup.near_duplicates(frame, 3, 85, limit=16, whole=32, rounds=1).collect()
    want = brute(rows.items(), 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_a_large_group_whose_typical_pair_is_below_the_threshold(spark):
    """Most pairs of the group are no links, so leaders connect little; the few links must be found all the same."""
    rng = random.Random(11)
    base = words(150, rng).split()
    group = [noisy(base, 5, rng) for _ in range(200)]
    rows = dict(enumerate(group)) | {1000 + k: noisy(group[rng.randrange(200)].split(), 3, rng) for k in range(100)}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = near_dup.near_duplicates(frame, 3, 85, first_levels=1, limit=8, whole=16, rounds=0, piece=40).collect()
    want = brute(rows.items(), 3, 85)
    assert 100 < len({c for _, c in want.values()}) < 250
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_deduplicated_keeps_columns(odd_docs, no_docs):
    kept = near_dup.deduplicated(odd_docs, 5, 80)
    assert kept.columns == odd_docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 15 not in ids and 6 not in ids and 2 in ids and 3 in ids
    assert near_dup.deduplicated(no_docs).count() == 0
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_ids_with_several_texts_and_repeated_rows(spark):
    rng = random.Random(3)
    a, b, c = (words(50, rng) for _ in range(3))
    rows = [(4, "q q q"), (4, "q q q"), (7, a), (7, b), (7, b), (9, b.upper()), (3, a), (8, c), (8, c.replace(" ", "  ")), (1, None), (1, None),
            (None, a), (None, a), (5, ""), (6, c)]
    frame = spark.createDataFrame([(i, t, k, True) for k, (i, t) in enumerate(rows)], "doc_id long, text string, part int, kept boolean")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(frame, 5, 80).collect() if r["doc_id"])
    want = [(1, 0, 1, True)] * 2 + [(3, 46, 3, True)] + [(4, 1, 4, True)] * 2 + [(5, 0, 5, True), (6, 46, 6, True)]
    want += [(7, 46, 3, False), (7, 46, 7, True), (7, 46, 7, True), (8, 46, 6, False), (8, 46, 6, False), (9, 46, 7, False)]
    assert got == want
    kept = near_dup.deduplicated(frame, 5, 80)
    assert kept.columns == frame.columns
    left = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    assert left == sorted([(0, a), (0, a), (1, ""), (1, ""), (3, a), (4, "q q q"), (5, ""), (6, c), (7, b)])
    spaced = spark.createDataFrame([(8, c), (8, c.replace(" ", "  "))], "doc_id long, text string")
    assert near_dup.deduplicated(spaced).count() == 1


def test_a_large_group_with_production_parameters(spark):
    rng = random.Random(19)
    base = words(150, rng).split()
    rows = {k: noisy(base, rng.randint(0, 3), rng) for k in range(400)} | {1000 + k: words(80, rng) for k in range(100)}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = near_dup.near_duplicates(frame, 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows.items(), 3, 85)


def vectors(rng):
    points = rng.normal(size=(300, 16))
    close = np.concatenate([points[:40] + rng.normal(size=(40, 16)) * s for s in (0.05, 0.15, 0.2)])
    hot = points[50] + rng.normal(size=(120, 16)) * 0.1
    rows = [(k, [float(np.float32(x)) for x in v], 1) for k, v in enumerate(np.concatenate([points, close, hot, points[:20]]))]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0], [], [1e30] * 16, [1e-30] * 16]
    return rows + [(9000 + k, v, None) for k, v in enumerate(odd)] + [(None, [1.0] * 16, 2)]


def brute_vectors(rows, cosine):
    sound = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    scaled = {i: v / np.abs(v).max() for i, v in sound.items()}
    scaled = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    links, ids = [], list(scaled)
    for k, a in enumerate(ids):
        links += [(a, b) for b in ids[k + 1 :] if len(scaled[a]) == len(scaled[b]) and scaled[a] @ scaled[b] >= cosine]
    parts = smallest_reachable([i for i, _, _ in rows if i is not None], links)
    counts = {i: 0 for i in parts}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    return {i: (counts[i], parts[i]) for i in parts}


@pytest.mark.parametrize("recall,block", [(0.99, 2048), (None, 32)])
def test_near_vectors(spark, recall, block):
    rows = vectors(np.random.default_rng(4))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_vectors(frame, 0.95, lists=12, recall=recall, block=block, query_block=200).collect()
    want = brute_vectors(rows, 0.95)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None}
    assert len(got) == len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    total, missed = sum(n for n, _ in want.values()), sum(abs(n - found[i][0]) for i, (n, _) in want.items())
    assert all(found[i][0] <= n for i, (n, _) in want.items())  # nothing below the threshold
    assert missed <= (0.02 * total if recall else 0)
    if recall is None:
        assert found == want
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_near_vectors_of_a_decaying_spectrum(spark):
    """Centres and differences lie along the same few directions; the default loses no link."""
    rng = np.random.default_rng(8)
    scale = 1 / np.arange(1, 65) ** 1.5
    points = rng.normal(size=(400, 64)) * scale
    close = points[:300] + rng.normal(size=(300, 64)) * scale * 0.2
    rows = [(k, [float(np.float32(x)) for x in v], 1) for k, v in enumerate(np.concatenate([points, close]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_vectors(frame, 0.95, lists=60).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_vectors(rows, 0.95)


def test_near_vectors_that_share_ids(spark):
    """Equal rows are one vector; an id with two vectors has two; doubles are compared as such."""
    a, b, c = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 0.0, 1.0]
    edge = [1.0, 0.32868410517886, 0.0]  # cosine with a: 0.95 less 1e-9
    rows = [(1, a), (1, a), (2, a), (3, b), (3, c), (4, c), (7, edge)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embedding_dedup.near_vectors(frame, 0.95).collect())
    first = [(1, 3, 1, True)] * 2 if np.dot(a, edge) / np.linalg.norm(edge) >= 0.95 else [(1, 2, 1, True)] * 2
    assert [g for g in got if g[0] == 1] == first
    assert sorted(g for g in got if g[0] == 3) == [(3, 1, 3, True), (3, 3, 1, False)]
    assert [g for g in got if g[0] == 4] == [(4, 1, 3, False)]


def test_recall_over_all_rows_of_a_table(spark):
    """The query's own parameters on a whole table and near copies of it, every row against every row."""
    rng = np.random.default_rng(6)
    points = np.array([r[0] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()])
    near = points[:800] + rng.normal(size=(800, points.shape[1])) * np.linalg.norm(points, axis=1).mean() / points.shape[1] ** 0.5 * 0.2
    points = np.concatenate([points, near, near[:400] * 1.5 + points[:400]]).astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<float>")
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    want = int((points @ points.T >= 0.95).sum()) - len(points)
    got = embedding_dedup.near_vectors(frame, 0.95).agg(F.sum("n_links")).first()[0]
    print(f"recall {got / want:.5f} of {want} links")
    assert want > 1500 and 0.999 * want <= got <= want


def test_many_lists_in_two_levels():
    points = np.random.default_rng(2).normal(size=(6000, 4))
    centres = embedding_dedup.nested_kmeans(points, 2500, 2, 1)
    assert 2300 < len(centres) < 2700


def test_table_distances_are_distances_to_the_codes():
    rng = np.random.default_rng(1)
    units = rng.normal(size=(500, 10))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    model = Quantiser(units, 8, 4, 16)
    own, codes, lost = model.encode(units)
    kept = np.concatenate([w[codes[:, k]] for k, w in enumerate(model.books)], axis=1) + model.centres[own]
    assert np.allclose(np.linalg.norm(units - kept, axis=1), lost)
    exact = ((units[:20, None] - kept[None]) ** 2).sum(axis=2)
    assert np.allclose(model.table_distances(units[:20], own, codes), exact)


def test_the_model_grows_with_the_lists_and_not_with_their_pairs():
    rng = np.random.default_rng(21)
    units = rng.normal(0, 1, (5000, 16))
    units /= np.sqrt((units**2).sum(axis=1))[:, None]
    sizes = [len(pickle.dumps(Quantiser(units, lists, 4, 16))) for lists in (500, 1000, 2000)]
    assert all(b <= 2.2 * a for a, b in zip(sizes, sizes[1:]))


def test_probed_lists_are_those_whose_bisector_is_in_reach():
    rng = np.random.default_rng(22)
    units = rng.normal(0, 1, (300, 8))
    units /= np.sqrt((units**2).sum(axis=1))[:, None]
    model = Quantiser(units, 20, 4, 16)
    own = embedding_dedup.nearest_of(units, model.centres)
    lists = np.array([1, 4, 7, 19])
    got = model.probes(units, own, lists, 0.2)
    for k, x in enumerate(units):
        for at, other in enumerate(lists):
            a, b = model.centres[own[k]], model.centres[other]
            past = (((x - b) ** 2).sum() - ((x - a) ** 2).sum()) / (2 * max(np.sqrt(((a - b) ** 2).sum()), 1e-9))
            if abs(past - 0.2) > 1e-6:
                assert got[k, at] == (past <= 0.2)
