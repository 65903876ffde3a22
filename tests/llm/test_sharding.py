import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from recordloom.llm import sharding
from recordloom.llm.sharding import Run, find_cuts, greedy, smallest_capacity


def best(sizes, shards):
    """Least largest part of a contiguous partition, by trying all cuts."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    row = [sums[k] for k in range(len(sums))]
    for _ in range(shards - 1):
        row = [0] + [min(max(row[j], sums[k] - sums[j]) for j in range(k)) for k in range(1, len(sums))]
    return row[-1]


def test_capacity_is_the_smallest():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.choice([1, 2, 3, 50, 7]) for _ in range(rng.randint(1, 30))]
        runs = [Run(f"{k:04x}", s, True) for k, s in enumerate(sizes)]
        shards = rng.randint(1, 6)
        found = smallest_capacity(runs, shards)
        assert found == best(sizes, shards)
        assert len(greedy(runs, found)) <= shards


def test_cuts_found_range_by_range_are_the_best(spark, monkeypatch):
    for name in ("FIRST", "FINER"):
        monkeypatch.setattr(sharding, name, 1)  # sixteen ranges at a look, so several looks are needed
    monkeypatch.setattr(sharding, "AT_ONCE", 3)
    rng = random.Random(3)
    sizes = {f"{rng.getrandbits(128):032x}": rng.choice([1, 5, 9, 400]) for _ in range(300)}
    groups = spark.createDataFrame(list(sizes.items()), "digest string, bytes long")
    for shards in (1, 3, 8):
        cuts, capacity = find_cuts(groups, shards)
        ordered = [sizes[d] for d in sorted(sizes)]
        assert capacity == best(ordered, shards)
        sums = defaultdict(int)
        for digest, size in sizes.items():
            sums[sum(c <= digest for c in cuts)] += size
        assert max(sums.values()) <= capacity and len(cuts) < shards


def test_shards(odd_docs):
    rows = sharding.shard(odd_docs, 4).collect()
    texts = sorted((r[0] or -1, r[1] or "") for r in odd_docs.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts
    )
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        shard_of[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())  # equal texts stay together
    assert set(slots) <= set(range(4))


def test_hot_group_and_empty_table(spark, no_docs):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shard(hot, 8).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.sum("size").alias("b")).collect()
    assert sum(r["n"] for r in rows) == 3000 and all(r["m"] == r["n"] - 1 for r in rows)
    assert max(r["b"] for r in rows) == 5000  # the group of equal texts can't be cut
    assert sharding.shard(no_docs, 8).count() == 0
