"""Records over several lines: chunks and fragments against one sequential pass."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from recordloom.plans import order as P
from recordloom.sources import lines as L
from recordloom.sources import multiline as M


def plain(streams, patterns, clobber=False, keep=(), keep_all=False):
    compiled = [(re.compile(p), [*names, *map(str, range(len(names), re.compile(p).groups))], role.split("+")) for p, names, role in patterns]
    made = []
    for g, texts in streams.items():
        held = {}

        def emit():
            nonlocal held
            if set(held) - set(keep):
                made.append((g, dict(held)))
            held = held if keep_all else {k: v for k, v in held.items() if k in keep}

        for text in texts:
            for pattern, names, role in compiled:
                if found := pattern.search(text):
                    new = {n: v for n, v in zip(names, found.groups()) if v is not None}
                    if "pre" in role or (not clobber and set(new) & (set(held) - set(keep))):
                        emit()
                    held = held | new
                    if "post" in role:
                        emit()
        if not clobber:
            emit()
    return sorted((g, tuple(sorted(r.items()))) for g, r in made)


ROLES = ["", "pre", "post", "pre+post"]


@pytest.mark.parametrize("seed", range(4))
def test_same_as_one_pass(spark, monkeypatch, seed):
    """One large stream over many chunks, and some small ones."""
    monkeypatch.setattr(P, "CHUNK_ROWS", [5, 7, 40][seed % 3])
    rng = random.Random(seed)
    streams = {f"s{k}": [] for k in range(5)}
    for k in range(400):
        name = "s0" if rng.random() < 0.8 else f"s{rng.randint(1, 4)}"
        streams[name].append(rng.choice([f"a {k}", f"b {k}", f"c {k} d {k}", f"c {k}", f"k {k}", "nothing"]))
    rows = [(g, k, t) for g, texts in streams.items() for k, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "file string, at long, value string").repartition(4)
    patterns = [(r"^a (\d+)", ["a"], rng.choice(ROLES)), (r"^b (\d+)", ["b"], rng.choice(["", "pre"])), (r"^c (\d+)(?: d (\d+))?", ["c"], rng.choice(ROLES)), (r"^k (\d+)", ["kept"], "")]
    few = [(seed % 2 == 1, ("kept",), False), (False, (), seed == 3)]
    for clobber, keep, keep_all in itertools.product([False, True], [(), ("kept",)], [False, True]) if seed == 0 else few:
        got = L.parse_multi_re(lines, patterns, ["at"], by=["file"], clobber=clobber, keep=keep, keep_all=keep_all)
        assert got.columns == ["file", "a", "b", "c", "1", "kept"]
        found = sorted((r["file"], tuple(sorted((c, r[c]) for c in got.columns[1:] if r[c] is not None))) for r in got.collect())
        assert found == plain(streams, patterns, clobber, keep, keep_all)


def test_one_file_in_many_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_ROWS", 1000)
    texts = [t for k in range(20_000) for t in ([f"block {k}"] if k % 50 == 0 else []) + [f"id {k}", f"name n{k}"]]
    (tmp_path / "one.log").write_text("\n".join(texts))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = L.read_lines(spark, str(tmp_path / "one.log"))
        assert lines.select("_block").distinct().count() > 10
        got = L.parse_multi_re(lines, [(r"^block (\d+)", ["block"], ""), (r"^id (\d+)", ["id"], "pre"), ("^name (.*)", ["name"], "")], ["_block", "_line"], keep=["block"])
        assert got.filter((F.col("name") == F.concat(F.lit("n"), "id")) & (F.floor(F.col("id") / 50) * 50 <= F.col("block") + 0) & (F.col("block") % 50 == 0)).count() == 20_000
        assert got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sets_fall_together():
    rules = M.Rules((False, True, False), (False, False, True), False, 0b111, False)
    starts = rules.reachable([(0, 1), (1, 2), (2, 4)])
    ends, counts = M.run_all(rules, starts, [(0, 1), (0, 1), (1, 2), (2, 4), (0, 1)])
    assert len(set(ends)) == 1 and dict(zip(starts, counts))[0] == 3
    with pytest.raises(ValueError):
        M.Rules((False,) * 14, (False,) * 14, True, (1 << 14) - 1, False).reachable([(k, 1 << k) for k in range(14)])


def test_nothing(spark):
    none = spark.createDataFrame([("f", 1, "zzz"), ("f", 2, None)], "file string, at long, value string")
    assert L.parse_multi_re(none, [("^a (.)", ["a"], "")], ["at"], by=["file"]).count() == 0
    assert L.parse_multi_re(none.limit(0), [("^a (.)", ["a"], "")], ["at"], by=[]).columns == ["a"]
