"""Keyed state on streams, stopped and started again between files, against the batch operators and plain loops."""

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import collate as C
from recordloom.streaming import events, keyed

RNG = random.Random(6)
ROWS = [(k, f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", RNG.choice("ab"), RNG.choice("xxyz"), RNG.choice([1.0, 2.0, 2.5])) for k in range(240)]
KIND = "i long, t string, k string, v string, x double"


@pytest.fixture
def replay(spark, tmp_path):
    """Runs a query over one file after the other, each with a new start from the checkpoint; all rows that it put out."""

    def run(made, files):
        schema = "i long, t timestamp, k string, v string, x double"
        for n, rows in enumerate(files):
            frame = spark.createDataFrame(rows, KIND).withColumn("t", F.to_timestamp("t"))
            frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            out = made(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
            stream = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
            stream = stream.outputMode("append").trigger(availableNow=True).start()
            stream.awaitTermination(120)
            assert stream.exception() is None
        return spark.read.parquet(f"{tmp_path}/out").collect()

    return run


FILES = [ROWS[:70], ROWS[70:71], ROWS[71:]]


def test_rolling_windows(replay):
    made = {"total": "sum", "low": "minimum", "high": "maximum", "dev": "stddev", "kinds": "distinctcount", "begin": "first", "mid": lambda w: np.median(w, axis=1)}
    got = {(r["k"], r["i"]): r for r in replay(lambda s: keyed.rolling_windows(s, "k", "i", "x", 4, made), FILES)}
    want = {}
    for k in "ab":
        mine = [r for r in ROWS if r[2] == k]
        want |= {(k, mine[j][0]): [r[4] for r in mine[j - 3 : j + 1]] for j in range(3, len(mine))}
    assert set(got) == set(want)
    for at, w in want.items():
        r = got[at]
        assert (r["total"], r["low"], r["high"], r["kinds"], r["begin"], r["mid"]) == (sum(w), min(w), max(w), len(set(w)), w[0], float(np.median(w)))
        assert abs(r["dev"] - np.std(w)) < 1e-12


def test_value_runs(spark, replay):
    """Runs that end are those of the batch operator; a timer closes the last ones."""
    later = [(1000, "2024-01-01 05:00:00", "c", "q", 0.0)], [(1001, "2024-01-01 06:00:00", "c", "q", 0.0)]
    found = replay(lambda s: keyed.value_runs(s, "k", "i", "v", "x", "t", 600, "1 second"), [*FILES, *later])
    got = sorted((r["k"], r["run"], r["value"], r["n"], r["total"], r["began"], r["ended"]) for r in found if r["k"] in "ab")
    frame = spark.createDataFrame(ROWS, KIND)
    runs = C.collate_adjacent(frame, ["v"], ["n=count", "total=sum,x", "began=min,i", "ended=max,i"], ["i"], by=["k"])
    assert got == sorted((r["k"], r["run"], r["v"], r["n"], r["total"], r["began"], r["ended"]) for r in runs.collect())
    want = sum(1 for k in "ab" for _ in groupby([r for r in ROWS if r[2] == k], lambda r: r[3]))
    assert len(got) == want


def test_open_groups(spark, replay):
    """What was closed is what the batch operator groups, but for the groups that are still open."""
    rows = [(i, t, "s", f"{RNG.choice('pqrstu')}", x) for i, t, _, _, x in ROWS]
    found = replay(lambda s: keyed.open_groups(s, "k", "v", "i", "x", 3), [rows[:70], rows[70:71], rows[71:]])
    got = sorted((r["v"], r["n"], r["total"], r["began"], r["ended"]) for r in found)
    batch = C.collate_recent(spark.createDataFrame(rows, KIND), "v", 3, ["n=count", "total=sum,x", "ended=max,i"], ["i"])
    every = sorted((r["v"], r["n"], r["total"], r["began"], int(r["ended"])) for r in batch.collect())
    still = sorted(every, key=lambda g: g[4])[-3:]
    assert len(got) > 20 and got == sorted(set(every) - set(still))


def test_idle_groups_are_closed(replay):
    later = [(1000, "2024-01-01 05:00:00", "c", "q", 0.0)]
    found = replay(lambda s: events.recent_groups(s, "k", "i", "x", "t", "10 minutes", "1 second"), [*FILES, later])
    got = {r["k"]: (r["n"], r["total"], r["last"]) for r in found}
    want = {k: [r for r in ROWS if r[2] == k] for k in "ab"}
    assert got == {k: (len(rs), sum(r[4] for r in rs), rs[-1][0]) for k, rs in want.items()}
