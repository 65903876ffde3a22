"""Charts drawn by Spark against pictures with every point drawn."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.flow import Flow
from recordloom.operators import rows as R
from recordloom.operators.join import join
from recordloom.sinks import raster


def every_point(values, wide, high):
    low, top = min(values), max(values)
    at = [(int(k / (len(values) - 1) * (2 * wide - 1) + 0.5), int((v - low) / ((top - low) or 1.0) * (4 * high - 1) + 0.5)) for k, v in enumerate(values)]
    dots = set(at)
    for a, b in zip(at, at[1:]):
        dots.update(raster.segment(a, b))
    return raster.canvas(dots, wide, high)


@pytest.mark.parametrize("count", [2, 7, 140, 1_000_000])
def test_a_line_is_the_full_one(spark, count):
    wave = F.col("id") % 1000 * F.when(F.col("id") % 7 == 0, -1.0).otherwise(0.5) + F.col("id") / 1000
    frame = spark.range(count).select("id", wave.alias("y"))
    values = [r[0] for r in frame.orderBy("id").select("y").collect()]
    shown = raster.line_chart(frame, ["id"], ["y"], 30, 6).splitlines()
    assert [line[-30:] for line in shown[:-1]] == every_point(values, 30, 6)
    assert shown[0].lstrip().startswith(f"{max(values):g}┤") and shown[-1].endswith("└" + "─" * 30)


def test_a_scatter_is_the_full_one(spark):
    rng = random.Random(1)
    points = [(rng.gauss(0, 1), rng.gauss(5, 2), None) for _ in range(3000)]
    shown = raster.scatter_chart(spark.createDataFrame(points, "a double, b double, c double"), "a", ["b", "c"], 20, 5, title="both").splitlines()
    ys = [p[1] for p in points] + [0.0]
    scale = lambda v, held, dots: int((v - min(held)) / (max(held) - min(held)) * (dots - 1) + 0.5)
    xs = [p[0] for p in points]
    dots = {(scale(a, xs, 40), scale(y, ys, 20)) for a, b, _ in points for y in (b, 0.0)}
    assert shown[0].strip() == "both" and [line[-20:] for line in shown[1:-1]] == raster.canvas(dots, 20, 5)


def test_small_pictures(spark):
    one = spark.createDataFrame([(1, "x", 3.0)], "o long, s string, v double")
    assert raster.line_chart(one, ["o"], ["v", "s"], 4, 2).count("\n") == 3
    assert raster.line_chart(one.limit(0), ["o"], ["v"]) == "" == raster.scatter_chart(one.limit(0), "o", ["v"])
    assert raster.canvas([(0, 0), (1, 3)], 1, 1) == [chr(0x2800 + 0x40 + 0x08)]


def test_elements_keep_their_places(spark):
    flow = Flow.from_records(spark, [{"l": [3, 1, 2]}, {"l": []}, {"l": [2, 2]}, {"l": [9]}], "l array<bigint>").decollate("l")
    values = lambda f: [r["l"] for r in f.records()]
    assert values(flow) == [3, 1, 2, 2, 2, 9] and values(flow.uniq("l")) == [3, 1, 2, 9] and values(flow.head(2)) == [3, 1] and values(flow.tail(4)) == [2, 9]


def test_deep_json_stays_text(spark):
    deep = "[" * 5000 + "]" * 5000
    got = R.expand_json(spark.createDataFrame([(deep,), ('{"a": "[1]"}',)], "m string"), recursive=True)
    assert sorted(r[0] for r in got.select(F.expr("cast(m as string)")).collect()) == sorted([deep, '{"a":[1]}'])


def test_joins_refuse_their_own_names(spark):
    frame = spark.createDataFrame([(1, 2)], "k long, _hit long")
    with pytest.raises(ValueError, match="_hit"):
        join(frame, frame.drop("_hit"), [("k", "k")])
