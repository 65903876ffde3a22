import pytest
from pyspark.sql import functions as F

from recordloom.flow import Flow
from recordloom.operators.profile import profile
from recordloom.plans.order import numbered

ROWS = [{"x": 3, "g": "a", "l": [1, 2]}, {"x": 1, "g": "b", "l": []}, {"x": 2, "g": "b", "l": None}, {"x": 1, "g": "a", "l": [7]}]


@pytest.fixture(scope="module")
def flow(spark):
    return Flow.from_records(spark, ROWS, "x bigint, g string, l array<bigint>")


def xs(flow):
    return [r["x"] for r in flow.records()]


def test_chain(flow):
    assert xs(flow) == [3, 1, 2, 1] and xs(flow.grep("{{x}} < 3")) == [1, 2, 1]
    assert xs(flow.sort("x=n")) == [1, 1, 2, 3] and [r["g"] for r in flow.sort("x=n").records()] == ["b", "a", "b", "a"]
    assert [r["g"] for r in flow.sort("x=n", reverse=True).records()] == ["a", "b", "a", "b"]
    assert xs(flow.head(2)) == [3, 1] and xs(flow.tail(3)) == [1] and xs(flow.sort("x=n").head(3).tail(1)) == [1, 2]
    assert xs(flow.uniq("g")) == [3, 1, 1] and xs(flow.delta("x")) == [-2, 1, -1] and xs(flow.topn(1, "g")) == [3, 1]
    assert [r["l"] for r in flow.decollate("l").records()] == [1, 2, 7]
    assert xs(flow.concat(flow.head(1))) == [3, 1, 2, 1, 3]
    assert [r["y"] for r in flow.map({"y": "{{x}} * 2"}).records()] == [6, 2, 4, 2]
    assert xs(flow.eval({"x": "{{x}} + 1"})) == [4, 2, 3, 2]
    got = flow.collate(["g"], ["n=count", "f=first,x"]).records()
    assert sorted((r["g"], r["n"], r["f"]) for r in got) == [("a", 2, 3), ("b", 2, 1)]
    assert xs(flow.join(flow.head(1).map({"k": "{{g}}", "z": "{{x}}"}), [("g", "k")])) == [3, 1]


def test_numbers_with_a_hot_first_key_and_with_nulls_only(spark):
    rows = spark.range(500).selectExpr("if(id % 5 = 0, id, 7L) as a", "id as b", "cast(null as int) as n").repartition(6)
    for order in (["a", "b"], ["n", "b"]):
        got = [tuple(r) for r in numbered(rows, order).orderBy("_place").select("_place", *order).collect()]
        want = sorted(([x["a"] if order[0] == "a" else None, x["b"]] for x in rows.collect()), key=lambda v: (v[0] or 0, v[1]))
        assert got == [(k, *v) for k, v in enumerate(want)]
    assert numbered(rows.limit(0), ["a", "b"]).count() == 0


def test_files(flow, spark, tmp_path):
    flow.to_json_array(f"{tmp_path}/a")
    flow.sort("x=-n").to_csv(f"{tmp_path}/c", ["x", "g"])
    flow.to_json_lines(f"{tmp_path}/l")
    assert sorted(r["x"] for r in Flow.from_csv(spark, f"{tmp_path}/c").records()) == [1, 1, 2, 3]
    assert sorted(r["x"] for r in Flow.from_json_lines(spark, f"{tmp_path}/l").records()) == [1, 1, 2, 3]
    whole = tmp_path / "whole.json"
    whole.write_text("".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*"))))
    read = Flow.from_json_array(spark, str(whole))
    assert read.df.columns == ["g", "l", "x"] and [r["x"] for r in read.records()] == xs(flow)


def test_order_is_asked_for(flow):
    with pytest.raises(ValueError):
        Flow(flow.df).head(1)


def test_profile(flow):
    got = {r["field"]: r for r in profile(flow.df.drop("_place")).collect()}
    assert (got["x"]["type"], got["x"]["records"], got["l"]["filled"], got["g"]["distinct"], got["g"]["example"]) == ("bigint", 4, 0.75, 2, "a")
    assert profile(flow.df.limit(0)).filter(F.col("filled").isNull()).count() == 4
