"""Operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from recordloom.operators import ordering as O
from recordloom.operators import reshape as S
from recordloom.operators import rows as R
from recordloom.operators.join import join, join_accumulate
from recordloom.plans.order import PLACE, numbered, running


@pytest.fixture(scope="module")
def count(spark):
    return spark.range(1, 41).select(F.col("id").alias("x"), (F.col("id") % 3).alias("g")).repartition(5)


def ids(df, column="x"):
    return sorted(r[0] for r in df.select(column).collect())


def test_numbers_and_running_sums(count):
    rows = numbered(count, ["x"])
    assert sorted((r["x"], r[PLACE]) for r in rows.collect()) == [(k, k - 1) for k in range(1, 41)]
    sums = running(rows, F.col("x"), "s", chunk=7).collect()
    assert all(r["s"] == r["x"] * (r["x"] + 1) // 2 for r in sums)
    text = count.withColumn("t", F.format_string("%03d", F.col("x")))
    assert sorted(r[PLACE] for r in numbered(text, ["t"]).collect()) == list(range(40))


def test_grep(count):
    assert ids(R.grep(count, "{{x}} < 4")) == [1, 2, 3] and len(ids(R.grep(count, "{{x}} < 4", invert=True))) == 37
    assert ids(R.grep(count, "case when x = 2 then null else x - 1 end")) == [k for k in range(3, 41)]
    assert ids(R.grep_context(count, "x in (10, 12)", ["x"], before=2, after=1)) == [8, 9, 10, 11, 12, 13]


def test_conditions_reach_the_scan(spark, capsys):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    R.grep(lines, "{{l_quantity}} > 49").select("l_orderkey").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,49.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_no_window_sees_all_rows(count, capsys):
    O.delta(count, ["x"], ["x"]).explain("formatted")
    assert "SinglePartition" not in capsys.readouterr().out


def test_neighbours(count):
    got = {r["x"]: ([b["x"] for b in r["B"]], [a["x"] for a in r["A"]]) for r in R.xform_neighbours(count, ["x"], 2, 1).collect()}
    assert got[1] == ([], [2]) and got[5] == ([4, 3], [6]) and got[40] == ([39, 38], [])


def test_xform_reads_the_record_as_it_came(count):
    row = R.xform(count.filter("x = 5"), {"x": "{{g}}", "g": "{{x}}", "n/m": "1"}).first()
    assert (row["x"], row["g"], row["n"]["m"]) == (2, 5, 1)


def test_assert_fails(count):
    assert R.ensure(count, "{{x}} > 0").count() == 40
    with pytest.raises(Exception, match="too small"):
        R.ensure(count, "{{x}} > 1", "too small").collect()


def test_rename_and_prune(count):
    assert R.rename(count, "g", "h").columns == ["x", "h"] and R.rename(count, "q", "h").filter("h is null").count() == 40
    assert R.prune(count, ["g", "nope"]).columns == ["g"]


def test_annotate(spark):
    frame = spark.createDataFrame([(1, "foo", 1), (2, "foo", 2), (3, None, 3), (4, None, 4)], "o long, name string, x long")
    out = R.annotate(frame, ["name"], {"y": "{{x}} * 10"}, ["o"])
    assert sorted((r["o"], r["y"]) for r in out.collect()) == [(1, 10), (2, 10), (3, 30), (4, 30)]


def test_expand_json(spark):
    frame = spark.createDataFrame([('{"a": [1]}',), ("plain",), ("12",), ("true",), (None,), ("{bad",)], "m string")
    out = R.expand_json(frame).select(F.expr("cast(m as string)"), F.expr("try_variant_get(m, '$.a[0]', 'int')"))
    assert [r[1] for r in out.collect()] == [1, None, None, None, None, None]
    assert [r[0] for r in out.collect()][1:] == ["plain", "12", "true", None, "{bad"]


def test_expand_json_recursive(spark):
    inner = '{"a": "{\\"b\\": \\"[1, \\\\\\"x\\\\\\", 12]\\"}", "c": "12", "d": "{bad}"}'
    frame = spark.createDataFrame([(inner,), ("12",), (None,), ("",)], "m string")
    got = [r[0] for r in R.expand_json(frame, recursive=True).select(F.expr("cast(m as string)")).collect()]
    assert got == ['{"a":{"b":[1,"x",12]},"c":"12","d":"{bad}"}', "12", None, ""]
    typed = R.expand_json(frame, ["m"], {"m": "a struct<b: array<string>>"}, recursive=True)
    assert typed.select("m.a.b").first()["b"] == ["1", "x", "12"]


def test_pivot_order_and_records(spark):
    rows = [(0, "ALL", "u", 1), (1, "b", "u", 2), (2, "a", "v", 3), (3, "a", "v", 4), (4, "a", "ALL", None)]
    frame = spark.createDataFrame(rows, "o long, k string, g string, n long")
    plain = S.pivot(frame, ["k"], ["g"], ["n"], ["o"], all_last=True)
    assert plain.columns == ["g", "a", "b", "ALL"] and [tuple(r) for r in plain.collect()] == [("u", None, "2", "1"), ("v", "4", None, None)]
    assert S.pivot(frame, ["k"], ["g"], ["n"], ["o"], sort=["k=-", "g=-"]).columns == ["g", "b", "a", "ALL"]
    nested = S.pivot_records(frame, ["k", "FIELD"], ["g"], ["n", "o"], ["o"])
    got = {r["g"]: {k: dict(v["FIELD"]) for k, v in r["k"].items()} for r in nested.collect()}
    assert got == {
        "u": {"ALL": {"n": "1", "o": "0"}, "b": {"n": "2", "o": "1"}}, "v": {"a": {"n": "4", "o": "3"}}, "ALL": {"a": {"o": "4"}},
    }
    assert S.pivot_records(frame.limit(0), ["k"], ["g"], ["n"], ["o"]).count() == 0


def test_times(spark):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([3600, 3659, 3725, 3775, 3795])], "o long, time long")
    loose = R.normalize_time(frame, "time", 60, ["o"], strict=False).orderBy("o")
    assert [r["n_time"] for r in loose.collect()] == [3600, 3600, 3720, 3720, 3720]
    strict = R.normalize_time(frame, "time", "1m").orderBy("o")
    assert [r["n_time"] for r in strict.collect()] == [3600, 3600, 3720, 3720, 3780]
    assert R.seconds_of("2d 12h") == 216_000


def test_dates(spark):
    frame = spark.createDataFrame([("15/Jan/2024 12:30",), ("",), (None,)], "d string")
    out = R.parse_date(frame, "d", output="e", read="%d/%b/%Y %H:%M", to_epoch=True)
    out = R.parse_date(out, "d", output="i", read="%d/%b/%Y %H:%M")
    out = R.parse_date(out, "d", output="w", read="%d/%b/%Y %H:%M", write="%Y at %H", zone="America/New_York")
    assert [tuple(r)[1:] for r in out.collect()] == [(1705321800, "2024-01-15T12:30:00.000Z", "2024 at 07"), (None, "", ""), (None, None, None)]
    with pytest.raises(Exception):
        R.parse_date(spark.createDataFrame([("junk",)], "d string"), "d", read="%Y").collect()


def test_sort(spark):
    rows = [(1, "10", "ALL"), (2, "9", "b"), (3, "x", None), (4, None, "a"), (5, "10", "b")]
    frame = spark.createDataFrame(rows, "o long, n string, s string")
    order = lambda *a, **k: [r["o"] for r in O.sort(frame, *a, order=["o"], **k).collect()]
    assert order(["n=n"]) == [3, 4, 2, 1, 5] and order(["n=-n"]) == [1, 5, 2, 4, 3]
    assert order(["s=*"]) == [3, 4, 2, 5, 1] and order(["n"], reverse=True) == [3, 2, 5, 1, 4]
    with pytest.raises(ValueError):
        order(["n=wrong"])


def test_streams(count):
    assert ids(O.topn(count, 2, ["g"], ["x"])) == [1, 2, 3, 4, 5, 6] and ids(O.topn(count, 2, (), ["x"])) == [1, 2]
    assert ids(O.skip(count, 38, ["x"])) == [39, 40]
    assert ids(O.substream(count, ["x"], "x >= 5", "x >= 7")) == [5, 6, 7] and ids(O.substream(count, ["x"], "x > 99")) == []
    assert ids(O.substream(count, ["x"], None, "x = 2")) == [1, 2] and len(ids(O.substream(count, ["x"], "x = 39", "x = 2"))) == 2
    runs = count.withColumn("h", F.floor(F.col("x") / 10))
    assert ids(O.uniq(runs, ["h"], ["x"])) == [1, 10, 20, 30, 40] and ids(O.uniq(runs, [], ["x"])) == [1]
    got = O.delta(count.withColumn("y", F.col("x") * F.col("x")), ["y"], ["x"]).collect()
    assert {r["x"]: r["y"] for r in got} == {k: 2.0 * k + 1 for k in range(1, 40)}


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "k", "a"), (2, None, "b"), (3, "z", "c"), (4, "k", "d")], "id long, key string, name string")
    right = spark.createDataFrame([("k", "K", 1), ("", "E", 2), ("q", None, 3)], "db string, name string, n long")
    return left, right


@pytest.mark.parametrize("kind,extra", [("inner", []), ("left", [(None, None, 3)]), ("right", [(3, "c", None)]), ("outer", [(3, "c", None), (None, None, 3)])])
def test_joins(sides, kind, extra):
    got = [(r["id"], r["name"], r["n"]) for r in join(*sides, [("key", "db")], kind).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted([(1, "K", 1), (2, "E", 2), (4, "K", 1), *extra], key=key)


def test_typed_join(sides):
    assert join(*sides, [("key", "db")], as_text=False).count() == 2


def test_accumulate(sides):
    got = {r["db"]: r["id"] for r in join_accumulate(*sides, [("key", "db")], ["id"], keep_unmatched=True).collect()}
    assert got == {"k": 1, "": 2, "q": None} and join_accumulate(*sides, [("key", "db")], ["id"]).count() == 2


def test_decollate(spark):
    frame = spark.createDataFrame([("x-y", "a-b-c", [1, 2], {"q": 1, "p": 2}), (None, "z", None, None)], "a string, b string, l array<long>, m map<string,long>")
    assert S.decollate(frame, ["split,a,-,p", "split,b,/-/,q"]).count() == 6
    assert [tuple(r) for r in S.decollate(frame, ["unarray,l,e", "unhash,m,k,v"], only=True).collect()] == [(1, "p", 2), (1, "q", 1), (2, "p", 2), (2, "q", 1)]
    held = frame.select(F.struct("a", "b").alias("s"))
    assert [tuple(r)[1:] for r in S.unhash(held, "s", "k", "v").collect()] == [("a", "x-y"), ("b", "a-b-c"), ("b", "z")]


def test_flatten(spark):
    frame = spark.createDataFrame([(([{"z": "v"}],), [1, 2]), (([],), [3])], "x struct<y:array<struct<z:string>>>, l array<long>")
    assert S.flatten(frame, ["x"], 2).columns == ["l", "x-y-0"] and S.flatten(frame, ["x"], 0).columns == ["l", "x-y-0-z"]
    assert [tuple(r)[1:] for r in S.flatten(frame, ["l"], 1, "_").collect()] == [(1, 2), (3, None)]
    with pytest.raises(ValueError):
        S.flatten(frame, ["l"], 1, widest=1)


def test_tables(spark):
    frame = spark.createDataFrame([(1, "foo", "a"), (2, "boo", "b"), (3, "foo", "c")], "o long, column string, data string")
    got = {r["i"]: (r["foo"] and r["foo"]["data"], r["boo"] and r["boo"]["data"]) for r in S.stream_to_table(frame, "column", ["o"]).collect()}
    assert got == {0: ("a", "b"), 1: ("c", None)}
    grid = S.pivot(frame, ["column"], [], ["data"], ["o"]).first()
    assert (grid["foo"], grid["boo"]) == ("c", "b")
    pinned = S.pivot(frame, ["FIELD"], ["column"], ["o", "data"], ["o"], pins={"column": "foo"}).collect()
    assert [tuple(r) for r in pinned] == [("foo", "c", "3")]
