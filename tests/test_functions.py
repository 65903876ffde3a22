"""Coercions, paths, patterns and aggregators on small fixtures with nulls and odd values."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import aggregators, coerce, domain, keys
from recordloom.functions.snippets import apply_rows, expression
from recordloom.operators.collate import collate, collate_adjacent, collate_each, collate_rolling, collate_running


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_numbers_from_text(spark):
    texts = ["5", " 5 ", "", "abc", "0x10", "5d", "1e3", "NaN", "-.5", None, "1_000", "Infinity"]
    got = one(spark.createDataFrame([(t,) for t in texts], "s string"), coerce.number(F.col("s"), T.StringType()))
    assert [None if g is None else "nan" if g != g else g for g in got] == [5.0, 5.0, 0.0, "nan", 16.0, "nan", 1000.0, "nan", -0.5, None, "nan", float("inf")]


def test_text_from_numbers(spark):
    rows = [(5.0, "5"), (5.25, "5.25"), (float("nan"), "NaN"), (float("inf"), "Infinity"), (0.0001, "0.0001"), (12345678.9, "12345678.9"), (1e10, "10000000000"), (None, None), (-0.5, "-0.5"), (1e21, "1e+21")]
    frame = spark.createDataFrame([(x,) for x, _ in rows], "x double")
    assert one(frame, coerce.text(F.col("x"), T.DoubleType())) == [t for _, t in rows]


def test_truth(spark):
    frame = spark.createDataFrame([(0.0, "", False), (2.0, "x", True), (float("nan"), "0", None), (None, None, None)], "n double, s string, b boolean")
    got = [one(frame, coerce.truth(F.col(c), frame.schema[c].dataType)) for c in "nsb"]
    assert got == [[False, True, False, False], [False, True, True, False], [False, True, False, False]]


@pytest.fixture(scope="module")
def nested(spark):
    kind = "foo_bar string, zip_foo string, zip_bar long, zip struct<foo:long,deep:struct<x:long>>, list array<struct<a:long>>, `odd/name` long"
    return spark.createDataFrame([("b", "f", 2, (1, (7,)), [(4,), (5,)], 9)], kind)


def test_paths(nested):
    for path, want in (("zip/foo", 1), ("zip/deep/x", 7), ("list/#1/a", 5), ("list/#7/a", None), ("odd\\/name", 9), ("nope", None), ("zip_foo/x", None), ("@ZIP_B", 2), ("@oo_b", "b")):
        assert one(nested, keys.value(nested, path)) == [want], path


def test_assign(nested):
    out = keys.assign(nested, "zip/deep/x", F.lit(8))
    assert out.select("zip.deep.x", "zip.foo").first()[:] == (8, 1)
    assert keys.assign(nested, "new/inner", F.lit(3)).select("new.inner").first()[0] == 3
    assert one(keys.assign(nested, "list/#0/a", F.lit(0).cast("long")), "list.a") == [[0, 5]]


def test_patterns(nested):
    assert keys.resolve(nested.schema, "!^zip!") == ["zip_foo", "zip_bar"]
    assert keys.resolve(nested.schema, "!foo!d=2,zip_bar") == ["foo_bar", "zip_foo", "zip/foo", "zip_bar"]
    assert keys.resolve(nested.schema, "!x!f") == ["zip/deep/x"]
    assert keys.resolve(nested.schema, "!^zip!rr!s") == ["zip", "zip_bar", "zip_foo"]
    for bad in ("!zip", "!zip!q", "!zip!s!s"):
        with pytest.raises(ValueError):
            keys.resolve(nested.schema, bad)


def test_snippets(nested):
    assert one(nested, expression(nested, "{{zip/foo}} + {{zip_b}}")) == [3]
    assert one(nested, expression(nested, "coalesce({{missing}}, 'none')")) == ["none"]
    out = apply_rows(nested.select("zip_bar"), lambda r: [{"n": r["zip_bar"]}, {"n": -r["zip_bar"]}], "n long")
    assert one(out, "n") == [2, -2]
    assert apply_rows(nested.select("zip_bar"), lambda r: None, "n long").count() == 0


ROWS = [(1, "a", "1", 10.0), (2, "a", None, None), (3, None, "1", 30.0), (4, "", "b", float("nan")), (5, "a", "b", 5.0), (6, "b", "c", 5.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "o long, g string, s string, x double")


def agg(rows, *specs, keys=(), order=("o",)):
    return collate(rows, list(keys), list(specs), list(order))


def test_groups_of_nulls(rows):
    got = {r["g"]: r["count"] for r in agg(rows, "count", keys=["g"]).collect()}
    assert got == {"a": 3, None: 1, "": 1, "b": 1}
    as_text = collate(rows, ["g"], ["count", "ids=array,o"], ["o"], as_text=True).collect()
    assert sorted((r["g"] or "", r["count"]) for r in as_text) == [("", 2), ("a", 3), ("b", 1)]
    assert [r["g"] for r in as_text if r["ids"] == [3, 4]] == [None]  # the first record's value


def test_no_rows_no_groups(rows):
    assert agg(rows.limit(0), "count").count() == 0 and agg(rows.limit(0), "mode,s", keys=["g"]).count() == 0


def test_aggregators_skip_nulls(rows):
    sound = rows.filter("o <> 4")
    got = agg(sound, "n=count", "sum,x", "avg,x", "lo=min,x", "hi=max,x", "f=first,s", "l=last,s", "m=mode,s", "d=dct,s", "u=uarray,s", "c=concat,-,s", "uc=uconcat,+,s").first()
    assert (got["n"], got["sum_x"], got["avg_x"], got["lo"], got["hi"]) == (5, 50.0, 12.5, 5.0, 30.0)
    assert (got["f"], got["l"], got["m"], got["d"], got["u"]) == ("1", "c", "1", 3, ["1", "b", "c"])
    assert (got["c"], got["uc"]) == ("1-null-1-b-c", "1+b+c")


def test_mode_ties_go_to_the_first_seen(spark):
    frame = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b")], "o long, s string")
    assert agg(frame, "m=mode,s", "c=cb,s").first()[:] == ("b", {"a": 2, "b": 2})


def test_percentiles(spark):
    frame = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "x double")
    row = collate(frame, [], [f"p{p}=perc,{p},x" for p in (0, 25, 50, 90, 100)] + ["m=percmap,50 90,x"]).first()
    assert row[:-1] == (1.0, 2.0, 3.0, 4.0, 4.0) and row["m"] == {"50": 3.0, "90": 4.0}


def test_records_for_extremes_take_the_last_of_ties(rows):
    got = agg(rows, "h=recformax,x", "l=recformin,x", "f=firstrec", "z=lastrec", "r=recs").first()
    assert (got["h"]["o"], got["l"]["o"], got["f"]["o"], got["z"]["o"]) == (3, 6, 1, 6)
    assert [r["o"] for r in got["r"]] == [1, 2, 3, 4, 5, 6]


def test_constant_input_has_no_correlation(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "x double, y double")
    got = collate(frame, [], ["corr,x,y", "cov,x,y", "l=linreg,x,y", "u=ord2uni,x", "b=ord2biv,x,y"]).first()
    assert got["corr_x_y"] is None and got["cov_x_y"] == 0.0 and got["l"]["beta"] is None
    assert (got["u"]["count"], got["u"]["variance"], got["u"]["kurtosis"]) == (3, 0.0, None) and got["b"]["count"] == 2


def test_values_to_keys_last_wins(spark):
    frame = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 3), (4, "b", None)], "o long, k string, v long")
    assert agg(frame, "m=vk,k,v").first()["m"] == {"a": 2, "b": None}


def test_specs(rows):
    assert aggregators.parse("avg,a/b") == ("avg_a_b", "average", ["a/b"])
    assert aggregators.parse("total=sum,x")[0] == "total" and len(aggregators.listing()) == 29
    for bad in ("sum", "nope,x", "perc,x"):
        with pytest.raises(ValueError):
            aggregators.parse(bad)
    with pytest.raises(ValueError):
        aggregators.build(aggregators.Fields(rows, None), "firstrecord", [])


def test_cube_keeps_null_apart_from_all(rows):
    got = {(r["g"], r["s"]): r["count"] for r in collate(rows, ["g", "s"], ["count"], cube=True).collect()}
    assert got["ALL", "ALL"] == 6 and got["a", "ALL"] == 3 and got[None, "ALL"] == 1 and got["a", None] == 1 and got["ALL", "b"] == 2


def test_subset_of_nothing_is_null(rows):
    specs = [("n", domain.subset("{{x}} > 100", domain.named("count"))), ("m", domain.subset("{{x}} > 8", domain.named("count"))), ("s", domain.subset("{{x}} > 8", domain.named("mode", "s")))]
    got = collate(rows.filter("not isnan(x) or x is null"), [], specs, ["o"]).first()
    assert got[:] == (None, 2, "1")


def test_windows(rows):
    assert [tuple(r) for r in collate_rolling(rows, 3, ["ids=array,o"], ["o"]).orderBy("o").collect()] == [(k, [k - 2, k - 1, k]) for k in (3, 4, 5, 6)]
    assert [r["n"] for r in collate_running(rows, ["g"], ["n=count"], ["o"]).orderBy("o").collect()] == [1, 2, 1, 1, 3, 1]
    runs = collate_adjacent(rows, ["g"], ["n=count"], ["o"]).orderBy("run").collect()
    assert [(r["g"], r["n"]) for r in runs] == [("a", 2), (None, 1), ("", 1), ("a", 1), ("b", 1)]
    assert [r["n"] for r in collate_each(rows, ["g"], ["n=count", "m=mode,s"], ["o"]).orderBy("o").collect()] == [3, 3, 1, 1, 3, 1]


def test_percentiles_by_group_and_cube(spark):
    frame = spark.createDataFrame([(k, g, float(x)) for k in "ab" for g in "xy" for x in range(4 if k == "a" else 1)], "k string, g string, x double")
    frame = frame.union(spark.createDataFrame([("n", "x", None)], frame.schema))
    specs = ["p=perc,50,x", "m=percmap,0 100,x", "n=dcount,x"]
    got = {(r["k"], r["g"]): (r["p"], r["m"], r["n"]) for r in collate(frame, ["k", "g"], specs, cube=True).collect()}
    assert got["a", "x"] == (2.0, {"0": 0.0, "100": 3.0}, 4) and got["b", "y"] == (0.0, {"0": 0.0, "100": 0.0}, 1)
    assert got["a", "ALL"] == (2.0, {"0": 0.0, "100": 3.0}, 4) and got["ALL", "ALL"] == (1.0, {"0": 0.0, "100": 3.0}, 4)
    assert got["n", "x"] == (None, {}, None)
    high = [("h", domain.subset("{{x}} > 1", domain.named("percentile", "50", "x"))), ("p", domain.named("percentile", "50", "x"))]
    assert {r["k"]: (r["h"], r["p"]) for r in collate(frame, ["k"], high).collect()} == {"a": (3.0, 2.0), "b": (None, 0.0), "n": (None, None)}


def test_percentiles_of_a_group_over_many_ranges(spark):
    groups = ["hot"] * 4_500 + [None] * 250 + ["a", "b", "c", "d", "e"] * 50
    rows = [(g, float((k * 7_919) % 3_001)) for k, g in enumerate(groups)]
    got = collate(spark.createDataFrame(rows, "g string, x double"), ["g"], [f"p{p}=perc,{p},x" for p in (0, 37, 50, 99)]).collect()
    assert len(got) == 7
    for row in got:
        values = sorted(x for g, x in rows if g == row["g"])
        for p in (0, 37, 50, 99):
            assert row[f"p{p}"] == values[min(len(values) * p // 100, len(values) - 1)], (row["g"], p)
