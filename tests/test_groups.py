"""Ordered operators by group and running aggregates, against plain loops, with a group of most rows over many chunks."""

import math
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from recordloom.operators import collate as C
from recordloom.operators import ordering as O
from recordloom.operators import reshape as S
from recordloom.operators import rows as R
from recordloom.plans import order as P

RNG = random.Random(4)
#: Nine tenths of the rows are of one group; null and empty text are one group too.
ROWS = [
    (k, "hot" if RNG.random() < 0.9 else RNG.choice(["a", "b", "c", None, ""]), RNG.choice(["x", "x", "y", None]), RNG.choice([1.5, 2.0, -3.0, 1e6, None]), 60 * k + RNG.randint(0, 90))
    for k in range(500)
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "o long, g string, s string, x double, t long").repartition(5).cache()


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(P, "CHUNK_ROWS", 16)


def streams(null_apart=False):
    key = (lambda r: "?" if r[1] is None else r[1]) if null_apart else (lambda r: r[1] or "")
    return [(g, sorted(rs)) for g, rs in ((g, list(rs)) for g, rs in groupby(sorted(ROWS, key=lambda r: (key(r), r[0])), key))]


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def by(rows, operator, **options):
    return S.by_group(rows, ["g"], operator, **options)


def test_substream(rows):
    want = []
    for _, rs in streams():
        begun = ended = False
        for r in rs:
            begun = begun or (r[3] or 0) < 0
            if begun and not ended:
                want.append((r[0],))
                ended = r[2] is None
    assert got(by(rows, O.substream, order=["o"], begin="{{x}} < 0", end="{{s}} is null"), "o") == sorted(want, key=repr)
    open_end = [(r[0],) for _, rs in streams() for k, r in enumerate(rs) if any((q[3] or 0) < 0 for q in rs[: k + 1])]
    assert got(by(rows, O.substream, order=["o"], begin="{{x}} < 0"), "o") == sorted(open_end, key=repr)
    only_end = [(r[0],) for _, rs in streams() for k, r in enumerate(rs) if not any(q[2] is None for q in rs[:k])]
    assert got(by(rows, O.substream, order=["o"], end="{{s}} is null"), "o") == sorted(only_end, key=repr)


def test_adjacent(rows):
    want = []
    for _, rs in streams():
        for n, (_, run) in enumerate(groupby(rs, lambda r: r[2]), 1):
            run = list(run)
            want.append((run[0][1], n, run[0][2], len(run), run[-1][0]))
    found = by(rows, C.collate_adjacent, keys=["s"], aggregates=["n=count", "end=last,o"], order=["o"])
    assert found.columns == ["run", "s", "g", "n", "end"]
    assert got(found, "g", "run", "s", "n", "end") == sorted(want, key=repr)


def test_rolling_context_neighbours(rows):
    rolled = [(r[1], r[0], [q[0] for q in rs[k - 2 : k + 1]]) for _, rs in streams() for k, r in enumerate(rs) if k >= 2]
    assert got(by(rows, C.collate_rolling, size=3, aggregates=["ids=array,o"], order=["o"]), "g", "o", "ids") == sorted(rolled, key=repr)
    near = [(r[0],) for _, rs in streams() for k, r in enumerate(rs) if any(q[3] == 1e6 for q in rs[max(k - 1, 0) : k + 3])]
    assert got(by(rows, R.grep_context, condition="{{x}} = 1e6", order=["o"], before=2, after=1), "o") == sorted(near, key=repr)
    around = [(r[0], [q[0] for q in rs[max(k - 2, 0) : k]][::-1], [q[0] for q in rs[k + 1 : k + 2]]) for _, rs in streams() for k, r in enumerate(rs)]
    found = by(rows, R.xform_neighbours, order=["o"], before=2, after=1)
    assert got(found.select("o", F.transform("B", lambda b: b["o"]).alias("B"), F.transform("A", lambda a: a["o"]).alias("A")), "o", "B", "A") == sorted(around, key=repr)


def test_skip_head_uniq_delta_sort(rows):
    assert got(by(rows, O.skip, n=3, order=["o"]), "o") == sorted([(r[0],) for _, rs in streams() for r in rs[3:]], key=repr)
    assert got(by(rows, O.head, n=3, order=["o"]), "o") == sorted([(r[0],) for _, rs in streams() for r in rs[:3]], key=repr)
    once = [(r[0],) for _, rs in streams() for k, r in enumerate(rs) if k == 0 or (r[2] or "") != (rs[k - 1][2] or "")]
    assert got(by(rows, O.uniq, keys=["s"], order=["o"]), "o") == sorted(once, key=repr)
    steps = [(r[0], float(q[4] - r[4])) for _, rs in streams() for r, q in zip(rs, rs[1:])]
    assert got(by(rows, O.delta, keys=["t"], order=["o"]), "o", "t") == sorted(steps, key=repr)
    ordered = [r[0] for _, rs in streams() for r in sorted(rs, key=lambda r: (-(r[3] or 0.0), r[0]))]
    assert [r["o"] for r in by(rows, O.sort, keys=["x=-n"], order=["o"]).collect()] == ordered


def test_loose_times(rows):
    want = []
    for _, rs in streams():
        last = None
        for r in rs:
            at = r[4] // 120 * 120
            last = last if last is not None and at == last + 120 else at
            want.append((r[0], last))
    found = by(rows, R.normalize_time, key="t", span=120, order=["o"], strict=False)
    assert got(found.select("o", F.col("n_t").cast("long").alias("n")), "o", "n") == sorted(want, key=repr)


def test_single_records_and_groups(rows):
    assert by(rows, R.grep, condition="{{x}} > 0").count() == sum((r[3] or 0) > 0 for r in ROWS)
    sizes = by(rows, C.collate, keys=["s"], aggregates=["n=count"])
    assert sizes.columns == ["g", "s", "n"] and sizes.agg(F.sum("n")).first()[0] == len(ROWS)
    with pytest.raises(TypeError):
        by(rows, S.pivot, x=[], y=[], values=[], order=["o"])


SPECS = [
    "n=count", "sum,x", "avg,x", "low=min,x", "high=max,x", "var,x", "dev=stddev,x", "dct,s", "f=first,s", "l=last,s", "fr=firstrec", "lr=lastrec",
    "top=recformax,x", "least=recformin,x", "c=cov,o,x", "r=linreg,o,x", "m=ord2uni,o", "ids=array,o",
]


def close(a, b):
    return a == b if a is None or b is None else math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)


@pytest.mark.parametrize("keys", [["g"], []])
def test_running(rows, keys):
    """Every state against the group's records so far, over many chunks."""
    found = {r["o"]: r for r in C.collate_running(rows, keys, SPECS, ["o"]).collect()}
    assert len(found) == len(ROWS)
    for _, rs in streams(null_apart=True) if keys else [("", sorted(ROWS))]:
        for k, r in enumerate(rs):
            sofar, row = rs[: k + 1], found[r[0]]
            xs = [q[3] for q in sofar if q[3] is not None]
            assert row["n"] == k + 1 and close(row["sum_x"], sum(xs) if xs else None) and close(row["avg_x"], sum(xs) / len(xs) if xs else None)
            assert (row["low"], row["high"]) == ((min(xs), max(xs)) if xs else (None, None))
            assert row["dct_s"] == len({q[2] for q in sofar} - {None})
            assert (row["f"], row["l"]) == (next((q[2] for q in sofar if q[2] is not None), None), r[2])
            assert (row["fr"]["o"], row["lr"]["o"]) == (rs[0][0], r[0]) and row["ids"] == [q[0] for q in sofar]
            if xs:
                mean = sum(xs) / len(xs)
                var = sum((x - mean) ** 2 for x in xs) / len(xs)
                assert math.isclose(row["var_x"], var, rel_tol=1e-6, abs_tol=1e-2) and math.isclose(row["dev"], math.sqrt(var), rel_tol=1e-6, abs_tol=1e-1)
                assert row["top"]["o"] == max((q[3], q[0]) for q in sofar if q[3] is not None)[1]
                assert row["least"]["o"] == max((-q[3], q[0]) for q in sofar if q[3] is not None)[1]
            ids = [q[0] for q in sofar]
            mean = sum(ids) / len(ids)
            assert row["m"]["count"] == len(ids) and close(row["m"]["mean"], mean) and close(row["m"]["variance"], sum((x - mean) ** 2 for x in ids) / len(ids))


def test_no_task_holds_a_group(rows, capsys):
    """All windows over rows part by chunk; of a group alone only rows that stand for chunks."""
    C.collate_running(rows, ["g"], ["n=count", "sum,x"], ["o"]).explain("formatted")
    plan = capsys.readouterr().out
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("windowspecdefinition(_chunk#" in w or "_total_" in w for w in windows)
    dealt = P.chunked(P.segmented(rows, P.by_columns(rows, ["g"]), ["o"])[0], 2, 1)
    assert dealt.groupBy(P.CHUNK).count().agg(F.max("count")).first()[0] <= 16 + 3


def test_helper_names_are_refused(rows):
    with pytest.raises(ValueError, match="_range"):
        P.numbered(rows.withColumn("_range", F.lit(1)), ["o"])


def test_empty(rows):
    none = rows.limit(0)
    assert C.collate_running(none, ["g"], SPECS, ["o"]).count() == 0
    assert by(none, O.substream, order=["o"], begin="{{x}} < 0", end="{{x}} > 0").count() == 0
    assert by(none, C.collate_adjacent, keys=["s"], aggregates=["n=count"], order=["o"]).count() == 0


@pytest.mark.parametrize("size", [1, 2, 4, 50])
def test_recent_groups(rows, spark, size):
    """Groups of a bounded number, against a list of open ones; most chunks see few keys, so lists reach far back."""
    marked = rows.withColumn("k", F.when(F.col("o") < 300, F.col("g")).otherwise((F.col("o") % 7).cast("string")))
    open_groups, want = {}, []
    for r in sorted(ROWS):
        key = (r[1] or "") if r[0] < 300 else str(r[0] % 7)
        held = open_groups.pop(key, None) or [r[0], key, 0, 0]
        open_groups[key] = [held[0], key, held[2] + 1, r[0]]
        while len(open_groups) > size:
            want.append(tuple(open_groups.pop(next(iter(open_groups)))))
    want += [tuple(v) for v in open_groups.values()]
    found = C.collate_recent(marked, "k", size, ["n=count", "last=last,o"], ["o"])
    assert sorted((r["began"], r["k"] or "", r["n"], r["last"]) for r in found.collect()) == sorted(want)
