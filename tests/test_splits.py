"""CSV and JSON files cut into many splits, against Python's readers and Spark's whole-file ones."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from recordloom.sinks import writers
from recordloom.sources import lines as L
from recordloom.sources import splits as S


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "700")
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def made_rows(count, seed):
    rng = random.Random(seed)
    odd = ["plain", 'q"q', "a,b", "two\nlines", "\n\n", '"', 'x""y', " wide ", "5\" pipe", "long " * 300, "naïve 日本"]
    return [[str(k), rng.choice(odd), rng.choice(["", "z", "é\n" * 3])] for k in range(count)]


def test_csv_in_many_splits(spark, tmp_path, small_splits):
    rows = made_rows(600, 1)
    for name, part in (("a.csv", rows[:400]), ("b.csv", rows[400:])):
        with open(tmp_path / name, "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n" if name == "a.csv" else "\r\n")
            writer.writerow(["id", "text", "more"])
            writer.writerows(part)
    path = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    cut = S.records(spark, path, S.CsvCut())
    assert cut.select("_file", "_block").distinct().count() > 50
    got = L.read_csv(spark, path, header=True, strict=True, places=True)
    found = [tuple(r[c] for c in ("id", "text", "more")) for r in got.orderBy("_file", "_block", "_line").collect()]
    assert found == [tuple(v or None for v in r) for r in rows]
    whole = spark.read.options(header="true", multiLine="true", escape='"').csv(path)
    assert sorted(map(str, found)) == sorted(str(tuple(r)) for r in whole.collect())
    typed = L.read_csv(spark, path, header=True, infer=True)
    assert [t for _, t in typed.dtypes] == ["int", "string", "string"] and typed.agg(F.sum("id")).first()[0] == sum(range(600))


def test_quotes_inside_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,5" pipe,x\n2, "in, side" ,y\n\n3,"open\n4,a""b\n",z,more\n')
    got = [tuple(r) for r in L.read_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert got == [("1", '5" pipe', "x", None), ("2", "in, side", "y", None), ("3", 'open\n4,a"b\n', "z", "more")]
    (tmp_path / "b.csv").write_text("k;v\n1;'a\\'b;c'\n")
    assert [tuple(r) for r in L.read_csv(spark, str(tmp_path / "b.csv"), header=True, delimiter=";", quote="'", escape="\\").collect()] == [("1", "a'b;c")]


def test_steps_follow_a_reader():
    rng = random.Random(2)
    cut = S.CsvCut(trim=False)
    for _ in range(300):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([[rng.choice(['"', "a", ",", "\n", 'b"', ""]) * rng.randint(0, 3) for _ in range(3)] for _ in range(4)])
        bit, ends = 0, 0
        for line in out.getvalue().split("\n")[:-1]:
            bit, _, _ = cut.step(line, bit)
            ends += not bit
        assert (bit, ends) == (0, len(list(csv.reader(io.StringIO(out.getvalue())))))


def objects(count):
    rng = random.Random(3)
    texts = ["a", "}{", '"}', "\\", "[{", "\\\"}", "é}日", "}" * 5]
    return [{"id": k, "t": rng.choice(texts), "in": {"x": [{"y": rng.choice(texts)}] * rng.randint(0, 2)}} for k in range(count)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_in_many_splits(spark, tmp_path, small_splits, indent):
    want = objects(500)
    (tmp_path / "a.json").write_text(json.dumps(want, indent=indent, ensure_ascii=False))
    cut = S.records(spark, str(tmp_path / "a.json"), S.JsonCut())
    assert cut.select("_block").distinct().count() > 20
    got = L.read_json_array(spark, str(tmp_path / "a.json"), places=True)
    assert got.schema["in"].dataType.simpleString() == "struct<x:array<struct<y:string>>>"
    found = [r.asDict(recursive=True) for r in got.orderBy("_block", "_line").select("id", "t", "in").collect()]
    assert found == want
    given = L.read_json_array(spark, str(tmp_path / "a.json"), ["t", "zap"], schema="id int, t string")
    assert given.columns == ["t", "zap"] and given.filter("t is not null and zap is null").count() == 500


def test_own_arrays_read_back(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"n}}{{{k}", [k], k / 2) for k in range(100)], "i long, s string, l array<long>, x double")
    writers.write_json_array(frame.repartition(4), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    back = L.read_json_array(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select("i", "s", "l", "x").collect()) == sorted(tuple(r) for r in frame.collect())


def test_small_and_empty_files(spark, tmp_path):
    for name, text, want in (("a", "[]", 0), ("b", "", 0), ("c", '{"a": 1}', 1), ("d", '{"a": 1}\n{"a": 2}', 2), ("e", '[{"a": {}}, 3, {"b": "}"}]\n', 2), ("f", "[{}]", 1)):
        (tmp_path / name).write_text(text)
        assert L.read_json_array(spark, str(tmp_path / name)).count() == want, name
    (tmp_path / "g").write_text("")
    assert L.read_csv(spark, str(tmp_path / "g")).count() == 0
    (tmp_path / "h").write_text('a,"never closed\nb,c\n')
    assert [tuple(r) for r in L.read_csv(spark, str(tmp_path / "h")).collect()] == [("a", "never closed\nb,c")]
