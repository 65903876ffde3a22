"""Sources, sinks and streaming forms."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from recordloom.sinks import render, writers
from recordloom.sources import external
from recordloom.sources import lines as L
from recordloom.streaming import events


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_lines_keep_their_order(spark, tmp_path):
    path = put(tmp_path, "a.txt", "".join(f"line {k}\n" for k in range(500)))
    rows = L.read_lines(spark, path, filename_key="from").orderBy(*L.LINE_ORDER).collect()
    assert [r["value"] for r in rows] == [f"line {k}" for k in range(500)] and rows[0]["from"].endswith("a.txt")


def test_json(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '{"a": 1}\n\nbroken\n{"a": 2, "b": {"c": 3}}\n')
    assert sorted(r["a"] for r in L.read_json_lines(spark, path).filter("a is not null").collect()) == [1, 2]
    array = put(tmp_path, "b.json", '[{"x": 1, "y": 2}, {"x": 3}]')
    assert [tuple(r) for r in L.read_json_array(spark, array, ["x", "zap"]).collect()] == [(1, None), (3, None)]


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'foo,bar\n1, x \n"2\n2","a ""q"""\n')
    assert [tuple(r) for r in L.read_csv(spark, path, header=True).collect()] == [("1", "x"), ("2\n2", 'a "q"')]
    bare = put(tmp_path, "b.csv", "1,2,3\n")
    assert L.read_csv(spark, bare, ["one"]).columns == ["one", "1", "2"]
    assert L.read_csv(spark, path, header=True, infer=True).schema["foo"].dataType.simpleString() == "string"


def test_key_values(spark, tmp_path):
    path = put(tmp_path, "a.kv", "x 1\ny 2\nodd one out\nEND\nx 3\nx 4\nEND\n")
    blocks = L.read_lines(spark, path, separator="END\n")
    got = L.fields_of_map(L.parse_kv(blocks), "record", ["x", "y"]).orderBy("_line").select("x", "y").collect()
    assert [tuple(r) for r in got] == [("1", "2"), ("4", None)]


def test_patterns(spark):
    frame = spark.createDataFrame([("a1-b2",), ("none",), ("c3",)], "value string")
    assert [tuple(r) for r in L.parse_re(frame, r"^(\w)(\d)", ["l"]).collect()] == [("a", "1"), ("c", "3")]
    split = L.parse_split(spark.createDataFrame([("A1 A2,2",), ("B1",)], "value string"), "[ ,]", ["k"])
    assert [tuple(r) for r in split.collect()] == [("A1", "A2", "2"), ("B1", None, None)]


def test_server_logs(spark):
    texts = [
        '192.168.0.1 - - [07/Feb/2011:10:59:59 +0900] "GET /x/i.cgi/net/0000/ HTTP/1.1" 200 9891 "-" "Agent/1 \\"q\\""',
        '10.0.0.1 - bob [07/Feb/2011:10:59:59 +0900] "GET /" 404 -',
        "junk",
    ]
    rows = L.parse_apache(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert [(r["rhost"], r["user"], r["method"], r["path"], r["proto"], r["status"], r["bytes"]) for r in rows] == [
        ("192.168.0.1", "-", "GET", "/x/i.cgi/net/0000/", "HTTP/1.1", "200", "9891"), ("10.0.0.1", "bob", "GET", "/", None, "404", "-"),
    ]
    assert rows[0]["agent"] == 'Agent/1 \\"q\\"' and rows[1]["agent"] is None and rows[0]["datetime"] == "07/Feb/2011:10:59:59 +0900"
    ftp = "Mon Oct  1 17:09:23 2001 0 127.0.0.1 2611 FILENAME a _ o r tmp ftp 0 * c"
    row = L.parse_xferlog(spark.createDataFrame([(ftp,), ("x",)], "value string")).collect()
    assert len(row) == 1 and (row[0]["file_size"], row[0]["username"], row[0]["completion_status"]) == ("2611", "tmp", "c")


def test_server_logs_with_more_behind(spark):
    head = '1.2.3.4 - - [07/Feb/2011:10:59:59 +0900] "GET /x HTTP/1.1" 200'
    long = "x" * 20_000
    texts = [f'{head} 9891 "-" "agent" extra', f"{head} 23 17", f"v {head} 23 more", f'{head} 1 "{long}\\" "b"', f"{head}", f'{head} 1 "a']
    rows = L.parse_apache(spark.createDataFrame(list(enumerate(texts)), "k long, value string"), ["combined", "common", "vhost"]).orderBy("k").collect()
    assert [(r["k"], r["vhost"], r["bytes"], r["agent"] and r["agent"][:9]) for r in rows] == [
        (0, None, "9891", "agent"), (1, None, "23", None), (2, "v", "23", None), (3, None, "1", "b"), (5, None, "1", None),
    ]
    ftp = "Mon Oct  1 17:09:23 2001 0 h 2611 two  names {} {} {} r tmp ftp 0 * c"
    lines = [ftp.format(*x) for x in (("m", "X", "S"), ("b", "CU", "a"), ("z", "_", "o"))]
    got = L.parse_xferlog(spark.createDataFrame([(t,) for t in lines], "value string")).collect()
    assert [(r["filename"], r["transfer_type"], r["special_action_flag"], r["direction"]) for r in got] == [("two  names", "m", "X", "S"), ("two  names", "b", "CU", "a")]


def test_groups_without_a_part_are_null(spark):
    frame = spark.createDataFrame([("b",), ("ab",), ("xb ab",)], "value string")
    assert [tuple(r) for r in L.parse_re(frame, "(a)?(b)").collect()] == [(None, "b"), ("a", "b"), (None, "b")]
    assert [tuple(r) for r in L.parse_re(frame, "(a*)(b)").collect()] == [("", "b"), ("a", "b"), ("", "b")]


TEXT = "team: A\nname: x\nteam: B\nname: y\nloc: z\n"


@pytest.mark.parametrize(
    "patterns,options,want",
    [
        ([("^team: (.*)", ["t"], ""), ("^name: (.*)", ["n"], "")], {}, [("A", "x"), ("B", "y")]),
        ([("^team: (.*)", ["t"], ""), ("^name: (.*)", ["n"], "post")], {"keep": ["t"]}, [("A", "x"), ("B", "y")]),
        ([("^team: (.*)", ["t"], ""), ("^name: (.*)", ["n"], "")], {"clobber": True}, []),
        ([("^team: (.*)", ["t"], "pre"), ("^(?:name|loc): (.*)", ["n"], "")], {"keep": ["t"], "clobber": True}, [("A", "x")]),
    ],
)
def test_records_of_several_lines(spark, tmp_path, patterns, options, want):
    lines = L.read_lines(spark, put(tmp_path, "a.txt", TEXT))
    got = L.parse_multi_re(lines, patterns, ["_block", "_line"], **options)
    assert [(r["t"], r["n"]) for r in got.collect()] == want


def test_xml(spark, tmp_path):
    path = put(tmp_path, "a.xml", "<c><server name='s1'><ip>1</ip><ip>2</ip></server><note>n</note></c>")
    rows = external.read_xml(spark, path, ["server"]).collect()
    assert rows[0]["name"] == "s1" and rows[0]["ip"] == [1, 2]
    both = external.read_xml(spark, path, ["ip", "note"], "value string").collect()
    assert sorted((r["element"], r["value"]) for r in both) == [("ip", "1"), ("ip", "2"), ("note", "n")]
    feed = put(tmp_path, "f.xml", "<feed><entry><id>1</id><link href='x'/></entry><entry><id>2</id></entry></feed>")
    assert external.read_atom(spark, feed).columns == ["id"]


def test_sqlite_round_trip(spark, tmp_path):
    file = str(tmp_path / "a.db")
    frame = spark.createDataFrame([(k, f"n{k}", k / 2, [k]) for k in range(25)], "i long, s string, x double, l array<long>")
    writers.write_sqlite(frame, file, "t")
    writers.write_sqlite(frame.limit(1), file, "t")
    got = external.read_sqlite(spark, file, "t", parts=4)
    assert got.count() == 26 and got.filter("i = 3").first()["l"] == "[3]" and got.agg(F.sum("x")).first()[0] == 150.0
    assert external.read_sqlite(spark, file, sql="SELECT max(i) AS m FROM t").first()["m"] == 24
    writers.write_sqlite(frame.limit(2), file, "t", drop=True)
    with sqlite3.connect(file) as base:
        assert base.execute("SELECT count(*) FROM t").fetchone() == (2,)
    writers.write_sqlite(frame.limit(2), file, "u", keys=["i", "s=TEXT"])
    with sqlite3.connect(file) as base:
        assert [r[1:3] for r in base.execute("PRAGMA table_info(u)")] == [("id", "INTEGER"), ("i", "INTEGER"), ("s", "TEXT")]


def test_split_header(spark, tmp_path):
    lines = L.read_lines(spark, put(tmp_path, "a.txt", "k v\n1 2\n3 4 5\nk v\n"))
    got = L.parse_split(lines, " ", header=True).orderBy("_line")
    assert [tuple(r) for r in got.select("k", "v", "2").collect()] == [("1", "2", None), ("3", "4", "5"), ("k", "v", None)]
    assert L.parse_split(lines.limit(0), " ", ["a"], header=True).count() == 0


def test_processes_and_packets(spark):
    assert "pid" in external.processes(spark).columns
    text = "12:34:56.789 IP 10.0.0.1.1234 > 10.0.0.2.80: Flags [S], seq 1, length 0"
    row = external.parse_tcpdump(spark.createDataFrame([(text,), ("other",)], "value string")).first()
    assert (row["ip"]["dest"], row["transport"]["dest_port"], row["transport"]["flags"], row["length"]) == ("10.0.0.2", 80, "S", 0)


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, "biz", 1.0, {"a": 1}), (2, 'q"u,o', float("nan"), None), (3, None, 2.5, {})], "foo long, zoo string, x double, m map<string,long>")


def test_text_sinks(small, tmp_path):
    assert [json.loads(r[0]) for r in writers.json_lines(small.select("foo", "x")).collect()] == [{"foo": 1, "x": 1.0}, {"foo": 2, "x": None}, {"foo": 3, "x": 2.5}]
    assert [r[0] for r in writers.csv_lines(small, ["zoo", "m"]).collect()] == ['biz,"{""a"":1}"', '"q""u,o",', ",{}"]
    writers.write_csv(small, f"{tmp_path}/csv", ["foo", "zoo"])
    back = L.read_csv(small.sparkSession, f"{tmp_path}/csv", header=True)
    assert sorted((r["foo"], r["zoo"]) for r in back.collect())[:2] == [("1", "biz"), ("2", 'q"u,o')]
    for name, frame, want in (("array", small.select("foo").orderBy("foo"), [1, 2, 3]), ("none", small.limit(0), [])):
        writers.write_json_array(frame, f"{tmp_path}/{name}")
        files = sorted(p for p in (tmp_path / name).iterdir() if p.name.startswith("part"))
        assert [r["foo"] for r in json.loads("".join(p.read_text() for p in files))] == want
    writers.write_by_group(small.select("foo", "zoo"), f"{tmp_path}/groups", ["zoo"])
    assert small.sparkSession.read.json(f"{tmp_path}/groups").count() == 3


def test_pictures(small):
    shown = render.table(small, ["foo"], ["zoo,foo"])
    assert shown == "zoo     foo\n-----   ---\nbiz     1  \nq\"u,o   2  \n        3  \n"
    assert render.table(small, ["foo"], ["foo,zoo"], spreadsheet=True, delimiter="t").splitlines()[:2] == ["footzoo", "1tbiz"]
    assert render.table(small.limit(0), ["foo"]) == ""
    same = small.withColumn("k", F.lit("s")).withColumn("j", F.col("foo") > 2)
    assert [x.strip() for x in render.table(same, ["foo"], ["k,j"], header=False, clear=True).splitlines()] == ["s   false", "", "true"]
    assert render.pretty(small.select("foo", "zoo", "m"), ["foo"], 1) == "-" * 70 + '\nfoo = 1\nm = HASH:\n   a = 1\nzoo = "biz"\n'
    assert "m = EMPTY HASH" in render.pretty(small, ["foo"]) and 'm = {"a":1}' in render.pretty(small, ["foo"], 1, nested=False)
    page = "<table>\n  <tr>\n    <th>foo</th>\n  </tr>\n  <tr>\n    <td>1</td>\n  </tr>\n</table>\n"
    assert render.html(small.limit(1), ["foo"], ["foo"]) == page
    assert "<td>q&quot;u,o</td>" in render.html(small, ["foo"], ["zoo"])
    assert render.grid(small.select("foo", "zoo").limit(1), ["foo"]) == "+---+---+\n|foo|zoo|\n+---+---+\n|1  |biz|\n+---+---+\n"
    assert render.chart(small, ["foo"], "x", "foo", size=10).splitlines() == ["1 │████ 1", "2 │ 0", "3 │██████████ 2.5"]
    assert render.chart(small, ["foo"], "x", kind="sparkline") == "▄▁█\n"
    assert render.gnuplot(small, ["foo"], ["foo", "x"])[1].endswith("plot 'data' using 2 with points title 'x'\n")
    assert render.svg(small, ["foo"], "foo", kind="bar").count("<rect") == 3 and render.width("日本a") == 5
    assert render.table(small, ["foo"], most=1).endswith("…\n")


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k:02d}:00", "a" if k % 2 else "b", float(k)) for k in range(30)]
    rows.append((99, "2023-12-31 00:00:00", "a", 1000.0))  # late
    frame = spark.createDataFrame(rows, "i long, t string, k string, x double").withColumn("t", F.to_timestamp("t"))
    for n, part in enumerate((frame.filter("i < 15"), frame.filter("i >= 15"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    read = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def run(out, mode, name):
        stream = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        stream.awaitTermination(120)
        return spark.table(name).collect()

    made = {"n": F.count(F.lit(1)), "s": F.sum("x")}
    got = run(events.tumbling(read(), "t", "10 minutes", ["k"], made, "1 minute"), "append", "tumbling")
    assert {(r["start"].minute, r["k"]): (r["n"], r["s"]) for r in got if r["start"].year == 2024} == {
        (0, "a"): (5, 25.0), (0, "b"): (5, 20.0), (10, "a"): (5, 75.0), (10, "b"): (5, 70.0),
    }
    rolled = run(events.rolling_rows(read().filter("i < 99"), "k", "i", "x", 3), "append", "rolling")
    assert {r["i"]: r["rolling"] for r in rolled} == {k: 3.0 * k - 6 for k in range(4, 30)}
    closed = run(events.recent_groups(read().filter("i < 99"), "k", "i", "x", "t", "5 minutes", "1 minute"), "append", "recent")
    assert closed == []  # both groups are still open
    table = events.sessions(frame, "t", "5 minutes", ["k"], made, "1 day").collect()
    assert sorted((r["k"], r["n"]) for r in table) == [("a", 1), ("a", 15), ("b", 15)]
