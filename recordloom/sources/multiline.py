"""Records put together from several lines, by merging fragments of chunks.

Whether a line matches doesn't depend on the lines before it, so all lines are
matched at once; what is left are events: a pattern's fields and its role. Where
a record begins and ends depends on the events before, but only through the set
of fields that the open record holds. So a chunk of events runs from each set
that it could begin with, which soon fall together, and tells which set it ends
with and how many records it closed. These tables, one row a chunk, are
followed through a file in order. With its true beginning known, each chunk
puts out its closed records, and fragments of those that lie over its edges,
which are merged field by field.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import coerce
from recordloom.plans import order as P
from recordloom.plans.store import keep as stored

#: Sets of fields that an open record may hold, up to which chunks run from all of them.
MOST_SETS = 4_096


class Rules(NamedTuple):
    """``pre``, ``post``: of each pattern, whether it ends the open record before or after itself; fields are bits of a number."""

    pre: tuple[bool, ...]
    post: tuple[bool, ...]
    clobber: bool
    loose: int  # fields that an open record is made of, all but those kept
    keep_all: bool

    def step(self, held: int, pattern: int, new: int) -> tuple[int, bool, bool]:
        """The set after an event, and whether a record was closed before it and after it."""
        ends = self.pre[pattern] or (not self.clobber and bool(new & held & self.loose))
        before = ends and bool(held & self.loose)
        left = held if self.keep_all or not ends else held & ~self.loose
        left |= new
        after = self.post[pattern] and bool(left & self.loose)
        return (left if self.keep_all or not self.post[pattern] else left & ~self.loose), before, after

    def reachable(self, kinds: Iterable[tuple[int, int]]) -> list[int]:
        """All sets that any order of events may lead to."""
        kinds, found, todo = list(kinds), {0}, [0]
        while todo:
            held = todo.pop()
            for pattern, new in kinds:
                to = self.step(held, pattern, new)[0]
                if to not in found:
                    found.add(to)
                    todo.append(to)
                    if len(found) > MOST_SETS:
                        raise ValueError(f"open records may hold more than {MOST_SETS} different sets of fields")
        return sorted(found)


def run_all(rules: Rules, starts: list[int], events: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Of each start, the set after all events and the number of closed records."""
    groups = {s: [0, [(k, 0)]] for k, s in enumerate(starts)}  # set: records, starts with what they had before they fell together
    for pattern, new in events:
        after: dict[int, list] = {}
        for held, (count, members) in groups.items():
            to, before, behind = rules.step(held, pattern, new)
            count += before + behind
            if to in after:
                other = after[to]
                other[1] += [(k, n + count - other[0]) for k, n in members]
            else:
                after[to] = [count, members]
        groups = after
    ends, counts = [0] * len(starts), [0] * len(starts)
    for held, (count, members) in groups.items():
        for k, n in members:
            ends[k], counts[k] = held, count + n
    return ends, counts


def _runs(values: list) -> Iterator[tuple[int, int]]:
    at = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[at]:
            yield at, k
            at = k


def parse_multi_re(
    lines: DataFrame, patterns: Sequence[tuple[str, Sequence[str], str]], order: Sequence[str], by: Sequence[str] = ("_file",),
    clobber: bool = False, keep: Sequence[str] = (), keep_all: bool = False,
) -> DataFrame:
    """Records put together from several lines.

    ``patterns`` are (regex, field names, role); role is any of ``pre`` (emit
    the open record before the match), ``post`` (emit it after), joined by
    ``+``, or empty. A field that is set already emits the open record first,
    unless ``clobber``. ``keep`` fields stay for the next record.

    Each ``by`` group is one stream, at whose end the open record comes too,
    unless ``clobber``. A stream may be one large file: it is cut into chunks,
    each a task. Records come in the order of their streams' lines. Patterns whose fields could be open in more than ``MOST_SETS``
    combinations are refused.
    """
    compiled = [(re.compile(p), list(names), set(role.split("+"))) for p, names, role in patterns]
    named = [[*names, *map(str, range(len(names), p.groups))][: p.groups] for p, names, _ in compiled]
    fields = list(dict.fromkeys(n for names in named for n in names))
    bit = {n: 1 << k for k, n in enumerate(fields)}
    lasting = fields if keep_all else [n for n in fields if n in keep]
    loose = sum(b for n, b in bit.items() if n not in keep)
    rules = Rules(tuple("pre" in r for _, _, r in compiled), tuple("post" in r for _, _, r in compiled), clobber, loose, keep_all)
    group, order, width, chunk_rows = list(by), list(order), len(fields), P.CHUNK_ROWS
    kind_of = lambda c: lines.schema[c].dataType.simpleString()
    given = [f"g{k}" for k in range(len(group))]
    places = [f"o{k}" for k in range(len(order))]
    held = [f"f{k}" for k in range(width)]

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = [], []
            for at, text in enumerate(batch.column(0).to_pylist()):
                for pattern, (found_by, _, _) in enumerate(compiled):
                    if text is not None and (found := found_by.search(text)):
                        values = {n: v for n, v in zip(named[pattern], found.groups()) if v is not None}
                        rows.append(at)
                        made.append((pattern, *[values.get(n) for n in fields]))
            taken = pa.array(rows, pa.int64())
            columns = [c.take(taken) for c in batch.columns[1:]]
            columns += [pa.array([m[k] for m in made], pa.int32() if k == 0 else pa.string()) for k in range(width + 1)]
            yield pa.RecordBatch.from_arrays(columns, [*given, *places, "pattern", *held])

    text = ", ".join(f"{h} string" for h in held)
    kinds = "".join(f"{n} {kind_of(c)}, " for n, c in zip([*given, *places], [*group, *order]))
    rows = lines.select("value", *[F.col(f"`{c}`").alias(n) for n, c in zip([*given, *places], [*group, *order])])
    events = rows.mapInArrow(matches, f"{kinds}pattern int, {text}")
    new = sum((F.when(F.col(h).isNotNull(), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, h in enumerate(held)), F.lit(0).cast("long"))
    told = [F.when(F.col(g).isNull(), "").otherwise(F.concat(F.lit("="), coerce.text(F.col(g), lines.schema[c].dataType))) for g, c in zip(given, group)]
    numbered, groups = P.segmented(events.withColumn("new", new), told, [*places, "pattern"])
    stream = F.concat_ws("\x00", *groups) if groups else F.lit("")
    dealt = numbered.select(F.floor(F.col(P.PLACE) / chunk_rows).alias("chunk"), P.PLACE, stream.alias("stream"), *given, "pattern", "new", *held)
    present = [(r["pattern"], r["new"]) for r in dealt.select("pattern", "new").distinct().collect()]  # a few of each pattern
    starts = rules.reachable(present)

    def streams(table: pa.Table) -> Iterator[pa.Table]:
        table = table.sort_by(P.PLACE)
        for at, to in _runs(table.column("stream").to_pylist()):
            yield table.slice(at, to - at)

    def events_of(part: pa.Table) -> Iterator[tuple[int, int]]:
        return zip(part.column("pattern").to_pylist(), part.column("new").to_pylist())

    def summary(table: pa.Table) -> pa.Table:
        made: list[tuple] = []
        for part in streams(table):
            first = part.column(P.PLACE)[0].as_py() % chunk_rows == 0 or not made
            ends, counts = run_all(rules, starts if first else [0], events_of(part))
            last = [next((v for v in reversed(part.column(held[fields.index(n)]).to_pylist()) if v is not None), None) for n in lasting]
            made.append((part.column("chunk")[0].as_py(), part.column("stream")[0].as_py(), ends, counts, last))
        names = ["chunk", "stream", "ends", "counts", "last"]
        types = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.table({n: pa.array([m[k] for m in made], t) for k, (n, t) in enumerate(zip(names, types))})

    def follow(table: pa.Table) -> pa.Table:
        state, base, last, made = 0, 0, [None] * len(lasting), []
        for row in table.sort_by("chunk").to_pylist():
            made.append((row["chunk"], row["stream"], state, base, last))
            k = starts.index(state) if len(row["ends"]) > 1 else 0
            state, base = row["ends"][k], base + row["counts"][k]
            last = [new if new is not None else old for new, old in zip(row["last"], last)]
        names = ["chunk", "stream", "state", "base", "last"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        return pa.table({n: pa.array([m[k] for m in made], t) for k, (n, t) in enumerate(zip(names, types))})

    def fragments(table: pa.Table, begun: pa.Table) -> pa.Table:
        known = {r["stream"]: r for r in begun.to_pylist()}
        source, records, edges, closed, values = [], [], [], [], [[] for _ in fields]
        at = 0
        for part in streams(table):
            start = known[part.column("stream")[0].as_py()]
            state, record = start["state"], start["base"]
            now: dict[str, str] = {n: v for n, v in zip(lasting, start["last"]) if v is not None}
            edge = True

            def put(ended: bool, at: int = at) -> None:
                source.append(at)
                records.append(record)
                edges.append(edge or not ended)
                closed.append(ended)
                for n, column in zip(fields, values):
                    column.append(now.get(n))

            texts = [part.column(h).to_pylist() for h in held]
            for k, (pattern, new) in enumerate(events_of(part)):
                after, before, behind = rules.step(state, pattern, new)
                ends = rules.pre[pattern] or (not clobber and bool(new & state & loose))
                if before:
                    put(True)
                    record, edge = record + 1, False
                if ends and not keep_all:
                    now = {n: v for n, v in now.items() if n in keep}
                now |= {n: texts[i][k] for i, n in enumerate(fields) if texts[i][k] is not None}
                if behind:
                    put(True)
                    record, edge = record + 1, False
                if rules.post[pattern] and not keep_all:
                    now = {n: v for n, v in now.items() if n in keep}
                state = after
            if state & loose:
                put(False)
            at += len(part)
        ordered = pa.concat_tables(list(streams(table)))
        taken = pa.array(source, pa.int64())
        columns = {"stream": ordered.column("stream").take(taken), **{g: ordered.column(g).take(taken) for g in given}}
        columns |= {"chunk": ordered.column("chunk").take(taken), "record": pa.array(records, pa.int64())}
        columns |= {"edge": pa.array(edges, pa.bool_()), "closed": pa.array(closed, pa.bool_())}
        return pa.table(columns | {h: pa.array(v, pa.string()) for h, v in zip(held, values)})

    tables = dealt.groupBy("chunk").applyInArrow(summary, "chunk long, stream string, ends array<long>, counts array<long>, last array<string>")
    begun = tables.groupBy("stream").applyInArrow(follow, "chunk long, stream string, state long, base long, last array<string>")
    begun = stored(begun, "multi-line-starts")
    given_kinds = "".join(f"{g} {kind_of(c)}, " for g, c in zip(given, group))
    made = dealt.groupBy("chunk").cogroup(begun.groupBy("chunk")).applyInArrow(
        fragments, f"stream string, {given_kinds}chunk long, record long, edge boolean, closed boolean, {text}"
    )
    made = stored(made, "multi-line-records")
    whole = made.filter("not edge").select("stream", "record", *given, *held)
    latest = [F.max_by(h, F.when(F.col(h).isNotNull(), F.col("chunk"))).alias(h) for h in held]
    firsts = [F.first(g).alias(g) for g in given]
    merged = made.filter("edge").groupBy("stream", "record").agg(*firsts, F.max("closed").alias("closed"), *latest)
    merged = merged.filter("closed") if clobber else merged
    out = whole.union(merged.select("stream", "record", *given, *held)).orderBy("stream", "record")
    return out.select(*[F.col(n).alias(c) for n, c in zip([*given, *held], [*group, *fields])])
