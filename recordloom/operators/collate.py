"""Grouping and aggregation."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import coerce
from recordloom.functions.aggregators import Aggregate, Fields, build, parse
from recordloom.functions.keys import kind_of, name_of, resolve, value
from recordloom.functions.running import power_states, running_form
from recordloom.plans import order as P
from recordloom.plans.order import (
    OWN, PLACE, State, by_columns, changed, chunked, in_chunk, numbered, own_rows, running, scan, segmented,
)
from recordloom.plans.store import keep

ALL = "ALL"
Spec = str | tuple  # "name=kind,arg" or (name, maker)


def _aggregates(df: DataFrame, specs: Sequence[Spec], order: list[str] | None) -> list[tuple[str, Aggregate]]:
    fields = Fields(df, order)
    made = []
    for spec in specs:
        if isinstance(spec, str):
            name, kind, arguments = parse(spec)
            made.append((name, build(fields, kind, arguments)))
        else:
            made.append((spec[0], spec[1](fields)))
    return made


def _keys(df: DataFrame, keys: Sequence[str | tuple]) -> list[tuple[str, Column, object]]:
    """Name, value and type of each key; a tuple is (name, expression)."""
    out = []
    for key in keys:
        if isinstance(key, tuple):
            out.append((key[0], key[1], df.select(key[1]).schema[0].dataType))
        else:
            out += [(name_of(p), value(df, p), kind_of(df, p)) for p in resolve(df.schema, key)]
    return out


def collate(
    df: DataFrame,
    keys: Sequence[str | tuple] = (),
    aggregates: Sequence[Spec] = (),
    order: list[str] | None = None,
    cube: bool = False,
    as_text: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """One record a group: its keys and its aggregates.

    Keys are paths, patterns or ``(name, column)``. ``as_text`` groups by the
    keys' text, null and empty text being one key, and gives the first record's
    value. ``cube`` adds every combination with ``ALL`` in place of a key (keys
    become text then; a null key stays apart from ``ALL``). Without keys there
    is one group; an empty table has none at all. ``by`` are keys ahead of the others.

    Ranks are found among the counted values of all groups, dealt to ranges
    together, so no group's values meet in one list or task.
    """
    found = _keys(df, [*by, *keys])
    names = [n for n, _, _ in found]
    made = _aggregates(df, aggregates, order)
    work, by, shown = df, [], []
    for k, (name, column, kind) in enumerate(found):
        if cube:
            work = work.withColumn(f"_key{k}", coerce.text(column, kind))
        elif as_text:
            work = work.withColumn(f"_key{k}", coerce.key_text(column, kind)).withColumn(f"_first{k}", column)
        else:
            work = work.withColumn(f"_key{k}", column)
        by.append(f"_key{k}")
    bases = [b.alias(f"_a{i}_{j}") for i, (_, a) in enumerate(made) if a.by_value is None for j, b in enumerate(a.bases)]
    if as_text and not cube:
        place = Fields(df, order).place
        bases += [F.min_by(f"_first{k}", place).alias(f"_shown{k}") for k in range(len(found))]
    if cube:
        bases += [F.grouping(c).alias(f"_all{c}") for c in by]
    grouped = (work.cube(*by) if cube else work.groupBy(*by)).agg(F.count(F.lit(1)).alias("_n"), *bases)
    alike: dict = {}
    for i, (_, part) in enumerate(made):
        if part.by_value is not None:
            alike.setdefault(part.shared or i, []).append(i)
    for together in alike.values():
        part = made[together[0]][1]
        place = Fields(df, order).place if order else F.lit(0)
        carried = F.lit(None) if part.carried is None else part.carried
        inner = work.select(*by, part.by_value.alias("s"), place.alias("_o"), carried.alias("_c"))
        sums = [F.count(F.lit(1)).alias("ct"), F.min("_o").alias("o"), F.max_by("_c", "_o").alias("c")]
        sums = sums if part.carried is not None else sums[:2]
        if cube:
            marks = [F.grouping(c).alias(f"_all{c}") for c in by]
            counted = inner.cube(*by, "s").agg(*sums, F.grouping("s").alias("_gs"), *marks).filter("_gs = 0")
            keys_now = [*by, *[f"_all{c}" for c in by]]
        else:
            counted = inner.groupBy(*by, "s").agg(*sums)
            keys_now = by
        counted = counted.filter("s is not null")
        if part.ranked:
            counted = _up_to(counted, keys_now)
        outer = counted.groupBy(*keys_now).agg(*[made[i][1].outer().alias(f"_v{i}") for i in together])
        if keys_now:
            outer = outer.toDF(*[f"_r{c}" if c in keys_now else c for c in outer.columns])
            match = reduce(lambda a, b: a & b, [grouped[c].eqNullSafe(outer[f"_r{c}"]) for c in keys_now])
            grouped = grouped.join(outer, match, "left").drop(*[f"_r{c}" for c in keys_now])
        else:
            grouped = grouped.crossJoin(outer)  # one row on either side
    for k, name in enumerate(names):
        if cube:
            shown.append(F.when(F.col(f"_all_key{k}") == 1, ALL).otherwise(F.col(f"_key{k}")).alias(name))
        else:
            shown.append(F.col(f"_shown{k}" if as_text else f"_key{k}").alias(name))
    values = []
    for i, (name, part) in enumerate(made):
        if part.by_value is None:
            done = part.finish(*[F.col(f"_a{i}_{j}") for j in range(len(part.bases))])
        else:
            done = F.coalesce(F.col(f"_v{i}"), part.empty()) if part.empty else F.col(f"_v{i}")
        values.append(done.alias(name))
    return grouped.filter("_n > 0").select(*shown, *values)


def _up_to(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Counted values with ``upto``, the records of their group up to them, and ``all``, those of the group.

    Values of all groups are dealt to ranges together and stored once, so a
    group of many values lies in several ranges. A range's values of a group are
    summed up there; what lies before comes from the ranges' totals, one row a
    group and range.
    """
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = counted.select(*keys, "s", "ct").repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in [*keys, "s"]])
    held = keep(ranges.withColumn("_range", F.spark_partition_id()), "ranked")
    totals = held.groupBy("_range", *keys).agg(F.sum("ct").alias("_here"))
    group = Window.partitionBy(*keys)
    before = F.sum("_here").over(group.orderBy("_range")) - F.col("_here")
    totals = totals.select("*", before.alias("_from"), F.sum("_here").over(group).alias("all")).drop("_here")
    totals = totals.toDF(*[f"_g{c}" if c in keys else c for c in totals.columns]).withColumnRenamed("_range", "_part")
    inside = Window.partitionBy("_range", *keys).orderBy("s")
    rows = held.withColumn("_sum", F.sum("ct").over(inside))
    match = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(totals[f"_g{c}"]) for c in keys], rows["_range"] == totals["_part"])
    return rows.join(totals, match).select(*keys, "s", "ct", (F.col("_sum") + F.col("_from")).alias("upto"), "all")


def _over(df: DataFrame, made: list[tuple[str, Aggregate]], over) -> DataFrame:
    """Aggregates as columns over a window."""
    out = df
    for name, part in made:
        if not part.bases:
            raise ValueError(f"{name}: aggregates by value aren't available record by record")
        out = out.withColumn(name, part.finish(*[b.over(over) for b in part.bases]))
    return out


def collate_each(
    df: DataFrame, keys: Sequence[str | tuple], aggregates: Sequence[Spec], order: list[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Every record with its group's aggregates beside its own fields.

    Groups are aggregated first and joined back, so a large group isn't held in
    one task; aggregates by value work too.
    """
    found = _keys(df, [*by, *keys])
    grouped = collate(df, [(f"_k{k}", c) for k, (_, c, _) in enumerate(found)], aggregates, order)
    if not found:
        return df.crossJoin(grouped)
    match = reduce(lambda a, b: a & b, [c.eqNullSafe(grouped[f"_k{k}"]) for k, (_, c, _) in enumerate(found)])
    return df.join(grouped, match).drop(*[f"_k{k}" for k in range(len(found))])


def collate_running(
    df: DataFrame, keys: Sequence[str | tuple], aggregates: Sequence[Spec], order: list[str], by: Sequence[str] = ()
) -> DataFrame:
    """After each record, the keys and the aggregates of its group so far, with the record's ``order`` columns.

    Rows are numbered group after group, and states that can be merged run on
    through chunks (``scan``), so a group of any size spreads over tasks.
    A null key is a group of its own. Aggregates of a group's list of values (``array``, ``records``,
    ``concatenate``, ``percentile`` and the like) hold that list after each
    record anyway and use a window by key; ``mode`` and ``countby`` have no
    running form.
    """
    found = _keys(df, [*by, *keys])
    fields = Fields(df, order)
    forms, plain = {}, {}
    for i, spec in enumerate(aggregates):
        name, kind, arguments = parse(spec) if isinstance(spec, str) else (spec[0], "", [])
        form = running_form(fields, kind, arguments) if kind else None
        if form is None:
            plain[i] = _aggregates(df, [spec], order)[0]
        else:
            forms[i] = name, form
    shifts = {i: form.shift for i, (_, form) in forms.items() if form.shift is not None}
    means = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in shifts.items()]).first() if shifts else {}
    told = [F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), coerce.text(c, kind))) for _, c, kind in found]
    rows, groups = segmented(df, told, order)
    states: dict[str, State] = {}
    distinct = [i for i, (_, form) in forms.items() if form.distinct is not None]
    for i in distinct:
        seen = rows.select(*groups, PLACE, forms[i][1].distinct.alias("_s")).filter("_s is not null")
        first = seen.groupBy(*groups, "_s").agg(F.min(PLACE).alias(PLACE)).select(PLACE, F.lit(1).alias(f"_new{i}"))
        rows = rows.join(first, PLACE, "left")
    if distinct:
        rows = keep(rows, "first-seen")
    for i, (_, form) in forms.items():
        made = form.states
        if form.shift is not None:
            made = power_states(form.shift, F.lit(means[f"m{i}"] or 0.0), form.powers)
        if form.distinct is not None:
            made = [State("sum", F.coalesce(f"_new{i}", F.lit(0)))]
        states |= {f"_s{i}_{j}": state for j, state in enumerate(made)}
    out = scan(rows, states, groups) if states else rows
    over = Window.partitionBy(*groups).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    out = _over(out, [(f"_value{i}", part) for i, (_, part) in plain.items()], over)
    values = {i: F.col(f"_value{i}").alias(name) for i, (name, _) in plain.items()}
    for i, (name, form) in forms.items():
        held = [F.col(c) for c in states if c.startswith(f"_s{i}_")]
        if form.shift is not None:
            held.append(F.lit(means[f"m{i}"] or 0.0))
        values[i] = (form.own if form.own is not None else form.finish(*held)).alias(name)
    columns = [F.col(c) for c in order if c not in [n for n, _, _ in found]]
    return out.select(*columns, *[c.alias(n) for n, c, _ in found], *[values[i] for i in range(len(aggregates))])


def collate_adjacent(
    df: DataFrame, keys: Sequence[str | tuple], aggregates: Sequence[Spec], order: list[str], by: Sequence[str] = ()
) -> DataFrame:
    """One record for each run of consecutive records with equal keys, with the run's number.

    ``by`` makes separate streams, whose runs are numbered from 1 each and come
    with the fields of their first record.
    """
    found = _keys(df, keys)
    rows, groups = segmented(df, by_columns(df, by), order)
    rows = chunked(rows, 1, 0)
    rows = own_rows(rows.withColumn("_starts", changed([c for _, c, _ in found], in_chunk(groups)).cast("long")))
    rows = running(rows, F.col("_starts"), "run", groups=groups)
    names = [(n, c) for n, c, _ in found]
    shown = [(name_of(p), lambda f, p=p: Aggregate([F.min_by(f.raw(p), F.col(PLACE))])) for p in by]
    out = collate(rows.drop("_starts"), [*groups, "run", *names], [*shown, *aggregates], [PLACE])
    return out.drop(*groups)


def collate_rolling(df: DataFrame, size: int, aggregates: Sequence[Spec], order: list[str], by: Sequence[str] = ()) -> DataFrame:
    """Aggregates over each run of exactly ``size`` consecutive records, with its last record's ``order``.

    ``by`` makes separate streams; their fields come with the result.
    """
    rows, groups = segmented(df, by_columns(df, by), order)
    rows = chunked(rows, size - 1, 0)
    over = in_chunk(groups).rowsBetween(-(size - 1), 0)
    made = _aggregates(df, aggregates, order)
    out = _over(rows.withColumn("_held", F.count(F.lit(1)).over(over)), [(f"_value{i}", a) for i, (_, a) in enumerate(made)], over)
    out = out.filter(F.col(OWN) & (F.col("_held") == size))
    columns = [F.col(c) for c in order if c not in map(name_of, by)]
    return out.select(*columns, *[value(df, p).alias(name_of(p)) for p in by], *[F.col(f"_value{i}").alias(n) for i, (n, _) in enumerate(made)])


def _open_keys(rows: DataFrame, size: int) -> DataFrame:
    """``chunk`` and ``open``: the last ``size`` distinct keys before it, the latest first.

    Each chunk lists its own; a list that isn't full takes on the list of the
    chunk before, then of the chunks two, four, … before, which by then stand
    for so many chunks each. Few rounds are needed, as a chunk holds many keys.
    """
    last = rows.groupBy("chunk", "_key").agg(F.max(PLACE).alias("at"))
    latest = F.sort_array(F.collect_list(F.struct("at", "_key")), asc=False)
    lists = last.groupBy((F.col("chunk") + 1).alias("chunk")).agg(F.slice(F.transform(latest, lambda x: x["_key"]), 1, size).alias("open"))
    lists, step = keep(lists, "open-keys"), 1
    while not lists.filter((F.size("open") < size) & (F.col("chunk") > step)).isEmpty():
        before = lists.select((F.col("chunk") + step).alias("chunk"), F.col("open").alias("more"))
        both = F.slice(F.array_distinct(F.concat("open", F.coalesce("more", F.array().cast("array<string>")))), 1, size)
        lists = keep(lists.join(before, "chunk", "left").select("chunk", both.alias("open")), "open-keys")
        step *= 2
    return lists


def collate_recent(df: DataFrame, key: str, size: int, aggregates: Sequence[Spec], order: list[str]) -> DataFrame:
    """Group by a key's text, with at most ``size`` groups open: the one whose last record is longest ago is closed.

    A closed key's next record opens a group of its own, so a key may come
    several times; ``began`` is the number of the group's first record. Null,
    missing and empty text are one key.

    What is open at a point are the last ``size`` distinct keys before it. They
    are found for the start of each chunk, from where chunks run on in parallel.
    """
    if size < 1:
        raise ValueError("at least one group must be open")
    chunk_rows = P.CHUNK_ROWS
    rows = numbered(df, order)
    held = rows.select(PLACE, by_columns(df, [key])[0].alias("_key"), F.floor(F.col(PLACE) / chunk_rows).alias("chunk"))

    def opened(table: pa.Table, before: pa.Table) -> pa.Table:
        table = table.sort_by(PLACE)
        now: OrderedDict[str, None] = OrderedDict((k, None) for k in reversed(before.column("open")[0].as_py() if before.num_rows else []))
        flags = []
        for found in table.column("_key").to_pylist():
            flags.append(found not in now)
            now[found] = None
            now.move_to_end(found)
            if len(now) > size:
                now.popitem(last=False)
        return pa.table({"_at": table.column(PLACE), "_key": table.column("_key"), "_opens": pa.array(flags, pa.bool_())})

    begun = held.groupBy("chunk").cogroup(_open_keys(held, size).groupBy("chunk")).applyInArrow(opened, "_at long, _key string, _opens boolean")
    begun = begun.filter("_at is not null").withColumnRenamed("_at", "_row")
    by_key, groups = segmented(begun, [F.col("_key")], ["_row"])
    group = scan(by_key, {"began": State("max", F.when(F.col("_opens"), F.col("_row")))}, groups).select("_row", "began", "_key")
    joined = rows.join(group.withColumnRenamed("_row", PLACE), PLACE)
    shown = (name_of(key), lambda f: Aggregate([F.min_by(f.raw(key), F.col(PLACE))]))
    return collate(joined, ["_key", "began"], [shown, *aggregates], [PLACE]).drop("_key")
