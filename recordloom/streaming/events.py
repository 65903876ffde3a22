"""Structured Streaming forms of time buckets, runs and rolling windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(
    df: DataFrame, time: str, span: str, keys: Sequence[str], aggregates: dict[str, Column], late: str, slide: str | None = None
) -> DataFrame:
    """Aggregates by time bucket and keys; records later than ``late`` are dropped.

    Works on streams and on tables. ``slide`` makes the buckets overlap.
    """
    window = F.window(time, span, slide) if slide else F.window(time, span)
    grouped = df.withWatermark(time, late).groupBy(window.alias("_w"), *keys)
    out = grouped.agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], aggregates: dict[str, Column], late: str) -> DataFrame:
    """Aggregates by sessions that end after ``gap`` without a record."""
    grouped = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("_w"), *keys)
    out = grouped.agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, *aggregates)


def rolling_rows(df: DataFrame, key: str, place: str, number: str, size: int) -> DataFrame:
    """For each record of a stream, the sum over the last ``size`` records of its key.

    State is the last ``size`` numbers of a key. Records of one micro-batch are
    taken in the order of ``place``; the first ``size - 1`` of a key give none.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        found = pd.concat(list(frames)).sort_values(place)
        made = []
        for at, amount in zip(found[place], found[number]):
            held = [*held, float(amount)][-size:]
            if len(held) == size:
                made.append((group[0], at, sum(held)))
        state.update((held,))
        yield pd.DataFrame(made, columns=[key, place, "rolling"])

    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(
        run, f"`{key}` {kind(key)}, `{place}` {kind(place)}, rolling double", "held array<double>", "append", GroupStateTimeout.NoTimeout
    )


def recent_groups(df: DataFrame, key: str, place: str, number: str, time: str, idle: str, late: str) -> DataFrame:
    """Count and sum of each open group; a group is put out and forgotten when it was idle for ``idle``.

    The state holds only groups that are open, which bounds it as a limit on
    open groups does in a single process.
    """
    return sessions(df, time, idle, [key], {"n": F.count(F.lit(1)), "total": F.sum(number), "last": F.max(place)}, late)
