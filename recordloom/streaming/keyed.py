"""Ordered operators on streams, by keyed state: rolling windows, runs of equal values, a bounded number of open groups.

Records of a micro-batch are taken in the order of ``place``; one that comes in a
later batch than its successors is taken when it comes. State survives a
restart through the stream's checkpoint.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a window of numbers becomes; each takes the windows as the rows of a matrix.
WINDOWS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "sum": lambda w: w.sum(axis=1), "average": lambda w: w.mean(axis=1), "minimum": lambda w: w.min(axis=1), "maximum": lambda w: w.max(axis=1),
    "variance": lambda w: w.var(axis=1), "stddev": lambda w: w.std(axis=1), "first": lambda w: w[:, 0], "last": lambda w: w[:, -1],
    "distinctcount": lambda w: 1.0 + (np.diff(np.sort(w, axis=1), axis=1) != 0).sum(axis=1),
}


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _batch(frames: Iterator[pd.DataFrame], place: str) -> pd.DataFrame | None:
    held = [f for f in frames if len(f)]
    return pd.concat(held).sort_values(place, kind="stable") if held else None


def rolling_windows(
    df: DataFrame, key: str, place: str, number: str, size: int, made: dict[str, str | Callable[[np.ndarray], np.ndarray]]
) -> DataFrame:
    """For each record of a stream, aggregates of the last ``size`` numbers of its key; the first ``size - 1`` give none.

    ``made`` names a column for each aggregate: one of ``WINDOWS`` or a function
    of the windows as rows of a matrix. State is the last ``size - 1`` numbers of
    a key. A null number counts as NaN.
    """
    functions = {n: WINDOWS[f] if isinstance(f, str) else f for n, f in made.items()}

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        found = _batch(frames, place)
        if found is None:
            return
        held = np.array(state.get[0] if state.exists else [], float)
        numbers = np.concatenate([held, found[number].to_numpy(float)])
        state.update((numbers[max(len(numbers) - size + 1, 0) :].tolist(),))
        if len(numbers) >= size:
            windows = np.lib.stride_tricks.sliding_window_view(numbers, size)
            places = found[place].to_numpy()[len(found) - len(windows) :]
            yield pd.DataFrame({key: group[0], place: places, **{n: f(windows) for n, f in functions.items()}})

    out = f"`{key}` {_kind(df, key)}, `{place}` {_kind(df, place)}" + "".join(f", `{n}` double" for n in functions)
    return df.groupBy(key).applyInPandasWithState(run, out, "held array<double>", "append", GroupStateTimeout.NoTimeout)


RUN = "run bigint, value string, n bigint, total double, began bigint, ended bigint"


def value_runs(df: DataFrame, key: str, place: str, value: str, number: str, time: str, idle_seconds: int, late: str) -> DataFrame:
    """Runs of consecutive records of a key with equal values (as text), put out when the value changes.

    A run is also put out, and its key's state forgotten, when the watermark
    has passed its last record by ``idle_seconds``; the key's runs then count
    from 1 again. ``place`` must be a whole number. Columns: the key, the run's
    number, its value, count, sum, first and last place.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        closed: list[tuple] = []
        if state.hasTimedOut:
            closed.append(tuple(state.get)[:6])
            state.remove()
        elif (found := _batch(frames, place)) is not None:
            held = tuple(state.get) if state.exists else None
            for at, text, amount, moment in zip(found[place], found[value], found[number], found[time]):
                text, amount, now = None if pd.isna(text) else str(text), 0.0 if pd.isna(amount) else float(amount), int(moment.timestamp() * 1000)
                if held is not None and held[1] == text:
                    held = (held[0], text, held[2] + 1, held[3] + amount, held[4], int(at), max(held[6], now))
                else:
                    if held is not None:
                        closed.append(held[:6])
                    held = (held[0] + 1 if held else 1, text, 1, amount, int(at), int(at), max(held[6] if held else 0, now))
            state.update(held)
            state.setTimeoutTimestamp(max(held[6] + 1000 * idle_seconds, state.getCurrentWatermarkMs() + 1))
        if closed:
            names = ["run", "value", "n", "total", "began", "ended"]
            yield pd.DataFrame({key: [group[0]] * len(closed), **{n: [c[k] for c in closed] for k, n in enumerate(names)}})

    grouped = df.withWatermark(time, late).groupBy(key)
    return grouped.applyInPandasWithState(run, f"`{key}` {_kind(df, key)}, {RUN}", f"{RUN}, latest bigint", "append", GroupStateTimeout.EventTimeTimeout)


def open_groups(df: DataFrame, stream: str, key: str, place: str, number: str, size: int) -> DataFrame:
    """Count and sum of groups of a key (as text), of which each ``stream`` keeps at most ``size`` open.

    When one more opens, the group whose last record is longest ago is put out
    and forgotten; its key opens a new group when it comes again. ``stream`` is a
    coarse key whose records stay in order, and its open groups are one state,
    so that state is bounded by ``size`` a stream. ``place`` must be a whole number.
    """
    if size < 1:
        raise ValueError("at least one group must be open")

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        found = _batch(frames, place)
        if found is None:
            return
        held: OrderedDict[str, tuple] = OrderedDict((k, tuple(v)) for k, *v in zip(*state.get)) if state.exists else OrderedDict()
        closed: list[tuple] = []
        for at, name, amount in zip(found[place], found[key], found[number]):
            name, amount = "" if pd.isna(name) else str(name), 0.0 if pd.isna(amount) else float(amount)
            n, total, began, _ = held.pop(name, (0, 0.0, int(at), 0))
            held[name] = (n + 1, total + amount, began, int(at))
            if len(held) > size:
                oldest, values = held.popitem(last=False)
                closed.append((oldest, *values))
        state.update((list(held), *[[v[k] for v in held.values()] for k in range(4)]))
        if closed:
            names = [key, "n", "total", "began", "ended"]
            yield pd.DataFrame({stream: [group[0]] * len(closed), **{n: [c[k] for c in closed] for k, n in enumerate(names)}})

    out = f"`{stream}` {_kind(df, stream)}, `{key}` string, n bigint, total double, began bigint, ended bigint"
    held_kind = "names array<string>, n array<bigint>, total array<double>, began array<bigint>, ended array<bigint>"
    return df.groupBy(stream).applyInPandasWithState(run, out, held_kind, "append", GroupStateTimeout.NoTimeout)
