"""Line and scatter charts in text over whole tables of any size.

A picture has few dots, so Spark draws it: a line's points fall into dot
columns, of which the first, last, lowest and highest dot are kept (what lies
between them is joined anyway), a scatter's points into distinct dots. Only
these reach the driver, as many as the picture has at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.coerce import number
from recordloom.functions.keys import kind_of, resolve, value
from recordloom.plans.order import PLACE, numbered

#: Bits of a Braille character's dots, by column and row from the top.
DOTS = ((0x01, 0x02, 0x04, 0x40), (0x08, 0x10, 0x20, 0x80))
Dot = tuple[int, int]


def _numbers(df: DataFrame, paths: Sequence[str]) -> list[Column]:
    """Values as numbers; what isn't one counts as 0."""
    found = [number(value(df, p), kind_of(df, p)) for p in paths]
    return [F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in found]


def _scaled(column: Column, low: float, high: float, dots: int) -> Column:
    """A value's dot from 0, rounded half up."""
    return F.floor((column - low) / ((high - low) or 1.0) * (dots - 1) + 0.5).cast("int")


def line_columns(df: DataFrame, order: list[str], keys: Sequence[str], across: int, up: int) -> tuple[DataFrame, float, float]:
    """``series``, ``x``, ``first``, ``last``, ``low``, ``high`` in dots, one row a dot column; and the values at the bottom and top.

    Records stand at equal distances in the order of ``order``, which must be total.
    """
    paths = [p for key in keys for p in resolve(df.schema, key)]
    held = df.select(*order, *[c.alias(f"y{k}") for k, c in enumerate(_numbers(df, paths))])
    rows = numbered(held, order)
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *[f(f"y{k}").alias(f"{n}{k}") for k in range(len(paths)) for n, f in (("a", F.min), ("z", F.max))]).first()
    n = ends["n"]
    low = min((ends[f"a{k}"] for k in range(len(paths))), default=0.0) if n else 0.0
    high = max((ends[f"z{k}"] for k in range(len(paths))), default=0.0) if n else 0.0
    x = _scaled(F.col(PLACE), 0, n - 1, across) if n > 1 else F.lit(across // 2)
    series = F.explode(F.array(*[F.struct(F.lit(k).alias("series"), F.col(f"y{k}").alias("v")) for k in range(len(paths))]))
    points = rows.select(PLACE, x.alias("x"), series.alias("s")).select(PLACE, "x", "s.series", _scaled(F.col("s.v"), low, high, up).alias("y"))
    made = points.groupBy("series", "x").agg(
        F.min_by("y", PLACE).alias("first"), F.max_by("y", PLACE).alias("last"), F.min("y").alias("low"), F.max("y").alias("high")
    )
    return made, low, high


def scatter_dots(df: DataFrame, x: str, keys: Sequence[str], across: int, up: int) -> tuple[DataFrame, float, float]:
    """``x``, ``y``, ``n``: the dots that records fall on and how many do; and the values at the bottom and top."""
    paths = [p for key in keys for p in resolve(df.schema, key)]
    columns = _numbers(df, [x, *paths])
    held = df.select(columns[0].alias("px"), F.explode(F.array(*columns[1:])).alias("py"))
    ends = held.agg(*[f(c).alias(f"{n}{c}") for c in ("px", "py") for n, f in (("a", F.min), ("z", F.max))]).first()
    sides = [ends[c] or 0.0 for c in ("apx", "zpx", "apy", "zpy")]
    dots = held.select(_scaled(F.col("px"), *sides[:2], across).alias("x"), _scaled(F.col("py"), *sides[2:], up).alias("y"))
    return dots.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), sides[2], sides[3]


def segment(a: Dot, b: Dot) -> Iterable[Dot]:
    """The dots of a straight line, both ends included."""
    steps = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    for k in range(steps + 1):
        yield tuple(p + (2 * k * (q - p) + steps) // (2 * steps) if steps else p for p, q in zip(a, b))


def canvas(dots: Iterable[Dot], wide: int, high: int) -> list[str]:
    """Lines of Braille characters, two dots across and four up each; y counts from the bottom."""
    cells = [[0] * wide for _ in range(high)]
    for x, y in dots:
        row = 4 * high - 1 - y
        cells[row // 4][x // 2] |= DOTS[x % 2][row % 4]
    return ["".join(chr(0x2800 + c) for c in row) for row in cells]


def _framed(dots: Iterable[Dot], low: float, high: float, wide: int, lines: int, title: str) -> str:
    labels = {0: f"{high:g}", lines // 2: f"{(low + high) / 2:g}", lines - 1: f"{low:g}"}
    pad = max(map(len, labels.values()))
    shown = [f"{labels.get(k, ''):>{pad}}{'┤' if k in labels else '│'}{row}" for k, row in enumerate(canvas(dots, wide, lines))]
    head = [title.center(pad + 1 + wide).rstrip()] if title else []
    return "\n".join([*head, *shown, " " * pad + "└" + "─" * wide]) + "\n"


def line_chart(df: DataFrame, order: list[str], keys: Sequence[str], wide: int = 70, high: int = 16, title: str = "") -> str:
    """All records as a line for each field; nothing for no records."""
    made, low, top = line_columns(df, order, keys, 2 * wide, 4 * high)
    dots: set[Dot] = set()
    before: dict[int, Dot] = {}
    rows = sorted(made.collect(), key=lambda r: (r["series"], r["x"]))  # one row a dot column
    for r in rows:
        if r["series"] in before:
            dots.update(segment(before[r["series"]], (r["x"], r["first"])))
        dots.update((r["x"], y) for y in range(r["low"], r["high"] + 1))
        before[r["series"]] = r["x"], r["last"]
    return _framed(dots, low, top, wide, high, title) if rows else ""


def scatter_chart(df: DataFrame, x: str, keys: Sequence[str], wide: int = 70, high: int = 16, title: str = "") -> str:
    """All records as dots, ``x`` across and the other fields up; nothing for no records."""
    made, low, top = scatter_dots(df, x, keys, 2 * wide, 4 * high)
    found = made.select("x", "y").collect()  # one row a dot
    return _framed([(r["x"], r["y"]) for r in found], low, top, wide, high, title) if found else ""
