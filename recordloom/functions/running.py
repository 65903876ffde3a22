"""Aggregators after each record: mergeable states and what finishes them.

A running form is a dict of states for :func:`recordloom.plans.order.scan` and a
function of their columns. Lists, percentiles and the like have none: what
they would carry on is the group itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.aggregators import ALIASES, Fields, build
from recordloom.plans.order import PLACE, State


@dataclass
class Running:
    """``states`` run on through a group; ``finish`` turns them into the value.

    ``shift`` is a field whose mean over all records is taken off first, so that
    sums of powers keep their digits; ``distinct`` a value whose first record in
    a group counts 1 in the state named ``new``.
    """

    states: list[State]
    finish: Callable[..., Column] = lambda x: x
    shift: Column | None = None
    powers: int = 0
    distinct: Column | None = None
    #: Records before this one play no part: the value is an expression of the record itself.
    own: Column | None = None


def _mean(total: Column, n: Column) -> Column:
    return F.try_divide(total, n.cast("double"))


def power_states(x: Column, shift: Column, most: int) -> list[State]:
    """The count of ``x`` and the sums of its first powers, less ``shift``."""
    d = x - shift
    made, power = [State("sum", F.when(x.isNotNull(), 1).otherwise(0))], d
    for _ in range(most):
        made.append(State("sum", power))
        power = power * d
    return made


def _spread(finish: Callable[[Column], Column]):
    def done(n: Column, s1: Column, s2: Column, shift: Column) -> Column:
        return F.when(n > 0, finish(F.greatest(_mean(s2, n) - _mean(s1, n) * _mean(s1, n), F.lit(0.0))))

    return lambda f, x: Running([], done, shift=f.number(x), powers=2)


def _moments(f: Fields, x: str) -> Running:
    def done(n: Column, s1: Column, s2: Column, s3: Column, s4: Column, shift: Column) -> Column:
        m = _mean(s1, n)
        m2 = F.greatest(_mean(s2, n) - m * m, F.lit(0.0))
        m3 = _mean(s3, n) - 3 * m * _mean(s2, n) + 2 * m * m * m
        m4 = _mean(s4, n) - 4 * m * _mean(s3, n) + 6 * m * m * _mean(s2, n) - 3 * m * m * m * m
        return F.struct(
            n.alias("count"), (m + shift).alias("mean"), m2.alias("variance"), F.sqrt(m2).alias("stddev"),
            F.when(m2 > 0, m3 / (m2 * F.sqrt(m2))).alias("skewness"), F.when(m2 > 0, m4 / (m2 * m2)).alias("kurtosis"),
        )

    return Running([], done, shift=f.number(x), powers=4)


def _pair(kind: str):
    def made(f: Fields, x: str, y: str) -> Running:
        a, b = f.number(x), f.number(y)
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        sums = [F.when(both, 1).otherwise(0), a, b, a * b, a * a, b * b]
        return Running([State("sum", s) for s in sums], build(f, kind, [x, y]).finish)

    return made


def _extreme(kind: str):
    def made(f: Fields, x: str) -> Running:
        v = f.number(x)
        return Running([State(kind, F.when(~F.isnan(v), v))])

    return made


def _best(sign: int):
    def made(f: Fields, x: str) -> Running:
        v = f.number(x)
        rank = F.when(v.isNotNull() & ~F.isnan(v), F.struct((v * sign).alias("v"), F.col(PLACE)))
        return Running([State("best", f.record, rank)])

    return made


_RUNNING: dict[str, Callable[..., Running]] = {
    "count": lambda f: Running([State("sum", F.lit(1))]),
    "sum": lambda f, x: Running([State("sum", f.number(x))]),
    "average": lambda f, x: Running([State("sum", f.number(x)), State("sum", F.when(f.number(x).isNotNull(), 1).otherwise(0))], _mean),
    "minimum": _extreme("min"),
    "maximum": _extreme("max"),
    "variance": _spread(lambda v: v),
    "stddev": _spread(F.sqrt),
    "ord2univariate": _moments,
    **{kind: _pair(kind) for kind in ("covariance", "correlation", "linearregression", "ord2bivariate")},
    "first": lambda f, x: Running([State("first", f.raw(x))]),
    "last": lambda f, x: Running([], own=f.raw(x)),
    "firstrecord": lambda f: Running([State("first", f.record)]),
    "lastrecord": lambda f: Running([], own=f.record),
    "recformax": _best(1),
    "recformin": _best(-1),
    "distinctcount": lambda f, x: Running([], distinct=f.text(x)),
}


def running_form(fields: Fields, kind: str, arguments: list[str]) -> Running | None:
    made = _RUNNING.get(ALIASES.get(kind, kind))
    return made(fields, *arguments) if made else None
