"""Building blocks for aggregates beyond the named ones.

Each makes an :class:`Aggregate` from a frame's fields, so all of them can be
given to ``collate`` under a name and be combined.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.aggregators import Aggregate, Fields, build
from recordloom.functions.snippets import expression

Maker = Callable[[Fields], Aggregate]


def named(kind: str, *arguments) -> Maker:
    """A registered aggregator; arguments are paths or columns."""
    return lambda fields: build(fields, kind, list(arguments))


def subset(condition: str | Column, inner: Maker) -> Maker:
    """The inner aggregate over records that meet a condition; null when none does.

    The inner aggregate reads fields that are null in all other records, and
    null is what aggregates skip.
    """

    def made(fields: Fields) -> Aggregate:
        meets = F.coalesce(expression(fields.df, condition), F.lit(False))
        part = inner(_Subset(fields, meets))
        if part.by_value is not None:
            return replace(part, by_value=F.when(meets, part.by_value), empty=None, shared=None)
        return Aggregate([*part.bases, F.count_if(meets)], lambda *x: F.when(x[-1] > 0, part.finish(*x[:-1])))

    return made


class _Subset(Fields):
    """Fields that are null where a condition isn't met."""

    def __init__(self, fields: Fields, meets: Column):
        super().__init__(fields.df, fields.order)
        self.meets = meets

    def raw(self, path: str | Column) -> Column:
        return F.when(self.meets, super().raw(path))

    @property
    def one(self) -> Column:
        return F.when(self.meets, F.lit(1))

    @property
    def place(self) -> Column:
        return F.when(self.meets, super().place)


def transformed(inner: Maker, change: Callable[[Column], Column]) -> Maker:
    """Post-process an aggregate's result."""

    def made(fields: Fields) -> Aggregate:
        part = inner(fields)
        finish = lambda *x: change(part.finish(*x))
        outer = part.outer and (lambda: change(part.outer()))
        return replace(part, finish=finish, outer=outer, empty=part.empty and (lambda: change(part.empty())))

    return made


def for_field(pattern: str, inner: Callable[[str], Maker]) -> Maker:
    """One aggregate for each field that a pattern matches, as a struct by field name."""

    def made(fields: Fields) -> Aggregate:
        names = [c for c in fields.df.columns if re.search(pattern, c)]
        return _struct([(n, inner(n)(fields)) for n in names])

    return made


def for_fields(first: str, second: str, inner: Callable[[str, str], Maker]) -> Maker:
    """One aggregate for each pair of matching fields, named ``a,b``."""

    def made(fields: Fields) -> Aggregate:
        columns = fields.df.columns
        pairs = [(a, b) for a in columns if re.search(first, a) for b in columns if re.search(second, b)]
        return _struct([(f"{a},{b}", inner(a, b)(fields)) for a, b in pairs])

    return made


def _struct(parts: list[tuple[str, Aggregate]]) -> Aggregate:
    if any(not p.bases for _, p in parts):
        raise ValueError("aggregates by value can't be repeated over fields")
    bases = [b for _, p in parts for b in p.bases]

    def finish(*found: Column) -> Column:
        at, out = 0, []
        for name, part in parts:
            out.append(part.finish(*found[at : at + len(part.bases)]).alias(name))
            at += len(part.bases)
        return F.struct(*out)

    return Aggregate(bases, finish)


def fold(start: Column, value: str | Column, combine: Callable[[Column, Column], Column], finish: Callable[[Column], Column] = lambda x: x) -> Maker:
    """An ordered fold over a group's values: start, combine with each, finish."""

    def made(fields: Fields) -> Aggregate:
        v = expression(fields.df, value)
        pairs = F.collect_list(F.struct(fields.place.alias("o"), v.alias("v")))
        return Aggregate([pairs], lambda p: F.aggregate(F.array_sort(p), start, lambda held, e: combine(held, e["v"]), finish))

    return made


def map_reduce(value: str | Column, reduce: Callable[[Column, Column], Column], finish: Callable[[Column], Column] = lambda x: x) -> Maker:
    """Map each record, then reduce in order; the first mapped value is the seed."""

    def made(fields: Fields) -> Aggregate:
        v = expression(fields.df, value)
        pairs = F.collect_list(F.struct(fields.place.alias("o"), v.alias("v")))

        def run(p: Column) -> Column:
            values = F.transform(F.array_sort(p), lambda e: e["v"])
            rest = F.slice(values, 2, F.greatest(F.array_size(values) - 1, F.lit(0)))
            return F.aggregate(rest, F.get(values, 0), reduce, finish)

        return Aggregate([pairs], run)

    return made
