"""Named aggregators.

An aggregator is given as ``[name=]kind,argument,…``. It becomes either plain
Spark aggregates with a finishing expression (so Spark pre-aggregates it, and
it also works over a window), or a count by value followed by a second
aggregate over the distinct values of a group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import coerce
from recordloom.functions.keys import kind_of, value


@dataclass
class Aggregate:
    """``bases`` are aggregate functions; ``finish`` turns their results into the value.

    One that has both forms uses ``by_value`` for groups and ``bases`` over windows.
    """

    bases: list[Column] = field(default_factory=list)
    finish: Callable[..., Column] = lambda x: x
    #: Two levels: values are counted first; ``outer`` aggregates s (value), ct (count), o (first place),
    #: c (``carried`` of the value's last record) and, if ``ranked``, upto (records of the group up to the
    #: value, itself included) and all (those of the group).
    by_value: Column | None = None
    outer: Callable[[], Column] | None = None
    carried: Column | None = None
    ranked: bool = False
    #: Aggregates with the same one read the same counted values, which are then counted once.
    shared: tuple | None = None
    #: The result of a group without values, if not null.
    empty: Callable[[], Column] | None = None


class Fields:
    """What aggregators read: typed fields of a frame, and the order of its records."""

    def __init__(self, df: DataFrame, order: list[str] | None):
        self.df, self.order = df, order

    def raw(self, path: str | Column) -> Column:
        return path if isinstance(path, Column) else value(self.df, path)

    def kind(self, path: str | Column) -> T.DataType:
        return self.df.select(path).schema[0].dataType if isinstance(path, Column) else kind_of(self.df, path)

    def number(self, path: str | Column) -> Column:
        return coerce.number(self.raw(path), self.kind(path))

    def text(self, path: str | Column) -> Column:
        return coerce.text(self.raw(path), self.kind(path))

    @property
    def one(self) -> Column:
        return F.lit(1)

    @property
    def place(self) -> Column:
        if not self.order:
            raise ValueError("this aggregator depends on the order of records: give order=[…]")
        return F.struct(*[F.col(c) for c in self.order])

    @property
    def record(self) -> Column:
        return F.struct(*[F.col(f"`{c}`") for c in self.df.columns])


def _plain(function: Callable[[Column], Column]):
    return lambda f, x: Aggregate([function(f.number(x))])


def _population(f: Fields, x: str) -> Aggregate:
    return Aggregate([F.var_pop(f.number(x))])


def _pair(f: Fields, x: str, y: str) -> list[Column]:
    """n, sums of x, y, xy, xx and yy over records that have both."""
    a, b = f.number(x), f.number(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return [F.count(a), F.sum(a), F.sum(b), F.sum(a * b), F.sum(a * a), F.sum(b * b)]


def _correlation(n: Column, x: Column, y: Column, xy: Column, xx: Column, yy: Column) -> Column:
    return F.try_divide(n * xy - x * y, F.sqrt((n * xx - x * x) * (n * yy - y * y)))


def _line(n: Column, x: Column, y: Column, xy: Column, xx: Column, yy: Column) -> tuple[Column, Column]:
    beta = F.try_divide(n * xy - x * y, n * xx - x * x)
    return F.try_divide(y - beta * x, n.cast("double")), beta


def _regression(f: Fields, x: str, y: str) -> Aggregate:
    def finish(n, sx, sy, xy, xx, yy):
        alpha, beta = _line(n, sx, sy, xy, xx, yy)
        rest = F.try_divide(n * yy - sy * sy - beta * beta * (n * xx - sx * sx), (n * (n - 2)).cast("double"))
        beta_se = F.sqrt(F.try_divide(n * rest, n * xx - sx * sx))
        alpha_se = F.sqrt(F.try_divide(beta_se * beta_se * xx, n.cast("double")))
        return F.struct(alpha.alias("alpha"), beta.alias("beta"), beta_se.alias("beta_se"), alpha_se.alias("alpha_se"))

    return Aggregate(_pair(f, x, y), finish)


def _moments(f: Fields, x: str) -> Aggregate:
    v = f.number(x)

    def finish(n, mean, variance, skew, excess):
        spread = variance > 0
        return F.struct(
            n.alias("count"), mean.alias("mean"), variance.alias("variance"), F.sqrt(variance).alias("stddev"),
            F.when(spread, skew).alias("skewness"), F.when(spread, excess + 3).alias("kurtosis"),
        )

    return Aggregate([F.count(v), F.avg(v), F.var_pop(v), F.skewness(v), F.kurtosis(v)], finish)


def _two_moments(f: Fields, x: str, y: str) -> Aggregate:
    def finish(n, sx, sy, xy, xx, yy):
        alpha, beta = _line(n, sx, sy, xy, xx, yy)
        spread = (n * xx - sx * sx > 0) & (n * yy - sy * sy > 0)
        mean = lambda s: F.try_divide(s, n.cast("double"))
        return F.struct(
            n.alias("count"), (mean(xy) - mean(sx) * mean(sy)).alias("covariance"),
            _correlation(n, sx, sy, xy, xx, yy).alias("correlation"),
            F.when(spread, alpha).alias("alpha"), F.when(spread, beta).alias("beta"),
        )

    return Aggregate(_pair(f, x, y), finish)


def _ranked(values: Column, share: float) -> Column:
    """Element floor(n * share / 100) of the sorted values, counted from 0; the last if that is n."""
    n = F.array_size(values)
    at = F.least(F.floor(n * float(share) / 100), n - 1)
    return F.get(values, at.cast("int"))


def _plain_field(kind: str, path: str | Column) -> tuple | None:
    return (kind, path) if isinstance(path, str) else None


def _at_rank(share: float) -> Column:
    """The same from counted values: the least one that more records than the rank reach up to."""
    rank = F.least(F.floor(F.col("all") * float(share) / 100), F.col("all") - 1)
    return F.min(F.when(F.col("upto") > rank, F.col("s")))


def _percentile(f: Fields, share: str, x: str) -> Aggregate:
    v = f.number(x)
    return Aggregate(
        [F.collect_list(v)], lambda v: _ranked(F.array_sort(v), float(share)),
        by_value=v, outer=lambda: _at_rank(float(share)), ranked=True, shared=_plain_field("number", x),
    )


def _percentile_map(f: Fields, shares: str, x: str) -> Aggregate:
    wanted, v = shares.split(), f.number(x)
    named = F.array(*map(F.lit, wanted))
    empty = lambda: F.create_map().cast("map<string,double>")

    def finish(v):
        ranked = F.array_sort(v)
        made = F.map_from_arrays(named, F.array(*[_ranked(ranked, float(s)) for s in wanted]))
        return F.when(F.array_size(v) > 0, made).otherwise(empty())

    def outer():
        return F.when(F.count("s") > 0, F.map_from_arrays(named, F.array(*[_at_rank(float(s)) for s in wanted])))

    return Aggregate([F.collect_list(v)], finish, by_value=v, outer=outer, ranked=True, empty=empty, shared=_plain_field("number", x))


def _first(f: Fields, x: str) -> Aggregate:
    v = f.raw(x)
    return Aggregate([F.min_by(v, F.when(v.isNotNull(), f.place))])


def _best(largest: bool):
    def made(f: Fields, x: str) -> Aggregate:
        v = f.number(x)
        # Ties go to the last record: rank by value first (negated for the minimum), then by place.
        rank = F.when(v.isNotNull() & ~F.isnan(v), F.struct(v if largest else -v, f.place))
        return Aggregate([F.max_by(f.record, rank)])

    return made


def _ordered(f: Fields, v: Column, finish: Callable[[Column], Column] = lambda x: x) -> Aggregate:
    pairs = F.collect_list(F.struct(f.place.alias("o"), v.alias("v")))
    return Aggregate([pairs], lambda p: finish(F.transform(F.array_sort(p), lambda e: e["v"])))


def _concatenate(f: Fields, delimiter: str, x: str) -> Aggregate:
    return _ordered(f, F.coalesce(f.text(x), F.lit("null")), lambda v: F.array_join(v, delimiter))


def _values_to_keys(f: Fields, k: str, v: str) -> Aggregate:
    named = f.text(k)
    pairs = F.collect_list(F.when(named.isNotNull(), F.struct(f.place.alias("o"), named.alias("k"), f.raw(v).alias("v"))))

    def finish(p):
        ordered = F.array_sort(p)
        names = F.array_distinct(F.transform(ordered, lambda e: e["k"]))
        last = lambda n: F.element_at(F.filter(ordered, lambda e: e["k"] == n), -1)["v"]
        return F.map_from_arrays(names, F.transform(names, last))

    def outer():
        ordered = F.array_sort(F.collect_list(F.struct("o", "s", "c")))
        return F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["s"], e["c"])))

    kind = f.kind(v).simpleString()
    empty = lambda: F.create_map().cast(f"map<string,{kind}>")
    return Aggregate([pairs], finish, by_value=named, outer=outer, carried=f.raw(v), empty=empty)


def _by_value(outer: Callable[[], Column]):
    return lambda f, x: Aggregate(by_value=f.text(x), outer=outer, shared=_plain_field("text", x))


_KINDS: dict[str, tuple[int, Callable[..., Aggregate], str]] = {
    "count": (0, lambda f: Aggregate([F.count(f.one)]), "records"),
    "sum": (1, _plain(F.sum), "sum of a field"),
    "average": (1, _plain(F.avg), "mean of a field"),
    "minimum": (1, lambda f, x: Aggregate([F.min(F.when(~F.isnan(f.number(x)), f.number(x)))]), "least number"),
    "maximum": (1, lambda f, x: Aggregate([F.max(F.when(~F.isnan(f.number(x)), f.number(x)))]), "largest number"),
    "variance": (1, _population, "population variance"),
    "stddev": (1, _plain(F.stddev_pop), "population standard deviation"),
    "covariance": (
        2,
        lambda f, x, y: Aggregate(_pair(f, x, y), lambda n, a, b, ab, aa, bb: F.try_divide(ab, n.cast("double")) - F.try_divide(a, n.cast("double")) * F.try_divide(b, n.cast("double"))),
        "population covariance",
    ),
    "correlation": (2, lambda f, x, y: Aggregate(_pair(f, x, y), _correlation), "Pearson's correlation"),
    "linearregression": (2, _regression, "least-squares line with standard errors"),
    "ord2univariate": (1, _moments, "moments up to the fourth"),
    "ord2bivariate": (2, _two_moments, "moments of two fields"),
    "percentile": (2, _percentile, "value at a rank, never interpolated"),
    "percentilemap": (2, _percentile_map, "values at several ranks"),
    "mode": (1, _by_value(lambda: F.min_by("s", F.struct(-F.col("ct"), F.col("o")))), "most frequent value, ties to the first seen"),
    "countby": (1, _by_value(lambda: F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "ct"))))), "counts by value"),
    "distinctcount": (1, _by_value(lambda: F.count("s")), "number of distinct values"),
    "first": (1, _first, "first value that isn't null"),
    "last": (1, lambda f, x: Aggregate([F.max_by(f.raw(x), f.place)]), "value of the last record"),
    "firstrecord": (0, lambda f: Aggregate([F.min_by(f.record, f.place)]), "first record"),
    "lastrecord": (0, lambda f: Aggregate([F.max_by(f.record, f.place)]), "last record"),
    "recformax": (1, _best(True), "record of the largest value"),
    "recformin": (1, _best(False), "record of the least value"),
    "records": (0, lambda f: _ordered(f, f.record), "all records in order"),
    "array": (1, lambda f, x: _ordered(f, f.raw(x)), "all values in order"),
    "uarray": (1, lambda f, x: Aggregate([F.collect_set(f.text(x))], F.array_sort), "distinct values, sorted"),
    "concatenate": (2, _concatenate, "values in order, joined"),
    "uconcatenate": (2, lambda f, d, x: Aggregate([F.collect_set(f.text(x))], lambda v: F.array_join(F.array_sort(v), d)), "distinct values, sorted and joined"),
    "valuestokeys": (2, _values_to_keys, "one field's values as keys of another's"),
}

#: Other names of the aggregators.
ALIASES = {
    "ct": "count", "avg": "average", "min": "minimum", "max": "maximum", "var": "variance", "cov": "covariance",
    "covar": "covariance", "corr": "correlation", "correl": "correlation", "linreg": "linearregression",
    "ord2uni": "ord2univariate", "ord2biv": "ord2bivariate", "perc": "percentile", "percmap": "percentilemap",
    "cb": "countby", "dcount": "distinctcount", "dct": "distinctcount", "distinctct": "distinctcount",
    "firstrec": "firstrecord", "lastrec": "lastrecord", "recformaximum": "recformax", "recordformax": "recformax",
    "recordformaximum": "recformax", "recforminimum": "recformin", "recordformin": "recformin",
    "recordforminimum": "recformin", "recs": "records", "concat": "concatenate", "uconcat": "uconcatenate",
    "vk": "valuestokeys",
}


def listing() -> dict[str, str]:
    """Names and one-line descriptions."""
    return {name: about for name, (_, _, about) in _KINDS.items()}


def parse(spec: str) -> tuple[str, str, list[str]]:
    """Name, kind and arguments of ``[name=]kind,argument,…``."""
    name, mark, rest = spec.partition("=")
    rest = rest if mark else spec
    kind, *arguments = rest.split(",")
    if ALIASES.get(kind, kind) not in _KINDS:
        raise ValueError(f"no aggregator {kind!r}")
    wanted = _KINDS[ALIASES.get(kind, kind)][0]
    if len(arguments) != wanted:
        raise ValueError(f"{kind} takes {wanted} arguments, not {len(arguments)}")
    return name if mark else "_".join([kind, *arguments]).replace("/", "_"), ALIASES.get(kind, kind), arguments


def build(fields: Fields, kind: str, arguments: list) -> Aggregate:
    return _KINDS[ALIASES.get(kind, kind)][1](fields, *arguments)
