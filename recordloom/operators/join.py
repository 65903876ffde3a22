"""Equi-joins of a stream of records with a second table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import coerce
from recordloom.functions.keys import kind_of, value
from recordloom.functions.snippets import expression

#: keep: unmatched records of which side stay.
KINDS = {"inner": "inner", "left": "right_outer", "right": "left_outer", "outer": "full_outer"}


def join(
    df: DataFrame,
    other: DataFrame,
    on: Sequence[tuple[str, str]],
    kind: str = "inner",
    as_text: bool = True,
    changes: dict[str, str] | None = None,
) -> DataFrame:
    """Records of ``df`` joined with those of ``other`` by pairs of paths.

    Fields of both sides come together; where both have a field, a matched
    record takes the value of ``other``. ``left`` keeps unmatched records of
    ``other``, ``right`` those of ``df``, ``outer`` both. Keys are compared as
    text, so null, missing and empty text match each other; ``as_text=False``
    compares typed values and null matches null. ``changes`` are expressions
    over ``i.*`` (record of ``df``) and ``d.*`` (of ``other``); then only those
    and the fields of ``other`` are returned.

    The value of ``other`` also replaces a column that gives ``df`` its order: drop
    such a column from ``other`` first if the order is to stay.

    Spark chooses between a broadcast and a shuffle by the sides' sizes. Columns
    named ``_hit``, ``_own``, ``_l0``, ``_r0`` and so on are refused.
    """
    helpers = {"_hit", "_own", *[f"_{side}{k}" for side in "lr" for k in range(len(on))]}
    if taken := helpers & {*df.columns, *other.columns}:
        raise ValueError(f"rename the columns {sorted(taken)}: joins use these names")
    tests, a, b = [], df, other
    for k, (mine, theirs) in enumerate(on):
        left, right = value(df, mine), value(other, theirs)
        if as_text:
            left, right = coerce.key_text(left, kind_of(df, mine)), coerce.key_text(right, kind_of(other, theirs))
        a, b = a.withColumn(f"_l{k}", left), b.withColumn(f"_r{k}", right)
        same = F.col(f"_l{k}") == F.col(f"_r{k}") if as_text else F.col(f"_l{k}").eqNullSafe(F.col(f"_r{k}"))
        tests.append(same)
    b = b.withColumn("_hit", F.lit(True))
    a = a.withColumn("_own", F.lit(True))
    both = a.alias("i").join(b.alias("d"), reduce(lambda x, y: x & y, tests), KINDS[kind])
    if changes is not None:
        made = {name: expression(both, code) for name, code in changes.items()}
        kept = [F.col(f"d.`{c}`") for c in other.columns if c not in made]
        return both.select(*kept, *[c.alias(n) for n, c in made.items()])
    out = []
    for name in dict.fromkeys([*df.columns, *other.columns]):
        if name in df.columns and name in other.columns:
            out.append(F.when(F.col("_hit"), F.col(f"d.`{name}`")).otherwise(F.col(f"i.`{name}`")).alias(name))
        else:
            out.append(F.col(f"{'i' if name in df.columns else 'd'}.`{name}`"))
    return both.select(*out)


def join_accumulate(
    df: DataFrame, other: DataFrame, on: Sequence[tuple[str, str]], order: list[str], keep_unmatched: bool = False
) -> DataFrame:
    """Each record of ``other`` with the fields it lacks from its first matching record of ``df``.

    Matches are aggregated by key before the join, so a key with many records
    is one row in it. A field that is null in the first match is taken from
    the next that has it.
    """
    lacks = [c for c in df.columns if c not in other.columns]
    place = F.struct(*[F.col(c) for c in order])
    keys = [coerce.key_text(value(df, m), kind_of(df, m)).alias(f"_k{k}") for k, (m, _) in enumerate(on)]
    firsts = df.groupBy(*keys).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in lacks]
    )
    tests = [coerce.key_text(value(other, t), kind_of(other, t)) == firsts[f"_k{k}"] for k, (_, t) in enumerate(on)]
    joined = other.join(firsts, reduce(lambda x, y: x & y, tests), "left_outer" if keep_unmatched else "inner")
    return joined.drop(*[f"_k{k}" for k in range(len(on))])
