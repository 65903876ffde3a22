"""A fluent form: a frame together with the order of its records.

``Flow(df, order).grep("{{x}} > 1").sort("x=-n").head(5).df``. Every method
returns a new flow; nothing runs before an action on ``df``. An operator that
changes what identifies a record's place drops or replaces the order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.keys import assign, value
from recordloom.operators import collate as C
from recordloom.operators import ordering as O
from recordloom.operators import reshape as S
from recordloom.operators import rows as R
from recordloom.operators.join import join
from recordloom.plans.order import PLACE, numbered, placed
from recordloom.sinks import writers
from recordloom.sources import lines as L


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    order: tuple[str, ...] = ()

    @classmethod
    def from_records(cls, spark: SparkSession, records: Sequence[dict], schema: str) -> Flow:
        """Records given in the program, in their order, which is kept in ``_place``."""
        rows = [{**r, PLACE: k} for k, r in enumerate(records)]
        return cls(spark.createDataFrame(rows, f"{schema}, {PLACE} bigint"), (PLACE,))

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, **options) -> Flow:
        """CSV with a header; values that look like numbers are numbers."""
        return cls(L.read_csv(spark, path, header=True, infer=True, **options))

    @classmethod
    def from_json_lines(cls, spark: SparkSession, path: str, schema: str | None = None) -> Flow:
        return cls(L.read_json_lines(spark, path, schema))

    @classmethod
    def from_json_array(cls, spark: SparkSession, path: str, schema: str | None = None) -> Flow:
        return cls(L.read_json_array(spark, path, schema=schema))

    def then(self, operator: Callable[..., DataFrame], *arguments, ordered: bool = False, **options) -> Flow:
        """Apply any operator; ``ordered`` passes the order on."""
        if ordered:
            options["order"] = self._needed()
        return Flow(operator(self.df, *arguments, **options), self.order)

    def _needed(self) -> list[str]:
        if not self.order:
            raise ValueError("this operator depends on the order of records; give Flow(df, order)")
        return list(self.order)

    def grep(self, condition: str | Column, invert: bool = False) -> Flow:
        return self.then(R.grep, condition, invert)

    def eval(self, changes: dict[str, str | Column]) -> Flow:
        """Set fields and keep the records."""
        return self.then(R.xform, changes)

    def map(self, columns: dict[str, str | Column]) -> Flow:
        """New records from expressions; the order stays if its columns do."""
        kept = [c for c in self.order if c not in columns]
        made = R.xform(self.df, columns).select(*columns, *kept)
        return Flow(made, self.order)

    def sort(self, *keys: str, reverse: bool = False) -> Flow:
        """Sort stably; the records' new place is kept in ``_place``."""
        ordered = O.sort(self.df.drop(PLACE) if PLACE not in self.order else self.df, keys, self._needed(), reverse)
        return Flow(placed(ordered), (PLACE,))

    def head(self, n: int) -> Flow:
        return Flow(O.head(self.df, n, self._needed()), self.order)

    def tail(self, n: int) -> Flow:
        """All but the first ``n`` records."""
        return Flow(O.skip(self.df, n, self._needed()), self.order)

    def uniq(self, *keys: str) -> Flow:
        return self.then(O.uniq, keys, ordered=True)

    def delta(self, *keys: str) -> Flow:
        return self.then(O.delta, keys, ordered=True)

    def topn(self, n: int, *keys: str) -> Flow:
        return self.then(O.topn, n, keys, ordered=True)

    def decollate(self, field: str) -> Flow:
        """One record for each element of an array field, in its place; an empty array gives none.

        The new place, kept in ``_place``, is the record's own and the element's within it.
        """
        if not self.order:
            return self.then(S.unarray, field, field)
        place = F.struct(*[F.col(f"`{c}`") for c in self.order], F.col("_element"))
        opened = self.df.select("*", F.posexplode(value(self.df, field)).alias("_element", "_value"))
        made = opened.withColumn(PLACE, place).drop("_element")
        return Flow(assign(made, field, F.col("_value")).drop("_value"), (PLACE,))

    def concat(self, other: Flow) -> Flow:
        """These records, then the other's."""
        first = numbered(self.df, self._needed()).withColumn("_part", F.lit(0))
        second = numbered(other.df, other._needed()).withColumn("_part", F.lit(1))
        return Flow(O.concat(first, second), ("_part", PLACE))

    def join(self, other: Flow, on: Sequence[tuple[str, str]], kind: str = "inner") -> Flow:
        """These records with the other's fields; they keep their own place."""
        places = [c for c in {PLACE, *other.order} if c in self.order]
        return Flow(join(self.df, other.df.drop(*places), on, kind), self.order)

    def collate(self, keys: Sequence[str] = (), aggregates: Sequence[str] = (), **options) -> Flow:
        return Flow(C.collate(self.df, list(keys), list(aggregates), list(self.order) or None, **options))

    def json_lines(self) -> DataFrame:
        return writers.json_lines(self.df)

    def _written(self) -> DataFrame:
        """The records in order, without a place that a flow added."""
        ordered = self.df.orderBy(*self.order) if self.order else self.df
        return ordered.drop(PLACE) if PLACE in self.order else ordered

    def to_json_lines(self, path: str) -> None:
        writers.write_json_lines(self._written(), path)

    def to_json_array(self, path: str) -> None:
        writers.write_json_array(self._written(), path)

    def to_csv(self, path: str, keys: Sequence[str] = (), header: bool = True, delimiter: str = ",") -> None:
        writers.write_csv(self._written(), path, keys, header, delimiter)

    def records(self, most: int = 10_000) -> list[dict]:
        """The first ``most`` records as dicts, in order."""
        rows = self.df.orderBy(*self.order) if self.order else self.df
        return [r.asDict(recursive=True) for r in rows.limit(most).collect()]
