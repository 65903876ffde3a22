"""What the fields of a frame hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.coerce import text


def profile(df: DataFrame) -> DataFrame:
    """One record a field: its type, records, share that isn't null, distinct values (estimated), an example.

    One pass over the data, whatever the number of fields.
    """
    parts = []
    for field in df.schema.fields:
        shown = text(F.col(f"`{field.name}`"), field.dataType)
        parts.append(
            F.struct(
                F.lit(field.name).alias("field"), F.lit(field.dataType.simpleString()).alias("type"),
                F.count(F.lit(1)).alias("records"), F.try_divide(F.count(shown), F.count(F.lit(1))).alias("filled"),
                F.approx_count_distinct(shown).alias("distinct"), F.min(shown).alias("example"),
            )
        )
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
