"""User expressions: Spark SQL text with ``{{path}}`` places, or Python callables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.keys import lookup, parts_of


def _sql(df: DataFrame, path: str) -> str:
    found = lookup(df.schema, path if path.startswith("@") else f"@{path}")
    if found is None:
        return "NULL"
    kind, text = df.schema, ""
    from recordloom.functions.keys import _loose  # the same loose rule as lookup

    for part in parts_of(path.removeprefix("@")):
        if part.startswith("#"):
            text, kind = f"get({text}, {part[1:]})", kind.elementType
        elif hasattr(kind, "names"):
            name = _loose(part, kind.names)
            text, kind = f"{text}.`{name}`" if text else f"`{name}`", kind[name].dataType
        else:
            text, kind = f"{text}['{part}']", kind.valueType
    return text


def expression(df: DataFrame, snippet: str | Column) -> Column:
    """A column from SQL text; ``{{a/b}}`` places are matched loosely, a missing field is null."""
    if isinstance(snippet, Column):
        return snippet
    return F.expr(re.sub(r"\{\{(.*?)\}\}", lambda m: _sql(df, m[1]), snippet))


def apply_rows(df: DataFrame, code: Callable[[dict], dict | list[dict] | None], schema: str) -> DataFrame:
    """Run Python for each record: a dict gives one record, a list many, None none.

    The slow path, for code that SQL can't say; records come in Arrow batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made: list[dict] = []
            for record in frame.to_dict("records"):
                found = code(record)
                made += found if isinstance(found, list) else [] if found is None else [found]
            yield pd.DataFrame(made)

    return df.mapInPandas(run, schema)
