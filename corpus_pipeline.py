"""A training-corpus pipeline: each stage filters what the one before kept, the last packs it.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.

In every stage an empty table gives an empty result, very long texts are used
whole and columns beside ``doc_id`` and ``text`` are only passed on, whatever
their names. What a stage does with nulls, ties and repeated rows it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import decontaminate, near_dup, packing, quality, toxicity
from recordloom.llm.common import read_table, stored
from recordloom.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that score at least 0.7 stay.

    Every row is judged by its own text, so repeated rows share their fate and
    null ids don't matter; a null or empty text has the score of all-zero statistics.
    """
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"), threshold=0.7)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that score below 0.5 stay.

    Every row is judged by its own text, so repeated rows share their fate and
    null ids don't matter; a text without a known word, null and empty ones
    included, has the share of toxic ones among such examples.
    """
    return toxicity.accepted(docs, read_table(spark, sf_dir, "labels"), threshold=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group linked by 80 % of five-word shingles one document stays.

    It is a row of the smallest id; of repeated rows one stays. Rows with a null
    id, a null text or a text without words are linked with nothing and stay.
    """
    return near_dup.deduplicated(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold 80 % of a benchmark item's five-word shingles go.

    Every row is judged by its own text; exactly 80 % is enough. Null and empty
    texts hold nothing and stay.
    """
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"), words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: what is left, concatenated and cut into sequences of 2,048 ids.

    A null text is an empty one and leaves its end id alone; repeated rows and
    null ids are packed like any other row.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=1, length=2048)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs


#: Trained models, trees and tokenizers aren't expressible in SQL.
ORACLE_SQL = None
