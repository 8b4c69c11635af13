"""Documents to training tokens: toxic documents out, one of each near-duplicate group, benchmark leaks out, sources mixed, ids written.

Each stage works on all rows its predecessor kept, and is written and read again as Parquet before the next. All but the last return the
columns of the documents they were given. Nulls, repeated rows, empty tables and further columns are treated as the operators say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyclock.llm import decontamination, mixing, simhash, token_files, toxicity
from keyclock.llm.queries import table, vocabulary
from keyclock.llm.shared import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.where(~decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), F.col("text")))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.applied(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.encode_and_check(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_leaks),
    ("mixing", mixed_to_weights),
    ("token_ids", token_ids),
]

#: SQL can express none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
