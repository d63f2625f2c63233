"""A corpus pipeline: language, exact and near duplicates, test items, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of ``documents``.

Stages decide on rows, not on ids: a doc_id that is null or repeats with another text is a document of its own. Null and
empty texts go with the first stage, as they are in no language.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm import decontamination, exact_dedup, jaccard_join, language_id, pieces
from vaultspark.llm.common import ready, scope, table, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter, or whose language stays unknown, go."""
    ready(spark)
    return language_id.known(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; of rows that are equal in id as well, one."""
    ready(spark)
    return exact_dedup.without_duplicates(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, the one with the smallest id; documents without a word stay.

    Rows whose id is null or repeats are told apart by negative ids made of id and text; of linked ones among these any one stays.
    """
    ready(spark)
    again = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    again = written(again.select(F.col("doc_id").alias("_again_id"), F.lit(True).alias("_again")), "again")
    own, columns = F.col("doc_id"), docs.columns
    if not again.isEmpty():
        docs = docs.join(again, F.col("doc_id").eqNullSafe(F.col("_again_id")), "left")
        own = F.when(F.col("_again"), -1 - F.pmod(F.xxhash64("doc_id", "text"), F.lit((1 << 62) - 1))).otherwise(F.col("doc_id"))
    found = jaccard_join.near_duplicates(docs.select(own.alias("doc_id"), "text"))
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, own == F.col("_kept_id"), "left_semi").select(columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    ready(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document."""
    ready(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", identified), ("exact_dedup", unique), ("near_dedup", apart), ("decontamination", clean), ("pieces", coded)]

#: Languages and pieces are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's own scratch tables go when it is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", 1)
    return STAGES[-1][1](spark, docs, sf_dir)
