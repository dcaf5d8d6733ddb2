"""Corpus pipeline over ``documents``: each stage takes what its predecessor kept.

The stages select, drop or repeat rows and never change a text. No stage can be expressed whole in SQL
(a fitted classifier, sketches and a tokenizer), so ``ORACLE_SQL`` is None and the tests compare with
brute force. Null texts, empty tables and extra columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceloom.llm import decontaminate, mixing, neardup, quality, tokens
from sliceloom.llm.common import materialize, table


def _rows_of(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs``, packed meanwhile so that no column name of theirs can clash, whose doc_id is (or is not) in ``ids``."""
    rows = docs.select(F.struct("*").alias("row"))
    chosen = ids.select("doc_id").distinct()
    return rows.join(chosen, F.col("row.doc_id").eqNullSafe(F.col("doc_id")), how).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good (score of at least 0.3)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _rows_of(docs, quality.scored(docs, model).where("predicted = 1"), "left_semi")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate group (five words, similarity 0.8), and documents without words."""
    return _rows_of(docs, neardup.near_duplicates(docs, k=5, percent=80).where("kept"), "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _rows_of(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole texts only, the copy cut by the budget if half of it is served.

    Rows that share a doc_id are repeated alike. Documents without words give the mix nothing and go.
    """
    queue = materialize(mixing.queued(mixing.sized(docs)), "queue")
    copies = mixing.fair_mix(queue).where("served * 2 >= size").groupBy("doc_id", "source", "start").agg(F.count(F.lit(1)).alias("times"))
    times = copies.groupBy("doc_id").agg(F.max("times").alias("times"))
    held = docs.select(F.struct("*").alias("row")).join(times, F.col("row.doc_id").eqNullSafe(F.col("doc_id")))
    return held.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order, and of each row what they hold: doc_id, start, n_tokens, ids_crc32."""
    return tokens.tokenized(docs, tokens.vocabulary_path())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is written to the shared folder, so no later one computes it again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
