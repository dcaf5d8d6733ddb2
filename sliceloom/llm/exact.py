"""Exact deduplication with a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP_SQL, materialize, table

#: A digest may hold at most this share of the rows before it counts as heavy: at most 1 / SUPPORT digests.
SUPPORT = 0.001


def with_groups(rows: DataFrame, won: list[Column], support: float = SUPPORT) -> DataFrame:
    """``rows``, which are written down, with what the aggregates ``won`` give of all rows of their ``digest``.

    A Misra-Gries pass (``freqItems``) proposes at most 1 / support digests; their true results, which are as
    few, are broadcast, so rows of heavy digests never leave their task. All other digests meet in an
    ordinary shuffle, where no key holds more than that share of the rows.
    """
    found = rows.select(F.hex("digest").alias("d")).freqItems(["d"], support)
    heavy = found.select(F.explode("d_freqItems").alias("d")).select(F.unhex("d").alias("digest"))
    few = materialize(rows.join(F.broadcast(heavy), "digest").groupBy("digest").agg(*won), "heavy")
    rest = rows.join(F.broadcast(few.select("digest")), "digest", "left_anti")
    light = rest.join(rest.groupBy("digest").agg(*won), "digest")
    return rows.join(F.broadcast(few), "digest").unionByName(light)


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one space. They meet by
    digest, heavy digests apart: see ``with_groups``.

    Null text counts as empty; empty texts equal each other, very long ones are compared whole. Rows that
    share the smallest doc_id all stay. Null doc_id never wins over a number; a group of nulls only has
    keep_id null and stays. An empty table gives an empty result. Other columns are ignored, whatever their
    names.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row.
    """
    text = F.regexp_replace(F.coalesce(docs["text"], F.lit("")), GAP_SQL, " ")
    rows = materialize(docs.select(docs["doc_id"], F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "digests")
    both = with_groups(rows, [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")], support)
    return both.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
