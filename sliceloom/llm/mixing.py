"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, materialize, table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEATS = 2


def word_count(text: Column) -> Column:
    """Words in ``text``: each shrinks to one mark before counting, so no array of them is built."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_SQL, "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """source, n, source_size, target: ``budget`` times all words shared by weight, none above ``repeats`` times its source.

    Sources in code-point order, null last, take the weights in turn. Sources are capped in the order
    of cap / weight: a source is capped exactly if the level that is left for it and all later ones
    reaches its cap. That is where resharing the excess again and again ends.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("w", given).withColumn("cap", F.col("source_size") * float(repeats))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    earlier, later, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("source_size").over(all_) * float(budget)
    per = per.withColumn("level", (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("w").over(later))
    first = F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(all_)
    per = per.withColumn("open", F.coalesce(first["level"], F.lit(float("inf"))))
    return per.select("source", "n", "source_size", F.least("cap", F.col("w") * F.col("open")).alias("target"))


def queued(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """``sizes`` (doc_id, source, size and any others) with source_size, target and start.

    Each source's documents stand in the order of the md5 of seed and id; start is the words of the
    source ahead of the document. The running sum has two levels: buckets of the md5, about the square
    root of a source's rows, then the rows of a bucket, so no task holds a whole source.
    """
    targets = source_targets(sizes, weights, budget, repeats)
    rows = sizes.join(targets.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    rows = rows.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("_bucket", F.floor(share * F.ceil(F.sqrt("n"))))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_of"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_b")))
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("_ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.select(*sizes.columns, "source_size", "target", "start")


def served(copy: Column) -> Column:
    """Words of a document's copy number ``copy`` that are served before its source's target is reached."""
    begin = F.col("start") + copy * F.col("source_size")
    return F.least(F.col("size"), F.greatest(F.floor(F.col("target") - begin), F.lit(0))).cast("long")


def fair_mix(queue: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The mix in its order: one row per copy that is taken, range-sorted by virtual finish time.

    A copy's virtual finish time is the words of its source up to its end over the source's target. At
    time 1 every source has had its target and the total budget is spent, so the order is cut there: a
    copy that begins later is never reached, one in service has given ``served`` of its words. Partitions
    follow each other in order.
    """
    copies = queue.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = (F.col("start") + F.col("copy") * F.col("source_size") + F.col("size")) / F.col("target")
    copies = copies.where("size > 0 AND start + copy * source_size < target").withColumn("finish", finish)
    n = int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["finish", "source", "doc_id", "copy"]
    line = copies.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return line.withColumn("served", served(F.col("copy"))).where("served > 0").withColumn("finish", F.least("finish", F.lit(1.0)))


def sized(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"), *more)


def mixed(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken.

    ``taken`` adds up the document's copies in ``fair_mix``. The queue is written once, as both the mix and
    the list of all documents read it; of rows with words, source and start name one.

    Null text and empty text have size 0 and take 0. A null source is a source of its own, the last.
    A null doc_id is shuffled as an empty id; rows with equal ids stand next to each other, smaller
    first. With no words at all every target is 0. An empty table gives an empty result. Other columns
    are ignored.
    """
    queue = materialize(queued(sized(docs)), "queue")
    took = fair_mix(queue).groupBy("source", "start", "size").agg(F.sum("served").alias("served"))
    took = took.select(F.col("source").alias("of"), F.col("start").alias("begin"), F.col("size").alias("words"), "served")
    mine = F.col("source").eqNullSafe(F.col("of")) & (F.col("start") == F.col("begin")) & (F.col("size") == F.col("words"))
    return queue.join(took, mine, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("served", F.lit(0)).cast("long").alias("taken"))


def op1_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("source")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source
), c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM s), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(cap, w * coalesce((SELECT arg_min(level, cap / w) FROM l WHERE cap / w > level), 'infinity'::DOUBLE)) AS target FROM l
), q AS (
  SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (
           PARTITION BY d.source ORDER BY md5(concat_ws(':', 'mix', doc_id::VARCHAR)), doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(floor(target - start), 0)) + least(size, greatest(floor(target - start - source_size), 0)))::BIGINT AS taken
FROM q
"""
