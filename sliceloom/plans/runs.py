"""Run queries over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import runs as R
from .tables import SLICES, observations


def slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and exact quantiles of each slice."""
    return R.slice_results(observations(spark, sf_dir))


def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts(observations(spark, sf_dir).withColumn("step", F.col("slice_index") % 3), "scenario_id", "step")


def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.error_counts(observations(spark, sf_dir), "scenario_id")


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(observations(spark, sf_dir), "scenario_id")


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("run_id", "slice_index", C.bucket(F.col("latency_ms")).alias("bound_ms")).agg(F.count(F.lit(1)).alias("n"))


def histogram_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merged(_buckets(spark, sf_dir), "run_id")


def worker_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of two workers, by event, together."""
    obs = observations(spark, sf_dir)
    workers = [R.counts(obs.where(F.col("event_id") % 2 == i), "scenario_id") for i in (0, 1)]
    return workers[0].unionByName(workers[1]).groupBy("scenario_id").agg(*(F.sum(c).alias(c) for c in ("total", "success", "failure")))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("run_id", C.bucket(F.col("latency_ms")).alias("bound_ms")).agg(F.count(F.lit(1)).alias("n"))


def run_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quantiles(_merged(spark, sf_dir), "run_id")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summaries(observations(spark, sf_dir), SLICES)


def run_summary_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.cumulated(_merged(spark, sf_dir), "run_id").withColumn("bound_ms", F.coalesce("bound_ms", F.lit(C.BOUNDS[-1]).cast("long")))
    return rows.groupBy("run_id", "bound_ms").agg(F.max("up_to").alias("up_to"), F.max("total").alias("total"))


def missing_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.missing_slices(observations(spark, sf_dir), SLICES)


def due_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.summaries(observations(spark, sf_dir), SLICES).where(f"received_slices < {SLICES} OR total < 100")
    return R.due(s.select("run_id", (F.col("last_ms") + 60_000).alias("deadline_ms")))


def summary_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run times out at noon of its day and is complete, as revision 2, once its last slice has come."""
    first = observations(spark, sf_dir).groupBy("run_id", "slice_index").agg(F.min("at_ms").alias("at_ms"))
    per = first.groupBy("run_id").agg(F.count_if(F.col("at_ms") % 86_400_000 < 43_200_000).alias("early"), F.count(F.lit(1)).alias("received"))
    timed_out = per.where("early > 0").select("run_id", F.lit(1).cast("long").alias("revision"), F.lit("TimedOut").alias("status"), F.col("early").alias("received"))
    complete = per.where(f"received = {SLICES}").select("run_id", F.lit(2).cast("long").alias("revision"), F.lit("Complete").alias("status"), "received")
    return R.latest(timed_out.unionByName(complete), "status", "received")


def drop_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = observations(spark, sf_dir).groupBy("scenario_id").agg(*R.outcomes(), (F.max("at_ms") - F.min("at_ms")).alias("elapsed_ms"))
    return R.throughput(per).select("scenario_id", "drop_ratio", "per_second")


def distinct_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("scenario_id").distinct()


QUERIES = {f.__name__: f for f in (slice_metrics, step_metrics, error_breakdown, latency_histogram, histogram_merge, worker_union, run_quantiles, run_summary, run_summary_long, missing_slices, due_runs, summary_latest_revision, drop_ratio, distinct_scenarios)}
