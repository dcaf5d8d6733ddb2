"""Observations, slices and runs: counts, histograms, quantiles, summaries, missing slices.

An observation has run_id, scenario_id, slice_index, at_ms, latency_ms, ok, error_kind. Everything is
aggregated once to (run, slice, bucket, kind) and derived from those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

QUANTILES = ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))


def outcomes(weight: Column | None = None) -> list[Column]:
    """total, success and failure; of rows that stand for many, ``weight`` says how many."""
    w = F.lit(1).cast("long") if weight is None else weight
    return [F.sum(w).alias("total"), F.sum(F.when(F.col("ok"), w).otherwise(0)).alias("success"), F.sum(F.when(F.col("ok"), 0).otherwise(w)).alias("failure")]


def counts(observations: DataFrame, *by: str | Column) -> DataFrame:
    return observations.groupBy(*by).agg(*outcomes())


def error_counts(observations: DataFrame, *by: str) -> DataFrame:
    return observations.where("NOT ok").groupBy(*by, "error_kind").agg(F.count(F.lit(1)).alias("n"))


def histogram(observations: DataFrame, *by: str, bounds: Sequence[int] = C.BOUNDS) -> DataFrame:
    """Counts by inclusive bound_ms, null being overflow; every bucket is there, also with 0."""
    own = C.bucket(F.col("latency_ms"), bounds)
    counted = observations.groupBy(*by).agg(*(F.count_if(own.eqNullSafe(F.lit(b))).alias(f"_{i}") for i, b in enumerate((*bounds, None))))
    every = F.array(*(F.struct(F.lit(b).cast("long").alias("bound_ms"), F.col(f"_{i}").alias("n")) for i, b in enumerate((*bounds, None))))
    return counted.select(*by, F.inline(every))


def merged(buckets: DataFrame, *by: str) -> DataFrame:
    """Histograms (bound_ms, n) of slices added up, and how many slices had a bucket. Unions of worker summaries merge alike."""
    return buckets.groupBy(*by, "bound_ms").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("slices"))


def cumulated(buckets: DataFrame, *by: str, overflow: int = C.BOUNDS[-1]) -> DataFrame:
    """With up_to, the count up to a bound, and total."""
    order = Window.partitionBy(*by).orderBy(F.coalesce("bound_ms", F.lit(overflow + 1)))
    return buckets.withColumns({"up_to": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy(*by))})


def quantiles(buckets: DataFrame, *by: str, overflow: int = C.BOUNDS[-1]) -> DataFrame:
    """Nearest rank over merged buckets: the first bound that reaches it; in the overflow bucket the last bound, without counts 0."""
    bound = F.coalesce("bound_ms", F.lit(overflow))
    reached = [F.coalesce(F.min(F.when((F.col("total") > 0) & (F.col("up_to") >= C.rank(F.col("total"), q)), bound)), F.lit(0)).cast("long").alias(name) for q, name in QUANTILES]
    return cumulated(buckets, *by, overflow=overflow).groupBy(*by).agg(*reached)


def slice_results(observations: DataFrame, overflow: int = C.BOUNDS[-1]) -> DataFrame:
    """Counts and exact quantiles of every slice. What is above ``overflow`` counts, but not in the quantiles.

    Equal latencies of a slice are counted before anything is sorted.
    """
    each = observations.groupBy("run_id", "slice_index", "latency_ms").agg(*outcomes())
    by, inside = Window.partitionBy("run_id", "slice_index"), F.when(F.col("latency_ms") <= overflow, F.col("total")).otherwise(0)
    up_to = F.sum(inside).over(by.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0))
    ranked = each.withColumns({"_n": F.sum(inside).over(by), "_up_to": up_to})
    exact = [F.coalesce(F.min(F.when((F.col("latency_ms") <= overflow) & (F.col("_up_to") >= C.rank(F.col("_n"), q)), F.col("latency_ms"))), F.lit(0)).alias(name) for q, name in QUANTILES]
    return ranked.groupBy("run_id", "slice_index").agg(*(F.sum(c).alias(c) for c in ("total", "success", "failure")), *exact)


def partials(observations: DataFrame) -> DataFrame:
    """One row a (run, slice, bucket, outcome, kind): all that a summary needs."""
    return observations.groupBy("run_id", "scenario_id", "slice_index", C.bucket(F.col("latency_ms")).alias("bound_ms"), "ok", "error_kind").agg(F.count(F.lit(1)).alias("n"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))


def missing(received: Column, slices: Column | int) -> Column:
    every = F.sequence(F.lit(0).cast("long"), F.lit(slices).cast("long") - 1)
    return F.array_except(every, received)


def summaries(observations: DataFrame, slices: int, revision: int = 1) -> DataFrame:
    """One summary a run: slices received and missing, counts, status, quantiles, errors, first and last time, event id.

    One shuffle by run carries the partial counts; buckets and kinds, a bounded number, are folded in arrays of the run.
    """
    w = F.col("n")
    # no error has the kind null; array of structs so that sums by bucket stay in the run's row
    per = partials(observations).groupBy("run_id", "scenario_id").agg(
        *outcomes(w), F.collect_set("slice_index").alias("_got"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"),
        *(F.sum(F.when(F.col("bound_ms") == b, w).otherwise(0)).alias(f"_b{b}") for b in C.BOUNDS), F.collect_list(F.when(~F.col("ok"), F.struct("error_kind", "n"))).alias("_errors"),
    )

    def reach(q: float) -> Column:
        rank, upto, out = C.rank(F.col("total"), q), F.lit(0), None
        for b in C.BOUNDS:
            upto = upto + F.col(f"_b{b}")
            out = F.when(upto >= rank, b) if out is None else out.when(upto >= rank, b)
        return out.otherwise(C.BOUNDS[-1]).cast("long")

    kinds = F.array_sort(F.array_distinct(F.transform("_errors", lambda e: e["error_kind"])))
    errors = F.transform(kinds, lambda k: F.concat(k, F.lit("="), F.aggregate(F.filter("_errors", lambda e: e["error_kind"] == k), F.lit(0).cast("long"), lambda a, e: a + e["n"]).cast("string")))
    received = F.size("_got").cast("long")
    status = F.when(received == slices, "Complete").otherwise("TimedOut")
    gone = F.array_join(F.transform(F.array_sort(missing(F.col("_got"), slices)), lambda i: i.cast("string")), ",")
    return per.select(
        "run_id", "scenario_id", F.lit(slices).cast("long").alias("expected_slices"), received.alias("received_slices"), gone.alias("missing_slices"), "total", "success", "failure", status.alias("status"),
        *(reach(q).alias(name) for q, name in QUANTILES), F.array_join(errors, ",").alias("error_breakdown"), "first_ms", "last_ms", C.summary_event(F.col("run_id"), F.lit(revision), status).alias("event_id"),
    )


def missing_slices(observations: DataFrame, slices: int) -> DataFrame:
    got = observations.groupBy("run_id").agg(F.collect_set("slice_index").alias("_got"))
    return got.select("run_id", F.explode(missing(F.col("_got"), slices)).alias("slice_index"))


def due(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Open runs whose deadline is nearest, the oldest first: a scan with a limit."""
    return runs.orderBy("deadline_ms", "run_id").limit(limit)


def latest(revisions: DataFrame, *columns: str) -> DataFrame:
    """Each run's last revision."""
    return revisions.groupBy("run_id").agg(F.max_by(F.struct("revision", *columns), "revision").alias("_r")).select("run_id", "_r.*")


def throughput(counts_: DataFrame) -> DataFrame:
    """drop_ratio, 1 where nothing began, and finished per second of elapsed_ms."""
    drop = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(1.0 - F.col("success").cast("double") / F.col("total"))
    rate = F.col("total").cast("double") / F.greatest(F.col("elapsed_ms").cast("double") / 1000, F.lit(0.001))
    return counts_.withColumns({"drop_ratio": drop, "per_second": rate})
