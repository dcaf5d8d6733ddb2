"""Metric samples (by columns of labels, at, value): increases, rates, quantiles, gates, alerts, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger(window: str, *by: str):
    return Window.partitionBy(*by).orderBy(window)


def increments(samples: DataFrame, by: tuple[str, ...], at: str, *values: str) -> DataFrame:
    """What each sample adds to the one before; a counter that falls began again at 0, the first adds nothing."""
    before = Window.partitionBy(*by).orderBy(at)
    steps = samples.withColumns({f"_{v}": F.lag(v).over(before) for v in values})
    return steps.withColumns({v: F.when(F.col(f"_{v}").isNull(), 0).when(F.col(v) < F.col(f"_{v}"), F.col(v)).otherwise(F.col(v) - F.col(f"_{v}")) for v in values}).drop(*(f"_{v}" for v in values))


def increase(increments_: DataFrame, by: tuple[str, ...], *values: str) -> DataFrame:
    return increments_.groupBy(*by).agg(*(F.sum(v).cast("long").alias(v) for v in values))


def or_zero(rows: DataFrame, condition: Column, value: str) -> DataFrame:
    """One number, 0 where no row matches."""
    return rows.agg(F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0)).cast("long").alias(value))


def interpolated(values: DataFrame, by: str, value: Column, bounds: tuple[float, ...], quantiles: dict[str, float]) -> DataFrame:
    """Quantiles that interpolate linearly in cumulative buckets; the last bound stands for no limit, its bucket gives the one before.

    Cumulative counts are conditional counts of one aggregation, so each row is read once and no join multiplies rows.
    """
    counts = values.groupBy(by).agg(F.count(F.lit(1)).cast("double").alias("_total"), *(F.count_if(value <= float(b)).cast("double").alias(f"_{i}") for i, b in enumerate(bounds)))

    def at(q: float) -> Column:
        rank, case, low, before = F.lit(q) * F.col("_total"), None, 0.0, F.lit(0.0)
        for i, b in enumerate(bounds):
            upto = F.col(f"_{i}")
            inside = F.lit(low) if b == bounds[-1] else F.lit(low) + F.lit(float(b) - low) * (rank - before) / (upto - before)
            case = F.when(upto >= rank, inside) if case is None else case.when(upto >= rank, inside)
            low, before = float(b), upto
        return case

    return counts.select(by, *(at(q).alias(name) for name, q in quantiles.items()))


def ratio(part: Column, whole: Column, clamp: float | None = None) -> Column:
    """A share; NaN where the whole is not positive, or with ``clamp`` over at least that much."""
    part, whole = part.cast("double"), whole.cast("double")
    return part / F.greatest(whole, F.lit(float(clamp))) if clamp is not None else F.when(whole > 0, part / whole).otherwise(F.lit(float("nan")))


def gate(metrics: DataFrame, thresholds: DataFrame, on: str) -> DataFrame:
    """Each threshold (throughput_floor, p95_max_s, p99_max_s, error_rate_max) against its metrics (success_rate, failure_rate, p95_s, p99_s).

    A missing failure rate is 0. Anything else that is missing or NaN fails with that reason alone; else reasons
    are every limit that is missed, in order.
    """
    m = metrics.select(F.col(on).alias("_on"), *("success_rate", "failure_rate", "p95_s", "p99_s"))
    rows = thresholds.join(m, F.col(on) == F.col("_on"), "left").drop("_on")
    real = lambda c: F.when(~F.isnan(c), c)
    rows = rows.withColumns({c: real(F.col(c)) for c in ("success_rate", "p95_s", "p99_s")} | {"failure_rate": F.coalesce(real(F.col("failure_rate")), F.lit(0.0))})
    rows = rows.withColumn("error_rate", real(ratio(F.col("failure_rate"), F.col("success_rate") + F.col("failure_rate"))))
    whole = F.col("success_rate").isNotNull() & F.col("p95_s").isNotNull() & F.col("p99_s").isNotNull() & F.col("error_rate").isNotNull()
    limits = (("throughput", F.col("success_rate") < F.col("throughput_floor")), ("p95", F.col("p95_s") > F.col("p95_max_s")), ("p99", F.col("p99_s") > F.col("p99_max_s")), ("error_rate", F.col("error_rate") > F.col("error_rate_max")))
    missed = F.array_compact(F.array(*(F.when(c, name) for name, c in limits)))
    reasons = F.when(whole, missed).otherwise(F.array(F.lit("missing_or_invalid_metrics")))
    return rows.withColumn("reasons", F.array_join(reasons, "|")).withColumn("status", F.when(F.col("reasons") == "", "PASS").otherwise("FAIL"))


def passed(*conditions: Column) -> Column:
    """1 if all hold, else 0: the product of the comparisons as numbers; null where one is."""
    out = F.lit(1)
    for c in conditions:
        out = out * c.cast("int")
    return out


def rollup(gates: DataFrame, *by: str) -> DataFrame:
    """checked, failures and status of groups of gates (status PASS or FAIL); nothing checked is a failure."""
    failures = F.count_if(F.col("status") != "PASS")
    return gates.groupBy(*by).agg(F.count(F.lit(1)).alias("checked"), failures.alias("failures")).withColumn("status", F.when((F.col("failures") > 0) | (F.col("checked") == 0), "FAIL").otherwise("PASS"))


#: Fixed table of the alert rules: name, condition over a row of evaluated expressions, minutes it has to hold.
ALERTS = (
    ("NoSchedulerLeader", "leaders < 1", 3),
    ("HighScenarioFailureRatio", "failure_ratio > 0.02", 10),
    ("ScenarioLatencyP95High", "p95_s > 1", 10),
    ("WorkerConsumeErrorsHigh", "consume_error_ratio > 0.005", 10),
    ("DlqActivityDetected", "dlq_rate > 0", 5),
    ("DlqPublishFailures", "dlq_failure_rate > 0", 3),
    ("ResultPublishFailures", "result_failure_rate > 0", 3),
    ("SourceCommitFailures", "commit_failure_rate > 0", 3),
    ("UncommittedJobsStuck", "uncommitted_jobs > 0", 3),
    ("IncompleteDispatch", "incomplete_dispatch_slices > 0", 3),
    ("SummaryPublishFailures", "summary_failure_rate > 0", 3),
    ("AggregateTimeouts", "aggregate_timeout_rate > 0", 5),
)


def held(evaluations: DataFrame, by: tuple[str, ...], step: str, condition: Column, least: int) -> DataFrame:
    """Evaluations (step numbers without gaps when nothing is missing) at which a condition has held so many times in a row, a gap ends it."""
    bad = evaluations.where(condition)
    island = bad.withColumn("_island", F.col(step) - F.row_number().over(Window.partitionBy(*by).orderBy(step)))
    return island.withColumn("_held", F.row_number().over(Window.partitionBy(*by, "_island").orderBy(step))).where(F.col("_held") >= least).drop("_island", "_held")


def firing(evaluations: DataFrame, rules=ALERTS, by: tuple[str, ...] = ()) -> DataFrame:
    """(alert, minute and labels) at which a rule fires: evaluations have ``minute`` and the columns that the rules name."""
    every = F.explode(F.array(*(F.struct(F.lit(name).alias("alert"), F.coalesce(F.expr(cond), F.lit(False)).alias("bad"), F.lit(m).alias("for_minutes")) for name, cond, m in rules)))
    rows = evaluations.select(*by, "minute", every.alias("r")).select(*by, "minute", "r.*").where("bad")
    key = Window.partitionBy(*by, "alert")
    island = rows.withColumn("_island", F.col("minute") - F.row_number().over(key.orderBy("minute")))
    since = island.withColumn("_since", F.min("minute").over(Window.partitionBy(*by, "alert", "_island")))
    return since.where("minute - _since >= for_minutes").select(*by, "alert", "minute")


def trend(points: DataFrame, by: str, order: tuple[str, ...], value: str) -> DataFrame:
    """With delta against the point before; a delta that is only rounding is 0."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return points.withColumn("delta", d).withColumn("delta", F.when(F.abs("delta") < 1e-12, 0.0).otherwise(F.col("delta")))


def last_points(points: DataFrame, by: str, order: tuple[str, ...], most: int = 40) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(by).orderBy(*(F.desc(c) for c in order)))
    return points.withColumn("_rn", rn).where(F.col("_rn") <= most).drop("_rn")


def last_value(points: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each group's last value that is not null."""
    return points.where(F.col(value).isNotNull()).groupBy(by).agg(F.max_by(value, order).alias(value))


def mixed_classes(records: DataFrame, by: str | None = None, evidence: str = "evidence_class") -> DataFrame:
    """Groups whose records are of several evidence classes; a record without one is legacy_unclassified."""
    classes = F.array_sort(F.collect_set(F.coalesce(evidence, F.lit("legacy_unclassified"))))
    return records.groupBy(*([by] if by else [])).agg(classes.alias("classes")).where(F.size("classes") > 1)


def progress(increases: DataFrame, by: str, fault_at: Column, at: str, value: str) -> DataFrame:
    """before, after and progressed: whether a counter went on after a fault."""
    per = increases.groupBy(by).agg(F.sum(F.when(F.col(at) < fault_at, F.col(value)).otherwise(0)).alias("before"), F.sum(F.when(F.col(at) >= fault_at, F.col(value)).otherwise(0)).alias("after"))
    return per.withColumn("progressed", F.col("after") > 0)


def cluster_totals(samples: DataFrame, *by: str) -> DataFrame:
    """Sums over nodes of each node's sum cut to a whole number."""
    per = samples.groupBy(*by, "node").agg(F.sum("value").cast("long").alias("_node"))
    return per.groupBy(*by).agg(F.sum("_node").alias("total"))


def history_entries(history: DataFrame, name: str | None = None) -> DataFrame:
    """A history record's first entry of each scenario name: run_id, timestamp_utc, evidence class, status, metrics, thresholds."""
    entries = history.select("run_id", "timestamp_utc", "summary", F.posexplode("scenarios").alias("_at", "s"))
    if name is not None:
        entries = entries.where(F.col("s.name") == name)
    first = entries.groupBy("run_id", "timestamp_utc", F.col("s.name").alias("name")).agg(F.min_by(F.struct("summary", "s"), "_at").alias("_e"))
    return first.select("run_id", "timestamp_utc", "name", F.coalesce("_e.summary.evidence_class", F.lit("legacy_unclassified")).alias("evidence_class"), F.coalesce("_e.s.status", "_e.summary.status", F.lit("FAIL")).alias("status"), F.col("_e.s.metrics").alias("metrics"), F.col("_e.s.thresholds").alias("thresholds"))
