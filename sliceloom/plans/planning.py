"""Planning queries over ``customer`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import planning as P
from .tables import millis, plans, scenarios, table

WINDOW_MS = 1_700_000_000_000


def slice_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.counted(scenarios(spark, sf_dir)).select("scenario_id", "slices")


def slice_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sliced(scenarios(spark, sf_dir)).select("scenario_id", "slice_index", "slices", "rate", "concurrency", "burst")


def slice_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sliced(scenarios(spark, sf_dir)).groupBy("scenario_id").agg(F.sum("concurrency").alias("concurrency"), F.sum("burst").alias("burst"))


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy = F.when(C.slice_count(F.col("rate"), F.col("concurrency"), F.col("duration_ms")) > 1, "execution_key").otherwise("scenario_id")
    rows = P.jobs(scenarios(spark, sf_dir).withColumn("strategy", strategy), F.lit(WINDOW_MS))
    scenario, i, n = F.col("scenario_id"), F.col("slice_index"), F.col("slices")
    return rows.select(
        "scenario_id", "run_id", "execution_key", C.terminal_event(F.col("execution_key"), F.col("attempt"), "result").alias("event_id"), C.legacy_key(scenario, F.lit(WINDOW_MS), i, n).alias("legacy_key"),
        C.versioned_run(scenario, F.lit(WINDOW_MS)).alias("versioned_run"), "partition_key", "rate", "concurrency", "burst", "attempt", "max_retries", C.within_identity_budget(scenario).alias("id_fits"),
    )


def identity_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of growing length, some of them blank, in two- and one-byte characters."""
    key = F.col("c_custkey")
    letter = F.when(key % 2 == 0, "é").otherwise("n")
    name = F.when(key % 50 == 0, " \t").otherwise(F.expr("repeat(letter, cast(c_custkey % 1100 AS int))"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", letter.alias("letter")).withColumn("scenario_id", name)
    return rows.select("c_custkey", C.within_identity_budget(F.col("scenario_id")).alias("fits"))


def pacing_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pacing(P.sliced(scenarios(spark, sf_dir))).select("scenario_id", "slice_index", "k", "at_s")


def zero_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios(spark, sf_dir).select("scenario_id", C.starts_nothing(F.col("rate"), F.col("duration_ms"), F.col("burst")).alias("to_dlq"))


def dispatch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the first hour; schedules of every seventh order come once."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 5 + 1) * 60_000).alias("every_ms"), millis("o_orderdate").alias("from_ms"))
    return P.windows(rows, F.col("from_ms") + 3_600_000).select("o_orderkey", "scheduled_ms", "next_ms")


def active_window_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")

    def side(shift: int) -> F.Column:
        return F.struct((F.lit(2) - ((key + shift) % 31 == 0).cast("int")).alias("contract_version"), (key % 9 + 1 + ((key + shift) % 29 == 0).cast("int")).alias("slices"), F.when((key + shift) % 23 != 0, F.lit(60_000)).alias("repeat_ms"), F.concat(F.lit("p"), (key % 5 + ((key + shift) % 19 == 0).cast("int")).cast("string")).alias("fingerprint"))

    rows = table(spark, sf_dir, "orders").select("o_orderkey", side(0).alias("stored"), side(1).alias("wanted"))
    return rows.select("o_orderkey", P.active_window_fault().alias("fault"))


def unacked_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's window of seven slices, those that no line acknowledges."""
    windows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("slice_index"))
    acks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") - 1).alias("slice_index"))
    return P.unacknowledged(windows, acks)


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (key % 5).alias("attempt"), (key % 4).alias("max_retries"), millis("o_orderdate").alias("now_ms"), C.joined("key-", key).alias("execution_key"))


def retry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries within the bounds of their jitter: the hash itself is tested with fixed values."""
    rows = P.retried(_attempts(spark, sf_dir), F.col("now_ms"))
    wait = F.col("not_before_ms") - F.col("now_ms")
    plain = F.least(F.lit(1000) * F.pow(F.lit(2), F.col("attempt") - 1), F.lit(60_000))
    return rows.select("o_orderkey", "attempt", "disposition", wait.between(plain * 0.8, plain * 1.2 + 1).alias("jittered"))


def deferral_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1300 * 1000 - 300_000).alias("wait_ms"))
    return rows.select("o_orderkey", P.deferral(F.col("wait_ms")).alias("action"), F.greatest("wait_ms", F.lit(0)).cast("long").alias("wait_ms"))


def startup_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenarios(spark, sf_dir).withColumn("every_ms", F.when(F.col("concurrency") % 3 == 0, F.lit(10_000)))
    return rows.select("scenario_id", F.array_join(P.startup_faults(400.0, 90, 25_000), ",").alias("faults"))


def plan_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the plan, some of them altered, against it."""
    plan = plans(spark, sf_dir)
    jobs = P.sliced(plan.where("scenario_id <> 'a'")).withColumnRenamed("slices", "slice_total").withColumn("h", F.octet_length("scenario_id") * 101 + F.col("slice_index") * 37 + F.floor(F.col("duration_ms") / 100))
    jobs = jobs.select(
        "scenario_id", "slice_index", "slice_total", "duration_ms", "concurrency", (F.col("burst") + (F.col("h") % 13 == 0).cast("int")).alias("burst"), (F.col("rate") + F.when(F.col("h") % 17 == 0, 1e-9).otherwise(0.0)).alias("rate"),
        F.when(F.col("h") % 11 == 0, 1).otherwise(2).alias("schema_version"), F.when(F.col("h") % 19 == 0, 9).otherwise(2).alias("max_retries"), F.when(F.col("h") % 23 == 0, "other").otherwise(F.col("fingerprint")).alias("plan_fingerprint"),
    )
    return P.plan_drift(jobs, plan, 4).select("scenario_id", "slice_index", "fault")


def step_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as steps: some override the endpoint, some with one that no gateway has."""
    key = F.col("n_nationkey")
    steps = table(spark, sf_dir, "nation").select("n_nationkey", F.when(key % 3 == 0, C.joined("http://h", key % 4)).alias("endpoint"))
    gateways = table(spark, sf_dir, "region").select(C.joined("http://h", F.col("r_regionkey")).alias("endpoint"), F.col("r_name").alias("gateway")).where("endpoint <> 'http://h3'")
    return P.step_endpoints(steps, gateways, "http://h1").select("n_nationkey", "resolved", "gateway", "configured")


def step_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("s_suppkey"), F.col("s_name")
    extract = F.when(key % 3 > 0, F.create_map(F.lit("z"), F.lit("a.b"), name, F.lit("c"), C.joined("k", key % 7), F.lit("d")))
    step = F.struct(F.when(key % 2 == 0, "http://other").alias("endpoint"), F.lit("demo.Echo").alias("service"), F.lit("Get").alias("method"), F.when(key % 5 == 0, C.joined("base64:", C.base64_text(name))).alias("request"), extract.alias("extract"), F.when(key % 4 == 0, "body").alias("payload_key"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", step.alias("step")).select("s_suppkey", P.step_material().alias("material"))


QUERIES = {
    f.__name__: f
    for f in (
        slice_count, slice_plan, slice_conservation, job_rows, identity_budget, pacing_schedule, zero_start, dispatch_windows, active_window_guard, unacked_slices, retry_rows, deferral_guard,
        startup_limits, plan_drift, step_endpoints, step_material,
    )
}
