"""Reconciliation queries over ``orders``, ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import reconcile as R
from .tables import arrivals, micros, orders, props_k, table

ORDER = ("at_us", "part", "supp", "n", "price")


def job_result_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.absent(orders(spark, sf_dir), arrivals(spark, sf_dir), "key").select("key", "scenario_id")


def result_job_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.absent(arrivals(spark, sf_dir).select("key").distinct(), orders(spark, sf_dir), "key")


def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumed against committed, both ways."""
    a = arrivals(spark, sf_dir)
    return R.multiset_difference(a.where("part % 50 <> 1").select("key", "n"), a.where("part % 50 <> 0").select("key", "n"))


def earliest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a key's deliveries before the order's deadline, 400 days on, the earliest."""
    rows = arrivals(spark, sf_dir).join(orders(spark, sf_dir).select("key", F.col("at_us").alias("from_us")), "key").where("at_us <= from_us + 86400000000 * 400")
    return R.earliest(rows, "key", ("at_us", "n", "part", "supp"), ("n", "at_us"))


def delivery_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.deliveries(arrivals(spark, sf_dir), ("key", "n"), ("at_us", "part", "supp", "quantity", "price"))
    return rows.select("key", "n", "at_us", "part", "supp", "delivery", "redelivered")


def positional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arrivals(spark, sf_dir)
    both = R.zipped(a.where("n % 2 = 1"), a.where("n % 2 = 0"), "key", ORDER)
    return both.select("key", "rn", F.col("part").alias("delivered"), F.col("part_right").alias("committed"), (F.col("at_us") <= F.col("at_us_right")).alias("in_order"))


def event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coverage(arrivals(spark, sf_dir), "key", "n")


def ordered_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four lines of an order as consume, lease, result and commit."""
    kinds = ("job_consumed", "lease_acquired", "terminal_result", "source_committed")
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.col("n"))
    events = arrivals(spark, sf_dir).where("n <= 4").select(F.col("key").alias("execution_key"), kind.alias("kind"), F.col("at_us").alias("at"))
    return R.chain_faults(events, kinds)


def plan_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments as the plan of orders: a key above the customers' is unknown."""
    plan = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("scenario"), F.col("c_mktsegment").alias("endpoint"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scenario"))
    return R.looked_up(rows, plan, "scenario", "endpoint").groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))


def result_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results joined with their jobs by key, and whether they came after them."""
    rows = arrivals(spark, sf_dir).join(orders(spark, sf_dir).select("key", F.col("at_us").alias("job_us"), "scenario_id"), "key")
    return rows.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("at_us") < F.col("job_us")).alias("early"))


def summary_against_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as summaries of their lines; those whose key is divisible by 7 say one too many."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.lit(1).cast("long").alias("results"), F.col("l_quantity").cast("long").alias("total"))
    said = lines.groupBy("run").agg(F.sum("results").alias("results"), F.sum("total").alias("total"))
    said = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run")).join(said, "run").withColumn("total", F.col("total") + (F.col("run") % 7 == 0).cast("int"))
    return R.summaries_against_results(said, lines, "run", "results", "total")


def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the orders' keys as partitions, groups of them as topics."""
    a = arrivals(spark, sf_dir)
    part = a.groupBy((F.col("key") % 64).alias("partition")).agg(F.count(F.lit(1)).alias("end"), F.count_if(F.col("part") % 3 < 2 + F.col("key") % 2).alias("current"))
    part = part.withColumn("current", F.when(F.col("partition") % 9 != 0, F.when(F.col("partition") % 2 == 0, F.col("end")).otherwise(F.col("current"))))
    return R.lag(part.withColumn("topic", F.col("partition") % 8), "topic")


def exactly_one_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as nodes, regions as clusters."""
    key = F.col("n_nationkey")
    gauges = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("cluster"), (key % 3).alias("node"), (key % 8 == 0).cast("int").alias("leader"))
    return R.one_leader(gauges, "cluster")


def elapsed_from_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("us"))
    return R.elapsed(e, "user_id", F.col("us"), F.col("event_type") == "signup").select("event_id", F.col("elapsed").alias("elapsed_us"))


def displayed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "target_success").otherwise(F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 10 == 0, "?").otherwise(props_k().cast("string")).alias("sequence"))
    return e.where(R.displayed(F.col("kind"), F.col("sequence"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").where(C.labels_match(labels, {"segment": "BUILDING", "nation": "3"})).select("c_custkey")


QUERIES = {
    f.__name__: f
    for f in (
        job_result_anti, result_job_anti, multiset_diff, earliest_preceding, delivery_index, positional_match, event_coverage, ordered_chain, plan_lookup, result_order, summary_against_results, consumer_lag,
        exactly_one_leader, elapsed_from_origin, displayed_events, label_match,
    )
}
