"""The test tables as the records that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import planning, samples

SLICES = 16
DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def millis(name: str) -> Column:
    return F.floor(micros(name) / 1000).cast("long")


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scenario executions: a type is a scenario, a day a window of 16 slices."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("scenario_id"), F.col("user_id"), "value", props_k().alias("k"), millis("ts").alias("at_ms"))
    factor = F.when(F.col("scenario_id") == "view", 1).when(F.col("scenario_id") == "click", 5).when(F.col("scenario_id") == "signup", 20).when(F.col("scenario_id") == "purchase", 100).otherwise(1000)
    window = (F.col("at_ms") - F.col("at_ms") % DAY_MS).alias("window_ms")
    kind = F.when(F.col("k") < 10, F.when(F.col("k") % 3 == 0, "target_status:Unavailable").when(F.col("k") % 3 == 1, "target_timeout").otherwise("target_transport"))
    rows = e.select("event_id", "scenario_id", (F.col("user_id") % SLICES).alias("slice_index"), "at_ms", window, F.greatest(F.lit(1).cast("long"), F.floor(F.col("value") * factor)).alias("latency_ms"), (F.col("k") >= 10).alias("ok"), kind.alias("error_kind"))
    return rows.withColumn("run_id", C.window_id(F.col("scenario_id"), F.col("window_ms"), F.lit(SLICES)))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five planning cases, and each customer as a scenario."""
    cases = spark.createDataFrame([("a", 0.1, 1, 10000, 0), ("b", 9.9, 2, 1000, 1), ("c", 20.0, 3, 100, 3), ("d", 200.5, 73, 1000, 10), ("e", 1000.0, 256, 1000, 256)], "scenario_id string, rate double, concurrency int, duration_ms int, burst int")
    key = F.col("c_custkey")
    concurrency = key % 97 + 1
    more = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer-"), key.cast("string")).alias("scenario_id"), ((key % 2000 + 1).cast("double") / 4).alias("rate"), concurrency.cast("int").alias("concurrency"),
        ((key % 60 + 1) * 500).cast("int").alias("duration_ms"), (key % 7 % concurrency).cast("int").alias("burst"),
    )
    return cases.union(more)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as deliveries: an order is a key, a line its part."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n"), micros("l_shipdate").alias("at_us"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), micros("o_orderdate").alias("at_us"), F.col("o_orderpriority").alias("scenario_id"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as results of slices: an order is a run; repeated lines are duplicates or conflicts."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), (F.col("l_linenumber") - 1).alias("slice_index"), micros("l_shipdate").alias("at_us"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("total"),
        F.round(F.col("l_discount") * 100).cast("long").alias("failure"), "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus",
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters sampled each hour (name, hour, day, value, bad): the running count of a day of each event type; it starts again every day."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.floor(micros("ts") / 3_600_000_000).alias("hour"), props_k().alias("k"))
    per = e.groupBy("name", "hour").agg(F.count(F.lit(1)).alias("value"), F.count_if(F.col("k") < 10).alias("bad")).withColumn("day", F.floor(F.col("hour") / 24))
    upto = samples.ledger("hour", "name", "day")
    return per.withColumns({c: F.sum(c).over(upto) for c in ("value", "bad")})


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.increments(hourly(spark, sf_dir), ("name",), "hour", "value", "bad").withColumnRenamed("value", "inc")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.increase(deltas(spark, sf_dir), ("name", "day"), "inc", "bad")


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenarios with slices, endpoint, repeat, strategy, steps and the plan's fingerprint."""
    rows = planning.counted(scenarios(spark, sf_dir))
    step = F.struct(F.lit(None).cast("string").alias("endpoint"), F.lit("demo.Echo").alias("service"), F.lit("Get").alias("method"), F.lit(None).cast("string").alias("request"), F.create_map(F.lit("id"), F.lit("item.id"), F.lit("at"), F.lit("item.at")).alias("extract"), F.lit(None).cast("string").alias("payload_key"))
    rows = rows.withColumns({"endpoint": F.lit("http://target:50051"), "every_ms": F.when(F.col("concurrency") % 2 == 0, F.lit(60_000)), "strategy": F.lit("ExecutionKey"), "step": step})
    rows = rows.withColumn("steps", F.array(planning.step_material()))
    semantics = planning.fingerprint(planning.semantics_material(F.lit(5000), F.lit(None), F.lit(None).cast("string"), "0.2.0"))
    return rows.withColumn("fingerprint", planning.fingerprint(planning.plan_material(F.lit(0), F.lit(2), semantics)))
