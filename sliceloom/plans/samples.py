"""Metric-sample, gate, trend and scalar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import samples as S
from .tables import daily, deltas, hourly, table

BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1_000_000)


def counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select("name", "day", F.col("inc").alias("increase"))


def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select("name", "day", (F.col("inc").cast("double") / 86400).alias("per_second"))


def increase_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.or_zero(daily(spark, sf_dir), F.col("name") == "absent", "inc").withColumnRenamed("inc", "increase")


def sum_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).groupBy("name").agg(F.sum("inc").alias("total"))


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.greatest("value", F.lit(0.0)).alias("s"))


def hq_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interpolated(_seconds(spark, sf_dir), "name", F.col("s"), BOUNDS, {"p95": 0.95, "p50": 0.5})


def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts' form, clamped, and the gate's, NaN (here null) where nothing was counted."""
    free = S.ratio(F.col("bad"), F.col("inc"))
    return daily(spark, sf_dir).select("name", "day", S.ratio(F.col("bad"), F.col("inc"), clamp=1).alias("ratio"), F.when(~F.isnan(free), free).alias("exact"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantiles = S.interpolated(_seconds(spark, sf_dir), "name", F.col("s"), BOUNDS, {"p95_s": 0.95, "p99_s": 0.99})
    rates = daily(spark, sf_dir).groupBy("name").agg((F.sum(F.col("inc") - F.col("bad")).cast("double") / 86400).alias("success_rate"), (F.sum("bad").cast("double") / 86400).alias("failure_rate"))
    return rates.join(quantiles, "name")


def _limits(spark: SparkSession) -> DataFrame:
    rows = [("click", 0.01, 200.0, 500.0, 0.05), ("error", 0.001, 1.0, 500.0, 0.2), ("view", 0.001, 1e6, 1e6, 1.0), ("none", 1.0, 1.0, 1.0, 0.1)]
    return spark.createDataFrame(rows, "name string, throughput_floor double, p95_max_s double, p99_max_s double, error_rate_max double")


def slo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gate(_metrics(spark, sf_dir), _limits(spark), "name").select("name", "reasons", "status")


def slis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success ratio, p95 and error share of each scenario."""
    m = _metrics(spark, sf_dir)
    total = F.col("success_rate") + F.col("failure_rate")
    return m.select("name", S.ratio(F.col("success_rate"), total).alias("success_ratio"), "p95_s", S.ratio(F.col("failure_rate"), total).alias("error_rate"))


def pass_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metrics(spark, sf_dir).join(_limits(spark), "name")
    total = F.col("success_rate") + F.col("failure_rate")
    return rows.select("name", S.passed(F.col("success_rate") >= F.col("throughput_floor"), F.col("p95_s") <= F.col("p95_max_s"), F.col("p99_s") <= F.col("p99_max_s"), F.col("failure_rate") / total <= F.col("error_rate_max")).alias("pass"))


def gate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = daily(spark, sf_dir).select("day", F.when(S.ratio(F.col("bad"), F.col("inc"), clamp=1) <= 0.15, "PASS").otherwise("FAIL").alias("status"))
    return S.rollup(gates, "day")


def alert_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition that has held for three evaluations in a row."""
    return S.held(deltas(spark, sf_dir), ("name",), "hour", S.ratio(F.col("bad"), F.col("inc"), clamp=1) > 0.12, 3).select("name", "hour")


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over hours of the events as minutes of evaluation."""
    d = deltas(spark, sf_dir).groupBy(F.col("hour").alias("minute")).agg(F.sum("inc").alias("inc"), F.sum("bad").alias("bad"))
    m = F.col("minute")
    ratio = S.ratio(F.col("bad"), F.col("inc"), clamp=1)
    rows = d.select(
        "minute", F.when(m % 24 < 6, 0).otherwise(1).alias("leaders"), (ratio / 5).alias("failure_ratio"), F.when(m % 48 < 20, 2.0).otherwise(0.5).alias("p95_s"), (ratio / 20).alias("consume_error_ratio"), F.when(m % 30 < 9, 0.1).otherwise(0.0).alias("dlq_rate"),
        F.lit(0.0).alias("dlq_failure_rate"), F.when(m % 10 < 4, 1.0).otherwise(0.0).alias("result_failure_rate"), F.when(m % 10 < 3, 1.0).otherwise(0.0).alias("commit_failure_rate"), (m % 7).alias("uncommitted_jobs"), (m % 3).alias("incomplete_dispatch_slices"),
        F.lit(None).cast("double").alias("summary_failure_rate"), F.when(m % 20 < 8, 1.0).otherwise(0.0).alias("aggregate_timeout_rate"),
    )
    return S.firing(rows)


def max_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders seen by day: a day whose highest gauge is below 1 has none."""
    gauges = hourly(spark, sf_dir).select("day", (F.col("hour") % 25 == 3).cast("int").alias("leader"))
    return gauges.groupBy("day").agg(F.max("leader").alias("top")).where("top < 1")


def cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's sum is cut to a whole number before the nodes are added."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 3).alias("node"), F.floor(F.col("value") * 4).alias("quarters"))
    return S.cluster_totals(rows.select("name", "node", (F.col("quarters") / 4).alias("value")), "name")


def trend_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = daily(spark, sf_dir).select("name", "day", S.ratio(F.col("bad"), F.col("inc"), clamp=1).alias("rate"))
    return S.trend(points, "name", ("day",), "rate")


def last_n_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each scenario's last 40 days, which is the feature."""
    return S.last_points(daily(spark, sf_dir), "name", ("day",)).select("name", "day", "inc")


def last_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = daily(spark, sf_dir).select("name", "day", F.when(F.col("day") % 4 == 0, F.col("inc")).alias("threshold"))
    return S.last_value(points, "name", "day", "threshold")


def mixed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of evidence class live, synthetic or none, by the events' JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", F.when(k % 3 == 0, "live").when(k % 3 == 1, "synthetic").alias("evidence_class"))
    return S.mixed_classes(rows, "user_id").select("user_id", F.array_join("classes", ",").alias("classes"))


def history_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as history records with their lines as scenarios: of each name the first entry counts."""
    item = F.struct(F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("name"), F.when(F.col("l_partkey") % 3 > 0, F.when(F.col("l_partkey") % 3 == 1, "PASS").otherwise("FAIL")).alias("status"), F.struct(F.col("l_quantity").alias("success_rate")).alias("metrics"), F.struct(F.col("l_tax").alias("throughput_floor")).alias("thresholds"))
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("i")))), lambda x: x["i"]).alias("scenarios"))
    summary = F.struct(F.when(F.col("l_orderkey") % 2 == 0, "live").alias("evidence_class"), F.when(F.col("l_orderkey") % 5 == 0, "PASS").alias("status"))
    history = lines.select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"), F.col("l_orderkey").cast("string").alias("timestamp_utc"), summary.alias("summary"), "scenarios")
    return S.history_entries(history).select("run_id", "name", "evidence_class", "status", F.col("metrics.success_rate").alias("success_rate"))


def post_fault_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors before and after the fault, day 19730."""
    return S.progress(daily(spark, sf_dir), "name", F.lit(19730), "day", "bad")


def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    unit = F.when(k % 5 == 0, "s").when(k % 5 == 1, "m").when(k % 5 == 2, "h").when(k % 5 == 3, "d").otherwise("")
    n = F.when(k % 11 == 0, "9223372036854775807").when(k % 13 == 0, "18446744073709551615").otherwise((k % 90).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.duration_ms(F.concat(F.lit(" "), n, unit)).alias("ms"))


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 10 == 0, " -/- ").otherwise(F.concat(F.lit("("), "c_name", F.lit(" / "), "c_mktsegment", F.lit(") ")))
    return table(spark, sf_dir, "customer").select("c_custkey", C.slugify(name).alias("slug"))


def base64url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL-safe without padding, and standard text decoded again, which fails for what is not base64."""
    standard = F.when(F.col("c_custkey") % 4 == 0, F.concat(C.base64_text(F.col("c_name")), F.lit("!"))).otherwise(C.base64_text(F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", C.base64_url(F.concat("c_name", F.lit("?>"))).alias("url"), C.from_base64(standard).cast("string").alias("decoded"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    t = F.when(k % 5 == 0, "NaN").when(k % 5 == 1, " 1.5e3 ").when(k % 5 == 2, "x1").when(k % 5 == 3, "").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.number(t).alias("x"), F.isnan(C.number(t, keep_nan=True)).alias("is_nan"))


def comma_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("c_mktsegment", F.lit(" ,, "), F.col("c_nationkey").cast("string"), F.lit(",\t"), F.col("c_mktsegment"), F.lit(", "), (F.col("c_custkey") % 3).cast("string"), F.lit(","))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(C.comma_list(t), "|").alias("parts"))


def utf8_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to the bytes that a reason may have, and the one-line summary of their first."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.utf8_cut(F.col("text")).cast("binary")).alias("cut_md5"), F.octet_length(C.utf8_cut(F.col("text"))).alias("bytes"), F.md5(C.one_line(F.col("text")).cast("binary")).alias("line_md5"))


def extract_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of object keys is a built-in; where arrays or JSON null matter there is the function of that name."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.absent.k").alias("none"))


QUERIES = {
    f.__name__: f
    for f in (
        counter_increase, counter_rate, increase_or_zero, sum_by_label, hq_interpolated, error_ratio, slo_gate, slis, pass_product, gate_rollup, alert_for, alert_rules, max_gauge, cluster_totals, trend_delta, last_n_points,
        last_threshold, mixed_evidence, history_entries, post_fault_progress, duration_parse, slugify, base64url, numbers, comma_lists, utf8_truncate, extract_path,
    )
}
