"""Validation, deduplication and dead letters. Records are made from ``orders``, ``events`` and ``lineitem``, some of them bad in one way or another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import contracts as K
from ..operators import planning as P
from ..operators import reconcile as R
from .tables import deliveries, millis, table

ORDER = ("at_us", "l_partkey", "l_suppkey", "total", "failure", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus")
TOPIC = "dlq"


def _every(key: Column, n: int) -> Column:
    return key % n == 0


def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    version = F.when(_every(k, 41), 3).when(_every(k, 43), 0).otherwise(1 + k % 2)
    load = F.struct(
        F.when(_every(k, 17), float("nan")).when(_every(k, 19), 0.0).otherwise((k % 500).cast("double") + 0.5).alias("scenarios_per_sec"), F.when(_every(k, 23), 0).otherwise(k % 90 * 1000 + 1000).alias("duration_ms"),
        F.when(_every(k, 29), 0).otherwise(k % 60 + 1).cast("int").alias("max_concurrency"), (k % 8).cast("int").alias("startup_burst"),
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
    ).select(
        "id", version.alias("schema_version"), C.joined("s", k % 7).alias("scenario_id"), F.when(_every(k, 37), " 　\t").otherwise(C.joined("run-", k)).alias("run_id"),
        F.when(_every(k, 47), F.repeat(F.lit("é"), 600)).otherwise(C.joined("run-", k, ":slice")).alias("execution_key"), F.when(_every(k, 11), "").otherwise("fnv128:0").alias("plan_fingerprint"),
        F.struct((k % 9).cast("int").alias("index"), F.when(_every(k, 31), 5000).otherwise(8 + k % 3).cast("int").alias("total")).alias("slice"), load.alias("load"),
        (k % 4).cast("int").alias("attempt"), F.when(_every(k, 53), 40).otherwise(2).alias("max_retries"), F.when(_every(k, 5), 0).otherwise(k).cast("long").alias("not_before_ms"),
    )


def invalid_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_records(spark, sf_dir).select("id", K.job_fault().alias("reason")).where("reason IS NOT NULL")


def job_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_records(spark, sf_dir).select("id", K.limits_fault(80_000, 450.0, 55).alias("reason"))


def result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") % 1000).alias("success"), (F.col("o_custkey") % 10).alias("failure"), millis("o_orderdate").alias("started_ms"),
    )
    base = base.withColumns({
        "schema_version": F.when(_every(k, 41), 3).when(_every(k, 43), 0).otherwise(1 + k % 2), "scenario_id": C.joined("s", k % 7), "run_id": F.when(_every(k, 37), " \t").otherwise(C.joined("run-", k)),
        "execution_key": C.joined("run-", k, ":slice"), "attempt": k % 35, "slice": F.struct((k % 9).alias("index"), F.when(_every(k, 31), 5000).otherwise(8 + k % 3).alias("total")),
        "total": F.col("success") + F.col("failure") + F.when(_every(k, 29), 1).otherwise(0), "finished_ms": F.col("started_ms") + F.when(_every(k, 19), -5).otherwise(5),
    })
    event = F.when(_every(k, 17), "other").otherwise(C.terminal_event(F.col("execution_key"), F.col("attempt"), "result"))
    bucket = lambda bound, n: F.struct(F.lit(str(bound)).cast("decimal(20,0)").alias("upper_bound_ms"), n.cast("long").alias("count"))
    rest = F.col("total") - F.col("success") + F.when(_every(k, 11), 1).otherwise(0)
    histogram = F.when(_every(k, 47), F.array().cast("array<struct<upper_bound_ms:decimal(20,0),count:bigint>>")).when(_every(k, 13), F.array(bucket(100, F.col("success")), bucket(10, rest))).otherwise(F.array(bucket(10, F.col("success")), bucket(2**64 - 1, rest)))
    half = F.floor(F.col("failure") / 2)
    kind = lambda name, n: F.struct(name.alias("kind"), n.cast("long").alias("count"))
    errors = F.array(kind(F.lit("target_timeout"), half), kind(F.when(_every(k, 53), "target_timeout").otherwise("target_transport"), F.col("failure") - half - F.when(_every(k, 23), 1).otherwise(0)))
    return base.withColumns({"event_id": event, "latency_histogram": histogram, "error_breakdown": errors})


def invalid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_records(spark, sf_dir).select("id", K.result_fault().alias("reason")).where("reason IS NOT NULL")


def result_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.routed(result_records(spark, sf_dir), K.result_fault())
    return rows.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason"), "route").agg(F.count(F.lit(1)).alias("n"))


def histogram_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_records(spark, sf_dir).select("id", K.histogram_fault().alias("reason"))


def failure_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured error kinds of a job, and what becomes of it."""
    k = F.col("event_id")
    labels = [("invariant_violation", 31), ("infrastructure", 7), ("permanent_processing", 11), ("missing_context_var", 13), ("target_timeout", 3)]
    kinds = F.map_filter(F.create_map(*(x for name, n in labels for x in (F.lit(name), F.when(_every(k, n), 1).otherwise(0)))), lambda _, n: n > 0)
    return table(spark, sf_dir, "events").select("event_id", C.disposition(kinds, k % 4, F.lit(2)).alias("disposition"))


def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, C.ERROR_LABELS))
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(names, (k % len(C.ERROR_LABELS) + 1).cast("int")).alias("variant"), F.when(k % 2 == 0, "Unavailable").otherwise("NotFound").alias("code"))
    return rows.select("event_id", C.error_label(F.col("variant"), F.col("code")).alias("kind"), C.measures_target(F.col("variant")).alias("is_target"))


def result_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = F.col("l_quantity").cast("long"), F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(C.result_status(q, q - F.when(_every(k, 9), 1).otherwise(0), k % 4).alias("status"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def endpoint_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    host = F.when(k % 4 == 0, "LocalHost").when(k % 4 == 1, "target.example").when(k % 4 == 2, "eviltarget.example").otherwise("[::1]")
    endpoint = F.when(_every(k, 13), "not an endpoint").otherwise(C.joined("http://", host, ":", 50_000 + k, "/"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.host_allowed(endpoint, ["localhost", "Target.Example"]).alias("allowed"))


# deliveries of results


def _firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each (run, slice) the first delivery, how many agree with it, and how many there are; equal totals are counted before the shuffle."""
    per = deliveries(spark, sf_dir).groupBy("run", "slice_index", F.col("total").alias("_total")).agg(F.min(F.struct(*ORDER)).alias("first"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("run", "slice_index").agg(F.min(F.struct("first", "n")).alias("f"), F.sum("n").alias("n"))


def dedupe_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = deliveries(spark, sf_dir).groupBy("run", "slice_index").agg(F.min(F.struct(*ORDER)).alias("f"))
    return first.select("run", "slice_index", "f.l_partkey", "f.l_suppkey", "f.total", "f.failure", "f.at_us")


def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _firsts(spark, sf_dir).select("run", "n", (F.col("f.n") - 1).alias("same"), (F.col("n") - F.col("f.n")).alias("other"))
    return per.groupBy("run").agg(F.sum("n").alias("physical"), F.count(F.lit(1)).alias("logical"), F.sum("same").alias("duplicates"), F.sum("other").alias("conflicts"))


def conflicting_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only slices that have a conflict are numbered."""
    odd = _firsts(spark, sf_dir).where("f.n < n").select("run", "slice_index", F.col("f.first.total").alias("first_total"))
    rows = R.numbered(deliveries(spark, sf_dir).join(odd, ["run", "slice_index"]), ("run", "slice_index"), ORDER, "delivery")
    return rows.where("delivery > 1 AND total <> first_total").select("run", "slice_index", "delivery", "total", "first_total")


def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return dedupe_results(spark, sf_dir).groupBy("run").agg(n.alias("received"), F.sum("total").alias("total"), F.sum("failure").alias("failure"), (7 - n).alias("missing"))


def logical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical copies by identity, and identities that were used again for another payload."""
    rows = deliveries(spark, sf_dir).withColumn("event_id", C.joined(F.col("run"), ":", F.col("slice_index")))
    return R.logical(rows, "event_id", F.to_json(F.struct("total", "failure")))


# dead letters


def letter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as records of a dead-letter topic: failed jobs, poison, both or neither, some with a bad field."""
    k = F.col("source_offset")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("source_offset"), (F.col("user_id") % 4).cast("int").alias("source_partition"), "event_type", "user_id", millis("ts").alias("at"), F.get_json_object("props", "$.k").cast("long").alias("p"))
    reason = F.when(F.col("p") % 7 == 0, "target_timeout: deadline").when(F.col("p") % 7 == 1, C.joined("Unavailable peer ", F.col("user_id") % 90)).when(F.col("p") % 7 == 2, "unknown scenario").otherwise(C.joined("decode failed at ", F.col("user_id") % 30))
    e = e.withColumn("reason", F.when(_every(k, 41), " ").otherwise(reason)).withColumn("attempt", (k % 3).cast("int"))
    failed, poison = k % 11 <= 5, (k % 11).between(6, 8)
    both = k % 11 == 10
    key = C.joined("exec-", k)
    own = lambda c, v: F.when(c, v)  # noqa: E731 - a null field is left out of the JSON
    value = F.to_json(F.struct(
        F.lit(2).alias("schema_version"), F.when(_every(k, 29), "x").when(poison, C.poison_event(TOPIC, F.col("source_partition"), k)).otherwise(C.terminal_event(key, F.col("attempt"), "dlq")).alias("event_id"),
        own(failed | both, F.col("event_type")).alias("scenario_id"), own(failed, C.joined("run-", F.floor(k / 4))).alias("run_id"), own(failed, key).alias("execution_key"),
        own(failed, F.struct((k % 4).cast("int").alias("index"), F.when(_every(k, 31), 0).otherwise(4).alias("total"))).alias("slice"), F.col("at").alias("failed_at_unix_ms"),
        own(failed, F.col("attempt")).alias("attempt"), own(failed, F.when(_every(k, 37), 0).otherwise(2)).alias("max_retries"), F.col("reason"),
        own(poison | both, F.lit(TOPIC)).alias("source_topic"), own(poison, F.when(_every(k, 43), -1).otherwise(F.col("source_partition"))).alias("source_partition"), own(poison, k).alias("source_offset"),
        own(poison, C.base64_text(F.col("reason"))).alias("payload_base64"), own(poison, F.octet_length("reason") + F.when(_every(k, 19), 1).otherwise(0)).alias("payload_original_bytes"), own(poison, F.lit(False)).alias("payload_truncated"),
        own(_every(k, 97), F.lit(1)).alias("surplus"),
    ))
    return e.select("source_partition", "source_offset", F.lit(TOPIC).alias("topic"), F.when(_every(k, 101), "[1]").otherwise(value).alias("value"))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.letters(letter_records(spark, sf_dir))
    return rows.withColumns({"scenario_id": F.col("failed.scenario_id"), "reason": F.coalesce("failed.reason", "poison.reason"), "failed_at_ms": F.col("failed.failed_at_unix_ms")})


def dlq_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class by the keys of the JSON, and the first fault of each letter."""
    return _letters(spark, sf_dir).select("source_offset", "class", "fault")


def dlq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = K.chosen(("click", "error"), 1704500000000, 1705900000000, "UNAVAILABLE")
    return _letters(spark, sf_dir).where(F.col("class") == "failed_job").where(wanted).select("source_offset", "scenario_id", "reason")


def dlq_reason_top64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bounded_reasons(_letters(spark, sf_dir).where("fault IS NULL"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known scenarios: all but error."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("scenario_id")).distinct().where("scenario_id <> 'error'")
    return names.withColumns({"rate": F.lit(5.0), "duration_ms": F.lit(1000), "concurrency": F.lit(4), "burst": F.lit(0), "plan_fingerprint": F.lit("fnv128:0")})


def dlq_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.counters(_letters(spark, sf_dir).withColumn("scenario_id", F.coalesce("scenario_id", F.lit("none"))), _plan(spark, sf_dir))


def dlq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with a limit, which is the feature: classes among the first 500 records seen."""
    return K.letters(K.scanned(letter_records(spark, sf_dir), 500)).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def dlq_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with a fault end their partition's replay, poison is passed over."""
    rows = _letters(spark, sf_dir).join(_plan(spark, sf_dir).select(F.col("scenario_id").alias("known")), F.col("scenario_id") == F.col("known"), "left")
    rows = rows.withColumn("fault", F.coalesce("fault", F.when((F.col("class") == "failed_job") & F.col("known").isNull(), "unknown scenario")))
    jobs = K.before_first_fault(rows).where(F.col("class") == "failed_job").withColumns({"execution_key": F.col("failed.execution_key"), "event_id": F.col("failed.event_id"), "attempt": F.col("failed.attempt")})
    out = P.replay_jobs(jobs.select("topic", "source_partition", "source_offset", "scenario_id", "execution_key", "event_id", "attempt", "failed_at_ms"), _plan(spark, sf_dir))
    return out.select("scenario_id", F.regexp_extract("run_id", "^(.*):e[0-9a-f]{32}$", 1).alias("run"), F.col("execution_key").endswith(":slice-0-of-1").alias("one_slice"), "scheduled_at_ms", "rate", "attempt", "max_retries")


def poison_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a poison letter of each comment would keep of it: identity and bounded evidence."""
    kept = C.evidence(F.col("text"), 3000)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("offset"), "text").select("offset", C.poison_event("docs", F.col("offset") % 4, F.col("offset")).alias("event_id"), kept.alias("e"))
    return rows.select("offset", "event_id", F.md5("e.base64").alias("base64_md5"), F.col("e.original_bytes").alias("original_bytes"), F.col("e.truncated").alias("truncated"))


QUERIES = {
    f.__name__: f
    for f in (
        invalid_jobs, job_limits, invalid_results, result_routing, histogram_faults, failure_routing, error_classify, result_statuses, endpoint_allowlist, dedupe_results, duplicate_counts, conflicting_results,
        merged_runs, logical_records, dlq_classify, dlq_filter, dlq_reason_top64, dlq_counters, dlq_scan, dlq_replay, poison_identity,
    )
}
