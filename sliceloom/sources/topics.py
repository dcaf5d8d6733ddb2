"""Topics as sources and sinks: jobs, results, summaries and dead letters, decoded, checked and keyed.

A record has key, value (text or bytes), topic, partition, offset as Spark's Kafka source gives them; files and
memory tables of that shape serve as well, which is how the tests run without a broker. Offsets belong to the
query's checkpoint: they are committed after a batch's output, and a restarted query goes on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import contracts as K
from .readers import too_large

JOB = (
    "schema_version int, scenario_id string, run_id string, execution_key string, plan_fingerprint string, scheduled_at_unix_ms long, not_before_unix_ms long, slice struct<index: int, total: int>, "
    "load struct<scenarios_per_sec: double, duration: struct<secs: bigint, nanos: int>, max_concurrency: int, startup_burst: int>, attempt int, max_retries int"
)
RESULT = (
    "schema_version int, scenario_id string, run_id string, execution_key string, event_id string, attempt int, slice struct<index: int, total: int>, started_at_unix_ms long, finished_at_unix_ms long, status string, "
    "total long, success long, failure long, scenario_latency_p50_ms long, scenario_latency_p95_ms long, scenario_latency_p99_ms long, latency_histogram array<struct<upper_bound_ms: decimal(20,0), count: bigint>>, "
    "error_breakdown array<struct<kind: string, count: bigint>>"
)
RECORD_BYTES = 1 << 20


def kafka_options(servers: str, topic: str, group: str, limit: int | None = None, starting: str = "earliest") -> dict[str, str]:
    """Options of Spark's Kafka source: every topic is read by a query, and so a group, of its own."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "kafka.group.id": group, "failOnDataLoss": "true"}
    return options | ({"maxOffsetsPerTrigger": str(limit)} if limit else {})


def kafka_stream(spark: SparkSession, servers: str, topic: str, group: str, limit: int | None = None) -> DataFrame:
    """Records of a topic as a stream; ``limit`` holds back what a micro-batch takes."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, group, limit)).load()


def kafka_table(spark: SparkSession, servers: str, topic: str, ends: str = "latest") -> DataFrame:
    """Records of a topic up to now, as a table: what a replay of dead letters scans."""
    return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("endingOffsets", ends).load()


def _decoded(records: DataFrame, schema: str, limit: int) -> DataFrame:
    text = F.col("value").cast("string")
    parsed = F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = records.withColumn("record", F.when(~too_large(limit), parsed))
    return rows.withColumn("malformed", F.when(too_large(limit), "TooLarge").when(F.col("record").isNull() | F.col("record._bad").isNotNull(), "Malformed"))


def _checked(rows: DataFrame, fields: dict[str, Column], fault: Column) -> DataFrame:
    """``fault`` speaks of columns of its own: they stand beside the record's for as long as it takes to evaluate it."""
    keep = rows.columns
    packed = rows.select(F.struct("*").alias("_row"), *(c.alias(n) for n, c in fields.items()))
    return packed.select(*(F.col(f"_row.{c}").alias(c) for c in keep), F.coalesce("_row.malformed", fault).alias("fault")).drop("malformed")


def _job_fields(r: str = "record") -> dict[str, Column]:
    ms = F.col(f"{r}.load.duration.secs") * 1000 + F.floor(F.coalesce(F.col(f"{r}.load.duration.nanos"), F.lit(0)) / 1_000_000)
    load = F.struct(F.col(f"{r}.load.scenarios_per_sec").alias("scenarios_per_sec"), ms.alias("duration_ms"), F.col(f"{r}.load.max_concurrency").alias("max_concurrency"), F.col(f"{r}.load.startup_burst").alias("startup_burst"))
    same = ("schema_version", "scenario_id", "run_id", "execution_key", "plan_fingerprint", "slice")
    return {n: F.col(f"{r}.{n}") for n in same} | {"load": load, "not_before_ms": F.col(f"{r}.not_before_unix_ms"), "attempt": F.coalesce(f"{r}.attempt", F.lit(0)), "max_retries": F.coalesce(f"{r}.max_retries", F.lit(0))}


def _result_fields(r: str = "record") -> dict[str, Column]:
    same = ("schema_version", "scenario_id", "run_id", "execution_key", "event_id", "slice", "total", "success", "failure", "latency_histogram", "error_breakdown")
    return {n: F.col(f"{r}.{n}") for n in same} | {"attempt": F.coalesce(f"{r}.attempt", F.lit(0)), "started_ms": F.col(f"{r}.started_at_unix_ms"), "finished_ms": F.col(f"{r}.finished_at_unix_ms")}


def jobs(records: DataFrame, limit: int = RECORD_BYTES) -> DataFrame:
    """Records with the job in ``record`` and its first ``fault``: TooLarge, Malformed or one of the contract's."""
    return _checked(_decoded(records, JOB, limit), _job_fields(), K.job_fault())


def results(records: DataFrame, limit: int = RECORD_BYTES) -> DataFrame:
    return _checked(_decoded(records, RESULT, limit), _result_fields(), K.result_fault())


def dead_letters(records: DataFrame, scan: int, limit: int = RECORD_BYTES) -> DataFrame:
    """The first ``scan`` (1 to 10,000) records of a dead-letter topic in (partition, offset) order, classed and checked; one that is too large is a fault."""
    if not 1 <= scan <= 10_000:
        raise ValueError("a scan sees 1 to 10000 records")
    rows = records.withColumnsRenamed({"partition": "source_partition", "offset": "source_offset"}).withColumn("value", F.col("value").cast("string"))
    rows = K.letters(K.scanned(rows, scan))
    return rows.withColumn("fault", F.coalesce(F.when(too_large(limit), "TooLarge"), "fault"))


def poison_records(faulty: DataFrame, failed_at_ms: Column, version: int = 2) -> DataFrame:
    """The poison record of each record with a fault: identity by its coordinates, bounded evidence of key and value, a bounded reason."""
    rows = faulty.withColumns({"_key": C.evidence(F.col("key")), "_value": C.evidence(F.col("value"))})
    evidence = [x for field, of in (("source_key", "_key"), ("payload", "_value")) for x in (F.col(f"{of}.base64").alias(f"{field}_base64"), F.col(f"{of}.original_bytes").alias(f"{field}_original_bytes"), F.coalesce(f"{of}.truncated", F.lit(False)).alias(f"{field}_truncated"))]
    return rows.select(
        F.lit(version).alias("schema_version"), C.poison_event(F.col("topic"), F.col("partition"), F.col("offset")).alias("event_id"), failed_at_ms.alias("failed_at_unix_ms"), F.col("topic").alias("source_topic"),
        F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), *evidence, C.utf8_cut(F.col("fault")).alias("reason"),
    )


def _outgoing(rows: DataFrame, fault: Column, key: Column) -> DataFrame:
    """key and value of outgoing records; one with a fault ends the query, as nothing invalid may be sent."""
    sound = F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("refusing to send an invalid record: "), fault)).cast("boolean"))
    return rows.where(sound).select(key.cast("string").alias("key"), F.to_json(F.col("record")).alias("value"))


def _whole(records: DataFrame) -> DataFrame:
    return records.select(F.struct("*").alias("record"), F.lit(None).cast("string").alias("malformed"))


def outgoing_jobs(records: DataFrame, by: str = "execution_key") -> DataFrame:
    """Jobs (columns of JOB), checked, keyed by scenario_id or execution_key."""
    rows = _checked(_whole(records), _job_fields(), K.job_fault())
    return _outgoing(rows, F.col("fault"), C.partition_key(F.lit(by), F.col("record.scenario_id"), F.col("record.execution_key")))


def outgoing_results(records: DataFrame) -> DataFrame:
    """Results (columns of RESULT), checked, keyed by execution_key."""
    return _outgoing(_checked(_whole(records), _result_fields(), K.result_fault()), F.col("fault"), F.col("record.execution_key"))


def outgoing_summaries(log: DataFrame) -> DataFrame:
    """Summary revisions keyed by run, so that a run's revisions stay in order; each has its deterministic event_id."""
    own = C.summary_event(F.col("record.run_id"), F.col("record.revision"), F.col("record.status"))
    return _outgoing(_whole(log), C.first_of(("event_id", F.col("record.event_id") != own)), F.col("record.run_id"))


def outgoing_failed(jobs_: DataFrame, key: str = "execution_key") -> DataFrame:
    """Failed jobs with a bounded reason; the key has to be the execution_key."""
    rows = _whole(jobs_.withColumn("reason", C.utf8_cut(F.col("reason"))))
    fault = F.coalesce(K.failed_fault("record"), C.first_of(("key", ~F.col(f"record.{key}").eqNullSafe(F.col("record.execution_key")))))
    return _outgoing(rows, fault, F.col(f"record.{key}"))


def outgoing_poison(records: DataFrame) -> DataFrame:
    """Poison records keyed by event_id, with identity and evidence checked."""
    return _outgoing(_whole(records), K.poison_fault("record"), F.col("record.event_id"))


def send(rows: DataFrame, path: str) -> None:
    """Append key and value as JSON lines; a key's records are in one file, in the order that they had."""
    rows.repartition("key").write.mode("append").json(path)


def kafka_send(rows: DataFrame, servers: str, topic: str) -> None:
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("topic", topic).save()
