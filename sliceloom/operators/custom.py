"""Queries that need a function or state that built-in expressions have not."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import protobuf, scalars
from ..functions import columns as C
from ..streaming import leases
from ..streaming import runs as stream

MESSAGE = {"id": {"number": 1, "kind": "uint64"}, "name": {"number": 2, "kind": "string"}, "tags": {"number": 3, "kind": "sint32", "repeated": True}}
END_MS = 4_000_000_000_000
PARTIAL_MS = 400 * 86_400_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fnv_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.concat(F.lit("fnv128:"), scalars.fnv128_udf(F.concat_ws("|", "c_name", "c_mktsegment"))).alias("fingerprint"))


def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    context = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    template = F.when(F.col("c_custkey") % 5 == 0, '{"to": "${ctx.absent}"}').otherwise('{"to": "${ctx.name}", "via": ["${ ctx.segment }", 1, null]}')
    return c.select("c_custkey", scalars.render_udf(template, context).alias("rendered"))


def retry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay = scalars.retry_delay_udf(F.col("c_name"), F.col("c_custkey") % 20, F.lit(500), F.lit(60_000))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.round(delay * 1000).cast("long").alias("delay_us"))


def protobuf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wire form of a message, and what it reads back as."""

    @F.pandas_udf("wire string, message string")
    def there_and_back(i: pd.Series, name: pd.Series) -> pd.DataFrame:
        wires = [protobuf.encode({"id": a, "name": b, "tags": [a, -a]}, MESSAGE) for a, b in zip(i, name, strict=True)]
        return pd.DataFrame({"wire": [w.hex().upper() for w in wires], "message": [json.dumps(protobuf.decode(w, MESSAGE), separators=(",", ":"), sort_keys=True) for w in wires]})

    return _table(spark, sf_dir, "customer").select("c_custkey", there_and_back("c_custkey", "c_name").alias("m")).select("c_custkey", "m.*")


def plan_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the plan are of one form and differ where plans do."""
    from ..plans.tables import plans

    p = plans(spark, sf_dir)
    same = p.groupBy("fingerprint").agg(F.count_distinct("rate", "duration_ms", "concurrency", "slices", "every_ms").alias("plans"))
    return p.join(same, "fingerprint").select("scenario_id", F.col("fingerprint").rlike("^fnv128:[0-9a-f]{32}$").alias("formed"), (F.col("plans") <= 1).alias("own"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a delivery is made of, in few columns."""
    total, failure = F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 10).cast("long")
    at_ms = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1000).cast("long")
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", at_ms.alias("at_ms"), (F.col("l_linenumber") - 1).cast("int").alias("slice_index"), (F.col("l_partkey") % 20 == 0).alias("other"), total.alias("total"), (total - failure).alias("success"), failure.alias("failure"),
    )


def _delivered(lines: DataFrame) -> DataFrame:
    run, total, failure = F.col("l_orderkey").cast("string"), F.col("total"), F.col("failure")
    key = F.concat(run, F.lit(":"), F.col("slice_index").cast("string"), F.when(F.col("other"), ":other").otherwise(""))
    half = F.floor(total / 2)
    bounds = F.array(*(F.lit(str(b)).cast("decimal(20,0)") for b in (10, 50, 2**64 - 1)))
    errors = F.when(failure > 0, F.create_map(F.lit("target_timeout"), failure)).otherwise(F.create_map().cast("map<string,long>"))
    null = F.lit(None)
    return lines.select(
        run.alias("run_id"), F.lit("result").alias("kind"), C.joined("s", F.col("l_orderkey") % 5).alias("scenario_id"), F.lit(2).alias("schema_version"), "slice_index", F.lit(7).alias("slices"), key.alias("execution_key"),
        "total", "success", "failure", bounds.alias("bounds"), F.array(half, total - half - F.floor(total / 40), F.floor(total / 40)).alias("counts"), errors.alias("errors"),
        null.cast("int").alias("revision"), null.cast("long").alias("load_ms"), "at_ms",
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as deliveries of slice results, with histograms and error kinds: an order is a run of 7 slices."""
    return _delivered(_lines(spark, sf_dir))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are dealt and sorted while they are narrow; of one slice the plain key comes before the other."""
    lines = _lines(spark, sf_dir).repartition("l_orderkey").sortWithinPartitions("l_orderkey", "at_ms", "slice_index", "other", "total", "success")
    return stream.replayed(_delivered(lines), PARTIAL_MS, END_MS, dealt=True)


def stream_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's last summary revision, from the state machine that the stream runs."""
    log = _log(spark, sf_dir).where(~F.col("outcome").isin(*stream.REFUSED))
    last = log.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "run_id"]), "revision").alias("s")).select("run_id", "s.*")
    return last.select("run_id", "event_id", "scenario_id", "revision", "status", "received", "missing", "total", "success", "failure", "p50_ms", "p95_ms", "p99_ms", "histogram", "errors", "first_ms", "last_ms")


def stream_poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that were refused, by run."""
    return stream.poison(_log(spark, sf_dir)).groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


def summary_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A publishing cycle: the oldest 200 pending summaries, which is the feature, when every third order has acknowledged its first revision."""
    acks = _table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("run_id"), F.lit(1).alias("revision"))
    return stream.pending(_log(spark, sf_dir), acks, 200).select("run_id", "event_id", "revision")


def lease_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as operations of three owners on its lease."""
    op = F.element_at(F.array(*map(F.lit, ("claim", "claim", "renew", "complete", "claim", "release", "claim"))), F.col("l_linenumber"))
    at = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    log = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), op.alias("op"), C.joined("w", F.col("l_suppkey") % 3).alias("owner"), at.alias("at_ms"), F.lit(30 * 86_400_000).cast("long").alias("lease_ms"))
    return leases.outcomes(log)


QUERIES = {f.__name__: f for f in (fnv_fingerprint, template_render, retry_delay, protobuf_roundtrip, plan_fingerprints, stream_run_summary, stream_poison, summary_outbox, lease_outcomes)}
