"""The first fault of job, result, failed-job and poison records, and where records with one go.

A job has schema_version, scenario_id, run_id, execution_key, plan_fingerprint, slice (index, total), load
(scenarios_per_sec, duration_ms, max_concurrency, startup_burst), attempt, max_retries, not_before_ms; a
result schema_version, the ids, event_id, attempt, slice, started_ms, finished_ms, total, success, failure,
latency_histogram (array of upper_bound_ms, count) and error_breakdown (array of kind, count). A null counts
as absent: as 0 or as empty, unless the field is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

col = F.col


def _version() -> list[tuple[str, Column]]:
    v = F.coalesce(col("schema_version"), F.lit(0))
    return [("UnsupportedVersion", v < C.VERSIONS[0]), ("FutureVersion", v > C.VERSIONS[1])]


def _ids(*names: str, since_2: str | None = None) -> list[tuple[str, Column]]:
    missing = [("MissingField", C.blank(col(n))) for n in names]
    if since_2:
        missing.append(("MissingField", (col("schema_version") >= 2) & C.blank(col(since_2))))
    return missing + [("FieldTooLong", F.octet_length(n) > C.ID_BYTES) for n in (*names, *([since_2] if since_2 else []))]


def _slice() -> list[tuple[str, Column]]:
    i, n = (F.coalesce(col(f"slice.{x}"), F.lit(-1)) for x in ("index", "total"))
    return [("InvalidSlice", (n < 1) | (n > C.SLICES) | (i < 0) | (i >= n))]


def job_fault() -> Column:
    load = {x: F.coalesce(col(f"load.{x}"), F.lit(0)) for x in ("scenarios_per_sec", "duration_ms", "max_concurrency", "startup_burst")}
    rate = load["scenarios_per_sec"]
    late = (col("schema_version") >= 2) & (col("attempt") > 0) & (F.coalesce(col("not_before_ms"), F.lit(0)) == 0)
    return C.first_of(
        *_version(), *_ids("scenario_id", "run_id", "execution_key", since_2="plan_fingerprint"), *_slice(),
        ("InvalidLoad", F.isnan(rate) | (rate <= 0) | (rate == float("inf")) | (load["duration_ms"] <= 0) | (load["max_concurrency"] <= 0) | (load["startup_burst"] > load["max_concurrency"])),
        ("InvalidAttempt", (col("attempt") > col("max_retries")) | (col("max_retries") > C.ATTEMPTS) | late),
    )


def limits_fault(duration_ms: int, rate: float, concurrency: int) -> Column:
    """The job's own fault, or that its load is above a ceiling of this installation."""
    above = (col("load.duration_ms") > duration_ms) | (col("load.scenarios_per_sec") > rate) | (col("load.max_concurrency") > concurrency)
    return F.coalesce(job_fault(), C.first_of(("SafetyLimit", above)))


def histogram_fault(buckets: str = "latency_histogram", total: str = "total") -> Column:
    """At most 128 buckets, bounds that rise, counts that add up to the total; an empty one is allowed."""
    b = F.coalesce(col(buckets), F.array())
    falls = F.exists(F.zip_with(F.slice(b, 2, C.BUCKETS), F.slice(b, 1, C.BUCKETS), lambda after, before: F.coalesce(after["upper_bound_ms"] <= before["upper_bound_ms"], F.lit(False))), lambda x: x)
    counts = F.aggregate(b, F.lit(0).cast("decimal(38,0)"), lambda acc, x: (acc + F.coalesce(x["count"], F.lit(0))).cast("decimal(38,0)"))
    return C.first_of(("TooManyBuckets", F.size(b) > C.BUCKETS), ("BoundsNotRising", falls), ("HistogramMismatch", (F.size(b) > 0) & (counts != col(total))))


def result_fault() -> Column:
    errors = F.coalesce(col("error_breakdown"), F.array())
    counted = F.aggregate(errors, F.lit(0).cast("decimal(38,0)"), lambda acc, x: (acc + F.coalesce(x["count"], F.lit(0))).cast("decimal(38,0)"))
    kinds = F.transform(errors, lambda x: x["kind"])
    new = col("schema_version") >= 2
    own_id = C.terminal_event(col("execution_key"), col("attempt"), "result")
    inexact = F.greatest("total", "success", "failure", counted) > C.EXACT
    return F.coalesce(C.first_of(
        *_version(), *_ids("scenario_id", "run_id", "execution_key"), *_slice(),
        ("InvalidAttempt", col("attempt") > C.ATTEMPTS),
        ("MissingField", new & C.blank(col("event_id"))), ("FieldTooLong", new & (F.octet_length("event_id") > C.ID_BYTES)), ("EventIdMismatch", new & (col("event_id") != own_id)),
        ("HistogramMissing", new & (col("total") > 0) & (F.size(F.coalesce(col("latency_histogram"), F.array())) == 0)),
        ("CountMismatch", col("success").cast("decimal(38,0)") + col("failure") != col("total")),
        ("TooManyKinds", F.size(errors) > C.KINDS), ("BadKind", F.exists(kinds, lambda k: C.blank(k) | (F.octet_length(k) > C.KIND_BYTES))),
        ("DuplicateKind", F.size(F.array_distinct(kinds)) < F.size(kinds)),
        ("CountTooLarge", new & inexact),
        ("ErrorMismatch", (new & (counted != col("failure"))) | (~new & (counted > col("failure")))),
        ("CountTooLarge", new & F.exists(F.coalesce(col("latency_histogram"), F.array()), lambda b: b["count"] > C.EXACT)),
        ("TimeOrder", col("finished_ms") < col("started_ms")),
    ), histogram_fault())


def routed(records: DataFrame, fault: Column) -> DataFrame:
    """With reason (null if valid) and route: poison, or what the result's status is."""
    ok = (col("failure") == 0) & (col("total") > 0)
    return records.withColumn("reason", fault).withColumn("route", F.when(col("reason").isNotNull(), "poison").when(ok, "Success").otherwise("Failed"))


# dead letters

FAILED_MARKS = ("scenario_id", "run_id", "execution_key", "slice")
POISON_MARKS = ("source_topic", "source_partition", "source_offset")
FAILED_FIELDS = (*("schema_version", "event_id"), *FAILED_MARKS, *("failed_at_unix_ms", "attempt", "max_retries", "reason"))
POISON_FIELDS = (
    *("schema_version", "event_id", "failed_at_unix_ms"), *POISON_MARKS, *("source_key_base64", "source_key_original_bytes", "source_key_truncated"),
    *("payload_base64", "payload_original_bytes", "payload_truncated", "reason"),
)
FAILED = "schema_version int, event_id string, scenario_id string, run_id string, execution_key string, slice struct<index int, total int>, failed_at_unix_ms long, attempt int, max_retries int, reason string"
POISON = (
    "schema_version int, event_id string, failed_at_unix_ms long, source_topic string, source_partition int, source_offset long, source_key_base64 string, source_key_original_bytes long, "
    "source_key_truncated boolean, payload_base64 string, payload_original_bytes long, payload_truncated boolean, reason string"
)


def envelope(value: Column) -> Column:
    """failed_job or poison, by the keys of the JSON object; ambiguous with both kinds, unknown with neither, malformed if it is no object."""
    return _envelope(F.json_object_keys(value))


def _envelope(keys: Column) -> Column:
    failed, poison = (F.arrays_overlap(keys, F.array(*map(F.lit, m))) for m in (FAILED_MARKS, POISON_MARKS))
    return F.when(keys.isNull(), "malformed").when(failed & poison, "ambiguous").when(failed, "failed_job").when(poison, "poison").otherwise("unknown")


def unknown_fields(value: Column) -> Column:
    """The keys that an envelope of its kind may not have."""
    return _unknown(F.json_object_keys(value), envelope(value))


def _unknown(keys: Column, kind: Column) -> Column:
    allowed = F.when(kind == "failed_job", F.array(*map(F.lit, FAILED_FIELDS))).otherwise(F.array(*map(F.lit, POISON_FIELDS)))
    return F.when(kind.isin("failed_job", "poison"), F.array_except(keys, allowed)).otherwise(F.array().cast("array<string>"))


def _text(name: str, of: str) -> list[tuple[str, Column]]:
    c = col(f"{of}.{name}")
    return [(name, C.blank(c) | (F.octet_length(c) > C.ID_BYTES))]


def failed_fault(of: str = "failed") -> Column:
    """The first bad field of a failed job."""
    c = lambda name: col(f"{of}.{name}")
    new = c("schema_version") >= 2
    own = C.terminal_event(c("execution_key"), c("attempt"), "dlq")
    i, n = (F.coalesce(c(f"slice.{x}"), F.lit(-1)) for x in ("index", "total"))
    return C.first_of(
        ("schema_version", ~F.coalesce(c("schema_version"), F.lit(0)).between(*C.VERSIONS)),
        *(x for name in ("scenario_id", "run_id", "execution_key") for x in _text(name, of)),
        ("event_id", new & (C.blank(c("event_id")) | (c("event_id") != own))), *_text("reason", of),
        ("slice", (n < 1) | (n > C.SLICES) | (i < 0) | (i >= n)), ("attempt", (c("attempt") > c("max_retries")) | (c("max_retries") > C.ATTEMPTS)),
    )


def _evidence(field: str, of: str) -> list[tuple[str, Column]]:
    encoded, size, cut = (col(f"{of}.{field}_{x}") for x in ("base64", "original_bytes", "truncated"))
    cut = F.coalesce(cut, F.lit(False))
    raw = C.from_base64(encoded)
    kept = F.octet_length(raw)
    return [
        (f"{field}_metadata", encoded.isNull() & (size.isNotNull() | cut)), (f"{field}_base64", encoded.isNotNull() & raw.isNull()), (f"{field}_bytes", kept > C.EVIDENCE_BYTES),
        (f"{field}_length", encoded.isNotNull() & ((size.isNull() & cut) | (cut & (size <= kept)) | (~cut & (size != kept)))),
    ]


def poison_fault(of: str = "poison") -> Column:
    """The first bad field of a poison record: identity, coordinates, lengths of the kept evidence."""
    c = lambda name: col(f"{of}.{name}")
    own = C.poison_event(c("source_topic"), c("source_partition"), c("source_offset"))
    return C.first_of(
        ("schema_version", ~F.coalesce(c("schema_version"), F.lit(0)).between(*C.VERSIONS)), *(x for name in ("event_id", "source_topic", "reason") for x in _text(name, of)),
        ("source_partition", c("source_partition").isNull() | (c("source_partition") < 0)), ("source_offset", c("source_offset").isNull() | (c("source_offset") < 0)),
        ("identity", c("event_id") != own), *_evidence("source_key", of), *_evidence("payload", of),
    )


def letters(records: DataFrame) -> DataFrame:
    """Records (value, JSON) with class, failed, poison and fault: the class if it is neither kind, an unknown field, or the first bad one.

    They come out of a generator, which no filter passes: one on ``fault`` would be written out down to the
    source, with the JSON made and parsed again at each of its many mentions.
    """
    rows = records.withColumn("_keys", F.json_object_keys("value")).withColumn("class", _envelope(col("_keys"))).withColumn("failed", F.when(col("class") == "failed_job", F.from_json("value", FAILED))).withColumn("poison", F.when(col("class") == "poison", F.from_json("value", POISON)))
    odd = _unknown(col("_keys"), col("class"))
    fault = F.when(~col("class").isin("failed_job", "poison"), col("class")).when(F.size(odd) > 0, F.concat(F.lit("unknown field "), F.array_min(odd)))
    rows = rows.withColumn("fault", F.coalesce(fault, F.when(col("class") == "failed_job", failed_fault()), F.when(col("class") == "poison", poison_fault())))
    made = ("class", "failed", "poison", "fault")
    return rows.select(*(c for c in records.columns if c not in made), F.inline(F.array(F.struct(*made))))


def chosen(scenarios: tuple[str, ...] = (), since_ms: int | None = None, until_ms: int | None = None, contains: str | None = None) -> Column:
    """Whether a failed job (scenario_id, failed_at_ms, reason) is asked for; both ends of time are included, text is found in any case."""
    wanted = F.lit(True)
    if scenarios:
        wanted &= col("scenario_id").isin(*scenarios)
    if since_ms is not None:
        wanted &= col("failed_at_ms") >= since_ms
    if until_ms is not None:
        wanted &= col("failed_at_ms") <= until_ms
    if contains is not None:
        wanted &= F.contains(F.lower("reason"), F.lit(contains.lower()))
    return F.coalesce(wanted, F.lit(False))


def scanned(records: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` records by (source_partition, source_offset): a scan counts what it sees, whatever is chosen of it later."""
    return records.orderBy("source_partition", "source_offset").limit(limit)


def before_first_fault(rows: DataFrame) -> DataFrame:
    """Rows before their partition's first with a fault: a replay stops there and leaves its offset."""
    stops = rows.where("fault IS NOT NULL").groupBy("source_partition").agg(F.min("source_offset").alias("_stop"))
    held = rows.join(stops, "source_partition", "left")
    return held.where("_stop IS NULL OR source_offset < _stop").drop("_stop")


def counters(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """seen, matched, skipped_poison and skipped_unknown by scenario_id of classed letters; the plan names the known scenarios."""
    known = plan.select(col("scenario_id").alias("_known")).distinct()
    rows = rows.join(known, col("scenario_id") == col("_known"), "left")
    n = lambda c: F.count_if(c).alias
    job = col("class") == "failed_job"
    return rows.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("seen"), n(job & col("_known").isNotNull())("matched"), n(col("class") == "poison")("skipped_poison"), n(job & col("_known").isNull())("skipped_unknown"),
    )


def bounded_reasons(rows: DataFrame, most: int = C.KINDS, other: str = "<other reasons>") -> DataFrame:
    """Counts by reason; the first ``most`` reasons by (source_partition, source_offset) keep their name.

    Reasons are aggregated first, their first places picked by a top-k, and those few are broadcast.
    """
    firsts = rows.groupBy("reason").agg(F.min(F.struct("source_partition", "source_offset")).alias("place"), F.count(F.lit(1)).alias("n"))
    named = firsts.orderBy("place", "reason").limit(most).select(col("reason").alias("_named"))
    held = firsts.join(F.broadcast(named), col("reason").eqNullSafe(col("_named")), "left")
    return held.groupBy(F.coalesce("_named", F.lit(other)).alias("reason")).agg(F.sum("n").alias("n"))
