"""From scenario rows to slices, jobs, schedules and retries.

A scenario is (scenario_id, rate, concurrency, duration_ms, burst) and, where a function says so, endpoint,
every_ms (null: once), strategy and steps (an array of fingerprint materials). Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import scalars

LOAD = ("rate", "duration_ms", "concurrency", "burst")


def counted(scenarios: DataFrame) -> DataFrame:
    """With ``slices``."""
    return scenarios.withColumn("slices", C.slice_count(F.col("rate"), F.col("concurrency"), F.col("duration_ms")))


def sliced(scenarios: DataFrame) -> DataFrame:
    """One row a slice, with slice_index and its part of rate, concurrency and burst: sums over slices are the scenario's."""
    fanned = counted(scenarios).withColumn("slice_index", F.explode(F.expr("sequence(0L, slices - 1)")))
    return fanned.withColumns({
        "rate": F.col("rate").cast("double") / F.col("slices"),
        **{c: C.share(F.col(c), F.col("slices"), F.col("slice_index")) for c in ("concurrency", "burst")},
    })


def jobs(scenarios: DataFrame, scheduled_ms: Column, max_retries: int = 2) -> DataFrame:
    """Job records of every slice: identities, load, attempt 0, the key by which they are dealt. ``scheduled_ms`` is the window."""
    key = F.col("strategy") if "strategy" in scenarios.columns else F.lit("execution_key")
    rows = sliced(scenarios).withColumn("scheduled_at_ms", scheduled_ms.cast("long"))
    rows = rows.withColumn("run_id", C.window_id(F.col("scenario_id"), F.col("scheduled_at_ms"), F.col("slices")))
    rows = rows.withColumn("execution_key", C.execution_key(F.col("run_id"), F.col("slice_index"), F.col("slices")))
    return rows.withColumns({
        "schema_version": F.lit(2), "attempt": F.lit(0), "max_retries": F.lit(max_retries), "not_before_ms": F.lit(0).cast("long"),
        "partition_key": C.partition_key(key, F.col("scenario_id"), F.col("execution_key")),
    })


def pacing(slices: DataFrame) -> DataFrame:
    """Every start of every slice: k and at_s, while before the end. Holds as long as no place is waited for.

    Slices are few and starts are many, so slices are dealt to all tasks before they are expanded. Those of one scenario
    stay together and those of equal pace follow each other: their starts are the same numbers, which a columnar file
    keeps once, where slices dealt apart would each bring numbers of their own.
    """
    ms = F.col("duration_ms").cast("double")
    most = F.ceil(F.col("rate") * F.col("duration_ms") / 1000) + F.col("burst")
    n = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = slices.repartition(n, "scenario_id").sortWithinPartitions("rate", "burst", "duration_ms", "scenario_id", "slice_index")
    starts = dealt.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))))
    at = C.start_s(F.col("k"), F.col("rate"), F.col("burst"))
    return starts.withColumn("at_s", at).where(F.col("at_s") < ms / 1000)


def windows(schedules: DataFrame, until_ms: Column) -> DataFrame:
    """Every window (scheduled_ms, next_ms) of schedules (from_ms, every_ms) up to and including ``until_ms``.

    They follow each other without drift; one without every_ms comes once and has no next.
    """
    last = F.when(F.col("every_ms").isNull(), F.lit(0)).otherwise(F.floor((until_ms - F.col("from_ms")) / F.col("every_ms"))).cast("long")
    due = schedules.withColumn("_last", last).where("_last >= 0 AND from_ms IS NOT NULL").where(F.col("from_ms") <= until_ms)
    due = due.withColumn("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    at = F.col("from_ms") + F.coalesce("every_ms", F.lit(0)) * F.col("_n")
    return due.withColumn("scheduled_ms", at.cast("long")).withColumn("next_ms", (F.col("scheduled_ms") + F.col("every_ms")).cast("long")).drop("_last", "_n")


def active_window_fault(stored: str = "stored", wanted: str = "wanted") -> Column:
    """The first field in which a resumed window differs from what is asked for; null if it may go on."""
    fields = ("contract_version", "slices", "repeat_ms", "fingerprint")
    return C.first_of(*((f, ~F.col(f"{stored}.{f}").eqNullSafe(F.col(f"{wanted}.{f}"))) for f in fields))


def unacknowledged(window_slices: DataFrame, acks: DataFrame, on: tuple[str, ...] = ("run_id", "slice_index")) -> DataFrame:
    """Slices of prepared windows that no acknowledgement names: what a resumed dispatch sends."""
    return window_slices.join(acks.select(*on), list(on), "left_anti")


def retried(jobs: DataFrame, now_ms: Column, base_ms: int = 1000, cap_ms: int = 60_000) -> DataFrame:
    """What follows a failed attempt: disposition retry with attempt + 1 and its not_before_ms, or dlq without."""
    spent = F.col("attempt") >= F.col("max_retries")
    delay = scalars.retry_delay_udf(F.col("execution_key"), F.col("attempt"), F.lit(base_ms), F.lit(cap_ms))
    wait = F.when(~spent, now_ms + F.ceil(delay).cast("long"))
    return jobs.withColumns({"disposition": F.when(spent, "dlq").otherwise("retry"), "not_before_ms": wait, "attempt": F.col("attempt") + 1})


def deferral(wait_ms: Column, most_ms: int = 600_000) -> Column:
    """run, defer or, when the wait is too long, dlq."""
    return F.when(wait_ms <= 0, "run").when(wait_ms > most_ms, "dlq").otherwise("defer")


def semantics_material(request_ms: Column, scenario_ms: Column, descriptor_fingerprint: Column, engine: str) -> Column:
    """What decides how a job runs; its FNV-1a-128 is the execution-semantics fingerprint."""
    return C.joined(f"engine={engine}|request_timeout_ms=", request_ms, "|scenario_timeout_ms=", F.coalesce(C.text(scenario_ms), F.lit("none")), "|descriptor=", F.coalesce(descriptor_fingerprint, F.lit("none")))


def step_material(step: str = "step") -> Column:
    """Canonical text of a step (endpoint, service, method, request, extract map, payload_key); extraction keys in order."""
    s = F.col(step)
    pairs = F.transform(F.array_sort(F.map_entries(s["extract"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    extract = F.coalesce(F.array_join(pairs, ","), F.lit(""))
    return C.joined("grpc|endpoint=", F.coalesce(s["endpoint"], F.lit("<default>")), "|service=", s["service"], "|method=", s["method"], "|request=", F.coalesce(s["request"], F.lit("empty")), "|extract=", extract, "|payload_key=", F.coalesce(s["payload_key"], F.lit("")))


def plan_material(global_burst: Column | int, max_retries: Column | int, semantics: Column | str) -> Column:
    """Canonical text of a scenario's plan, with its ``slices``; its FNV-1a-128 is the plan fingerprint."""
    repeat = F.when(F.col("every_ms").isNull(), "once").otherwise(C.joined("every:", F.col("every_ms")))
    steps = F.array_join(F.transform("steps", lambda x: F.concat(F.lit("|step="), x)), "")
    bits = F.lpad(F.lower(F.hex(scalars.double_bits_udf("rate"))), 16, "0")
    return C.joined(
        "v2|endpoint=", F.col("endpoint"), "|rate=", bits, "|duration_ms=", F.col("duration_ms"), "|concurrency=", F.col("concurrency"), "|slices=", F.col("slices"),
        "|startup_burst=", global_burst, "|max_retries=", max_retries, "|repeat=", repeat, "|partition=", F.col("strategy"), "|execution_semantics=", semantics, steps,
    )


def fingerprint(material: Column) -> Column:
    return F.concat(F.lit("fnv128:"), scalars.fnv128_udf(material))


def plan_drift(jobs: DataFrame, plan: DataFrame, max_retries: int) -> DataFrame:
    """``fault`` of each job against the local plan (scenario_id, rate, concurrency, duration_ms, burst, fingerprint), null if it agrees.

    The plan is small and broadcast behind no assumption: Spark decides by its size. Jobs of version 1 and
    of unknown scenarios have no fault here.
    """
    of = plan.select(F.col("scenario_id").alias("_of"), *[F.col(c).alias(f"_{c}") for c in (*LOAD, "fingerprint")])
    rows = jobs.join(of, F.col("scenario_id") == F.col("_of"), "left")
    known = (F.col("schema_version") >= 2) & F.col("_of").isNotNull()
    total, i = F.greatest(F.col("slice_total"), F.lit(1)), F.col("slice_index")
    same_load = (
        (F.col("rate") == F.col("_rate").cast("double") / total) & (F.col("duration_ms") == F.col("_duration_ms"))
        & (F.col("concurrency") == C.share(F.col("_concurrency"), total, i)) & (F.col("burst") == C.share(F.col("_burst"), total, i))
    )
    fault = C.first_of(("retries", F.col("max_retries") > max_retries), ("load", known & ~same_load), ("fingerprint", known & ~F.col("plan_fingerprint").eqNullSafe(F.col("_fingerprint"))))
    return rows.withColumn("fault", fault).select(*jobs.columns, "fault")


def startup_faults(rate_max: float, concurrency_max: int, duration_max_ms: int) -> Column:
    """Every reason why a scenario may not be started, in order."""
    cases = [
        ("rate", ~((F.col("rate") > 0) & (F.col("rate") <= rate_max))), ("concurrency", ~F.col("concurrency").between(1, concurrency_max)), ("duration", ~F.col("duration_ms").between(1, duration_max_ms)),
        ("repeat", F.col("every_ms") < F.col("duration_ms")), ("burst", F.col("burst") > F.col("concurrency")), ("identity", ~C.within_identity_budget(F.col("scenario_id"))),
        ("starts_nothing", C.starts_nothing(F.col("rate"), F.col("duration_ms"), F.col("burst"))),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in cases)))


def step_endpoints(steps: DataFrame, gateways: DataFrame, default: str) -> DataFrame:
    """Steps (endpoint or null) with the gateway of their endpoint; configured is false where there is none."""
    resolved = steps.withColumn("resolved", F.coalesce("endpoint", F.lit(default)))
    known = gateways.select(F.col("endpoint").alias("_endpoint"), F.col("gateway")).distinct()
    return resolved.join(known, F.col("resolved") == F.col("_endpoint"), "left").drop("_endpoint").withColumn("configured", F.col("gateway").isNotNull())


def replay_jobs(letters: DataFrame, plan: DataFrame, max_retries: int = 2, scale: float = 1.0) -> DataFrame:
    """A new run of one slice for each failed job, by the coordinates of its letter, so that a redelivery gives the same one.

    Letters: topic, source_partition, source_offset and the failed job's scenario_id, execution_key, event_id,
    attempt, failed_at_ms. Plan: scenario_id, load and plan_fingerprint of a single slice.
    """
    if scale != 1.0:
        raise ValueError("a replay keeps the plan's load: scale must be 1")
    event = F.when(C.blank(F.col("event_id")), C.terminal_event(F.col("execution_key"), F.col("attempt"), "dlq")).otherwise(F.col("event_id"))
    run = C.joined("v2:replay:t", C.base64_url(F.col("topic")), ":p", F.col("source_partition"), ":o", F.col("source_offset"), ":e", scalars.fnv128_udf(event))
    load = plan.select("scenario_id", *LOAD, "plan_fingerprint")
    rows = letters.withColumn("run_id", run).select("scenario_id", "run_id", F.col("failed_at_ms").alias("scheduled_at_ms")).join(load, "scenario_id")
    return rows.withColumns({
        "execution_key": C.execution_key(F.col("run_id"), F.lit(0), F.lit(1)), "schema_version": F.lit(2), "slice_index": F.lit(0), "slice_total": F.lit(1),
        "not_before_ms": F.lit(0).cast("long"), "attempt": F.lit(0), "max_retries": F.lit(max_retries),
    })


def replay_source_fault(topic: Column, partition: Column, offset: Column) -> Column:
    """Why coordinates cannot name a replay; a topic has at most 249 bytes."""
    return C.first_of(("topic", C.blank(topic)), ("topic_bytes", F.octet_length(topic) > 249), ("partition", partition.isNull() | (partition < 0)), ("offset", offset.isNull() | (offset < 0)))
