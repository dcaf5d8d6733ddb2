"""Column functions of built-in expressions: identities, planning arithmetic, histogram bounds, text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the record contract.
VERSIONS = (1, 2)
ID_BYTES, KIND_BYTES, KINDS, SLICES, ATTEMPTS, BUCKETS = 1024, 256, 64, 4096, 32, 128
EXACT = 9_007_199_254_740_991
EVIDENCE_BYTES = 262_144
MARKER = "...[truncated]"
#: Inclusive upper bounds of latency buckets; what is above the last is overflow.
BOUNDS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000, 120000)
#: Fixed values of planning: a slice's share of rate and concurrency, and the most slices.
RATE_A_SLICE, CONCURRENCY_A_SLICE, MOST_SLICES = 10, 25, 128


def text(c: Column | str | int) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("string")


def joined(*parts) -> Column:
    return F.concat(*(text(p) for p in parts))


def trimmed(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def first_of(*cases: tuple[str, Column]) -> Column:
    """The name of the first condition that holds, null if none does. A null condition does not hold."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in cases))


# identities


def window_id(scenario: Column, scheduled_ms: Column, slices: Column, version: int = 2) -> Column:
    return joined(f"v{version}:s", F.octet_length(scenario), ":", scenario, ":w", scheduled_ms, ":n", slices)


def execution_key(window: Column, index: Column, slices: Column) -> Column:
    return joined(window, ":slice-", index, "-of-", slices)


def legacy_key(scenario: Column, scheduled_ms: Column, index: Column, slices: Column) -> Column:
    return execution_key(joined(scenario, ":", scheduled_ms), index, slices)


def versioned_run(scenario: Column, scheduled_ms: Column, version: int = 2) -> Column:
    return joined(f"v{version}:", scenario, ":", scheduled_ms)


def terminal_event(key: Column, attempt: Column | int, kind: str) -> Column:
    return joined(key, ":attempt-", attempt, f":{kind}")


def summary_event(run_id: Column, revision: Column, status: Column) -> Column:
    """``status`` is Complete, TimedOut, Partial or Cancelled."""
    tail = F.when(status == "TimedOut", "timed-out").otherwise(F.lower(status))
    return joined(run_id, ":summary:r", revision, ":", tail)


def poison_event(topic: Column | str, partition: Column, offset: Column) -> Column:
    return joined("poison:", topic, ":", partition, ":", offset)


def within_identity_budget(scenario: Column) -> Column:
    """Whether every identity of a scenario fits, with its widest time, slice, attempt and revision."""
    widest_ms, widest_revision = str((1 << 128) - 1), str((1 << 64) - 1)
    window = window_id(scenario, F.lit(widest_ms), F.lit(MOST_SLICES))
    key = execution_key(window, F.lit(MOST_SLICES - 1), F.lit(MOST_SLICES))
    longest = F.greatest(*(F.octet_length(x) for x in (scenario, window, key, terminal_event(key, ATTEMPTS, "result"), joined(window, ":summary:r", widest_revision, ":timed-out"))))
    return ~blank(scenario) & (longest <= ID_BYTES)


def partition_key(strategy: Column, scenario: Column, key: Column) -> Column:
    """``scenario_id`` keeps a scenario's jobs together, anything else deals them by execution."""
    return F.when(strategy == "scenario_id", scenario).otherwise(key)


# planning


def slice_count(rate: Column, concurrency: Column, duration_ms: Column) -> Column:
    """Slices of a scenario: enough for its rate and concurrency, at most one a start and one a place; 1 if it cannot run."""
    rate, seconds = rate.cast("double"), duration_ms.cast("double") / 1000
    wanted = F.greatest(F.ceil(rate / RATE_A_SLICE), F.ceil(concurrency.cast("double") / CONCURRENCY_A_SLICE), F.lit(1))
    starts = F.least(F.greatest(F.floor(rate * seconds), F.lit(1)), F.lit(2**32 - 1))
    runs = rate.isNotNull() & ~F.isnan(rate) & (rate > 0) & (rate < float("inf")) & (concurrency > 0) & (duration_ms > 0)
    return F.when(runs, F.least(wanted, concurrency.cast("long"), starts, F.lit(MOST_SLICES))).otherwise(1).cast("long")


def share(total: Column, parts: Column, index: Column) -> Column:
    """What part ``index`` gets of a whole number: the quotient, and one more for the first of them while something remains."""
    total, parts = total.cast("long"), parts.cast("long")
    return F.floor(total / parts).cast("long") + F.when(index < total % parts, 1).otherwise(0)


def start_s(k: Column, rate: Column, burst: Column) -> Column:
    """When token k is due, in seconds: a burst at 0 and then one every 1 / rate, or without burst half an interval in."""
    later = (k - burst + 1).cast("double") / rate
    return F.when(burst == 0, (k.cast("double") + 0.5) / rate).when(k < burst, F.lit(0.0)).otherwise(later)


def starts_nothing(rate: Column, duration_ms: Column, burst: Column) -> Column:
    return (burst == 0) & (rate * duration_ms / 1000 < 1)


# histograms


def bucket(latency_ms: Column, bounds: Sequence[int] = BOUNDS) -> Column:
    """The first inclusive bound that holds a latency; null is overflow."""
    return reduce(lambda c, b: c.when(latency_ms <= b, b), bounds[1:], F.when(latency_ms <= bounds[0], bounds[0])).cast("long")


def rank(total: Column, q: float) -> Column:
    """Nearest rank of a quantile."""
    return F.greatest(F.ceil(total.cast("double") * F.lit(float(q))), F.lit(1)).cast("long")


# text


def duration_ms(c: Column) -> Column:
    """``Ns``, ``Nm`` or ``Nh`` in milliseconds; null for anything else, for 0 and for what does not fit."""
    n, unit = (F.regexp_extract(trimmed(c), r"^(\d+)([smh])$", i) for i in (1, 2))
    number = F.nullif(F.nullif(n, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.try_multiply(number, F.when(unit == "s", 1000).when(unit == "m", 60_000).otherwise(3_600_000).cast("bigint"))


def slugify(c: Column, default: str = "scenario") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def base64_text(c: Column) -> Column:
    """Standard base64 on one line."""
    return F.regexp_replace(F.base64(c.cast("binary")), "[\r\n]", "")


def base64_url(c: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.regexp_replace(F.translate(base64_text(c), "+/", "-_"), "=+$", "")


def from_base64(c: Column) -> Column:
    """Bytes of standard base64, null if it is not that."""
    whole = c.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(whole, F.unbase64(F.when(whole, c)))


def utf8_prefix(c: Column, most: Column | int) -> Column:
    """The longest prefix of at most so many bytes that ends with a whole character."""
    raw, most = c.cast("binary"), F.lit(most)

    def inside(n: Column) -> Column:  # byte n, counted from 0, goes on with a character
        return F.conv(F.hex(raw.substr(n + 1, F.lit(1))), 16, 10).cast("int").between(128, 191)

    cut = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(raw.substr(F.lit(1), cut), "UTF-8"))


def utf8_cut(c: Column, most: int = ID_BYTES, marker: str = MARKER) -> Column:
    """At most ``most`` bytes, never half a character, with a marker where something was cut."""
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(utf8_prefix(c, max(0, most - len(marker.encode()))), F.lit(marker)))


def one_line(c: Column, most: int = 160) -> Column:
    return utf8_cut(F.regexp_replace(c, r"\p{Cc}", " "), most)


def evidence(c: Column, most: int = EVIDENCE_BYTES) -> Column:
    """What is kept of bad bytes: a prefix in base64, the original length, and whether it was cut."""
    raw = c.cast("binary")
    n = F.octet_length(raw).cast("long")
    kept = base64_text(raw.substr(F.lit(1), F.lit(most)))
    return F.when(c.isNotNull(), F.struct(kept.alias("base64"), n.alias("original_bytes"), (n > most).alias("truncated")))


def number(c: Column, keep_nan: bool = False) -> Column:
    """A double from text; null for what is none, and for NaN unless that is kept."""
    x = F.nullif(trimmed(c), F.lit("")).try_cast("double")
    return x if keep_nan else F.when(~F.isnan(x), x)


def comma_list(c: Column) -> Column:
    """The distinct parts that are not blank, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), trimmed), lambda x: x != ""))


def host_allowed(endpoint: Column, hosts: Sequence[str], any_host: bool = False) -> Column:
    """Whether the endpoint's host is one of ``hosts``, whatever the case."""
    return F.lit(True) if any_host else F.coalesce(F.lower(F.try_parse_url(endpoint, F.lit("HOST"))).isin([h.lower() for h in hosts]), F.lit(False))


#: Label of the runtime's own faults; a runtime that puts its name before it passes its own to the functions below.
INFRASTRUCTURE = "infrastructure"
#: Fixed table: an error's variant, its label (a status adds its code), whether it measures the target.
ERROR_LABELS = {
    "MissingContextVar": ("missing_context_var", False),
    "Client": ("invalid_scenario", False),
    "GrpcStatus": ("target_status", True),
    "InvalidScenario": ("invalid_scenario", False),
    "TargetTransport": ("target_transport", True),
    "TargetStatus": ("target_status", True),
    "RequestTimeout": ("target_timeout", True),
    "TransientInfrastructure": (INFRASTRUCTURE, False),
    "PermanentProcessing": ("permanent_processing", False),
    "Cancelled": ("cancelled", False),
    "InvariantViolation": ("invariant_violation", False),
}


def error_label(variant: Column, code: Column, infrastructure: str = INFRASTRUCTURE) -> Column:
    labels = F.create_map(*(F.lit(x) for k, (label, _) in ERROR_LABELS.items() for x in (k, infrastructure if label == INFRASTRUCTURE else label)))
    label = F.try_element_at(labels, variant)
    return F.when(label == "target_status", joined(label, ":", code)).otherwise(label)


def measures_target(variant: Column) -> Column:
    return variant.isin([k for k, (_, target) in ERROR_LABELS.items() if target])


def disposition(kinds: Column, attempt: Column, retries: Column, infrastructure: str = INFRASTRUCTURE) -> Column:
    """What becomes of a job whose measured errors are ``kinds`` (map of label to count), the first that applies."""

    def n(*labels: str) -> Column:
        return reduce(lambda a, b: a + b, (F.coalesce(F.try_element_at(kinds, F.lit(k)), F.lit(0)) for k in labels))

    again = F.when(attempt >= retries, "dlq").otherwise("retry")
    permanent = n("permanent_processing", "invalid_scenario", "missing_context_var") > 0
    return F.when(n("invariant_violation") > 0, "stop").when(n(infrastructure) > 0, again).when(permanent, "dlq").otherwise("result")


def result_status(started: Column, finished: Column, failure: Column) -> Column:
    return F.when((started == finished) & (failure == 0) & (finished > 0), "Success").otherwise("Failed")


def labels_match(labels: Column, wanted: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(F.try_element_at(labels, F.lit(k)) == v, F.lit(False)) for k, v in wanted.items()), F.lit(True))
