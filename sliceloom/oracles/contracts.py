"""Expected faults, deduplication and dead letters, from the rules by which the test records are made."""

from __future__ import annotations

_JOBS = """
WITH j AS (
  SELECT o_orderkey AS k, CASE WHEN k % 41 = 0 THEN 3 WHEN k % 43 = 0 THEN 0 ELSE 1 + k % 2 END AS v, k % 500 + 0.5::DOUBLE AS rate, k % 90 * 1000 + 1000 AS ms, k % 60 + 1 AS places, k % 4 AS attempt,
         CASE WHEN k % 53 = 0 THEN 40 ELSE 2 END AS most FROM orders),
faults AS (
  SELECT k, rate, ms, places, CASE
    WHEN v = 0 THEN 'UnsupportedVersion' WHEN v = 3 THEN 'FutureVersion'
    WHEN k % 37 = 0 OR v = 2 AND k % 11 = 0 THEN 'MissingField'
    WHEN k % 47 = 0 THEN 'FieldTooLong'
    WHEN k % 31 = 0 OR k % 9 >= 8 + k % 3 THEN 'InvalidSlice'
    WHEN k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0 OR k % 29 = 0 OR k % 8 > places THEN 'InvalidLoad'
    WHEN attempt > most OR most > 32 OR v = 2 AND attempt > 0 AND k % 5 = 0 THEN 'InvalidAttempt' END AS reason FROM j)
"""
_RESULTS = """
WITH r AS (
  SELECT o_orderkey AS k, CASE WHEN k % 41 = 0 THEN 3 WHEN k % 43 = 0 THEN 0 ELSE 1 + k % 2 END AS v, (floor(o_totalprice) % 1000)::BIGINT AS success, o_custkey % 10 AS failure,
         success + failure + CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS total FROM orders),
h AS (SELECT *, k % 47 <> 0 AS has_bins, total + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS binned, failure - CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END AS errors FROM r),
bins AS (SELECT *, CASE WHEN has_bins AND k % 13 = 0 THEN 'BoundsNotRising' WHEN has_bins AND binned <> total THEN 'HistogramMismatch' END AS binned_fault FROM h),
faults AS (
  SELECT k, total, failure, binned_fault, CASE
    WHEN v = 0 THEN 'UnsupportedVersion' WHEN v = 3 THEN 'FutureVersion' WHEN k % 37 = 0 THEN 'MissingField' WHEN k % 31 = 0 OR k % 9 >= 8 + k % 3 THEN 'InvalidSlice' WHEN k % 35 > 32 THEN 'InvalidAttempt'
    WHEN v = 2 AND k % 17 = 0 THEN 'EventIdMismatch' WHEN v = 2 AND total > 0 AND NOT has_bins THEN 'HistogramMissing' WHEN success + failure <> total THEN 'CountMismatch' WHEN k % 53 = 0 THEN 'DuplicateKind'
    WHEN v = 2 AND errors <> failure OR errors > failure THEN 'ErrorMismatch' WHEN k % 19 = 0 THEN 'TimeOrder' ELSE binned_fault END AS reason FROM bins)
"""
_DELIVERED = """
WITH delivered AS (
  SELECT l_orderkey AS run, l_linenumber - 1 AS slice_index, l_partkey, l_suppkey, l_quantity::BIGINT AS total, round(l_discount * 100)::BIGINT AS failure, epoch_us(l_shipdate) AS at_us, l_extendedprice, l_tax, l_returnflag, l_linestatus FROM lineitem),
placed AS (
  SELECT *, row_number() OVER o AS rn, first_value(total) OVER o AS first_total FROM delivered
  WINDOW o AS (PARTITION BY run, slice_index ORDER BY at_us, l_partkey, l_suppkey, total, failure, l_extendedprice, l_tax, l_returnflag, l_linestatus))
"""
_LETTERS = """
WITH e AS (
  SELECT event_id AS k, event_id % 11 AS m, user_id % 4 AS part, event_type, epoch_us(ts) // 1000 AS at_ms, json_extract_string(props, '$.k')::BIGINT AS p, user_id,
         CASE WHEN p % 7 = 0 THEN 'target_timeout: deadline' WHEN p % 7 = 1 THEN concat('Unavailable peer ', user_id % 90) WHEN p % 7 = 2 THEN 'unknown scenario' ELSE concat('decode failed at ', user_id % 30) END AS why FROM events),
l AS (SELECT *, CASE WHEN k % 101 = 0 THEN 'malformed' WHEN m <= 5 THEN 'failed_job' WHEN m <= 8 THEN 'poison' WHEN m = 10 THEN 'ambiguous' ELSE 'unknown' END AS class FROM e),
letters AS (
  SELECT k, part, at_ms, class, CASE WHEN class = 'failed_job' THEN event_type END AS scenario_id, CASE WHEN class IN ('failed_job', 'poison') THEN CASE WHEN k % 41 = 0 THEN ' ' ELSE why END END AS reason, CASE
    WHEN class NOT IN ('failed_job', 'poison') THEN class WHEN k % 97 = 0 THEN 'unknown field surplus'
    WHEN class = 'failed_job' THEN CASE WHEN k % 29 = 0 THEN 'event_id' WHEN k % 41 = 0 THEN 'reason' WHEN k % 31 = 0 THEN 'slice' WHEN k % 37 = 0 AND k % 3 > 0 THEN 'attempt' END
    ELSE CASE WHEN k % 41 = 0 THEN 'reason' WHEN k % 43 = 0 THEN 'source_partition' WHEN k % 29 = 0 THEN 'identity' WHEN k % 19 = 0 THEN 'payload_length' END END AS fault FROM l)
"""

QUERIES = {
    "invalid_jobs": _JOBS + "SELECT k AS id, reason FROM faults WHERE reason IS NOT NULL",
    "job_limits": _JOBS + "SELECT k AS id, coalesce(reason, CASE WHEN ms > 80000 OR rate > 450 OR places > 55 THEN 'SafetyLimit' END) AS reason FROM faults",
    "invalid_results": _RESULTS + "SELECT k AS id, reason FROM faults WHERE reason IS NOT NULL",
    "result_routing": _RESULTS + "SELECT coalesce(reason, 'valid') AS reason, CASE WHEN reason IS NOT NULL THEN 'poison' WHEN failure = 0 AND total > 0 THEN 'Success' ELSE 'Failed' END AS route, count(*) AS n FROM faults GROUP BY ALL",
    "histogram_faults": _RESULTS + "SELECT k AS id, binned_fault AS reason FROM faults",
    "failure_routing": """SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'stop' WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 4 >= 2 THEN 'dlq' ELSE 'retry' END WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'dlq' ELSE 'result' END AS disposition FROM events""",
    "error_classify": """SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'missing_context_var' WHEN 1 THEN 'invalid_scenario' WHEN 2 THEN concat('target_status:', code) WHEN 3 THEN 'invalid_scenario' WHEN 4 THEN 'target_transport'
  WHEN 5 THEN concat('target_status:', code) WHEN 6 THEN 'target_timeout' WHEN 7 THEN 'infrastructure' WHEN 8 THEN 'permanent_processing' WHEN 9 THEN 'cancelled' ELSE 'invariant_violation' END AS kind, event_id % 11 IN (2, 4, 5, 6) AS is_target
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Unavailable' ELSE 'NotFound' END AS code FROM events)""",
    "result_statuses": "SELECT CASE WHEN l_partkey % 4 = 0 AND l_partkey % 9 <> 0 AND l_quantity::BIGINT > 0 THEN 'Success' ELSE 'Failed' END AS status, count(*) AS n FROM lineitem GROUP BY 1",
    "endpoint_allowlist": "SELECT s_suppkey, s_suppkey % 13 <> 0 AND s_suppkey % 4 IN (0, 1) AS allowed FROM supplier",
    "dedupe_results": _DELIVERED + "SELECT run, slice_index, l_partkey, l_suppkey, total, failure, at_us FROM placed WHERE rn = 1",
    "duplicate_counts": _DELIVERED + """SELECT run, count(*) AS physical, count(DISTINCT slice_index) AS logical, count(*) FILTER (rn > 1 AND total = first_total) AS duplicates, count(*) FILTER (rn > 1 AND total <> first_total) AS conflicts FROM placed GROUP BY run""",
    "conflicting_results": _DELIVERED + "SELECT run, slice_index, rn AS delivery, total, first_total FROM placed WHERE rn > 1 AND total <> first_total",
    "merged_runs": _DELIVERED + "SELECT run, count(*) AS received, sum(total)::BIGINT AS total, sum(failure)::BIGINT AS failure, 7 - count(*) AS missing FROM placed WHERE rn = 1 GROUP BY run",
    "logical_records": _DELIVERED + "SELECT concat(run, ':', slice_index) AS event_id, count(*) AS physical, count(*) - 1 AS duplicates, count(DISTINCT (total, failure)) > 1 AS conflicting FROM delivered GROUP BY run, slice_index",
    "dlq_classify": _LETTERS + "SELECT k AS source_offset, class, fault FROM letters",
    "dlq_filter": _LETTERS + "SELECT k AS source_offset, scenario_id, reason FROM letters WHERE class = 'failed_job' AND scenario_id IN ('click', 'error') AND at_ms BETWEEN 1704500000000 AND 1705900000000 AND lower(reason) LIKE '%unavailable%'",
    "dlq_reason_top64": _LETTERS + """, firsts AS (SELECT reason, min((part, k)) AS place, count(*) AS n FROM letters WHERE fault IS NULL GROUP BY reason),
ranked AS (SELECT *, row_number() OVER (ORDER BY place, reason) AS rk FROM firsts)
SELECT CASE WHEN rk <= 64 THEN reason ELSE '<other reasons>' END AS reason, sum(n)::BIGINT AS n FROM ranked GROUP BY 1""",
    "dlq_counters": _LETTERS + """SELECT coalesce(scenario_id, 'none') AS scenario_id, count(*) AS seen, count(*) FILTER (class = 'failed_job' AND scenario_id <> 'error') AS matched,
  count(*) FILTER (class = 'poison') AS skipped_poison, count(*) FILTER (class = 'failed_job' AND scenario_id = 'error') AS skipped_unknown FROM letters GROUP BY 1""",
    "dlq_scan": _LETTERS + "SELECT class, count(*) AS n FROM (SELECT class FROM letters ORDER BY part, k LIMIT 500) GROUP BY class",
    "dlq_replay": _LETTERS + """, stops AS (SELECT part, min(k) AS stop FROM letters WHERE fault IS NOT NULL OR scenario_id = 'error' GROUP BY part)
SELECT scenario_id, concat('v2:replay:t', 'ZGxx', ':p', l.part, ':o', k) AS run, true AS one_slice, at_ms AS scheduled_at_ms, 5.0::DOUBLE AS rate, 0 AS attempt, 2 AS max_retries
FROM letters l LEFT JOIN stops s ON l.part = s.part WHERE class = 'failed_job' AND (stop IS NULL OR k < stop)""",
    "poison_identity": """SELECT doc_id AS "offset", concat('poison:docs:', doc_id % 4, ':', doc_id) AS event_id, md5(base64(encode(text)[1:3000])) AS base64_md5, octet_length(encode(text)) AS original_bytes, octet_length(encode(text)) > 3000 AS truncated FROM documents""",
}
