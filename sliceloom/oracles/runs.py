"""Observations, slices, runs: counts, histograms, quantiles, summaries, missing slices."""

from __future__ import annotations

SLICES = 16
BOUNDS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000, 120000)
OVERFLOW = 120000

#: One row per scenario execution, seen in ``events``.
OBSERVED = f"""
obs AS (
  SELECT event_id, event_type AS scenario_id, user_id % {SLICES} AS slice_index, at_ms, win AS window_ms,
         concat('v2:s', cast(octet_length(encode(event_type)) AS string), ':', event_type, ':w', cast(win AS string), ':n{SLICES}') AS run_id,
         greatest(cast(1 AS bigint), cast(floor(value * factor) as bigint)) AS latency_ms, k >= 10 AS ok,
         CASE WHEN k >= 10 THEN NULL WHEN k % 3 = 0 THEN 'target_status:Unavailable' WHEN k % 3 = 1 THEN 'target_timeout' ELSE 'target_transport' END AS error_kind
  FROM (
    SELECT event_id, event_type, user_id, value, cast(json_extract_string(props, '$.k') AS bigint) AS k,
           CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 5 WHEN 'signup' THEN 20 WHEN 'purchase' THEN 100 ELSE 1000 END AS factor,
           (epoch_us(ts) // 1000) AS at_ms, ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS win
    FROM events
  ) e
)"""
_CASES = " ".join(f"WHEN latency_ms <= {b} THEN {b}" for b in BOUNDS)
#: Inclusive upper bounds; NULL is the overflow bucket.
BUCKET = f"CASE {_CASES} END"
BOUND_ROWS = "bounds AS (SELECT cast(b AS bigint) AS bound_ms FROM (VALUES " + ", ".join(f"({b})" for b in BOUNDS) + ", (NULL)) v(b))"
COUNTS = "cast(count(*) AS bigint) AS total, cast(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS bigint) AS success, cast(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS bigint) AS failure"


def _rank(q: str) -> str:
    return f"greatest(cast(ceil(cast(total as double) * cast({q} as double)) as bigint), 1)"


#: Nearest rank over the merged histogram; a rank in the overflow bucket gives the last finite bound.
HISTOGRAM = f"""
hist AS (SELECT run_id, {BUCKET} AS bound_ms, cast(count(*) AS bigint) AS n FROM obs GROUP BY run_id, {BUCKET}),
cum AS (
  SELECT run_id, coalesce(bound_ms, {OVERFLOW}) AS bound_ms, sum(n) OVER (PARTITION BY run_id ORDER BY coalesce(bound_ms, {OVERFLOW + 1}) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
         sum(n) OVER (PARTITION BY run_id) AS total
  FROM hist
),
quant AS (
  SELECT run_id, """ + ", ".join(f"cast(min(CASE WHEN c >= {_rank(q)} THEN bound_ms END) AS bigint) AS {name}" for q, name in (("0.5", "p50_ms"), ("0.95", "p95_ms"), ("0.99", "p99_ms"))) + """
  FROM cum GROUP BY run_id
)"""
MERGED = f"""
run AS (
  SELECT run_id, scenario_id, window_ms, {COUNTS}, cast(count(DISTINCT slice_index) AS bigint) AS received, min(at_ms) AS first_ms, max(at_ms) AS last_ms
  FROM obs GROUP BY run_id, scenario_id, window_ms
),
want AS (SELECT run_id, cast(i AS bigint) AS slice_index FROM (SELECT run_id, unnest(generate_series(0, {SLICES - 1})) AS i FROM run) s),
gaps AS (
  SELECT want.run_id, want.slice_index FROM want LEFT JOIN (SELECT DISTINCT run_id, slice_index FROM obs) o
    ON want.run_id = o.run_id AND want.slice_index = o.slice_index WHERE o.run_id IS NULL
),
missing AS (SELECT run_id, coalesce(string_agg(cast(slice_index as varchar), ',' order by slice_index), '') AS missing FROM gaps GROUP BY run_id),
kinds AS (SELECT run_id, error_kind, count(*) AS n FROM obs WHERE NOT ok GROUP BY run_id, error_kind),
errors AS (SELECT run_id, coalesce(string_agg(concat(error_kind, '=', cast(n as varchar)), ',' order by error_kind), '') AS errors FROM kinds GROUP BY run_id)"""

_EXACT = ", ".join(
    f"cast(coalesce(min(CASE WHEN rn >= greatest(cast(ceil(cast(inside as double) * cast({q} as double)) as bigint), 1) AND latency_ms <= {OVERFLOW} THEN latency_ms END), 0) AS bigint) AS {name}"
    for q, name in (("0.5", "p50_ms"), ("0.95", "p95_ms"), ("0.99", "p99_ms"))
)

QUERIES = {
    # per-slice result: overflow observations count, but not in the quantiles
    "slice_metrics": f"""WITH {OBSERVED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, slice_index ORDER BY latency_ms, event_id) AS rn,
         sum(CASE WHEN latency_ms <= {OVERFLOW} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, slice_index) AS inside FROM obs)
SELECT run_id, slice_index, {COUNTS}, {_EXACT} FROM ranked GROUP BY run_id, slice_index""",
    "step_metrics": f"WITH {OBSERVED} SELECT scenario_id, slice_index % 3 AS step, {COUNTS} FROM obs GROUP BY scenario_id, slice_index % 3",
    "error_breakdown": f"WITH {OBSERVED} SELECT scenario_id, error_kind, cast(count(*) AS bigint) AS n FROM obs WHERE NOT ok GROUP BY scenario_id, error_kind",
    "latency_histogram": f"""WITH {OBSERVED}, {BOUND_ROWS}, h AS (SELECT scenario_id, {BUCKET} AS bound_ms, count(*) AS n FROM obs GROUP BY scenario_id, {BUCKET}),
every AS (SELECT scenario_id, bound_ms FROM (SELECT DISTINCT scenario_id FROM h) s CROSS JOIN bounds)
SELECT e.scenario_id, e.bound_ms, cast(coalesce(h.n, 0) AS bigint) AS n FROM every e LEFT JOIN h ON e.scenario_id = h.scenario_id AND coalesce(e.bound_ms, -1) = coalesce(h.bound_ms, -1)""",
    "histogram_merge": f"""WITH {OBSERVED}, part AS (SELECT run_id, slice_index, {BUCKET} AS bound_ms, count(*) AS n FROM obs GROUP BY run_id, slice_index, {BUCKET})
SELECT run_id, cast(bound_ms AS bigint) AS bound_ms, cast(sum(n) AS bigint) AS n, cast(count(*) AS bigint) AS slices FROM part GROUP BY run_id, bound_ms""",
    "run_quantiles": f"WITH {OBSERVED}, {HISTOGRAM} SELECT * FROM quant",
    "run_summary": f"""WITH {OBSERVED}, {HISTOGRAM}, {MERGED}
SELECT run.run_id, scenario_id, cast({SLICES} AS bigint) AS expected_slices, received AS received_slices, coalesce(missing, '') AS missing_slices, total, success, failure,
       CASE WHEN received = {SLICES} THEN 'Complete' ELSE 'TimedOut' END AS status, p50_ms, p95_ms, p99_ms, coalesce(errors, '') AS error_breakdown, first_ms, last_ms,
       concat(run.run_id, ':summary:r1:', CASE WHEN received = {SLICES} THEN 'complete' ELSE 'timed-out' END) AS event_id
FROM run JOIN quant ON run.run_id = quant.run_id LEFT JOIN missing ON run.run_id = missing.run_id LEFT JOIN errors ON run.run_id = errors.run_id""",
    "run_summary_long": f"""WITH {OBSERVED}, {HISTOGRAM} SELECT run_id, cast(bound_ms AS bigint) AS bound_ms, cast(max(c) AS bigint) AS up_to, cast(max(total) AS bigint) AS total FROM cum GROUP BY run_id, bound_ms""",
    "missing_slices": f"WITH {OBSERVED}, {MERGED} SELECT run_id, slice_index FROM gaps",
    # open runs by deadline, oldest first: a scan with a limit is the feature
    "due_runs": f"WITH {OBSERVED}, {MERGED} SELECT run_id, last_ms + 60000 AS deadline_ms FROM run WHERE received < {SLICES} OR total < 100 ORDER BY 2, 1 LIMIT 50",
    # a timed-out run that its last slice completes later gets revision 2
    "summary_latest_revision": f"""WITH {OBSERVED}, first AS (SELECT run_id, slice_index, min(at_ms) AS at_ms FROM obs GROUP BY run_id, slice_index),
log AS (
  SELECT run_id, 1 AS revision, 'TimedOut' AS status, count(*) AS received FROM first WHERE at_ms % 86400000 < 43200000 GROUP BY run_id
  UNION ALL SELECT run_id, 2, 'Complete', count(*) FROM first GROUP BY run_id HAVING count(*) = {SLICES}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY revision DESC) AS rn FROM log)
SELECT run_id, cast(revision AS bigint) AS revision, status, cast(received AS bigint) AS received FROM ranked WHERE rn = 1""",
    "drop_ratio": f"""WITH {OBSERVED}, r AS (SELECT scenario_id, {COUNTS}, max(at_ms) - min(at_ms) AS elapsed FROM obs GROUP BY scenario_id)
SELECT scenario_id, CASE WHEN total = 0 THEN cast(1 AS double) ELSE cast(1 AS double) - cast(success as double) / total END AS drop_ratio, cast(total as double) / greatest(cast(elapsed as double) / 1000, cast(0.001 as double)) AS per_second FROM r""",
    "distinct_scenarios": f"WITH {OBSERVED} SELECT DISTINCT scenario_id FROM obs",
    "worker_union": f"WITH {OBSERVED} SELECT scenario_id, {COUNTS} FROM obs GROUP BY scenario_id",
}
