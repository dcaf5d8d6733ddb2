"""From scenario rows to slices, schedules, identities and retries."""

from __future__ import annotations

#: (scenario, rate, concurrency, duration ms, burst); each customer is a scenario of its own besides.
SCENARIOS = """
scen AS (
  SELECT * FROM (VALUES ('a', cast(0.1 AS double), 1, 10000, 0), ('b', cast(9.9 AS double), 2, 1000, 1), ('c', cast(20 AS double), 3, 100, 3),
                        ('d', cast(200.5 AS double), 73, 1000, 10), ('e', cast(1000 AS double), 256, 1000, 256)) v(scenario_id, rate, concurrency, duration_ms, burst)
  UNION ALL
  SELECT concat('customer-', cast(c_custkey AS string)), cast(c_custkey % 2000 + 1 AS double) / 4, cast(c_custkey % 97 + 1 AS int), cast((c_custkey % 60 + 1) * 500 AS int), cast(c_custkey % 7 % (c_custkey % 97 + 1) AS int) FROM customer
)"""
COUNTED = """
counted AS (
  SELECT *, cast(CASE WHEN rate <= 0 OR concurrency <= 0 OR duration_ms <= 0 THEN 1 ELSE
    least(greatest(cast(ceil(rate / 10) as bigint), cast(ceil(cast(concurrency as double) / 25) as bigint), 1), cast(concurrency AS bigint), greatest(cast(floor(rate * cast(duration_ms as double) / 1000) as bigint), 1), 128) END AS bigint) AS slices
  FROM scen
)"""
FANNED = """
fanned AS (SELECT *, cast(i AS bigint) AS slice_index FROM (SELECT *, unnest(generate_series(0, slices - 1)) AS i FROM counted) f)"""
SPLIT = """
split AS (
  SELECT scenario_id, slice_index, slices, rate / slices AS rate, duration_ms, (concurrency // slices) + CASE WHEN slice_index < concurrency % slices THEN 1 ELSE 0 END AS concurrency,
         (burst // slices) + CASE WHEN slice_index < burst % slices THEN 1 ELSE 0 END AS burst
  FROM fanned
)"""

QUERIES = {
    "slice_count": f"WITH {SCENARIOS}, {COUNTED} SELECT scenario_id, slices FROM counted",
    "slice_plan": f"WITH {SCENARIOS}, {COUNTED}, {FANNED}, {SPLIT} SELECT scenario_id, slice_index, slices, rate, cast(concurrency AS bigint) AS concurrency, cast(burst AS bigint) AS burst FROM split",
    "slice_conservation": f"""WITH {SCENARIOS}, {COUNTED}, {FANNED}, {SPLIT}
SELECT scenario_id, cast(sum(concurrency) AS bigint) AS concurrency, cast(sum(burst) AS bigint) AS burst FROM split GROUP BY scenario_id""",
    "job_rows": f"""WITH {SCENARIOS}, {COUNTED}, {FANNED}, {SPLIT}, w AS (
  SELECT *, format('v2:s{{}}:{{}}:w1700000000000:n{{}}', strlen(scenario_id), scenario_id, slices) AS run_id, format('slice-{{}}-of-{{}}', slice_index, slices) AS part FROM split)
SELECT scenario_id, run_id, concat(run_id, ':', part) AS execution_key, concat(run_id, ':', part, ':attempt-0:result') AS event_id, concat(scenario_id, ':1700000000000:', part) AS legacy_key,
       concat('v2:', scenario_id, ':1700000000000') AS versioned_run, CASE WHEN slices > 1 THEN concat(run_id, ':', part) ELSE scenario_id END AS partition_key, rate, concurrency::BIGINT AS concurrency, burst::BIGINT AS burst,
       0 AS attempt, 2 AS max_retries, true AS id_fits FROM w""",
    # the longest identity is the event of the last slice: v2:s<bytes>:<name>:w<39 digits>:n128 and :slice-127-of-128:attempt-32:result
    "identity_budget": """SELECT c_custkey, c_custkey % 50 <> 0 AND n > 0 AND strlen(concat('v2:s', n, '::w:n128:slice-127-of-128:attempt-32:result')) + n + 39 <= 1024 AS fits
FROM (SELECT c_custkey, c_custkey % 1100 * CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM customer)""",
    # token k at (k + 0.5) / rate, or with a burst b: b at 0, then every 1 / rate; only while before the end
    "pacing_schedule": f"""WITH {SCENARIOS}, {COUNTED}, {FANNED}, {SPLIT}, t AS (
  SELECT scenario_id, slice_index, rate, burst, duration_ms, cast(k AS bigint) AS k FROM (SELECT *, unnest(generate_series(0, cast(ceil(rate * duration_ms / 1000) as bigint) + burst)) AS k FROM split) s)
SELECT scenario_id, slice_index, k, CASE WHEN burst = 0 THEN (k + cast(0.5 as double)) / rate WHEN k < burst THEN cast(0 AS double) ELSE (k - burst + 1) / rate END AS at_s
FROM t WHERE CASE WHEN burst = 0 THEN (k + cast(0.5 as double)) / rate WHEN k < burst THEN cast(0 AS double) ELSE (k - burst + 1) / rate END < cast(duration_ms as double) / 1000""",
    "zero_start": f"WITH {SCENARIOS} SELECT scenario_id, burst = 0 AND rate * duration_ms / 1000 < 1 AS to_dlq FROM scen",
    "dispatch_windows": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 5 + 1) * 60000 END AS every_ms, epoch_us(o_orderdate) // 1000 AS from_ms FROM orders)
SELECT o_orderkey, from_ms + coalesce(every_ms, 0) * i AS scheduled_ms, from_ms + every_ms * (i + 1) AS next_ms FROM (SELECT *, unnest(generate_series(0, coalesce(3600000 // every_ms, 0))) AS i FROM o)""",
    "active_window_guard": """SELECT k AS o_orderkey, CASE WHEN (k % 31 = 0) <> ((k + 1) % 31 = 0) THEN 'contract_version' WHEN (k % 29 = 0) <> ((k + 1) % 29 = 0) THEN 'slices' WHEN (k % 23 = 0) <> ((k + 1) % 23 = 0) THEN 'repeat_ms'
  WHEN (k % 19 = 0) <> ((k + 1) % 19 = 0) THEN 'fingerprint' END AS fault FROM (SELECT o_orderkey AS k FROM orders)""",
    "unacked_slices": """SELECT run_id, slice_index FROM (SELECT o_orderkey AS run_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS slice_index FROM orders) w WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = run_id AND l_linenumber = slice_index + 1)""",
    "retry_rows": """SELECT o_orderkey, o_orderkey % 5 + 1 AS attempt, CASE WHEN o_orderkey % 5 >= o_orderkey % 4 THEN 'dlq' ELSE 'retry' END AS disposition, CASE WHEN o_orderkey % 5 < o_orderkey % 4 THEN true END AS jittered FROM orders""",
    "startup_limits": f"""WITH {SCENARIOS} SELECT scenario_id, concat_ws(',', CASE WHEN NOT (rate > 0 AND rate <= 400) THEN 'rate' END, CASE WHEN NOT concurrency BETWEEN 1 AND 90 THEN 'concurrency' END, CASE WHEN NOT duration_ms BETWEEN 1 AND 25000 THEN 'duration' END,
  CASE WHEN concurrency % 3 = 0 AND duration_ms > 10000 THEN 'repeat' END, CASE WHEN burst > concurrency THEN 'burst' END, CASE WHEN burst = 0 AND rate * duration_ms < 1000 THEN 'starts_nothing' END) AS faults FROM scen""",
    # a scenario without burst in a slice, and with one in another, has the same load rule
    "plan_drift": f"""WITH {SCENARIOS}, {COUNTED}, {FANNED}, j AS (
  SELECT *, strlen(scenario_id) * 101 + slice_index * 37 + duration_ms // 100 AS h FROM fanned WHERE scenario_id <> 'a')
SELECT scenario_id, slice_index, CASE WHEN h % 19 = 0 THEN 'retries' WHEN h % 11 = 0 THEN NULL WHEN h % 17 = 0 OR h % 13 = 0 THEN 'load' WHEN h % 23 = 0 THEN 'fingerprint' END AS fault FROM j""",
    "step_endpoints": """SELECT n_nationkey, resolved, r_name AS gateway, r_name IS NOT NULL AS configured FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 4 ELSE 1 END AS h, concat('http://h', h) AS resolved FROM nation)
  LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 3) ON r_regionkey = h""",
    "step_material": """SELECT s_suppkey, concat('grpc|endpoint=', CASE WHEN s_suppkey % 2 = 0 THEN 'http://other' ELSE '<default>' END, '|service=demo.Echo|method=Get|request=', CASE WHEN s_suppkey % 5 = 0 THEN concat('base64:', base64(encode(s_name))) ELSE 'empty' END,
  '|extract=', CASE WHEN s_suppkey % 3 > 0 THEN array_to_string(list_sort(['z=a.b', concat(s_name, '=c'), concat('k', s_suppkey % 7, '=d')]), ',') ELSE '' END, '|payload_key=', CASE WHEN s_suppkey % 4 = 0 THEN 'body' ELSE '' END) AS material FROM supplier""",
    "deferral_guard": """SELECT o_orderkey, CASE WHEN wait_ms <= 0 THEN 'run' WHEN wait_ms > 600000 THEN 'dlq' ELSE 'defer' END AS action, greatest(wait_ms, cast(0 AS bigint)) AS wait_ms
FROM (SELECT o_orderkey, o_orderkey % 1300 * 1000 - 300000 AS wait_ms FROM orders) o""",
}
