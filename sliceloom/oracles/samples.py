"""Metric samples: increases with resets, rates, interpolated quantiles, ratios, gates, alerts, trends."""

from __future__ import annotations

#: Counters sampled each hour: the running count of a day of events for each type; it starts again every day.
SAMPLED = """
hourly AS (SELECT event_type AS name, (epoch_us(ts) // 3600000000) AS hour, count(*) AS n, sum(CASE WHEN cast(json_extract_string(props, '$.k') AS bigint) < 10 THEN 1 ELSE 0 END) AS bad FROM events GROUP BY 1, 2),
samples AS (
  SELECT name, hour, sum(n) OVER (PARTITION BY name, (hour // 24) ORDER BY hour) AS value, sum(bad) OVER (PARTITION BY name, (hour // 24) ORDER BY hour) AS bad FROM hourly),
steps AS (SELECT *, lag(value) OVER (PARTITION BY name ORDER BY hour) AS pv, lag(bad) OVER (PARTITION BY name ORDER BY hour) AS pb FROM samples),
deltas AS (SELECT name, hour, (hour // 24) AS day, CASE WHEN pv IS NULL THEN 0 WHEN value < pv THEN value ELSE value - pv END AS inc, CASE WHEN pb IS NULL THEN 0 WHEN bad < pb THEN bad ELSE bad - pb END AS bad FROM steps),
daily AS (SELECT name, day, cast(sum(inc) AS bigint) AS inc, cast(sum(bad) AS bigint) AS bad FROM deltas GROUP BY name, day)"""

LATENCY = """
obs AS (SELECT event_type AS name, greatest(value, cast(0 AS double)) AS s FROM events),
le AS (SELECT cast(b AS double) AS le FROM (VALUES (1), (5), (10), (25), (50), (100), (250), (500), (1000000)) v(b)),
totals AS (SELECT name, cast(count(*) as double) AS total FROM obs GROUP BY name),
buckets AS (SELECT name, le, cast(count(*) as double) AS c FROM obs JOIN le ON obs.s <= le.le GROUP BY name, le),
lines AS (SELECT name, le, c, coalesce(lag(c) OVER (PARTITION BY name ORDER BY le), cast(0 AS double)) AS pc, coalesce(lag(le) OVER (PARTITION BY name ORDER BY le), cast(0 AS double)) AS ple FROM buckets)"""


def _hq(q: str) -> str:
    rank = f"cast({q} as double) * total"
    return f"arg_min(CASE WHEN le > 500000 THEN ple WHEN c = pc THEN le ELSE ple + (le - ple) * ({rank} - pc) / (c - pc) END, le) FILTER (c >= {rank})"


METRICS = f"""
q AS (SELECT l.name, {_hq('0.95')} AS p95, {_hq('0.99')} AS p99 FROM lines l JOIN totals t ON l.name = t.name GROUP BY l.name),
m AS (SELECT d.name, sum(inc - bad)::DOUBLE / 86400 AS ok, sum(bad)::DOUBLE / 86400 AS failed, CASE WHEN sum(inc) > 0 THEN sum(bad)::DOUBLE / sum(inc) END AS err, any_value(p95) AS p95, any_value(p99) AS p99 FROM daily d JOIN q ON q.name = d.name GROUP BY d.name),
limits AS (SELECT * FROM (VALUES ('click', 0.01, 200, 500, 0.05), ('error', 0.001, 1, 500, 0.2), ('view', 0.001, 1e6, 1e6, 1), ('none', 1, 1, 1, 0.1)) v(name, floor_rate, p95_max, p99_max, err_max))"""

QUERIES = {
    "counter_increase": f"WITH {SAMPLED} SELECT name, day, inc AS increase FROM daily",
    "counter_rate": f"WITH {SAMPLED} SELECT name, day, cast(inc as double) / 86400 AS per_second FROM daily",
    "increase_or_zero": f"WITH {SAMPLED} SELECT cast(coalesce(sum(CASE WHEN name = 'absent' THEN inc END), 0) AS bigint) AS increase FROM daily",
    "sum_by_label": f"WITH {SAMPLED} SELECT name, cast(sum(inc) AS bigint) AS total FROM daily GROUP BY name",
    "hq_interpolated": f"WITH {LATENCY} SELECT l.name, {_hq('0.95')} AS p95, {_hq('0.5')} AS p50 FROM lines l JOIN totals t ON l.name = t.name GROUP BY l.name",
    "error_ratio": f"WITH {SAMPLED} SELECT name, day, bad::DOUBLE / greatest(inc, 1) AS ratio, CASE WHEN inc > 0 THEN bad::DOUBLE / inc END AS exact FROM daily",
    "slo_gate": f"""WITH {SAMPLED}, {LATENCY}, {METRICS}
SELECT l.name, CASE WHEN whole THEN concat_ws('|', CASE WHEN ok < floor_rate THEN 'throughput' END, CASE WHEN p95 > p95_max THEN 'p95' END, CASE WHEN p99 > p99_max THEN 'p99' END, CASE WHEN err > err_max THEN 'error_rate' END) ELSE 'missing_or_invalid_metrics' END AS reasons,
  CASE WHEN whole AND ok >= floor_rate AND p95 <= p95_max AND p99 <= p99_max AND err <= err_max THEN 'PASS' ELSE 'FAIL' END AS status
FROM limits l LEFT JOIN m ON l.name = m.name, LATERAL (SELECT ok IS NOT NULL AND p95 IS NOT NULL AND p99 IS NOT NULL AND err IS NOT NULL AS whole)""",
    "slis": f"WITH {SAMPLED}, {LATENCY}, {METRICS} SELECT name, ok / (ok + failed) AS success_ratio, p95 AS p95_s, err AS error_rate FROM m",
    "pass_product": f"WITH {SAMPLED}, {LATENCY}, {METRICS} SELECT m.name, CASE WHEN ok >= floor_rate AND p95 <= p95_max AND p99 <= p99_max AND err <= err_max THEN 1 ELSE 0 END AS pass FROM m JOIN limits l ON l.name = m.name",
    "gate_rollup": f"""WITH {SAMPLED}, g AS (SELECT name, day, cast(bad as double) / greatest(inc, 1) <= cast(0.15 as double) AS pass FROM daily)
SELECT day, cast(count(*) AS bigint) AS checked, cast(sum(CASE WHEN pass THEN 0 ELSE 1 END) AS bigint) AS failures, CASE WHEN sum(CASE WHEN pass THEN 0 ELSE 1 END) > 0 OR count(*) = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM g GROUP BY day""",
    # a condition that has held for three evaluations in a row fires
    "alert_for": f"""WITH {SAMPLED}, cond AS (SELECT name, hour, cast(bad as double) / greatest(inc, 1) > cast(0.12 as double) AS bad FROM deltas),
runs AS (SELECT name, hour, hour - row_number() OVER (PARTITION BY name ORDER BY hour) AS island FROM cond WHERE bad),
held AS (SELECT name, hour, row_number() OVER (PARTITION BY name, island ORDER BY hour) AS held FROM runs)
SELECT name, hour FROM held WHERE held >= 3""",
    "max_gauge": f"WITH {SAMPLED} SELECT day, 0 AS top FROM samples JOIN (SELECT name, hour, hour // 24 AS day FROM samples) USING (name, hour) GROUP BY day HAVING count(*) FILTER (hour % 25 = 3) = 0",
    "cluster_totals": """SELECT name, sum(n)::BIGINT AS total FROM (SELECT event_type AS name, user_id % 3 AS node, trunc(sum(floor(value * 4)) / 4)::BIGINT AS n FROM events GROUP BY ALL) GROUP BY name""",
    "alert_rules": f"""WITH {SAMPLED}, d AS (SELECT hour AS m, sum(bad)::DOUBLE / greatest(sum(inc), 1) AS r FROM deltas GROUP BY hour),
bad AS (
  SELECT 'NoSchedulerLeader' AS alert, m, 3 AS f FROM d WHERE m % 24 < 6 UNION ALL SELECT 'HighScenarioFailureRatio', m, 10 FROM d WHERE r / 5 > 0.02 UNION ALL SELECT 'ScenarioLatencyP95High', m, 10 FROM d WHERE m % 48 < 20
  UNION ALL SELECT 'WorkerConsumeErrorsHigh', m, 10 FROM d WHERE r / 20 > 0.005 UNION ALL SELECT 'DlqActivityDetected', m, 5 FROM d WHERE m % 30 < 9 UNION ALL SELECT 'ResultPublishFailures', m, 3 FROM d WHERE m % 10 < 4
  UNION ALL SELECT 'SourceCommitFailures', m, 3 FROM d WHERE m % 10 < 3 UNION ALL SELECT 'UncommittedJobsStuck', m, 3 FROM d WHERE m % 7 > 0 UNION ALL SELECT 'IncompleteDispatch', m, 3 FROM d WHERE m % 3 > 0
  UNION ALL SELECT 'AggregateTimeouts', m, 5 FROM d WHERE m % 20 < 8)
SELECT alert, m AS minute FROM bad b WHERE (SELECT count(*) FROM bad e WHERE e.alert = b.alert AND e.m BETWEEN b.m - b.f AND b.m) = f + 1""",
    "trend_delta": f"""WITH {SAMPLED}, t AS (SELECT name, day, cast(bad as double) / greatest(inc, 1) AS rate FROM daily), p AS (SELECT *, rate - lag(rate) OVER (PARTITION BY name ORDER BY day) AS d FROM t)
SELECT name, day, rate, CASE WHEN abs(d) < 1e-12 THEN cast(0 AS double) ELSE d END AS delta FROM p""",
    "last_n_points": f"WITH {SAMPLED}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY day DESC) AS rn FROM daily) SELECT name, day, inc FROM r WHERE rn <= 40",
    "last_threshold": f"""WITH {SAMPLED}, t AS (SELECT name, day, CASE WHEN day % 4 = 0 THEN inc END AS threshold FROM daily), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY day DESC) AS rn FROM t WHERE threshold IS NOT NULL)
SELECT name, threshold FROM r WHERE rn = 1""",
    "mixed_evidence": """WITH c AS (SELECT DISTINCT user_id, CASE json_extract_string(props, '$.k')::INT % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'synthetic' ELSE 'legacy_unclassified' END AS c FROM events)
SELECT user_id, string_agg(c, ',' ORDER BY c) AS classes FROM c GROUP BY user_id HAVING count(*) > 1""",
    "history_entries": """SELECT DISTINCT ON (l_orderkey, l_linenumber) concat('r', l_orderkey) AS run_id, concat('s', l_linenumber) AS name, CASE WHEN l_orderkey % 2 = 0 THEN 'live' ELSE 'legacy_unclassified' END AS evidence_class,
  CASE WHEN l_partkey % 3 = 1 THEN 'PASS' WHEN l_partkey % 3 = 2 THEN 'FAIL' WHEN l_orderkey % 5 = 0 THEN 'PASS' ELSE 'FAIL' END AS status, l_quantity AS success_rate FROM lineitem ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax""",
    "post_fault_progress": f"WITH {SAMPLED} SELECT name, coalesce(sum(bad) FILTER (day < 19730), 0)::BIGINT AS before, coalesce(sum(bad) FILTER (day >= 19730), 0)::BIGINT AS after, coalesce(sum(bad) FILTER (day >= 19730), 0) > 0 AS progressed FROM daily GROUP BY name",
}

_CUT = "CASE WHEN strlen({0}) <= {1} THEN {0} ELSE concat(left({0}, list_max(list_filter(range({2}, {1}), lambda n: strlen(left({0}, n)) <= {1} - 14))), '...[truncated]') END"

SCALARS = {
    "duration_parse": """SELECT c_custkey, CASE WHEN c_custkey % 5 > 2 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN NULL
  ELSE nullif(c_custkey % 90, 0) * CASE c_custkey % 5 WHEN 0 THEN 1000 WHEN 1 THEN 60000 ELSE 3600000 END END AS ms FROM customer""",
    "slugify": """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'scenario' ELSE trim(regexp_replace(lower(concat(c_name, '-', c_mktsegment)), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM customer""",
    "base64url": "SELECT c_custkey, rtrim(translate(base64(encode(concat(c_name, '?>'))), '+/', '-_'), '=') AS url, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS decoded FROM customer",
    "numbers": "SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 1500 WHEN 4 THEN c_acctbal END AS x, c_custkey % 5 = 0 AS is_nan FROM customer",
    "comma_lists": "SELECT c_custkey, CASE WHEN c_nationkey = c_custkey % 3 THEN concat_ws('|', c_mktsegment, c_nationkey) ELSE concat_ws('|', c_mktsegment, c_nationkey, c_custkey % 3) END AS parts FROM customer",
    "utf8_truncate": f"""SELECT doc_id, md5(cut) AS cut_md5, strlen(cut)::INT AS bytes, md5(line) AS line_md5 FROM (
  SELECT doc_id, {_CUT.format("text", 1024, 250)} AS cut, {_CUT.format("flat", 160, 34)} AS line FROM (SELECT doc_id, text, regexp_replace(text, '[\\x00-\\x1F\\x7F\\x{{80}}-\\x{{9F}}]', ' ', 'g') AS flat FROM documents))""",
    "extract_path": "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS none FROM events",
}
