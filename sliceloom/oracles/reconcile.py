"""Reconciliation: what was dispatched against what arrived, and the order in which it did."""

from __future__ import annotations

FLOW = """
jobs AS (SELECT o_orderkey AS key, epoch_us(o_orderdate) AS at_us, o_orderpriority AS scenario_id FROM orders),
arrived AS (SELECT l_orderkey AS key, l_linenumber AS n, epoch_us(l_shipdate) AS at_us, l_partkey AS part, l_suppkey AS supp, l_quantity AS quantity, l_extendedprice AS price FROM lineitem)"""

QUERIES = {
    "job_result_anti": f"WITH {FLOW} SELECT key, scenario_id FROM jobs WHERE NOT EXISTS (SELECT 1 FROM arrived a WHERE a.key = jobs.key)",
    "result_job_anti": f"WITH {FLOW} SELECT DISTINCT key FROM arrived WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.key = arrived.key)",
    "multiset_diff": f"""WITH {FLOW}, consumed AS (SELECT key, n FROM arrived WHERE part % 50 <> 1), committed AS (SELECT key, n FROM arrived WHERE part % 50 <> 0)
SELECT key, n, 1 * count(*) AS copies FROM (SELECT * FROM consumed EXCEPT ALL SELECT * FROM committed) GROUP BY ALL UNION ALL SELECT key, n, -1 * count(*) FROM (SELECT * FROM committed EXCEPT ALL SELECT * FROM consumed) GROUP BY ALL""",
    # of a key's deliveries before the order's deadline, the earliest
    "earliest_preceding": f"""WITH {FLOW}, m AS (
  SELECT j.key, a.n, a.at_us, row_number() OVER (PARTITION BY j.key ORDER BY a.at_us, a.n, a.part, a.supp) AS rn FROM jobs j JOIN arrived a ON a.key = j.key AND a.at_us <= j.at_us + 86400000000 * 400)
SELECT key, n, at_us FROM m WHERE rn = 1""",
    "delivery_index": f"""WITH {FLOW}, r AS (SELECT key, n, at_us, part, supp, quantity, price, row_number() OVER (PARTITION BY key, n ORDER BY at_us, part, supp, quantity, price) AS rn FROM arrived)
SELECT key, n, at_us, part, supp, cast(rn AS bigint) AS delivery, rn > 1 AS redelivered FROM r""",
    "positional_match": f"""WITH {FLOW}, a AS (SELECT key, at_us, part, row_number() OVER (PARTITION BY key ORDER BY at_us, part, supp, n, price) AS rn FROM arrived WHERE n % 2 = 1),
b AS (SELECT key, at_us, part, row_number() OVER (PARTITION BY key ORDER BY at_us, part, supp, n, price) AS rn FROM arrived WHERE n % 2 = 0)
SELECT a.key, cast(a.rn AS bigint) AS rn, a.part AS delivered, b.part AS committed, a.at_us <= b.at_us AS in_order FROM a JOIN b ON a.key = b.key AND a.rn = b.rn""",
    "event_coverage": f"WITH {FLOW} SELECT key, n, cast(count(*) AS bigint) AS times FROM arrived GROUP BY key, n HAVING count(*) <> 1",
    "ordered_chain": """WITH c AS (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS c, min(l_shipdate) AS t FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
p AS (SELECT k, max(c) FILTER (n = 1) AS c1, max(c) FILTER (n = 2) AS c2, max(c) FILTER (n = 3) AS c3, max(c) FILTER (n = 4) AS c4, min(t) FILTER (n = 1) AS t1, min(t) FILTER (n = 2) AS t2, min(t) FILTER (n = 3) AS t3, min(t) FILTER (n = 4) AS t4 FROM c GROUP BY k)
SELECT k AS execution_key, CASE WHEN c1 IS DISTINCT FROM 1 THEN 'job_consumed' WHEN c2 IS DISTINCT FROM 1 OR t2 < t1 THEN 'lease_acquired' WHEN c3 IS DISTINCT FROM 1 OR t3 < t2 THEN 'terminal_result' WHEN c4 IS DISTINCT FROM 1 OR t4 < t3 THEN 'source_committed' END AS fault FROM p""",
    "plan_lookup": """SELECT CASE WHEN c_custkey % 3 = 0 OR c_custkey IS NULL THEN 'unknown' ELSE c_mktsegment END AS endpoint, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "result_order": """SELECT o_orderpriority AS scenario_id, count(*) AS results, count(*) FILTER (l_shipdate < o_orderdate) AS early FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "summary_against_results": """SELECT l_orderkey AS run, count(*) AS summary_results, count(*) AS results_results, sum(l_quantity::BIGINT)::BIGINT + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS summary_total, sum(l_quantity::BIGINT)::BIGINT AS results_total
FROM lineitem WHERE l_orderkey % 7 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, NULL, count(*), NULL, sum(l_quantity::BIGINT)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey""",
    "consumer_lag": """WITH p AS (SELECT l_orderkey % 64 AS p, count(*) AS e, count(*) FILTER (l_partkey % 3 < 2 + l_orderkey % 2) AS c FROM lineitem GROUP BY 1),
q AS (SELECT p, e, CASE WHEN p % 9 <> 0 THEN CASE WHEN p % 2 = 0 THEN e ELSE c END END AS c FROM p)
SELECT p % 8 AS topic, sum(greatest(e - coalesce(c, 0), 0))::BIGINT AS lag, count(*) FILTER (CASE WHEN c IS NULL THEN e > 0 ELSE c < e END) = 0 AS caught_up FROM q GROUP BY 1""",
    "exactly_one_leader": """SELECT cluster, sum(s) = 1 AND max(s) <= 1 AS exactly_one FROM (SELECT n_regionkey AS cluster, n_nationkey % 3 AS node, count(*) FILTER (n_nationkey % 8 = 0) AS s FROM nation GROUP BY ALL) GROUP BY cluster""",
    "displayed_events": """SELECT CASE WHEN event_type = 'view' THEN 'target_success' ELSE event_type END AS kind, count(*) AS n FROM (SELECT event_type, event_id, json_extract_string(props, '$.k')::INT AS k FROM events)
WHERE event_type <> 'view' OR event_id % 10 = 0 OR k = 1 OR k % 6 = 0 GROUP BY 1""",
    "label_match": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3",
    "elapsed_from_origin": """SELECT event_id, epoch_us(ts) - coalesce(min(CASE WHEN event_type = 'signup' THEN epoch_us(ts) END) OVER (PARTITION BY user_id), min(epoch_us(ts)) OVER (PARTITION BY user_id)) AS elapsed_us FROM events""",
}
