"""What hashes, codecs and the run state machine must give, in DuckDB's wide integers and windows."""

from __future__ import annotations

_BYTES = "list_transform(string_split({0}, ''), lambda c: ord(c)::HUGEINT)"
# the product with 2^88 + 315 in two halves of 64 bits
_FNV = """list_reduce(list_prepend({{'hi': 7809847782465536322::HUGEINT, 'lo': 7113472399480571277::HUGEINT}}, list_transform(string_split({0}, ''), lambda c: {{'hi': 0::HUGEINT, 'lo': ord(c)::HUGEINT}})),
  lambda a, b: {{'hi': (a.hi * 315 + xor(a.lo, b.lo) * 315 // 18446744073709551616 + xor(a.lo, b.lo) * 16777216) % 18446744073709551616, 'lo': xor(a.lo, b.lo) * 315 % 18446744073709551616}})"""
_VARINT = "CASE WHEN {0} < 128 THEN printf('%02X', {0}) WHEN {0} < 16384 THEN printf('%02X%02X', {0} % 128 + 128, {0} // 128) ELSE printf('%02X%02X%02X', {0} % 128 + 128, {0} // 128 % 128 + 128, {0} // 16384) END"

_RUNS = """
WITH d AS (
  SELECT l_orderkey AS run, l_linenumber - 1 AS i, l_quantity::BIGINT AS total, round(l_discount * 10)::BIGINT AS failure, total - failure AS success, epoch_us(l_shipdate) // 1000 AS at_ms,
         concat(run, ':', i, CASE WHEN l_partkey % 20 = 0 THEN ':other' ELSE '' END) AS key FROM lineitem),
f AS (SELECT *, row_number() OVER o AS rn, first_value(key) OVER o AS first_key FROM d WINDOW o AS (PARTITION BY run, i ORDER BY at_ms, key, total, success)),
w AS (SELECT *, min(at_ms) OVER (PARTITION BY run) AS t0, count(*) OVER (PARTITION BY run) = 7 AS every_slice FROM f WHERE rn = 1),
-- what comes after a deadline is in no summary unless it completes the run
v AS (SELECT * FROM w WHERE every_slice OR at_ms < t0 + 34560000000),
r AS (
  SELECT run, count(*) AS received, sum(total)::BIGINT AS total, sum(success)::BIGINT AS success, sum(failure)::BIGINT AS failure, min(at_ms) AS first_ms, max(at_ms) AS last_ms, sum(total // 2)::BIGINT AS b1, sum(total // 40)::BIGINT AS b3,
         list(i) AS got, count(*) = 7 AS whole, count(*) = 7 AND max(at_ms) >= min(at_ms) + 34560000000 AS late FROM v GROUP BY run),
s AS (SELECT *, CASE WHEN late THEN 2 ELSE 1 END AS revision, CASE WHEN whole THEN 'Complete' ELSE 'TimedOut' END AS status, concat(run, ':summary:r', CASE WHEN late THEN 2 ELSE 1 END, ':', CASE WHEN whole THEN 'complete' ELSE 'timed-out' END) AS event_id FROM r)
"""


def _p(q: str) -> str:
    return f"CASE WHEN total = 0 THEN 0 WHEN b1 >= greatest(ceil(total * {q}::DOUBLE), 1) THEN 10 ELSE 50 END::BIGINT"


QUERIES = {
    "fnv_fingerprint": f"SELECT c_custkey, concat('fnv128:', lpad(lower(hex(h.hi::UBIGINT)), 16, '0'), lpad(lower(hex(h.lo::UBIGINT)), 16, '0')) AS fingerprint FROM (SELECT c_custkey, {_FNV.format("concat(c_name, '|', c_mktsegment)")} AS h FROM customer)",
    "template_render": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'error: missing context variable absent' ELSE concat('{"to": "', c_name, '", "via": ["', c_mktsegment, '", 1, null]}') END AS rendered FROM customer""",
    "retry_delay": f"""SELECT c_custkey, least(least(500000 * 2::BIGINT ** least(a, 16), 60000000)::BIGINT * 1000 * (8000 + h % 4001) // 10000, 60000000000)::BIGINT // 1000 AS delay_us
FROM (SELECT c_custkey, c_custkey % 20 AS a, list_reduce(list_prepend((c_custkey % 20 + 2654435769)::HUGEINT, {_BYTES.format("c_name")}), lambda s, b: (s * 1099511628211 + b) % 18446744073709551616) AS h FROM customer)""",
    "protobuf_roundtrip": f"""SELECT c_custkey, concat('08', {_VARINT.format("c_custkey")}, '12', {_VARINT.format("strlen(c_name)")}, hex(c_name), '1A', {_VARINT.format("(strlen(t) // 2)")}, t) AS wire,
  concat('{{"id":', c_custkey, ',"name":"', c_name, '","tags":[', c_custkey, ',', -c_custkey, ']}}') AS message
FROM (SELECT *, concat({_VARINT.format("(2 * c_custkey)")}, {_VARINT.format("greatest(2 * c_custkey - 1, 0)")}) AS t FROM customer)""",
    "plan_fingerprints": "SELECT scenario_id, true AS formed, true AS own FROM (SELECT concat('customer-', c_custkey) AS scenario_id FROM customer UNION ALL SELECT unnest(['a', 'b', 'c', 'd', 'e']))",
    "stream_run_summary": _RUNS + f"""SELECT run::VARCHAR AS run_id, event_id, concat('s', run % 5) AS scenario_id, revision, status, received, array_to_string(list_filter([0, 1, 2, 3, 4, 5, 6], lambda x: NOT list_contains(got, x)), ',') AS missing,
  total, success, failure, {_p("0.5")} AS p50_ms, {_p("0.95")} AS p95_ms, {_p("0.99")} AS p99_ms, concat('10=', b1, ',50=', total - b1 - b3, ',18446744073709551615=', b3) AS histogram, CASE WHEN failure > 0 THEN concat('target_timeout=', failure) ELSE '' END AS errors, first_ms, last_ms FROM s""",
    "stream_poison": _RUNS + "SELECT run::VARCHAR AS run_id, 'conflict' AS outcome, count(*) AS n FROM f WHERE key <> first_key GROUP BY run",
    "summary_outbox": _RUNS + """, t AS (SELECT run, revision, event_id, CASE WHEN whole THEN last_ms ELSE coalesce((SELECT min(at_ms) FROM d WHERE d.run = s.run AND at_ms >= first_ms + 34560000000), 4000000000000) END AS final FROM s)
SELECT run::VARCHAR AS run_id, event_id, revision FROM t WHERE NOT (run % 3 = 0 AND revision = 1 AND run IN (SELECT o_orderkey FROM orders)) ORDER BY final, run::VARCHAR LIMIT 200""",
}
