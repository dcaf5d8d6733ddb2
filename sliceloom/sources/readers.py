"""Sources: scenario files, JSON lines, threshold tables, metric exposition text, logs, letters with a size guard."""

from __future__ import annotations

import base64
import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "struct<protocol: string, name: string, endpoint: string, service: string, method: string, request: string, extract: map<string,string>, payload_key: string>"
PLAN = f"scenario_id string, rate double, concurrency int, duration_ms long, burst int, every_ms long, endpoint string, strategy string, steps array<{STEP}>"
#: Fixed bounds of a scenario file.
SCENARIOS, NAME_BYTES, STEPS = 128, 256, 128
_UNIT = {"s": 1000, "m": 60_000, "h": 3_600_000}


def duration_ms(text: str) -> int:
    m = re.fullmatch(r"(\d+)([smh])", str(text).strip())
    if not m or not int(m[1]) or int(m[1]) * _UNIT[m[2]] >= 1 << 63:
        raise ValueError(f"bad duration {text!r}")
    return int(m[1]) * _UNIT[m[2]]


def _empty(value) -> bool:
    return value is not None and not str(value).strip()


def _step(step: dict) -> tuple[tuple, list[str]]:
    """A step as a row, and what is wrong with it."""
    kind = step.get("protocol", "grpc")
    allowed = {"grpc": {"protocol", "name", "endpoint", "service", "method", "request_base64", "request_fields", "extract", "response_payload_context_key"}, "http": {"protocol", "name", "method", "url"}}
    if kind not in allowed:
        return (), [f"unknown protocol {kind!r}"]
    faults = [f"unknown field {k}" for k in sorted(set(step) - allowed[kind])]
    if kind == "http":
        faults += [f"{k} must not be empty" for k in ("method", "url") if not str(step.get(k) or "").strip()]
        return (kind, step.get("name"), step.get("url"), None, step.get("method"), None, None, None), faults
    faults += [f"{k} must not be empty" for k in ("service", "method") if not str(step.get(k) or "").strip()]
    raw, fields, extract = step.get("request_base64"), step.get("request_fields"), step.get("extract") or {}
    faults += [f"{k} must not be empty when provided" for k in ("endpoint", "request_base64", "response_payload_context_key") if _empty(step.get(k))]
    if raw and "${" not in raw:
        try:
            base64.b64decode(raw, validate=True)
        except ValueError:
            faults.append("request_base64 must be base64")
    if raw is not None and fields is not None:
        faults.append("only one of request_base64 and request_fields")
    if fields is not None and not isinstance(fields, dict):
        faults.append("request_fields must be an object")
    faults += [f"extract {k!r}: key and path must not be empty" for k, v in extract.items() if not str(k).strip() or not str(v).strip()]
    request = f"base64:{raw}" if raw is not None else f"fields:{json.dumps(fields, separators=(',', ':'))}" if fields is not None else None
    return (kind, step.get("name"), step.get("endpoint"), step.get("service"), step.get("method"), request, {str(k): str(v) for k, v in extract.items()}, step.get("response_payload_context_key")), faults


def _scenario(s: dict, default_endpoint: str) -> tuple[tuple, list[str]]:
    allowed = {"name", "endpoint", "load", "repeat", "partition", "steps"}
    faults = [f"unknown field {k}" for k in sorted(set(s) - allowed)]
    name, load, repeat = str(s.get("name") or ""), s.get("load") or {}, s.get("repeat") or {"type": "once"}
    try:
        rate = float(load.get("rate", "nan"))
        concurrency, burst = int(load.get("concurrency") or 0), int(load.get("burst") or 0)
    except (TypeError, ValueError):
        return (name, None), [*faults, "load must be of numbers"]
    checks = (
        ("name is blank", not name.strip()), (f"name exceeds {NAME_BYTES} bytes", len(name.encode()) > NAME_BYTES), ("endpoint must not be empty when provided", _empty(s.get("endpoint"))),
        ("rate must be positive", not 0 < rate < float("inf")), ("concurrency must be positive", concurrency < 1), ("burst exceeds concurrency", burst > concurrency),
        ("repeat must be once or every", repeat.get("type") not in ("once", "every")), ("steps must not be empty", not s.get("steps")), (f"more than {STEPS} steps", len(s.get("steps") or []) > STEPS),
    )
    faults += [w for w, bad in checks if bad]
    times = {}
    for key, raw in (("duration", load.get("duration")), ("interval", repeat.get("every")) if repeat.get("type") == "every" else ("", None)):
        if key:
            try:
                times[key] = duration_ms(raw)
            except ValueError as e:
                faults.append(f"{key}: {e}")
    steps = []
    for j, step in enumerate(s.get("steps") or []):
        row, wrong = _step(step)
        steps.append(row)
        faults += [f"step {j}: {w}" for w in wrong]
    return (name, rate, concurrency, times.get("duration"), burst, times.get("interval"), s.get("endpoint") or default_endpoint, s.get("partition", "ExecutionKey"), steps), faults


def scenarios(spark: SparkSession, path: str, default_endpoint: str = "") -> DataFrame:
    """A scenario file, which holds at most 128 scenarios, as rows with their steps. All faults are reported together."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    doc = yaml.safe_load(text) or {}
    found = doc.get("scenarios") or []
    faults = [w for w, bad in (("version must be 1", doc.get("version") != 1), ("there are no scenarios", not found), (f"more than {SCENARIOS} scenarios", len(found) > SCENARIOS)) if bad]
    faults += [f"unknown field {k}" for k in sorted(set(doc) - {"version", "scenarios"})]
    rows = []
    for i, s in enumerate(found):
        row, wrong = _scenario(s, default_endpoint)
        rows.append(row)
        faults += [f"scenario {i}: {w}" for w in wrong]
    names = [r[0].strip() for r in rows]
    faults += [f"duplicate name {n}" for n in sorted({n for n in names if n and names.count(n) > 1})]
    if faults:
        raise ValueError("; ".join(faults))
    return spark.createDataFrame(rows, PLAN)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Strict: a bad line or a missing file ends the query. Lenient: bad lines are left out, a missing file is empty."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    except AnalysisException:
        if strict:
            raise
        return spark.createDataFrame([], schema)


def append_json_lines(rows: DataFrame, path: str) -> None:
    """Compact records behind those that are there."""
    rows.write.mode("append").json(path)


def evidence_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file of a bundle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    schema = "scenario string, throughput_floor double, p95_max_s double, p99_max_s double, error_rate_max double"
    return spark.read.schema(schema).csv(path, comment="#", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)


def exposition(spark: SparkSession, path: str) -> DataFrame:
    """name, labels, value of each sample line."""
    line = spark.read.text(path).where("value NOT LIKE '#%' AND trim(value) <> ''")
    pairs = F.regexp_extract("value", r"\{(.*)\}", 1)
    keys, values = (F.regexp_extract_all(pairs, F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), F.lit(i)) for i in (1, 2))
    number = F.regexp_extract("value", r"(\S+)\s*$", 1).try_cast("double")
    return line.select(F.regexp_extract("value", r"^([A-Za-z_:][\w:]*)", 1).alias("name"), F.map_from_arrays(keys, values).alias("labels"), number.alias("value"))


def log_events(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, kind and the key=value fields of each log line; colours are taken out."""
    clean = F.regexp_replace("value", "\x1b\\[[0-9;]*m", "")
    field = lambda k: F.nullif(F.regexp_extract("line", rf'\b{k}="?([^"\s]+)', 1), F.lit(""))
    stamp = F.to_timestamp(F.regexp_replace(F.regexp_extract("line", r"(\d{4}-\d\d-\d\dT[\d:.]+Z?)", 1), r"(\.\d{6})\d+", "$1"))
    kind = F.lit(None).cast("string")
    for text, name in (("claim", "lease"), ("consumed", "consume"), ("published", "result"), ("committed", "commit"), ("ready", "node_ready")):
        kind = F.coalesce(kind, F.when(F.col("line").contains(text), name))
    lines = spark.read.text(path).select(clean.alias("line"))
    return lines.select(stamp.alias("at"), kind.alias("kind"), *[field(k).alias(k) for k in ("node", "scenario_id", "run_id", "execution_key", "slice", "attempt")]).where("kind IS NOT NULL").orderBy(F.asc_nulls_last("at"), "node", "kind")


def too_large(limit: int) -> Column:
    """Key and value together have more bytes than a record may have."""
    return F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0)) > limit
