"""Scalar functions, the protobuf codec, the run state machine, leases and the sources, on small cases."""

import datetime as dt
import decimal
import hashlib
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sliceloom import catalogue
from sliceloom.functions import columns as C
from sliceloom.functions import protobuf, scalars
from sliceloom.operators import contracts as K
from sliceloom.operators import planning as P
from sliceloom.operators import samples as S
from sliceloom.sources import descriptors, readers, topics
from sliceloom.streaming import leases, runs


def test_fnv_and_cut():
    assert scalars.fnv128("") == "6c62272e07bb014262b821756295c58d"
    assert scalars.fnv128("a") == "d228cb696f1a8caf78912b704e4a8964"

    def plain(data):
        h = 0x6C62272E07BB014262B821756295C58D
        for b in data:
            h = ((h ^ b) * 0x0000000001000000000000000000013B) % (1 << 128)
        return f"{h:032x}"

    rng = random.Random(2)
    many = [rng.randbytes(rng.randrange(60)) for _ in range(3000)]
    assert scalars.fnv128_many(many) == [plain(x) for x in many] and scalars.fnv128_many([]) == []
    assert scalars.utf8_cut("é" * 20, 21) == "ééé...[truncated]"
    assert scalars.utf8_cut(None, 7) is None and scalars.utf8_cut("abc", 3) == "abc"
    assert scalars.one_line("a\nb\x7fc") == "a b c"


def test_retry_delay_values():
    """Fixed values, by hand: exponential times 0.8 to 1.2, both times up to the cap."""
    assert [scalars.retry_delay_ms("key", a, 500, 60_000) for a in range(9)] == [537.65, 1023.1, 1941.8, 3674.8, 6932.0, 13028.8, 29193.6, 51606.0, 48474.0]
    assert scalars.retry_delay_ms("k", 40, 1, 1 << 40) <= 1.2 * (1 << 16)


def test_utf8_columns(spark):
    texts = ["", "abc", "é" * 600, "a" + "é" * 600, "ab" + "한" * 400, "🙂" * 300, "x" + "🙂" * 300, "xy" + "🙂" * 300, "xyz" + "🙂" * 300, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.utf8_cut(F.col("t"), 1024).alias("a"), C.utf8_cut(F.col("t"), 20).alias("b")).collect()
    assert all(r.a == scalars.utf8_cut(r.t, 1024) and r.b == scalars.utf8_cut(r.t, 20) for r in rows)
    kept = spark.createDataFrame([(b"\x00\xff" * 5,), (None,)], "v binary").select(C.evidence(F.col("v"), 4).alias("e")).collect()
    assert kept[0].e.base64 == "AP8A/w==" and kept[0].e.original_bytes == 10 and kept[0].e.truncated and kept[1].e is None


def test_scalar_columns(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert [get(C.duration_ms(F.lit(t))) for t in ("5s", " 2h ", "0m", "7d", "", "18446744073709551616s", "9223372036854775807h")] == [5000, 7_200_000, None, None, None, None, None]
    assert [get(C.slugify(F.lit(t))) for t in ("  A/b c--", "é", "x")] == ["a-b-c", "scenario", "x"]
    assert get(C.comma_list(F.lit(" a, ,b,a,"))) == ["a", "b"]
    assert [get(C.number(F.lit(t))) for t in ("1.5", "nan", "", "x")] == [1.5, None, None, None] and get(F.isnan(C.number(F.lit("NaN"), keep_nan=True)))
    assert get(C.from_base64(F.lit("YWI="))) == b"ab" and get(C.from_base64(F.lit("YWI"))) is None
    hosts = ["localhost", "a.example"]
    assert [get(C.host_allowed(F.lit(e), hosts)) for e in ("http://LOCALHOST:1", "http://x.a.example", "nothing")] == [True, False, False] and get(C.host_allowed(F.lit("http://b"), hosts, any_host=True))
    kinds = lambda **k: F.create_map(*(x for a, b in k.items() for x in (F.lit(a), F.lit(b))))
    route = lambda attempt, **k: get(C.disposition(kinds(**k), F.lit(attempt), F.lit(2)))
    assert [route(0, invariant_violation=1, infrastructure=1), route(0, infrastructure=1), route(2, infrastructure=1), route(0, invalid_scenario=1), route(0, target_timeout=3)] == ["stop", "retry", "dlq", "dlq", "result"]
    assert get(C.summary_event(F.lit("r"), F.lit(2), F.lit("TimedOut"))) == "r:summary:r2:timed-out"


@pytest.mark.parametrize(("rate", "concurrency", "duration", "slices"), [(0.1, 1, 10000, 1), (9.9, 2, 1000, 1), (20.0, 3, 100, 2), (200.5, 73, 1000, 21), (1000.0, 256, 1000, 100), (float("nan"), 5, 1000, 1), (5.0, 0, 1000, 1)])
def test_slices_conserve(spark, rate, concurrency, duration, slices):
    for burst in {0, 1, concurrency // 2, concurrency}:
        rows = P.sliced(spark.createDataFrame([("s", rate, concurrency, duration, burst)], "scenario_id string, rate double, concurrency int, duration_ms int, burst int")).collect()
        assert len(rows) == slices and sum(r.concurrency for r in rows) == concurrency and sum(r.burst for r in rows) == burst
        assert max(r.concurrency for r in rows) - min(r.concurrency for r in rows) <= 1 and (rate != rate or abs(sum(r.rate for r in rows) - rate) < 1e-9 * rate)


def test_pacing(spark):
    rows = [("a", 0, 0.1, 0, 30000), ("b", 0, 100.0, 0, 20), ("c", 0, 2.0, 3, 1000)]
    got = {}
    for r in P.pacing(spark.createDataFrame(rows, "scenario_id string, slice_index int, rate double, burst int, duration_ms int")).collect():
        got.setdefault(r.scenario_id, []).append(r.at_s)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [5.0, 15.0, 25.0], "b": [0.005, 0.015], "c": [0.0, 0.0, 0.0, 0.5]}


def test_windows(spark):
    rows = spark.createDataFrame([(1, 100, 10), (2, 100, None), (3, 500, 10)], "id int, from_ms long, every_ms long")
    got = sorted((r.id, r.scheduled_ms, r.next_ms) for r in P.windows(rows, F.lit(125)).collect())
    assert got == [(1, 100, 110), (1, 110, 120), (1, 120, 130), (2, 100, None)]


def test_replay_identity(spark):
    """The run of a replay follows from the letter's coordinates and event, also where a first-version letter has none."""
    letters = spark.createDataFrame([("dlq", 1, 7, "s", "exec", e, 2, 5000) for e in ("exec:attempt-2:dlq", "", None, "other")], "topic string, source_partition int, source_offset long, scenario_id string, execution_key string, event_id string, attempt int, failed_at_ms long")
    plan = spark.createDataFrame([("s", 5.0, 1000, 4, 1, "fnv128:x")], "scenario_id string, rate double, duration_ms int, concurrency int, burst int, plan_fingerprint string")
    rows = P.replay_jobs(letters, plan).collect()
    own = f"v2:replay:tZGxx:p1:o7:e{scalars.fnv128('exec:attempt-2:dlq')}"
    assert sorted(r.run_id == own for r in rows) == [False, True, True, True] and all(r.scheduled_at_ms == 5000 and r.execution_key == f"{r.run_id}:slice-0-of-1" for r in rows)
    with pytest.raises(ValueError):
        P.replay_jobs(letters, plan, scale=2.0)


def test_fingerprint_material(spark):
    step = F.struct(F.lit(None).cast("string").alias("endpoint"), F.lit("S").alias("service"), F.lit("M").alias("method"), F.lit(None).cast("string").alias("request"), F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.lit("y")).alias("extract"), F.lit(None).cast("string").alias("payload_key"))
    row = spark.createDataFrame([("e", 2.5, 1000, 3, 4, "ExecutionKey", None)], "endpoint string, rate double, duration_ms int, concurrency int, slices int, strategy string, every_ms long").withColumn("step", step).withColumn("steps", F.array(P.step_material()))
    got = row.select(P.plan_material(0, 2, "sem").alias("m"), P.fingerprint(P.plan_material(0, 2, "sem")).alias("f"), P.semantics_material(F.lit(5), F.lit(None), F.lit(None).cast("string"), "1").alias("s")).first()
    assert got.m == "v2|endpoint=e|rate=4004000000000000|duration_ms=1000|concurrency=3|slices=4|startup_burst=0|max_retries=2|repeat=once|partition=ExecutionKey|execution_semantics=sem|step=grpc|endpoint=<default>|service=S|method=M|request=empty|extract=a=y,b=x|payload_key="
    assert got.f == f"fnv128:{scalars.fnv128(got.m)}" and got.s == "engine=1|request_timeout_ms=5|scenario_timeout_ms=none|descriptor=none"


JOB = {
    "schema_version": 2, "scenario_id": "scenario", "run_id": "run", "execution_key": "execution", "plan_fingerprint": "fnv128:test-plan", "slice": (0, 1), "load": (0.1, 1000, 1, 0), "attempt": 0, "max_retries": 2, "not_before_ms": 0,
}
JOB_SCHEMA = "schema_version int, scenario_id string, run_id string, execution_key string, plan_fingerprint string, slice struct<index: int, total: int>, load struct<scenarios_per_sec: double, duration_ms: long, max_concurrency: int, startup_burst: int>, attempt int, max_retries int, not_before_ms long"


def test_job_faults(spark):
    cases = [
        ({}, None), ({"load": (float("nan"), 1000, 1, 0)}, "InvalidLoad"), ({"load": (0.0, 1000, 1, 0)}, "InvalidLoad"), ({"load": (1.0, 0, 1, 0)}, "InvalidLoad"), ({"load": (1.0, 1, 1, 2)}, "InvalidLoad"), ({"slice": (1, 1)}, "InvalidSlice"), ({"slice": (0, 4097)}, "InvalidSlice"),
        ({"attempt": 3}, "InvalidAttempt"), ({"max_retries": 33}, "InvalidAttempt"), ({"attempt": 1}, "InvalidAttempt"), ({"attempt": 1, "not_before_ms": 5}, None), ({"attempt": 1, "schema_version": 1}, None), ({"schema_version": 3}, "FutureVersion"), ({"schema_version": None}, "UnsupportedVersion"),
        ({"scenario_id": None}, "MissingField"), ({"run_id": "　 \t"}, "MissingField"), ({"plan_fingerprint": ""}, "MissingField"), ({"plan_fingerprint": "", "schema_version": 1}, None), ({"run_id": "é" * 513}, "FieldTooLong"), ({"run_id": "é" * 512}, None), ({"load": None}, "InvalidLoad"),
    ]
    frame = spark.createDataFrame([tuple((JOB | c).values()) for c, _ in cases], JOB_SCHEMA)
    assert [r.f for r in frame.select(K.job_fault().alias("f")).collect()] == [f for _, f in cases]
    assert [r.f for r in frame.limit(1).select(K.limits_fault(999, 1.0, 5).alias("f"), ).collect()] == ["SafetyLimit"]


def test_histogram_faults(spark):
    cases = [([], 5, None), (None, 5, None), ([(1, 2), (10, 3)], 5, None), ([(1, 2), (1, 3)], 5, "BoundsNotRising"), ([(1, 2), (10, 3)], 6, "HistogramMismatch"), ([(i, 0) for i in range(129)], 0, "TooManyBuckets"), ([(i, 1) for i in range(128)], 128, None), ([(1, None), (2, 5)], 5, None)]
    frame = spark.createDataFrame([(b, t) for b, t, _ in cases], "latency_histogram array<struct<upper_bound_ms: decimal(20,0), count: bigint>>, total long".replace("decimal(20,0)", "bigint"))
    assert [r.f for r in frame.select(K.histogram_fault().alias("f")).collect()] == [f for *_, f in cases]


def test_letters(spark):
    failed = {"schema_version": 2, "event_id": "e:attempt-1:dlq", "scenario_id": "s", "run_id": "r", "execution_key": "e", "slice": {"index": 0, "total": 2}, "failed_at_unix_ms": 5, "attempt": 1, "max_retries": 2, "reason": "no"}
    poison = {"schema_version": 2, "event_id": "poison:t:0:9", "failed_at_unix_ms": 5, "source_topic": "t", "source_partition": 0, "source_offset": 9, "payload_base64": "YWI=", "payload_original_bytes": 2, "payload_truncated": False, "reason": "bad"}
    cases = [
        (failed, "failed_job", None), (failed | {"more": 1}, "failed_job", "unknown field more"), (failed | {"event_id": "x"}, "failed_job", "event_id"), (failed | {"event_id": "", "schema_version": 1}, "failed_job", None), (failed | {"slice": {"index": 2, "total": 2}}, "failed_job", "slice"),
        (failed | {"attempt": 3, "event_id": "e:attempt-3:dlq"}, "failed_job", "attempt"), (poison, "poison", None), (poison | {"payload_original_bytes": 3}, "poison", "payload_length"), (poison | {"payload_truncated": True, "payload_original_bytes": 3}, "poison", None),
        (poison | {"payload_base64": "?"}, "poison", "payload_base64"), ({k: v for k, v in poison.items() if k != "payload_base64"}, "poison", "payload_metadata"), (poison | {"source_offset": 8}, "poison", "identity"), (poison | {"source_offset": -1}, "poison", "source_offset"),
        (failed | poison, "ambiguous", "ambiguous"), ({"reason": "x"}, "unknown", "unknown"),
    ]
    values = [json.dumps(c) for c, *_ in cases] + ["[1]", "no json", None]
    got = [(r["class"], r.fault) for r in K.letters(spark.createDataFrame([(v,) for v in values], "value string")).collect()]
    assert got == [c[1:] for c in cases] + [("malformed", "malformed")] * 3


def test_alert_needs_the_whole_time(spark):
    """A rule fires once its condition has held for its minutes, and a gap begins again."""
    rows = [(m, 0 if m not in (4,) else 1) for m in range(9)]
    frame = spark.createDataFrame(rows, "minute int, leaders int")
    assert sorted(r.minute for r in S.firing(frame, (("none", "leaders < 1", 3),)).collect()) == [3, 8]


FIELDS = {
    "i": {"number": 1, "kind": "int64"}, "s": {"number": 2, "kind": "string"}, "z": {"number": 3, "kind": "sint32", "repeated": True}, "d": {"number": 4, "kind": "double"},
    "b": {"number": 5, "kind": "bytes"}, "m": {"number": 6, "kind": "message", "fields": {"t": {"number": 1, "kind": "bool"}}}, "f": {"number": 7, "kind": "fixed32"},
}


def test_protobuf():
    message = {"i": -5, "s": "é", "z": [-1, 2, -300], "d": 1.5, "b": "AAE=", "m": {"t": True}, "f": 7}
    assert protobuf.decode(protobuf.encode(message, FIELDS), FIELDS) == message
    assert protobuf.encode({"i": 150}, FIELDS) == b"\x08\x96\x01"
    assert protobuf.decode(b"\x48\x01\x08\x02", FIELDS) == {"i": 2}  # unknown field 9 is skipped
    for bad in (b"\x12\x05ab", b"\x08", b"\x0b"):
        with pytest.raises(ValueError):
            protobuf.decode(bad, FIELDS)
    with pytest.raises(ValueError):
        protobuf.encode({"no": 1}, FIELDS)


def test_descriptor_set(spark, tmp_path):
    from google.protobuf import descriptor_pb2 as pb

    file = pb.FileDescriptorProto(name="a.proto", package="demo")
    message = file.message_type.add(name="Item")
    message.field.add(name="id", number=1, type=pb.FieldDescriptorProto.TYPE_UINT64, label=1)
    message.field.add(name="part", number=2, type=pb.FieldDescriptorProto.TYPE_MESSAGE, type_name=".demo.Item.Part", label=3)
    message.nested_type.add(name="Part").field.add(name="ok", number=1, type=pb.FieldDescriptorProto.TYPE_BOOL, label=1)
    file.service.add(name="Echo").method.add(name="Get", input_type=".demo.Item", output_type=".demo.Item")
    (tmp_path / "set.bin").write_bytes(pb.FileDescriptorSet(file=[file]).SerializeToString())
    methods, fields = descriptors.descriptor_set(spark, str(tmp_path / "set.bin"))
    assert [tuple(r) for r in methods.collect()] == [("demo.Echo/Get", "demo.Echo", "demo.Item", "demo.Item", True)]
    table = descriptors.field_table([tuple(r) for r in fields.collect()], "demo.Item")
    value = {"id": 7, "part": [{"ok": True}, {"ok": True}]}
    assert protobuf.decode(protobuf.encode(value, table), table) == value
    file.service.add(name="Echo").method.add(name="Get", input_type=".demo.Item", output_type=".demo.Item")
    with pytest.raises(ValueError, match="twice"):
        descriptors.descriptor_rows(pb.FileDescriptorSet(file=[file]).SerializeToString())


def result(i, at, slices=2, key=None, total=1, failure=0, bounds=(10, 100), bucket=0, errors=None, scenario="s"):
    counts = [total if j == bucket else 0 for j in range(len(bounds))]
    return {"run_id": "r", "kind": "result", "scenario_id": scenario, "schema_version": 2, "slice_index": i, "slices": slices, "execution_key": key or f"k{i}", "total": total, "success": total - failure, "failure": failure, "bounds": list(bounds), "counts": counts, "errors": errors or ({"timeout": failure} if failure else {}), "revision": None, "load_ms": None, "at_ms": at}


def test_run_outcomes():
    run = runs.Run(None, 100)
    assert run.take(result(1, 0, total=3, bucket=1))[0] == "accepted" and run.take(result(1, 1, total=3, bucket=1))[0] == "duplicate"
    assert run.take(result(1, 1, key="other"))[0] == "conflict" and run.take(result(0, 2, key="k1"))[0] == "conflict"
    assert run.take(result(0, 3, scenario="t"))[0] == "conflict" and run.take(result(0, 3, bounds=(5, 50)))[0] == "conflict" and run.take(result(0, 3, slices=3))[0] == "conflict"
    assert run.take(result(0, 3, total=7)) == ("completed", True)
    end = run.summary("r", "")
    assert (end["total"], end["missing"], end["p50_ms"], end["p95_ms"], end["histogram"], end["event_id"]) == (10, "", 10, 100, "10=7,100=3", "r:summary:r1:complete")


def test_late_and_cancelled():
    run = runs.Run(None, 100)
    run.take(result(0, 100))
    assert not run.expire(199) and run.expire(200) and run.summary("r", "")["missing"] == "1"
    run = runs.Run(run.dump(), 100)
    assert run.take(result(1, 300, failure=1)) == ("late-completed", True) and run.s["revision"] == 2 and run.summary("r", "")["errors"] == "timeout=1"
    run = runs.Run(None, 100)
    registered = {"kind": "register", "scenario_id": "s", "schema_version": 2, "slices": 3, "at_ms": 0, "load_ms": 50}
    assert run.take(registered)[0] == "registered" and run.take(registered | {"slices": 4})[0] == "conflict" and run.s["deadline"] == 150
    run.take({"kind": "cancel", "at_ms": 1})
    assert run.take(result(0, 2, slices=3)) == ("rejected", False) and run.take({"kind": "partial", "at_ms": 2}) == ("closed", False)
    run = runs.Run(None, 100)
    run.take(registered)
    assert run.take({"kind": "tick", "at_ms": 150}) == ("expired", True) and run.summary("r", "")["missing"] == "0,1,2" and run.summary("r", "")["p99_ms"] == 0
    run = runs.Run(None, 100)
    run.take(registered)
    run.take({"kind": "partial", "at_ms": 1})
    assert [run.take(result(i, 2, slices=3))[0] for i in range(3)] == ["late-accepted", "late-accepted", "late-completed"]


def test_bounds_of_a_run():
    run = runs.Run(None, 100)
    run.take(result(0, 0, total=(1 << 53) - 1))
    assert run.take(result(1, 0))[0] == "overflow"
    run = runs.Run(None, 100, max_kinds=2)
    run.take(result(0, 0, total=2, failure=2, errors={"a": 1, "b": 1}))
    assert run.take(result(1, 0, total=1, failure=1, errors={"c": 1}))[0] == "error-kinds" and run.take(result(1, 0, total=1, failure=1, errors={"b": 1}))[0] == "completed"
    assert run.summary("r", "")["errors"] == "a=1,b=2"
    # the first version has no histogram: counts add up, quantiles are 0
    run = runs.Run(None, 100)
    assert [run.take(result(i, 0, total=4, bounds=()))[0] for i in (0, 1)] == ["accepted", "completed"] and run.summary("r", "")["p50_ms"] == 0 and run.summary("r", "")["total"] == 8
    assert runs._quantile([10, (1 << 64) - 1], [1, 9], 0.5) == 10


def test_acknowledgement_and_retention():
    run = runs.Run(None, 100, retention_ms=1000)
    run.take(result(0, 0))
    run.expire(100)
    assert run.pending and run.expired_at() is None
    run.take(result(1, 200))
    ack = lambda n: run.take({"kind": "ack", "revision": n, "at_ms": 0})[0]
    assert [ack(3), ack(0), ack(1), ack(2), ack(2)] == ["invalid", "invalid", "stale", "acknowledged", "acknowledged-again"]
    assert not run.pending and run.expired_at() == 1200


def test_stream_equals_batch(spark, tmp_path):
    """Shuffled results with duplicates, in several files, give the totals, histograms and kinds of the batch."""
    rows = [{**result(i, 1000 + i, slices=4, total=i + 1, failure=i % 2, bucket=i % 2), "run_id": f"r{r}"} for r in range(3) for i in range(4)]
    rows += rows[::3]
    random.Random(1).shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], runs.INPUT.replace("decimal(20,0)", "long")).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(runs.INPUT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    query = runs.summaries(stream).writeStream.format("memory").queryName("summed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = lambda df: {(r.run_id, r.status, r.total, r.histogram, r.errors, r.p95_ms) for r in df.where("status = 'Complete'").collect()}
    batch = spark.createDataFrame(rows, runs.INPUT.replace("decimal(20,0)", "long"))
    assert want(spark.table("summed")) == want(runs.replayed(batch)) == {(f"r{r}", "Complete", 10, "10=4,100=6", "timeout=2", 100) for r in range(3)}


def test_replay_expires_at_the_end(spark):
    rows = [result(0, 1000), {**result(0, 5000, slices=1), "run_id": "whole"}, {**result(9, 1000), "run_id": "bad"}]
    log = runs.replayed(spark.createDataFrame(rows, runs.INPUT.replace("decimal(20,0)", "long")), 60_000, end_ms=1 << 40)
    assert sorted((r.run_id, r.outcome, r.status) for r in log.collect()) == [("bad", "conflict", "Open"), ("r", "expired", "TimedOut"), ("whole", "completed", "Complete")]
    assert [r.run_id for r in runs.poison(log).collect()] == ["bad"]
    acks = spark.createDataFrame([("whole", 1)], "run_id string, revision int")
    assert [r.run_id for r in runs.pending(log, acks).collect()] == ["r"] and runs.pending(log, acks.where("false"), 1).count() == 1


def test_admission(spark):
    active = spark.createDataFrame([("a",), ("b",)], "run_id string")
    new = spark.createDataFrame([("c", 5), ("d", 3), ("a", 1), ("d", 9)], "run_id string, at_ms long")
    assert [r.run_id for r in runs.admitted(active, new, 3).collect()] == ["d"] and runs.admitted(active, new, 1).count() == 0


def test_leases(spark):
    steps = [("claim", "a", 0, "acquired"), ("claim", "b", 5, "busy"), ("renew", "a", 8, "done"), ("renew", "b", 9, "lost"), ("claim", "b", 20, "recovered"), ("complete", "a", 21, "lost"), ("release", "b", 22, "done"), ("claim", "a", 23, "acquired"), ("complete", "a", 24, "done"), ("complete", "a", 25, "completed"), ("claim", "b", 99, "completed")]
    log = spark.createDataFrame([("k", op, who, at, 10) for op, who, at, _ in steps] + [("other", "claim", "b", 1, 10)], "key string, op string, owner string, at_ms long, lease_ms long").repartition(3)
    got = sorted((r.key, r.at_ms, r.outcome) for r in leases.outcomes(log).collect())
    assert got == sorted([("k", at, out) for _, _, at, out in steps] + [("other", 1, "acquired")])


def test_sources(spark, tmp_path):
    plan = tmp_path / "plan.yaml"
    step = "\n  steps:\n  - {protocol: grpc, service: S, method: M, extract: {a: b}}\n"
    plan.write_text("version: 1\nscenarios:\n- name: a\n  load: {rate: 2, concurrency: 3, duration: 5m}\n  repeat: {type: every, every: 1h}" + step)
    row = readers.scenarios(spark, str(plan)).first()
    assert tuple(row)[:8] == ("a", 2.0, 3, 300000, 0, 3600000, "", "ExecutionKey") and row.steps[0].service == "S" and row.steps[0].extract == {"a": "b"}
    plan.write_text("version: 2\nscenarios:\n- name: ' '\n  extra: 1\n  load: {rate: -1, concurrency: 0, duration: 5x, burst: 2}\n  steps:\n  - {protocol: grpc, service: '', method: M, request_base64: '??', request_fields: [1]}\n")
    with pytest.raises(ValueError, match="version.*extra.*blank.*rate.*concurrency.*burst.*duration.*service.*base64.*only one.*object"):
        readers.scenarios(spark, str(plan))
    text = tmp_path / "m.txt"
    text.write_text('# HELP x\nx{a="1",b="q\\"r"} 2.5\ny 3\n\n')
    assert [(r.name, r.labels, r.value) for r in readers.exposition(spark, str(text)).collect()] == [("x", {"a": "1", "b": 'q\\"r'}, 2.5), ("y", {}, 3.0)]
    csv = tmp_path / "t.csv"
    csv.write_text("scenario,throughput_floor,p95_max_seconds,p99_max_seconds,error_rate_max\n# none\ns, 1.0 ,0.25,0.5,0.01\n")
    assert [tuple(r) for r in readers.thresholds(spark, str(csv)).collect()] == [("s", 1.0, 0.25, 0.5, 0.01)]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nno\n')
    assert [r.a for r in readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).collect()] == [1] and readers.json_lines(spark, str(tmp_path / "none"), "a int", strict=False).count() == 0
    with pytest.raises(Exception, match="(?i)malformed|cannot_parse|failfast"):
        readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    readers.append_json_lines(spark.range(2), str(tmp_path / "out"))
    readers.append_json_lines(spark.range(1), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    (tmp_path / "log").write_text('\x1b[32m2024-05-01T10:00:00.123456789Z job consumed node="n1" execution_key=e1 slice=0\nnothing here\n2024-05-01T09:00:00Z lease claim node=n2\n')
    rows = readers.log_events(spark, str(tmp_path / "log")).collect()
    assert [(r.kind, r.node, r.execution_key) for r in rows] == [("lease", "n2", None), ("consume", "n1", "e1")] and rows[1].at.microsecond == 123456
    (tmp_path / "bundle").mkdir()
    (tmp_path / "bundle/a").write_bytes(b"abc")
    assert [(r.bytes, r.sha256) for r in readers.evidence_manifest(spark, str(tmp_path / "bundle")).collect()] == [(3, hashlib.sha256(b"abc").hexdigest())]


def test_topics(spark):
    job = {"schema_version": 1, "scenario_id": "s", "run_id": "r", "execution_key": "e", "scheduled_at_unix_ms": 1, "slice": {"index": 0, "total": 1}, "load": {"scenarios_per_sec": 1.5, "duration": {"secs": 2, "nanos": 5_000_000}, "max_concurrency": 1}}
    values = [json.dumps(job), "no", None, json.dumps(job | {"slice": {"index": 1, "total": 1}}), json.dumps(job) + " " * 3000]
    records = spark.createDataFrame([("k", v, "jobs", 0, i) for i, v in enumerate(values)], "key string, value string, topic string, partition int, offset long")
    rows = topics.jobs(records, limit=2000).orderBy("offset")
    assert [r.fault for r in rows.collect()] == [None, "Malformed", "Malformed", "InvalidSlice", "TooLarge"]
    bad = topics.poison_records(rows.where("fault IS NOT NULL"), F.lit(7).cast("long"))
    sent = topics.outgoing_poison(bad).collect()
    assert len(sent) == 4 and all(r.key == json.loads(r.value)["event_id"] for r in sent)
    back = topics.dead_letters(spark.createDataFrame([(r.key, r.value, "dlq", 0, i) for i, r in enumerate(sent)], records.schema), 10).collect()
    assert {r["class"] for r in back} == {"poison"} and {r.fault for r in back} == {None}
    good = rows.where("fault IS NULL").select("record.*").drop("_bad")
    assert [r.key for r in topics.outgoing_jobs(good, "scenario_id").collect()] == ["s"] and [r.key for r in topics.outgoing_jobs(good).collect()] == ["e"]
    with pytest.raises(Exception, match="refusing to send"):
        topics.outgoing_jobs(good.withColumn("run_id", F.lit(" "))).collect()
    failed = spark.createDataFrame([(1, "", "s", "r", "e", (0, 1), 5, 0, 2, "x" * 3000)], K.FAILED)
    assert json.loads(topics.outgoing_failed(failed).first().value)["reason"].endswith("[truncated]")
    with pytest.raises(Exception, match="refusing to send"):
        topics.outgoing_failed(failed, key="run_id").collect()
    log = spark.createDataFrame([("r", "r:summary:r1:complete", 1, "Complete")], "run_id string, event_id string, revision int, status string")
    assert topics.outgoing_summaries(log).first().key == "r"
    with pytest.raises(ValueError):
        topics.dead_letters(records, 0)
    assert topics.kafka_options("b:1", "jobs", "g", 5)["maxOffsetsPerTrigger"] == "5"


def test_results_of_topics(spark):
    r = {"schema_version": 2, "scenario_id": "s", "run_id": "r", "execution_key": "e", "event_id": "e:attempt-0:result", "slice": {"index": 0, "total": 1}, "started_at_unix_ms": 1, "finished_at_unix_ms": 2, "status": "Success", "total": 3, "success": 2, "failure": 1, "latency_histogram": [{"upper_bound_ms": 10, "count": 2}, {"upper_bound_ms": 18446744073709551615, "count": 1}], "error_breakdown": [{"kind": "a", "count": 1}]}
    cases = [({}, None), ({"event_id": "x"}, "EventIdMismatch"), ({"latency_histogram": []}, "HistogramMissing"), ({"latency_histogram": [], "schema_version": 1}, None), ({"total": 4}, "CountMismatch"), ({"error_breakdown": []}, "ErrorMismatch"), ({"error_breakdown": [], "schema_version": 1}, None), ({"error_breakdown": [{"kind": "a", "count": 1}, {"kind": "a", "count": 0}]}, "DuplicateKind"), ({"error_breakdown": [{"kind": "x" * 257, "count": 1}]}, "BadKind"), ({"error_breakdown": [{"kind": f"k{i}", "count": 0} for i in range(65)]}, "TooManyKinds"), ({"finished_at_unix_ms": 0}, "TimeOrder"), ({"success": 1 << 53, "total": (1 << 53) + 1, "latency_histogram": [{"upper_bound_ms": 1, "count": (1 << 53) + 1}]}, "CountTooLarge"), ({"attempt": 33, "event_id": "e:attempt-33:result"}, "InvalidAttempt")]
    frame = spark.createDataFrame([("k", json.dumps(r | c), "results", 0, i) for i, (c, _) in enumerate(cases)], "key string, value string, topic string, partition int, offset long")
    assert [x.fault for x in topics.results(frame).orderBy("offset").collect()] == [f for _, f in cases]


def test_template():
    assert scalars.render_json({"a": ["${ctx.x}", 1, None], "${ctx.x}": "b${ ctx.x }"}, {"x": "1"}) == {"a": ["1", 1, None], "${ctx.x}": "b1"}
    assert 3 <= int(scalars.render("${gen.int:3:5}", {})) <= 5
    assert len(scalars.render("${gen.uuid}", {})) == 36 and scalars.render("${gen.phone}", {}).startswith("+1") and len(scalars.render("${gen.phone}", {})) == 12
    for bad in ("${ctx.no}", "${open", "${what}", "${gen.int:5:3}"):
        with pytest.raises(scalars.TemplateError):
            scalars.render(bad, {})


def test_extract_path():
    value = {"a": {"b": None, "c": [1]}}
    assert scalars.extract_path(value, "a.b") == (True, None) and scalars.extract_path(value, "a.c.0") == (False, None)
    assert scalars.extract_path(value, " ") == (True, value)
    assert scalars.context_string(True) == "true" and scalars.context_string({"a": [1]}) == '{"a":[1]}'
    with pytest.raises(scalars.TemplateError):
        scalars.context_string(None)


def test_schedules_are_whole(spark, tmp_path):
    spark.createDataFrame([(59,), (7,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = {}
    for r in catalogue.QUERIES["pacing_schedule"](spark, str(tmp_path)).collect():
        got.setdefault((r.scenario_id, r.slice_index), []).append((r.k, r.at_s))
    assert {s for s, _ in got} == {"a", "b", "c", "d", "e", "customer-59", "customer-7"}
    assert got["a", 0] == [(0, 5.0)]  # 10 s at 0.1 a second
    # 30 s at 15 a second and a burst of 3, in three slices
    assert sorted(k for k in got if k[0] == "customer-59") == [("customer-59", i) for i in range(3)]
    assert sorted(got["customer-59", 2]) == [(0, 0.0), *((k, pytest.approx(k / 5)) for k in range(1, 150))]


def test_windows_reach_the_end(spark, tmp_path):
    day = dt.date(1995, 1, 1)
    spark.createDataFrame([(4, day), (5, day), (7, day)], "o_orderkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    rows = catalogue.QUERIES["dispatch_windows"](spark, str(tmp_path)).collect()
    begin = 788918400000
    for key, every in ((4, 300_000), (5, 60_000)):
        assert sorted((r.scheduled_ms, r.next_ms) for r in rows if r.o_orderkey == key) == [(t, t + every) for t in range(begin, begin + 3_600_001, every)]
    assert [(r.scheduled_ms, r.next_ms) for r in rows if r.o_orderkey == 7] == [(begin, None)]


def test_filtered_letters_are_parsed_once(spark):
    rows = K.letters(spark.createDataFrame([("{}",)], "value string").withColumn("value", F.to_json(F.struct("value"))))
    parsed = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")
    assert 0 < parsed(rows.where("fault IS NULL")) <= parsed(rows) and 0 < parsed(rows.where("fault LIKE 'unknown%'")) <= parsed(rows)


def test_paced_slices_of_a_scenario_follow_each_other(spark):
    """Their starts are the same numbers, and are written side by side."""
    rows = P.pacing(P.sliced(spark.createDataFrame([(f"s{i}", 60.0 + i % 2, 12, 1000, 0) for i in range(20)], "scenario_id string, rate double, concurrency int, duration_ms int, burst int")))
    got = [(r.part, r.scenario_id, r.slice_index, r.rate) for r in rows.withColumn("part", F.spark_partition_id()).collect()]
    places = {x[:3] for x in got}
    assert len({(part, s) for part, s, _ in places}) == 20 and len(places) == 10 * 6 + 10 * 7
    assert all(a[3] <= b[3] for a, b in zip(got, got[1:], strict=False) if a[0] == b[0])
    changes = sum(a[:3] != b[:3] for a, b in zip(got, got[1:], strict=False))
    assert changes == len(places) - 1


def test_plain_runs_are_folded_together(monkeypatch):
    """Random rows, some of them odd, give in batches of any length what the state machine gives; plain runs within a batch do not pass it row by row."""
    rng, rows = random.Random(5), []
    for r in range(400):
        slices, odd = rng.choice([1, 2, 3, 7]), r % 5 == 0
        for _ in range(rng.randrange(1, 9)):
            i, at = rng.randrange(slices), rng.choice([1000, 1500, 61_000, 61_001, 200_000])
            row = {**result(i, at, slices=slices, total=rng.randrange(9)), "run_id": f"r{r:03}", "execution_key": f"e{i}" + rng.choice(["", "", "x"]), "bounds": [10, 100, 2**64 - 1]}
            row |= {"success": row["total"], "counts": [rng.randrange(4) for _ in range(3)], "errors": dict.fromkeys(rng.sample("cab", rng.randrange(3)), rng.randrange(3))}
            if odd and rng.random() < 0.3:
                row |= rng.choice([{"slice_index": 70}, {"slice_index": -1}, {"slices": 9}, {"scenario_id": None}, {"bounds": [10, 101, 2**64 - 1]}, {"execution_key": "e"}, {"kind": "register"}, {"kind": "cancel"}, {"kind": "tick"}, {"total": 2**53}, {"errors": None}])
            rows.append(row)
    rows.sort(key=lambda x: (x["run_id"], *(x[c] for c in runs.ORDER)))
    numbers = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<decimal(20,0)>": pa.list_(pa.decimal128(20, 0)), "array<long>": pa.list_(pa.int64()), "map<string,long>": pa.map_(pa.string(), pa.int64())}
    types = [f.split(" ") for f in runs.INPUT.split(", ")]
    schema = pa.schema([(n, numbers[t]) for n, t in types])
    made = [{n: [decimal.Decimal(b) for b in r[n]] if n == "bounds" else list((r[n] or {}).items()) if n == "errors" else r.get(n) for n, _ in types} for r in rows]
    batches = lambda n: [pa.RecordBatch.from_pylist(made[k : k + n], schema=schema) for k in range(0, len(made), n)]
    log = lambda n, end: sorted((repr(x) for b in runs._fold(60_000, end)(iter(batches(n))) for x in b.to_pylist()))
    took, take = [], runs.Run.take
    monkeypatch.setattr(runs.Run, "take", lambda self, row: took.append(row) or take(self, row))
    for end in (None, 61_000, 1 << 40):
        want = log(1, end)
        assert len(took) == len(rows)
        took.clear()
        for n in (7, 50, len(rows)):
            assert log(n, end) == want
        took.clear()
        assert log(len(rows), end) == want and 0 < len(took) < len(rows) // 3
        took.clear()
