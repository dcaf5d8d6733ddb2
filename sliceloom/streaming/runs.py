"""Stateful run aggregation, keyed by run: histograms and error kinds added up, duplicates, conflicts, late slices, deadlines, revisions and their acknowledgement.

A row has a kind. ``result`` carries a slice's counts, its histogram (bounds and counts) and error kinds;
``register`` announces a run with its slices, scheduled time and load; ``cancel`` and ``partial`` end an open
run; ``ack`` acknowledges a revision; ``tick`` lets time pass. Time is that of the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import EXACT, KINDS

INPUT = (
    "run_id string, kind string, scenario_id string, schema_version int, slice_index int, slices int, execution_key string, total long, success long, failure long, "
    "bounds array<decimal(20,0)>, counts array<long>, errors map<string,long>, revision int, load_ms long, at_ms long"
)
OUTPUT = (
    "run_id string, event_id string, scenario_id string, revision int, status string, received int, expected int, missing string, total long, success long, failure long, "
    "p50_ms long, p95_ms long, p99_ms long, histogram string, errors string, first_ms long, last_ms long, finalized_ms long, outcome string"
)
STATE = "body string"
NAMES = {"open": "Open", "complete": "Complete", "timed_out": "TimedOut", "cancelled": "Cancelled", "partial": "Partial"}
#: What was wrong with a row: these go to the poison output, all others settle it.
REFUSED = ("conflict", "rejected", "overflow", "error-kinds")


def _quantile(bounds: list[int], counts: list[int], q: float) -> int:
    """Nearest rank; a rank in the overflow bucket gives the bound before it, nothing counted gives 0."""
    total = sum(counts)
    if not total:
        return 0
    rank, upto, last = max(1, -int(-(total * q) // 1)), 0, 0
    for bound, n in zip(bounds, counts, strict=True):
        upto += n
        last = bound if bound < (1 << 64) - 1 else last
        if upto >= rank:
            return last
    return last


class Run:
    """What one run has received."""

    def __init__(self, body: str | None = None, partial_ms: int = 60_000, max_kinds: int = KINDS, retention_ms: int | None = None):
        self.s = json.loads(body) if body else {"status": "open", "identity": None, "bounds": None, "seen": {}, "keys": {}, "sums": [0, 0, 0], "buckets": [], "errors": {}, "deadline": None, "first": None, "last": None, "final": None, "revision": 0, "acked": 0}
        self.partial_ms, self.max_kinds, self.retention_ms = partial_ms, max_kinds, retention_ms

    def dump(self) -> str:
        return json.dumps(self.s)

    @property
    def slices(self) -> int:
        return self.s["identity"][2] if self.s["identity"] else 0

    @property
    def pending(self) -> bool:
        """Whether the last revision still waits for its acknowledgement."""
        return self.s["revision"] > self.s["acked"]

    def expired_at(self) -> int | None:
        """When this run may be forgotten: never while a summary is pending, else some time after its last row."""
        if self.retention_ms is None or self.pending or self.s["last"] is None or self.s["status"] == "open":
            return None
        return self.s["last"] + self.retention_ms

    def summary(self, run_id: str, outcome: str) -> dict:
        s = self.s
        gone = [i for i in range(self.slices) if str(i) not in s["seen"]]
        status = NAMES[s["status"]]
        tail = {"TimedOut": "timed-out"}.get(status, status.lower())
        bounds = s["bounds"] or []
        p50, p95, p99 = (_quantile(bounds, s["buckets"], q) for q in (0.5, 0.95, 0.99))
        return {
            "run_id": run_id, "event_id": f"{run_id}:summary:r{s['revision']}:{tail}", "scenario_id": s["identity"][0] if s["identity"] else None, "revision": s["revision"], "status": status,
            "received": len(s["seen"]), "expected": self.slices, "missing": ",".join(map(str, gone)), "total": s["sums"][0], "success": s["sums"][1], "failure": s["sums"][2], "p50_ms": p50, "p95_ms": p95, "p99_ms": p99,
            "histogram": ",".join(f"{b}={n}" for b, n in zip(bounds, s["buckets"], strict=True)), "errors": ",".join(f"{k}={n}" for k, n in sorted(s["errors"].items())),
            "first_ms": s["first"], "last_ms": s["last"], "finalized_ms": s["final"], "outcome": outcome,
        }

    def _final(self, status: str, at_ms: int) -> None:
        self.s["status"], self.s["final"] = status, at_ms
        self.s["revision"] += 1

    def expire(self, now_ms: int) -> bool:
        if self.s["status"] == "open" and self.s["deadline"] is not None and now_ms >= self.s["deadline"]:
            self._final("timed_out", now_ms)
            return True
        return False

    def acknowledge(self, revision: int) -> str:
        """One revision: the current one settles the run, an older one is stale, one that was never made is an error."""
        if revision < 1 or revision > self.s["revision"]:
            return "invalid"
        if revision < self.s["revision"]:
            self.s["acked"] = max(self.s["acked"], revision)
            return "stale"
        again = self.s["acked"] >= revision
        self.s["acked"] = revision
        return "acknowledged-again" if again else "acknowledged"

    def take(self, row: dict) -> tuple[str, bool]:
        """The outcome of a row, and whether it made a new revision."""
        s, kind = self.s, row["kind"]
        if kind == "tick":
            return "expired" if (new := self.expire(row["at_ms"])) else "tick", new
        if kind == "ack":
            return self.acknowledge(row["revision"]), False
        if kind in ("cancel", "partial"):
            if s["status"] != "open" or s["identity"] is None:
                return "closed", False
            self._final("cancelled" if kind == "cancel" else "partial", row["at_ms"])
            return kind, True
        identity = [row.get("scenario_id"), row.get("schema_version"), row["slices"]]
        if kind == "register":
            if s["identity"] is None:
                s["identity"], s["deadline"] = identity, row["at_ms"] + (row.get("load_ms") or 0) + self.partial_ms
            return ("registered" if s["identity"] == identity else "conflict"), False
        return self._result(row, identity)

    def _result(self, row: dict, identity: list) -> tuple[str, bool]:
        s = self.s
        i, key = str(row["slice_index"]), row["execution_key"]
        bounds, counts = ([int(x) for x in row.get(c) or []] for c in ("bounds", "counts"))
        errors = dict(row.get("errors") or {})
        if not 0 <= row["slice_index"] < (row["slices"] or 0) or s["identity"] not in (None, identity) or (s["bounds"] and bounds != s["bounds"]):
            return "conflict", False
        if s["seen"].get(i, key) != key or s["keys"].get(key, i) != i:
            return "conflict", False
        if i in s["seen"]:
            return "duplicate", False
        if s["status"] in ("complete", "cancelled"):
            return "rejected", False
        if len(s["errors"].keys() | errors.keys()) > self.max_kinds:
            return "error-kinds", False
        sums = [a + int(row[k]) for a, k in zip(s["sums"], ("total", "success", "failure"), strict=True)]
        buckets = [a + b for a, b in zip(s["buckets"] or [0] * len(counts), counts, strict=True)] if counts else s["buckets"]
        added = {k: s["errors"].get(k, 0) + int(n) for k, n in errors.items()}
        if max([*sums, *buckets, *added.values()]) > EXACT:
            return "overflow", False
        late = s["status"] != "open"
        if s["identity"] is None:
            s["identity"], s["deadline"] = identity, row["at_ms"] + self.partial_ms
        s["bounds"], s["seen"][i], s["keys"][key], s["sums"], s["buckets"] = bounds or s["bounds"], key, i, sums, buckets
        s["errors"].update(added)
        s["first"] = row["at_ms"] if s["first"] is None else s["first"]
        s["last"] = max(row["at_ms"], s["last"] or 0)
        if len(s["seen"]) == self.slices:
            self._final("complete", row["at_ms"])
            return ("late-completed" if late else "completed"), True
        return ("late-accepted" if late else "accepted"), False


_COLUMNS = [f.split()[0] for f in OUTPUT.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
SCHEMA = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in OUTPUT.split(", ")])
ORDER = ("at_ms", "slice_index", "execution_key", "total", "success")


def _rows(frame: pd.DataFrame) -> list[dict]:
    """Rows as dictionaries: arrays as lists, maps as dictionaries, nothing as None."""
    out = frame.sort_values(list(ORDER), kind="stable").to_dict("records")
    for row in out:
        for k, v in row.items():
            if k in ("bounds", "counts"):
                row[k] = [] if v is None else [int(x) for x in v]
            elif k == "errors":
                row[k] = dict(v) if v is not None and not isinstance(v, float) else {}
            elif v is None or v != v:
                row[k] = None
            elif k in ("slice_index", "slices", "schema_version", "total", "success", "failure", "revision", "load_ms", "at_ms"):
                row[k] = int(v)
    return out


def _update(partial_ms: int, retention_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run_, out = Run(state.get[0] if state.exists else None, partial_ms, retention_ms=retention_ms), []
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            if run_.expire(now):
                out.append(run_.summary(key[0], "expired"))
            elif (end := run_.expired_at()) is not None and now >= end:
                state.remove()
                yield pd.DataFrame([], columns=_COLUMNS)
                return
        else:
            for row in _rows(pd.concat(list(batches))):
                if run_.expire(row["at_ms"]):
                    out.append(run_.summary(key[0], "expired"))
                outcome, new = run_.take(row)
                if new or outcome in REFUSED:
                    out.append(run_.summary(key[0], outcome))
        state.update((run_.dump(),))
        due = run_.s["deadline"] if run_.s["status"] == "open" else run_.expired_at()
        if due is not None:
            state.setTimeoutDuration(max(1000, due - now))
        yield pd.DataFrame(out, columns=_COLUMNS)

    return run


def summaries(rows: DataFrame, partial_ms: int = 60_000, retention_ms: int | None = None) -> DataFrame:
    """An append-only log of summary revisions from a stream of rows (INPUT); refused rows come out with their outcome.

    With ``retention_ms`` a settled run's state is dropped that long after its last row, unless a summary of it is not acknowledged.
    """
    return rows.groupBy("run_id").applyInPandasWithState(_update(partial_ms, retention_ms), OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _numbers(column: pa.Array) -> np.ndarray | None:
    """Items of lists, a row of lists of one length each; decimals as their two halves. None if it cannot be that."""
    flat = column.flatten()
    if flat.null_count or not len(column) or len(flat) % len(column):
        return None
    if pa.types.is_decimal128(flat.type):
        return np.frombuffer(flat.buffers()[1], "<i8")[2 * flat.offset : 2 * (flat.offset + len(flat))].reshape(len(column), -1)
    return flat.to_numpy().reshape(len(column), -1) if pa.types.is_int64(flat.type) else None


class _Plain:
    """Many runs of one batch at once: what ``Run`` makes of runs that have results only, well formed, each key at one slice.

    ``runs`` has each row's run, rising from 0; ``odd`` says of each run whether it is not of that kind and is left to ``Run``.
    """

    MOST, KINDS_AT_ONCE = 62, KINDS
    WHOLE = ("run_id", "kind", "scenario_id", "schema_version", "slice_index", "slices", "execution_key", "total", "success", "failure", "bounds", "counts", "at_ms")

    def __init__(self, batch: pa.RecordBatch, runs: np.ndarray, count: int):
        self.batch, self.g, self.n = batch, runs, count
        self.odd = np.zeros(count, bool)
        # runs with a null or with lists of another length than most are left out at once, the others are looked at
        lengths = [batch.column(c).value_lengths().fill_null(-1).to_numpy() for c in ("bounds", "counts")]
        wide = int(np.bincount(lengths[0] + 1).argmax()) - 1
        bad = (lengths[0] != wide) | (lengths[1] != wide)
        for c in self.WHOLE:
            if batch.column(c).null_count:
                bad |= batch.column(c).is_null().to_numpy(zero_copy_only=False)
        if bad.any():
            self.odd[runs[bad]] = True
            keep = np.flatnonzero(~self.odd[runs])
            self.batch, self.g = batch.take(pa.array(keep)), runs[keep]
        if wide < 1 or not len(self.g):
            self.odd[:] = True
        else:
            self._check()

    def column(self, name: str) -> np.ndarray:
        return self.batch.column(name).to_numpy(zero_copy_only=False)

    def codes(self, name: str) -> np.ndarray:
        return self.batch.column(name).dictionary_encode().indices.to_numpy()

    def _check(self) -> None:
        b, g = self.batch, self.g
        start = np.searchsorted(g, np.arange(self.n))
        self.last = np.append(start[1:], len(g)) - 1
        first = np.minimum(start, len(g) - 1)
        i, of, at = (self.column(c).astype(np.int64) for c in ("slice_index", "slices", "at_ms"))
        sums = np.stack([self.column(c) for c in ("total", "success", "failure")], 1)
        bad = (i < 0) | (i >= of) | (of > self.MOST) | (at < 0) | (self.column("kind") != "result") | (np.abs(sums) > EXACT // len(b)).any(1)
        for same in (of, self.codes("scenario_id"), self.column("schema_version")):
            bad |= same != same[first][g]
        bad[1:] |= (at[1:] < at[:-1]) & (g[1:] == g[:-1])
        # a key stands at one slice
        key = self.codes("execution_key").astype(np.int64)
        _, where, back = np.unique(g * (int(key.max()) + 1) + key, return_index=True, return_inverse=True)
        bad |= i != i[where][back]
        bounds, counts = b.column("bounds"), b.column("counts")
        values, numbers = _numbers(bounds), _numbers(counts)
        kinds, errors = b.column("errors").keys.dictionary_encode(), b.column("errors")
        if values is None or numbers is None or len(kinds.dictionary) > self.KINDS_AT_ONCE or errors.items.null_count or errors.offset:
            self.odd[:] = True
            return
        bad |= (values != values[0]).any(1) | (numbers < 0).any(1) | (numbers > EXACT // len(b)).any(1)
        sizes = np.diff(errors.offsets.to_numpy())
        amounts = errors.items.to_numpy()
        owner = np.repeat(np.arange(len(b)), sizes)
        if len(amounts) != len(owner):
            self.odd[:] = True
            return
        bad[owner[np.abs(amounts) > EXACT // len(b)]] = True
        self.odd[g[bad]] = True
        self.first, self.i, self.of, self.at, self.sums, self.key = first, np.clip(i, 0, self.MOST), of[first], at, sums, key
        self.bounds, self.counts = [int(x) for x in bounds[0].as_py()], numbers
        self.kinds, self.kind, self.owner, self.amounts = kinds.dictionary.to_pylist(), kinds.indices.to_numpy(), owner, amounts

    def _upto(self, x: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """What has been taken of a run up to each row and with it."""
        x = np.where(taken if x.ndim == 1 else taken[:, None], x, 0)
        c = np.cumsum(x, axis=0)
        return c - (c[self.first] - x[self.first])[self.g]

    def log(self, partial_ms: int, end_ms: int | None) -> pa.RecordBatch:
        """The summaries of all runs that are not odd."""
        g, at, rows = self.g, self.at, np.arange(len(self.g))
        last = self.last
        _, where, back = np.unique(g * 64 + self.i, return_index=True, return_inverse=True)
        taken = np.zeros(len(g), bool)
        taken[where] = True
        conflict = self.key != self.key[where][back]
        received = self._upto(np.ones(len(g), np.int64), taken)
        never = len(g)

        def earliest(c: np.ndarray) -> np.ndarray:
            out = np.full(self.n, never)
            np.minimum.at(out, g[c], rows[c])
            return out

        whole = earliest(taken & (received == self.of[g]))
        deadline = at[self.first] + partial_ms
        expired = earliest((at >= deadline[g]) & (rows > self.first[g]))
        expired[expired > whole] = never
        ended = (whole == never) & (expired == never) & (deadline <= (end_ms if end_ms is not None else -(1 << 62)))
        fine = ~self.odd
        e, w, d = (np.flatnonzero(x & fine) for x in (expired < never, whole < never, ended))
        c = np.flatnonzero(conflict & fine[g])
        # of each summary: its run, the row it stands at and the last one whose state it shows
        run = np.concatenate([e, g[c], w, d])
        row = np.concatenate([expired[e], c, whole[w], last[d]])
        shown = np.concatenate([expired[e] - 1, c, whole[w], last[d]])
        phase = np.repeat([0, 1, 1, 2], [len(e), len(c), len(w), len(d)])
        order = np.lexsort((phase, row))
        run, row, shown, phase = run[order], row[order], shown[order], phase[order]
        refused = (phase == 1) & conflict[row]
        complete = (phase == 1) & (whole[run] <= row)
        timed = (phase == 2) | (expired[run] <= row)
        revision = complete.astype(np.int64) + timed
        status = np.where(complete, "complete", np.where(timed, "timed_out", "open"))
        outcome = np.where(refused, "conflict", np.where(complete, np.where(timed, "late-completed", "completed"), "expired"))
        reach = np.append(at, 0)
        final = np.where(complete, reach[whole[run]], np.where(phase == 2, end_ms or 0, reach[expired[run]]))
        names = [NAMES[x] for x in status]
        tails = ["timed-out" if x == "TimedOut" else x.lower() for x in names]
        ids = self.batch.column("run_id").take(pa.array(self.first[run])).to_pylist()
        total, success, failure = self._upto(self.sums, taken)[shown].T
        buckets = self._upto(self.counts, taken)[shown]
        p50, p95, p99 = (self._quantile(buckets, q) for q in (0.5, 0.95, 0.99))
        bins = ",".join(f"{b}=%d" for b in self.bounds)
        latest = np.maximum.accumulate(np.where(taken, rows, 0))[shown]
        memo: dict[tuple[int, int], str] = {}
        missing = []
        for seen in zip(self.of[run].tolist(), self._upto(np.int64(1) << self.i, taken)[shown].tolist(), strict=True):
            if seen not in memo:
                memo[seen] = ",".join(str(i) for i in range(seen[0]) if not seen[1] >> i & 1)
            missing.append(memo[seen])
        columns = {
            "run_id": ids, "event_id": [f"{r}:summary:r{n}:{t}" for r, n, t in zip(ids, revision.tolist(), tails, strict=True)], "scenario_id": self.batch.column("scenario_id").take(pa.array(self.first[run])), "revision": revision, "status": names,
            "received": received[shown], "expected": self.of[run], "missing": missing, "total": total, "success": success, "failure": failure, "p50_ms": p50, "p95_ms": p95, "p99_ms": p99,
            "histogram": [bins % tuple(x) for x in buckets.tolist()], "errors": self._errors(taken, shown), "first_ms": at[self.first][run], "last_ms": at[latest],
            "finalized_ms": pa.array(final, pa.int64(), mask=~(complete | timed)), "outcome": outcome.tolist(),
        }
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for f, v in zip(SCHEMA, (columns[f.name] for f in SCHEMA), strict=True)], schema=SCHEMA)

    def _quantile(self, buckets: np.ndarray, q: float) -> np.ndarray:
        shown, last = [], 0
        for b in self.bounds:
            last = b if b < (1 << 64) - 1 else last
            shown.append(last)
        upto = np.cumsum(buckets, axis=1)
        total = upto[:, -1]
        at = (upto >= np.maximum(1, np.ceil(total * q))[:, None]).argmax(1)
        return np.where(total > 0, np.array(shown, np.int64)[at], 0)

    def _errors(self, taken: np.ndarray, shown: np.ndarray) -> list[str]:
        names = sorted(self.kinds)
        place = np.array([names.index(k) for k in self.kinds], np.int64)[self.kind]
        amounts, there = np.zeros((len(taken), len(names)), np.int64), np.zeros((len(taken), len(names)), np.int64)
        amounts[self.owner, place], there[self.owner, place] = self.amounts, 1
        amounts, there = self._upto(amounts, taken)[shown].tolist(), self._upto(there, taken)[shown].tolist()
        return [",".join(f"{k}={n}" for k, n, x in zip(names, some, has, strict=True) if x) for some, has in zip(amounts, there, strict=True)]


def _fold(partial_ms: int, end_ms: int | None):
    """Batches of rows, sorted by run and ORDER, to batches of the log."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, run_id = Run(None, partial_ms), None

        def ended() -> list[dict]:
            return [now.summary(run_id, "expired")] if run_id is not None and end_ms is not None and now.expire(end_ms) else []

        def stepped(part: pa.RecordBatch) -> list[dict]:
            nonlocal now, run_id
            out = []
            for row in part.to_pylist():
                if row["run_id"] != run_id:
                    out += ended()
                    now, run_id = Run(None, partial_ms), row["run_id"]
                row["errors"] = dict(row["errors"] or {})
                if now.expire(row["at_ms"]):
                    out.append(now.summary(run_id, "expired"))
                outcome, new = now.take(row)
                if new or outcome in REFUSED:
                    out.append(now.summary(run_id, outcome))
            return out

        for batch in batches:
            ids = batch.column("run_id")
            starts = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(batch) and not ids.null_count else []
            if len(starts) < 2:
                yield pa.RecordBatch.from_pylist(stepped(batch), schema=SCHEMA)
                continue
            # the first and the last run may go on in other batches
            begin, end = int(starts[0]), int(starts[-1])
            out = stepped(batch.slice(0, begin))
            inner = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) if not c.offset else c.take(pa.array(np.arange(len(c)))) for c in batch.slice(begin, end - begin).columns], schema=batch.schema)
            marks = np.zeros(end - begin, np.int64)
            marks[starts[1:-1] - begin] = 1
            plain = _Plain(inner, np.cumsum(marks), len(starts) - 1)
            if not plain.odd.all():
                yield plain.log(partial_ms, end_ms)
            for k in np.flatnonzero(plain.odd):
                out += stepped(batch.slice(int(starts[k]), int(starts[k + 1] - starts[k])))
            out += stepped(batch.slice(end))
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
        yield pa.RecordBatch.from_pylist(ended(), schema=SCHEMA)

    return fold


def replayed(rows: DataFrame, partial_ms: int = 60_000, end_ms: int | None = None, dealt: bool = False) -> DataFrame:
    """The same log from a bounded table, in order of time; at ``end_ms`` the deadlines of runs that are still open are looked at once more.

    Rows are dealt and sorted by run and folded as they pass, so a task holds one run's state and no group is collected.
    Plain runs that lie within a batch are folded together. ``dealt`` says that a run's rows come in one partition and follow
    each other by ORDER already.
    """

    names = [f.split()[0] for f in INPUT.split(", ")]
    ready = rows.select(names) if dealt else rows.select(names).repartition("run_id").sortWithinPartitions("run_id", *ORDER)
    return ready.mapInArrow(_fold(partial_ms, end_ms), OUTPUT)


def poison(log: DataFrame) -> DataFrame:
    """The rows that were refused: in a stream the second output, split off in foreachBatch."""
    return log.where(F.col("outcome").isin(*REFUSED))


def pending(log: DataFrame, acks: DataFrame, limit: int = 1024) -> DataFrame:
    """Summaries to publish: each run's last revision that no acknowledgement (run_id, revision) has reached, the oldest first, as many as a cycle takes."""
    last = log.where(~F.col("outcome").isin(*REFUSED)).groupBy("run_id").agg(F.max_by(F.struct("revision", "event_id", "status", "finalized_ms"), "revision").alias("r")).select("run_id", "r.*")
    known = acks.groupBy("run_id").agg(F.max("revision").alias("acked"))
    open_ = last.join(known, "run_id", "left").where("acked IS NULL OR acked < revision").drop("acked")
    return open_.orderBy("finalized_ms", "run_id").limit(limit)


def admitted(active: DataFrame, arrivals: DataFrame, most: int) -> DataFrame:
    """Of runs that arrive (run_id, at_ms) those that find room beside the ``active`` ones, first come first served: a check before a micro-batch is taken."""
    new = arrivals.groupBy("run_id").agg(F.min("at_ms").alias("at_ms")).join(active.select("run_id").distinct(), "run_id", "left_anti")
    room = max(0, most - active.select("run_id").distinct().count())
    return new.orderBy("at_ms", "run_id").limit(room)
