"""Execution leases as a fold over their log: claim, renew, complete, release, in order of time.

A row has key, op, owner, at_ms, lease_ms. A key is claimed by one owner until its lease ends; a completed key is
never run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

OUTPUT = "key string, op string, owner string, at_ms long, outcome string"
SCHEMA = pa.schema([("key", pa.string()), ("op", pa.string()), ("owner", pa.string()), ("at_ms", pa.int64()), ("outcome", pa.string())])


class Lease:
    def __init__(self) -> None:
        self.owner: str | None = None
        self.until = 0
        self.done = False

    def take(self, op: str, owner: str, at_ms: int, lease_ms: int) -> str:
        """claim: acquired, recovered (from an owner whose lease ended), busy or completed. Others: done, or lost where the owner has no lease."""
        held = self.owner is not None and at_ms < self.until
        if op == "claim":
            if self.done:
                return "completed"
            if held and self.owner != owner:
                return "busy"
            before, self.owner, self.until = self.owner, owner, at_ms + lease_ms
            return "acquired" if before in (None, owner) else "recovered"
        if self.done or not held or self.owner != owner:
            return "completed" if self.done and op == "complete" and self.owner == owner else "lost"
        if op == "renew":
            self.until = at_ms + lease_ms
        elif op == "complete":
            self.done = True
        else:
            self.owner = None
        return "done"


def outcomes(log: DataFrame) -> DataFrame:
    """What came of every row; rows are dealt and sorted by key and folded as they pass."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lease, key = Lease(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    lease, key = Lease(), row["key"]
                out.append({**{c: row[c] for c in ("key", "op", "owner", "at_ms")}, "outcome": lease.take(row["op"], row["owner"], row["at_ms"], row["lease_ms"])})
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    rows = log.select("key", "op", "owner", "at_ms", "lease_ms").repartition("key").sortWithinPartitions("key", "at_ms", "owner", "op")
    return rows.mapInArrow(fold, OUTPUT)
