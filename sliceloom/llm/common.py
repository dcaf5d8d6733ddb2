"""Shared pieces: scratch tables, byte-level word and shingle hashing, batching by size.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where intermediate tables go without a cluster.
DEFAULT_SHARED = "/tmp/checkpoints"
WORD_SQL = r"[^\x20\x09-\x0D]+"
GAP_SQL = r"[\x20\x09-\x0D]+"


def _shared(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local default only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{(base or DEFAULT_SHARED).rstrip('/')}/sliceloom"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables: once results that read them have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_shared(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Within, batches on their way to Python have so many bytes, or one longer row: they are held by the JVM, by Arrow and by Python at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there."""
    path = shared_dir(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings end to end, and n + 1 offsets into them. Null counts as empty."""
    col = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Free memory of this worker, which lives on when its task has ended, goes back to the system: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run):
    """``run``, a function of batches, with ``give_back`` at its end."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidy


def by_size(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` text bytes, or of one longer row. At the end memory is given back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_P = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in ``raw``, and n + 1 offsets of the documents' words."""
    n = len(raw)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[off[:-1]] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | np.append(edge[1:n], True)[:n])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, with repeats, and their n + 1 document offsets.

    A document of 1 to k - 1 words has its whole sequence as one shingle; one without words has none.
    """
    n = np.diff(doc)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.concatenate(([0], np.cumsum(count)))
    which = np.repeat(np.arange(len(n)), count)
    at = doc[:-1][which] + np.arange(out_off[-1]) - out_off[:-1][which]
    size = np.minimum(n, k)[which]
    acc = size.astype(np.uint64)
    padded = np.append(hashes, np.zeros(k, np.uint64))
    for j in range(k):
        part = np.where(j < size, padded[at + j], np.uint64(0))
        acc = mix(acc * np.uint64(0xD1342543DE82EF95) + part + np.uint64(j + 1))
    return acc, out_off
