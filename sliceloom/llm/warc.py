"""WARC archives: written with revisit records, read in splits with boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table
from .exact import with_groups
from .files import read_range, write_file

#: An archive is closed when its records have this many bytes; a reading task takes this many.
FILE_BYTES, SPLIT_BYTES = 16 << 20, 4 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP, _PLAIN = b"\x1f\x8b\x08", b"WARC/1."
_HEAD = re.compile(rb"WARC/1\.\d\r\n((?:[^\r\n]+\r\n)*)\r\n")
_SAFE = str.maketrans({c: f"%{c:02X}" for c in [*range(33), 127]})


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, refers_url: str | None = None, place: str = "") -> bytes:
    """One record: the payload in an HTTP response, or a revisit that names the page that has it.

    Its id comes from ``place``, where it stands, as page_ids may repeat or be null; a revisit names the
    other page by id and url.
    """
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place or f'page:{page_id}')}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.translate(_SAFE)))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    head += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("X-Payload-Length", str(len(payload)))]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", str(refers_to))]
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", refers_url.translate(_SAFE)))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(folder: str, compressed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held, size
            name = f"{folder}/{part:07d}-{seq:05d}.warc" + ".gz" * compressed
            write_file(name, b"".join(held))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], names=["file", "size"])
            seq, held, size = seq + 1, [], 0
            return row

        for batch in batches:
            for page, url, html, to, there in zip(*(batch.column(i) for i in range(5)), strict=True):
                place = f"{folder}/{part}/{seq}/{len(held)}"
                data = record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), to.as_py(), there.as_py(), place)
                held.append(gzipped(data) if compressed else data)
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield close()
        if held:
            yield close()

    return run


def write_archives(pages: DataFrame, compressed: bool = True) -> DataFrame:
    """Archives of all pages, and (file, size) of each. Of pages with equal payloads the one with the
    largest page_id is a response, the others revisit it; pages that tie for it are all responses."""
    folder = shared_dir(pages.sparkSession, "warc")
    rows = pages.select(pages["page_id"], pages["url"], pages["html"])
    digest = F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)).alias("digest")
    keys = materialize(rows.select("page_id", "url", digest), "page-digests")
    groups = with_groups(keys, [F.max(F.struct("page_id", "url")).alias("most"), F.count(F.lit(1)).alias("n")]).where("n > 1")
    later = groups.where("most.page_id IS NOT NULL AND (page_id IS NULL OR page_id < most.page_id)")
    later = later.select(F.col("page_id").alias("own"), F.col("digest").alias("key"), F.col("most.page_id").alias("to"), F.col("most.url").alias("there")).distinct()
    dealt = rows.withColumn("digest", digest).join(later, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("key")), "left")
    return materialize(dealt.select("page_id", "url", "html", "to", "there").mapInArrow(_write(folder, compressed), "file string, size long"), "archives")


def _parse(data: bytes) -> tuple[int, dict] | None:
    """Length of the plain record at the start of ``data``, and what it says; None if there is no whole record."""
    m = _HEAD.match(data)
    if not m:
        return None
    head = {}
    for line in m[1].decode("utf-8", "replace").split("\r\n")[:-1]:
        k, colon, v = line.partition(":")
        if colon:
            head[k.strip().lower()] = v.strip()
    if not head.get("content-length", "").isdigit():
        return None
    end = m.end() + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[m.end() : end]
    if head.get("warc-type") == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        head |= {"x-payload-length": str(len(payload)), "warc-payload-digest": f"sha1:{sha1_base32(payload)}"}
    return end + 4, head


def _whole(uri: str, size: int, at: int, data: bytes, inside: int, compressed: bool) -> tuple[int, dict] | None:
    """The record at ``at``, where data[inside:] begins; more is read while it goes on beyond."""
    view, step = data[inside:], SPLIT_BYTES
    while True:
        have_all = at + len(view) >= size
        if compressed:
            z = zlib.decompressobj(31)
            try:
                plain = z.decompress(view)
            except zlib.error:
                return None
            if z.eof:
                got = _parse(plain)
                return (len(view) - len(z.unused_data), got[1]) if got and got[0] == len(plain) else None
            if plain[:7] != _PLAIN[: len(plain)]:
                return None
        else:
            got = _parse(view)
            if got:
                return got
            m = _HEAD.match(view)
            declared = re.search(rb"(?i)content-length:\s*(\d+)", m[1]) if m else None
            if m and (not declared or m.end() + int(declared[1]) + 4 <= len(view)) or not m and len(view) > 1 << 16:
                return None
        if have_all:
            return None
        view += read_range(uri, at + len(view), min(step, size - at - len(view)))
        step *= 2


def _candidates(split: int):
    """Every place of a split where a record may begin, its successor, and what the record says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, begin in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                compressed = uri.endswith(".gz")
                magic = _GZIP if compressed else _PLAIN
                stop = min(begin + split, size)
                data = read_range(uri, begin, min(stop + (1 << 16), size) - begin)
                rows, at = [], data.find(magic)
                while 0 <= at < stop - begin:
                    if got := _whole(uri, size, begin + at, data, at, compressed):
                        n, h = got
                        number = lambda k: int(h[k]) if re.fullmatch(r"-?\d+", h.get(k, "")) else None
                        rows.append((uri, begin + at, begin + at + n, number("x-page-id"), number("x-payload-length"), h.get("warc-payload-digest", "").removeprefix("sha1:"), h.get("warc-type"), number("x-refers-to-page"), h.get("warc-target-uri")))
                    at = data.find(magic, at + 1)
                kinds = (pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "at", "next", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return run


_SCHEMA = "file string, at long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def reachable(at: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which of the sorted offsets the chain from offset 0 visits, by pointer jumping.

    Each round joins the chain that the marked offsets have to the places that it reaches in twice as
    many steps, so a file of n records takes log2(n) rounds.
    """
    n = len(at)
    jump = np.searchsorted(at, successor)
    jump = np.append(np.where((jump < n) & (at[np.minimum(jump, n - 1)] == successor), jump, n), n)
    mark = np.append(at == 0, False)
    for _ in range(max(1, n).bit_length()):
        mark[jump[np.flatnonzero(mark)]] = True
        jump = jump[jump]
    return mark[:n]


def _chain(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    return group[reachable(group["at"].to_numpy(), group["next"].to_numpy())]


def read_archives(files: DataFrame) -> DataFrame:
    """The records of the archives (file, size): file, at, next, page_id, payload_bytes, payload_digest,
    record_type, refers_to, url.

    Each split of a file proposes candidates: places with a record's magic where a whole record parses,
    with the place after it. Payloads may hold such places too, even whole records; those are not on the
    chain of successors from the file's start, and go. A file's offsets, some bytes a record, meet in one task.
    """
    splits = files.select("file", "size", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {SPLIT_BYTES}L)")).alias("begin"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = splits.repartition(n, "file", "begin").mapInArrow(_candidates(SPLIT_BYTES), _SCHEMA)
    found = materialize(found, "candidates")
    chains = found.select("file", "at", "next").groupBy("file").applyInPandas(_chain, "file string, at long, next long")
    return found.join(chains.select("file", "at"), ["file", "at"])


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from its archive.

    Null html is an empty payload, and empty payloads equal each other. A null page_id revisits any
    equal page that has an id, and is a response where none has. Null urls are left out of the header,
    control characters in urls are escaped. An empty table writes no archive and gives an empty result.
    Other columns are ignored.
    """
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))
