"""Removal of long repeated byte strings with a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _powers, by_size, materialize, mix, table, tidied, utf8
from .exact import with_groups

LENGTH = 50
#: Anchors are strings of KGRAM bytes; every LENGTH-byte string holds SPAN of them and so one minimum.
KGRAM = 24
SPAN = LENGTH - KGRAM + 1
#: An anchor that more batches than this hold is dealt by its whole strings instead.
HOT = 256
TASK_BYTES = 16 << 20
#: Bytes of strings that a task gathers by bucket before it sends them.
SEND_BYTES = 24 << 20
#: Buckets that one row holds: they travel together, and are matched one after another.
SECTIONS = 4
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width] for each i, the rest of the array beyond its end."""
    size = 1
    while size * 2 <= width:
        x = np.concatenate((f(x[:-size], x[size:]), x[-size:])) if len(x) > size else x
        size *= 2
    rest = width - size
    return np.concatenate((f(x[:-rest], x[rest:]), x[-rest:])) if rest and len(x) > rest else x


def rolling(raw: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of raw[i : i + width] for each i."""
    if len(raw) < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: len(raw) - width + 1])


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last, doc): for runs of strings first..last (starts) whose least anchor has this hash.

    A string's anchor is the least hash among its k-grams, so equal strings have equal anchors.
    """
    h = rolling(raw, KGRAM)
    size = np.diff(off)
    strings = np.maximum(size - LENGTH + 1, 0)
    which = np.repeat(np.arange(len(size)), strings)
    starts = off[:-1][which] + np.arange(strings.sum()) - (np.cumsum(strings) - strings)[which]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, which
    least = _slide(h, SPAN, np.minimum)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (which[1:] != which[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1
    return least[at], starts[at], starts[last], which[at]


def _same(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether raw[a : a + LENGTH] equals raw[b : b + LENGTH], eight bytes at a time."""
    eight = np.ndarray((max(0, len(raw) - 7),), np.uint64, np.ascontiguousarray(raw), strides=(1,))
    same = np.ones(len(a), bool)
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        same &= eight[a + k] == eight[b + k]
    return same


def _short(h: np.ndarray) -> np.ndarray:
    """The upper 5 bytes of each hash: enough to propose anchors, as strings are compared in full later."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 3:])


def _long(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(data, np.uint8, 5 * n).reshape(n, 5)
    return wide.reshape(-1).view(np.uint64)


def _pack(*parts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(p).tobytes() for p in parts))


def _open(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _strings(ids: np.ndarray, *more: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (np.array([len(ids)], np.int64), ids, *more))


def _sectioned(sections: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(x) for x in sections], np.int64).tobytes() + b"".join(sections))


def _sections(blob: bytes) -> list[bytes]:
    data = memoryview(_open(blob))
    ends = 8 * SECTIONS + np.cumsum(np.frombuffer(data, np.int64, SECTIONS))
    return [data[a:b] for a, b in zip(np.append(8 * SECTIONS, ends[:-1]), ends, strict=True)]


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64)


def _rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "chunk": pa.int64(), "kind": pa.int32(), "payload": pa.binary(), "doc_id": pa.int64(), "rid": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)], names=names)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they are shuffled: compressed, with their size."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in by_size(batches, "text", 2 << 20):
        raw, off = utf8(batch.column(2))
        blobs = [z.compress(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), np.diff(off), pa.array(blobs, pa.binary())], names=["doc_id", "rid", "n", "body"])


def _texts(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows in batches of about ``most`` text bytes, with their texts end to end and the offsets."""
    z, sizes, at = zstandard.ZstdDecompressor(), batch.column(2).to_numpy(), 0
    off = np.append(0, np.cumsum(sizes))
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        part = batch.slice(at, end - at)
        raw = np.frombuffer(b"".join(z.decompress(b) if n else b"" for b, n in zip(part.column(3).to_pylist(), sizes[at:end], strict=True)), np.uint8)
        yield part, raw, off[at : end + 1] - off[at]
        at = end


def _offer(buckets: int):
    """Pass 1: the distinct anchors of each document, by bucket of hash; and which documents a chunk has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        for batch in by_size(batches, "text", 2 << 20):
            raw, off = utf8(batch.column(2))
            h, _, _, which = anchors(raw, off)
            both = np.lexsort((h, which))
            h, which = h[both], which[both]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (which[1:] != which[:-1])
            h, which = h[first], which[first]
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, which, bucket = _short(h[order]), which[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h) else np.zeros(0, int)
            out = [(-1 - chunk, chunk, 1, _pack(_ids(batch.column(0)), _ids(batch.column(1))))]
            for a, b in zip(cuts, np.append(cuts[1:], len(which)), strict=True):
                out.append((int(bucket[a]), chunk, 0, _pack(h[a:b], np.diff(which[a:b], prepend=0).astype(np.int32))))
            yield _rows(["key", "chunk", "kind", "payload"], out)
            chunk += 1

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which anchors several documents share, told to each chunk that offered one; the hot ones apart."""
    blobs: list[tuple[int, bytes]] = []
    for batch in batches:
        for chunk, kind, payload in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if kind:
                yield _rows(["chunk", "kind", "payload"], [(chunk, 1, payload)])
            else:
                blobs.append((chunk, payload))
    hashes, whiches, sizes = [], [], []
    for _, payload in blobs:
        data = _open(payload)
        n = len(data) // 9
        hashes.append(_long(data, n))
        whiches.append(np.cumsum(np.frombuffer(data, np.int32, n, 5 * n)).astype(np.int32))
        sizes.append(n)
    if not blobs:
        return
    h, which, of = np.concatenate(hashes), np.concatenate(whiches), np.repeat(np.arange(len(blobs)), sizes)
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(h)))
    total = np.empty(len(h), np.int64)
    total[order] = np.repeat(count, count)
    shared = np.flatnonzero(total > 1)
    cut = np.searchsorted(of[shared], np.arange(len(blobs) + 1))
    for i, (chunk, _) in enumerate(blobs):
        at = shared[cut[i] : cut[i + 1]]
        if len(at):
            hot = (total[at] > HOT).astype(np.uint8)
            yield _rows(["chunk", "kind", "payload"], [(chunk, 0, _pack(_short(h[at]), which[at], hot))])


def _address(group: pd.DataFrame) -> pd.DataFrame:
    """One chunk's answers, by document."""
    names = _open(group.loc[group["kind"] == 1, "payload"].iloc[0])
    n = len(names) // 16
    ids, rids = np.frombuffer(names, np.int64, n), np.frombuffer(names, np.int64, n, 8 * n)
    parts = [_open(p) for p in group.loc[group["kind"] == 0, "payload"]]
    m = [len(p) // 10 for p in parts]
    if not parts:
        return pd.DataFrame({"doc_id": ids[:0], "rid": rids[:0], "shared": np.zeros(0, object)})
    h = np.concatenate([_long(p, k) for p, k in zip(parts, m, strict=True)])
    which = np.concatenate([np.frombuffer(p, np.int32, k, 5 * k) for p, k in zip(parts, m, strict=True)])
    hot = np.concatenate([np.frombuffer(p, np.uint8, k, 9 * k) for p, k in zip(parts, m, strict=True)])
    order = np.argsort(which, kind="stable")
    h, which, hot = h[order], which[order], hot[order]
    docs, at = np.unique(which, return_index=True)
    ends = np.append(at[1:], len(which))
    blobs = [_short(h[a:b]).tobytes() + hot[a:b].tobytes() for a, b in zip(at, ends, strict=True)]
    return pd.DataFrame({"doc_id": ids[docs], "rid": rids[docs], "shared": blobs})


def _settled(raw: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(done, ready): strings that a smaller document of this batch has too, and those to ask about.

    A passage that very many documents share so leaves each batch once.
    """
    if not len(at):
        return np.zeros(0, bool), np.zeros(0, bool)
    h = rolling(raw, LENGTH)[at]
    order = np.lexsort((doc, h))
    new = np.append(True, h[order][1:] != h[order][:-1])
    head = np.empty(len(at), np.int64)
    head[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    done = _same(raw, at, at[head]) & (doc[head] < doc)
    return done, ~done


def _extract(buckets: int):
    """Pass 2: around each shared anchor the bytes of its strings, by bucket of the anchor (hot: of the string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        size_held = 0

        def send() -> pa.RecordBatch:
            rows = []
            for key in sorted({bucket // SECTIONS for bucket in held}):
                parts = [held.pop(key * SECTIONS + i, None) for i in range(SECTIONS)]
                rows.append((key, _sectioned([b"" if p is None else _strings(*(np.concatenate(x) for x in zip(*p, strict=True))) for p in parts])))
            return _rows(["key", "payload"], rows)

        live = (b.filter(pc.and_(b.column(4).is_valid(), b.column(5).is_null())) for b in batches)
        for batch, raw, off in (part for b in live for part in _texts(b)):
            ids, rids = _ids(batch.column(0)), _ids(batch.column(1))
            h, first, last, which = anchors(raw, off)
            keep, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
            lo = np.searchsorted(which, np.arange(len(ids) + 1))
            for d, blob in enumerate(batch.column(4).to_pylist()):
                if blob:
                    n = len(blob) // 6
                    want, warm = _long(blob, n), np.frombuffer(blob, np.uint8, n, 5 * n)
                    order = np.argsort(want)
                    want, warm = want[order], warm[order]
                    own = h[lo[d] : lo[d + 1]] & ~np.uint64(0xFFFFFF)
                    at = np.minimum(np.searchsorted(want, own), n - 1)
                    keep[lo[d] : lo[d + 1]] = want[at] == own
                    hot[lo[d] : lo[d + 1]] = (want[at] == own) & (warm[at] > 0)
            wide = keep & ~hot
            n = (last - first + 1)[hot]
            each = np.repeat(np.flatnonzero(hot), n)
            one = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            done, ready = _settled(raw, one, ids[which[each]])
            if done.any():
                o, b = which[each[done]], one[done] - off[:-1][which[each[done]]]
                yield _rows(["key", "payload"], [(-1 - int(o[0]), _sectioned([b"".join(x.tobytes() for x in (np.array([-len(o)], np.int64), ids[o], rids[o], b)), *[b""] * (SECTIONS - 1)]))])
            one, each = one[ready], each[ready]
            begin = np.concatenate((first[wide], one))
            size = np.concatenate(((last - first)[wide] + LENGTH, np.full(len(one), LENGTH))).astype(np.int64)
            key = np.concatenate((h[wide], rolling(raw, LENGTH)[one] if len(one) else np.zeros(0, np.uint64)))
            owner = np.concatenate((which[wide], which[each]))
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            begin, size, owner, bucket = begin[order], size[order], owner[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(begin) else np.zeros(0, int)
            for a, b in zip(cuts, np.append(cuts[1:], len(begin)), strict=True):
                total = np.cumsum(size[a:b])
                take = np.repeat(begin[a:b] - (total - size[a:b]), size[a:b]) + np.arange(total[-1])
                o = owner[a:b]
                held.setdefault(int(bucket[a]), []).append((ids[o], rids[o], begin[a:b] - off[:-1][o], size[a:b], raw[take]))
                size_held += int(total[-1])
            if size_held > SEND_BYTES:
                yield send()
                size_held = 0
        if held:
            yield send()

    return run


#: Places of the eight-byte words by which suffixes are compared; the last ends with byte LENGTH.
_WORDS = (*range(0, LENGTH - 7, 8), LENGTH - 8)


class SuffixLevels:
    """A logarithmic family of suffix arrays over one text: levels of doubling size, each its suffixes in order.

    Suffixes are compared over their first LENGTH bytes, as longer matches need not be told apart. ``add``
    takes the suffixes of a batch of documents that all come after the earlier batches: it builds their suffix
    array, merge-scans it against every level, and then merges levels of like size.
    """

    def __init__(self, raw: np.ndarray) -> None:
        self.eight = np.ndarray((max(0, len(raw) - 7),), ">u8", np.ascontiguousarray(raw), strides=(1,))
        #: Of each level: the first word of each suffix, where it starts, and its number.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _word(self, at: np.ndarray, k: int) -> np.ndarray:
        return self.eight[at + _WORDS[k]].astype(np.uint64)

    def _sorted(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array of these starts, equal ones in their order, and where it has a new one.

        By the first word; ties, and only they, by the words behind.
        """
        key = self._word(at, 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        for k in range(1, len(_WORDS)):
            tied = np.flatnonzero(~new | np.append(~new[1:], False))
            if not len(tied):
                break
            group, word = np.cumsum(new)[tied], self._word(at[order[tied]], k)
            inside = np.lexsort((word, group))
            order[tied] = order[tied[inside]]
            word, group = word[inside], group[inside]
            new[tied[1:]] |= (word[1:] != word[:-1]) | (group[1:] != group[:-1])
        return order, new

    def _place(self, level: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted suffixes (first words, starts) their places in a level, and whether it has them: one merge by first words, then by the words behind."""
        heads, starts, _ = level
        low, high = np.searchsorted(heads, first), np.searchsorted(heads, first, "right")
        open_ = np.flatnonzero(low < high)
        hit = np.zeros(len(at), bool)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            mine, theirs = at[open_], starts[middle]
            sign = np.zeros(len(open_), np.int8)
            even = np.arange(len(open_))
            for k in range(1, len(_WORDS)):
                a, b = self._word(mine[even], k), self._word(theirs[even], k)
                sign[even] = (b > a).astype(np.int8) - (b < a)
                even = even[a == b]
                if not len(even):
                    break
            hit[open_[even]] = True
            low[open_] = np.where(sign < 0, middle + 1, np.where(sign == 0, middle, low[open_]))
            high[open_] = np.where(sign > 0, middle, np.where(sign == 0, middle, high[open_]))
            open_ = open_[low[open_] < high[open_]]
        return low, hit

    def add(self, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix (start and number) the number of an equal one of an earlier batch, or -1; and the first place in this batch with its bytes."""
        order, new = self._sorted(at)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        starts, first = at[order[head]], self._word(at[order[head]], 0)
        old = np.full(len(head), -1, np.int64)
        for level in self.levels:
            ask = np.flatnonzero(old < 0)
            place, hit = self._place(level, first[ask], starts[ask])
            old[ask[hit]] = level[2][place[hit]]
        found, least = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        found[order], least[order] = np.repeat(old, size), np.repeat(order[head], size)
        fresh = old < 0
        made = (first[fresh], starts[fresh], rows[order[head[fresh]]])
        while self.levels and len(self.levels[-1][0]) <= len(made[0]):
            level = self.levels.pop()
            place, _ = self._place(level, made[0], made[1])
            made = tuple(np.insert(a, place, b) for a, b in zip(level, made, strict=True))
        if len(made[0]):
            self.levels.append(made)
        return found, least


def _earlier(raw: np.ndarray, at: np.ndarray, doc: np.ndarray, batch: int = 1 << 16) -> np.ndarray:
    """Whether raw[at : at + LENGTH] is also that of an entry with a smaller doc. ``doc`` is sorted."""
    found, index, a = np.zeros(len(at), bool), SuffixLevels(raw), 0
    while a < len(at):
        b = int(np.searchsorted(doc, doc[min(a + batch, len(at)) - 1], "right"))
        own, head = index.add(at[a:b], np.arange(a, b))
        # the first of equal suffixes is of the batch's smallest doc that has it
        found[a:b] = (own >= 0) | (doc[a:b][head] < doc[a:b])
        a = b
    return found


def _runs(d: np.ndarray, r: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """(doc_id, rid, begin, end) of the runs that strings of LENGTH bytes at these starts make."""
    order = np.lexsort((start, r, d))
    d, r, start = d[order], r[order], start[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (start[1:] > start[:-1] + LENGTH)
    at = np.flatnonzero(new)
    return [d[at], r[at], start[at], start[np.append(at[1:], len(d)) - 1] + LENGTH if len(d) else start]


def _bucket_runs(sections: list[bytes]) -> list[np.ndarray]:
    """The strings of one bucket that an earlier document has, as runs."""
    parts, sure = [], []
    for data in sections:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        if n < 0:
            sure.append([np.frombuffer(data, np.int64, -n, 8 - 8 * n * i) for i in range(3)])
        else:
            parts.append([np.frombuffer(data, np.int64, n, 8 + 8 * n * i) for i in range(4)] + [np.frombuffer(data, np.uint8, -1, 8 + 32 * n)])
    if parts:
        ids, rids, begin, size, raw = (np.concatenate(p) for p in zip(*parts, strict=True))
        strings = size - LENGTH + 1
        where = np.cumsum(size) - size
        order = np.argsort(ids, kind="stable")
        strings = strings[order]
        entry = np.repeat(order, strings)
        step = np.arange(len(entry)) - np.repeat(np.cumsum(strings) - strings, strings)
        hit = _earlier(raw, where[entry] + step, ids[entry])
        entry, step = entry[hit], step[hit]
        sure.append([ids[entry], rids[entry], begin[entry] + step])
    return _runs(*(np.concatenate(x) for x in zip(*sure, strict=True)))


def _match(parts: int):
    """Bucket by bucket, what to remove; sent on as one row for each of the ``parts`` that documents are dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(max(key, -1), []).append(payload)
        if not held:
            return
        found = []
        for key in list(held):
            for own in zip(*map(_sections, held.pop(key)), strict=True):
                if any(own):
                    found.append(_bucket_runs([x for x in own if len(x)]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        to = (mix(columns[1].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1])) if len(to) else np.zeros(0, int)
        rows = [(int(to[order[a]]), _pack(*(c[order[a:b]] for c in columns))) for a, b in zip(cuts, np.append(cuts[1:], len(to)), strict=True)]
        yield _rows(["key", "payload"], rows)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: all its runs."""
    found = []
    for batch in batches:
        for data in map(_open, batch.column(1).to_pylist()):
            n = len(data) // 32
            found.append([np.frombuffer(data, np.int64, n, 8 * n * i) for i in range(4)])
    if not found:
        return
    d, r, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((begin, r, d))
    d, r, pairs = d[order], r[order], np.stack((begin[order], end[order]), axis=1)
    cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1])))
    ends = np.append(cut[1:], len(d))
    for at in range(0, len(cut), 4096):
        some = cut[at : at + 4096]
        blobs = [pairs[a:b].tobytes() for a, b in zip(some, ends[at : at + 4096], strict=True)]
        yield pa.RecordBatch.from_arrays([d[some], r[some], pa.array(blobs, pa.binary())], names=["doc_id", "rid", "spans"])


def _spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sorted, merged [begin, end) pairs; touching ones become one."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return np.stack((begin[at], reach[np.append(at[1:], len(begin)) - 1]), axis=1).astype(np.int64)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, off in (part for b in batches for part in _texts(b)):
        out = []
        for d, (copy, blob) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            own = raw[off[d] : off[d + 1]]
            n = len(own)
            pairs = np.array([[0, n]]) if copy else np.frombuffer(blob or b"", np.int64).reshape(-1, 2)
            gone = _spans(pairs[:, 0], pairs[:, 1]) if len(pairs) else pairs
            keep, at = hashlib.sha256(), 0
            for a, b in gone:
                keep.update(own[at:a])
                at = b
            keep.update(own[at:])
            out.append((n, int((gone[:, 1] - gone[:, 0]).sum()), len(gone), keep.hexdigest(), gone.reshape(-1).tolist()))
        cols = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Bytes covered by a 50-byte string that also starts in a document with a smaller doc_id.

    Suffixes are taken where they can matter. Each 50-byte string is filed under its least 24-byte
    anchor, so equal strings are filed alike wherever they stand. Pass 1 counts anchors over all
    documents; pass 2 sends the bytes around anchors that several documents share to tasks by anchor,
    which index them, batch after batch in doc_id order, in a logarithmic family of suffix arrays: each
    batch's is merge-scanned against those that are there. Documents equal to an earlier one are found by
    digest, heavy digests apart.

    Null text is empty; texts under 50 bytes lose nothing. A null doc_id is neither smaller nor larger
    than another: such a row loses nothing and takes nothing away. Rows that share a doc_id take
    nothing from each other. An empty table gives an empty result. Other columns are ignored.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (flat [begin, end) byte offsets).
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], F.xxhash64(docs["doc_id"], text).alias("rid"), text.alias("text"))
    tags = rows.where("doc_id IS NOT NULL").select("doc_id", "rid", F.octet_length("text").alias("n"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    tags = materialize(tags, "digests")
    total = tags.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)
    firsts = with_groups(tags.where(F.col("n") >= LENGTH).withColumnRenamed("sha", "digest"), [F.min("doc_id").alias("first")])
    copies = firsts.where("doc_id > first").select("doc_id", "rid", F.lit(True).alias("copy"))
    copies = materialize(copies.repartition(parts, "doc_id", "rid").distinct(), "copies")
    live = rows.where("doc_id IS NOT NULL")
    told = live.mapInArrow(tidied(_offer(4 * parts)), "key long, chunk long, kind int, payload binary").repartition(parts, "key").mapInArrow(tidied(_answer), "chunk long, kind int, payload binary")
    shared = told.groupBy("chunk").applyInPandas(_address, "doc_id long, rid long, shared binary")
    shared = shared.repartition(parts, "doc_id", "rid").groupBy("doc_id", "rid").agg(F.first("shared").alias("shared"))
    dealt = rows.mapInArrow(tidied(_squeeze), "doc_id long, rid long, n long, body binary").repartition(parts, "doc_id", "rid")
    copies = copies.repartition(parts, "doc_id", "rid")
    # both uses of the texts are left joins of one exchange, so that the second reuses the first's files; all sides are dealt alike
    asked = dealt.join(shared, ["doc_id", "rid"], "left").join(copies, ["doc_id", "rid"], "left")
    sent = asked.select("doc_id", "rid", "n", "body", "shared", "copy").mapInArrow(tidied(_extract(4 * SECTIONS * parts)), "key long, payload binary").repartition(parts, "key")
    spans = sent.mapInArrow(tidied(_match(parts)), "key long, payload binary").repartition(parts, "key").mapInArrow(tidied(_gather), "doc_id long, rid long, spans binary").repartition(parts, "doc_id", "rid")
    final = dealt.join(spans, ["doc_id", "rid"], "left").join(copies, ["doc_id", "rid"], "left")
    return final.select("doc_id", "rid", "n", "body", "copy", "spans").mapInArrow(tidied(_remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")
