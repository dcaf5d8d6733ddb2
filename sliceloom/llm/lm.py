"""Masked pseudo-likelihood: a bidirectional window network and the corpus's own counts score every word from both sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, lower_ascii, mix, table, utf8, word_hashes, words

#: Word hashes are counted in this many slots.
SLOTS = 1 << 16
#: Classes of words: 0 is the edge of a document, REST classes share the rarer words, the others are one slot each.
CLASSES, REST = 128, 24
#: A task's counts are sent in this many ranges.
RANGES = 64
WIDTH, STEPS, RATE = 32, 150, 0.03
#: A bucket of (word, context) counts is made for so many words of the corpus; the least number of buckets.
BUCKET_WORDS, BUCKETS = 1 << 20, 64
#: What p(word | class) weighs against the counts of a context, in words.
PRIOR = 10.0
CELLS = "part int, batch long, words binary, contexts binary, numbers binary"


def _hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = lower_ascii(raw)
    starts, ends, doc = words(raw, off)
    return word_hashes(raw, starts, ends), doc


def _slot(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(SLOTS)).astype(np.int64)


def _slots(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, doc = _hashes(raw, off)
    return _slot(h), doc


def _sent(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The cells that are not 0 as (range, cells and counts)."""
    at = np.flatnonzero(total)
    size = -(-len(total) // RANGES)
    cut = np.searchsorted(at, np.arange(RANGES + 1) * size)
    rows = [(r, at[a:b].astype(np.int32).tobytes() + total[at[a:b]].tobytes()) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "cells"])


def _added(group: pd.DataFrame) -> pd.DataFrame:
    cells, counts = [], []
    for blob in group["cells"]:
        n = len(blob) // 12
        cells.append(np.frombuffer(blob, np.int32, n))
        counts.append(np.frombuffer(blob, np.int64, n, 4 * n))
        if len(cells) > 64:
            cells, counts = _sum(cells, counts)
    cells, counts = _sum(cells, counts)
    return pd.DataFrame({"cells": [cells[0].tobytes() + counts[0].tobytes()]})


def _sum(cells: list, counts: list) -> tuple[list, list]:
    at, inverse = np.unique(np.concatenate(cells), return_inverse=True)
    return [at], [np.bincount(inverse, np.concatenate(counts), minlength=len(at)).astype(np.int64)]


def _counted(docs: DataFrame, count, cells: int) -> np.ndarray:
    """Sum over all documents of what ``count`` adds to an array of ``cells`` numbers; the array is all that is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in by_size(batches, "text", 4 << 20):
            count(total, *utf8(batch.column(0)))
        yield from _sent(total)

    sums = docs.select(docs["text"]).mapInArrow(run, "part int, cells binary").groupBy("part").applyInPandas(_added, "cells binary")
    total = np.zeros(cells, np.int64)
    for row in sums.toLocalIterator():
        n = len(row["cells"]) // 12
        total[np.frombuffer(row["cells"], np.int32, n)] = np.frombuffer(row["cells"], np.int64, n, 4 * n)
    return total


def classes_of(counts: np.ndarray) -> np.ndarray:
    """The class of each slot: the most frequent have one each, the others share REST classes by hash."""
    out = 1 + (mix(np.arange(SLOTS, dtype=np.uint64)) % np.uint64(REST)).astype(np.int64)
    own = np.argsort(-counts, kind="stable")[: CLASSES - 1 - REST]
    out[own] = 1 + REST + np.arange(len(own))
    return out


def _context(slot: np.ndarray, doc: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, own) class of each word; the edge of a document is class 0."""
    own = kind[slot]
    left, right = np.append(0, own[:-1])[: len(own)], np.append(own[1:], 0)[: len(own)]
    some = doc[:-1] < doc[1:]
    left[doc[:-1][some]] = 0
    right[doc[1:][some] - 1] = 0
    return left, right, own


class WindowNetwork:
    """log p(word | left, right): one embedding a side, a tanh layer, a softmax over the classes."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        shape = {"l": (CLASSES, WIDTH), "r": (CLASSES, WIDTH), "u": (WIDTH, CLASSES)}
        self.w = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shape.items()}
        self.w["c"] = np.zeros(CLASSES, np.float32)

    def _forward(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(self.w["l"][left] + self.w["r"][right])
        z = hidden @ self.w["u"] + self.w["c"]
        z -= z.max(axis=1, keepdims=True)
        return hidden, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, counts: np.ndarray, steps: int = STEPS, rate: float = RATE) -> WindowNetwork:
        """Adam on the whole corpus at once, as counts of (left, right, word)."""
        flat = counts.reshape(CLASSES * CLASSES, CLASSES)
        live = np.flatnonzero(flat.sum(axis=1))
        if not len(live):
            return self
        left, right = live // CLASSES, live % CLASSES
        target = (flat[live] / flat.sum()).astype(np.float32)
        weight = target.sum(axis=1, keepdims=True)
        self.w["c"] = np.log((target.sum(axis=0) + 1e-6) / (1 + 1e-6 * CLASSES)).astype(np.float32)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for t in range(1, steps + 1):
            hidden, logp = self._forward(left, right)
            dz = np.exp(logp) * weight - target
            dh = (dz @ self.w["u"].T) * (1 - hidden * hidden)
            grad = {"u": hidden.T @ dz, "c": dz.sum(axis=0), "l": np.zeros_like(self.w["l"]), "r": np.zeros_like(self.w["r"])}
            np.add.at(grad["l"], left, dh)
            np.add.at(grad["r"], right, dh)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] = self.w[k] - (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-10)).astype(np.float32)
        return self

    def table(self) -> np.ndarray:
        """log p for every (left, right, word): CLASSES cubed numbers."""
        every = np.arange(CLASSES * CLASSES)
        return self._forward(every // CLASSES, every % CLASSES)[1].reshape(-1)


def _tallied(h: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (word, context) once, in order, and the sum of its numbers."""
    order = np.lexsort((context, h))
    h, context, n = h[order], context[order], n[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (context[1:] != context[:-1]))[: len(h)])
    return h[first], context[first], np.add.reduceat(n, first) if len(first) else n


def _dealt(h: np.ndarray, context: np.ndarray, kind: np.ndarray, parts: int) -> np.ndarray:
    """The bucket: of the word, or of word and context where the word's slot has a class of its own and may be frequent."""
    spread = kind[_slot(h)] > REST
    return (mix(np.where(spread, h + mix(context.astype(np.uint64) + np.uint64(1)), h)) % np.uint64(parts)).astype(np.int64)


def _cells(rows: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["part", "batch", "words", "contexts", "numbers"])


def _packed(batch: int, h: np.ndarray, context: np.ndarray, n: np.ndarray, part: np.ndarray) -> list:
    order = np.argsort(part, kind="stable")
    h, context, n, part = h[order], context[order].astype(np.int16), n[order], part[order]
    at = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))
    return [(int(part[a]), batch, h[a:b].tobytes(), context[a:b].tobytes(), _narrow(n[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]


def _unpacked(blobs: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _widened(rows: pa.Table) -> np.ndarray:
    """``numbers`` of the rows again: each has as many as it has contexts."""
    size = [len(c) // 2 for c in rows["contexts"].to_pylist()]
    wide = [np.frombuffer(b, f"u{len(b) // n}").astype(np.int64) for b, n in zip(rows["numbers"].to_pylist(), size, strict=True) if n]
    return np.concatenate(wide) if wide else np.zeros(0, np.int64)


def _context_counts(docs: DataFrame, kind: np.ndarray, parts: int) -> DataFrame:
    """How often each word of the corpus stands in each context (left, right class): one row of packed cells a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", 4 << 20):
            h, doc = _hashes(*utf8(batch.column(0)))
            left, right, _ = _context(_slot(h), doc, kind)
            h, context, n = _tallied(h, left * CLASSES + right, np.ones(len(h), np.int64))
            yield _cells(_packed(-1, h, context, n, _dealt(h, context, kind, parts)))

    def added(group: pa.Table) -> pa.Table:
        h, context, n = _tallied(_unpacked(group["words"], np.uint64), _unpacked(group["contexts"], np.int16), _widened(group))
        return pa.Table.from_batches([_cells([(group["part"][0].as_py(), -1, h.tobytes(), context.tobytes(), _narrow(n))])])

    return docs.select(docs["text"]).mapInArrow(run, CELLS).groupBy("part").applyInArrow(added, CELLS)


def _spread_words(docs: DataFrame, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in slots that have a class of their own (about one in 600 of the vocabulary), sorted by hash, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", 4 << 20):
            h, _ = _hashes(*utf8(batch.column(0)))
            word, n = np.unique(h[kind[_slot(h)] > REST], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    found = docs.select(docs["text"]).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    word, n = np.array([r["word"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(word)
    return word[order], n[order]


def _looked_up(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The value of each key, 0 for those that are not there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], 0)


def fit(docs: DataFrame) -> tuple:
    """(class of each slot, log p(class | left, right) table, counts of (left, right, class), frequent words, context counts, buckets).

    The class tables have fixed sizes. The counts of (word, left, right) grow with the corpus: they stay a
    distributed table in buckets, whose number grows too.
    """

    def slots(total: np.ndarray, raw: np.ndarray, off: np.ndarray) -> None:
        total += np.bincount(_slots(raw, off)[0], minlength=SLOTS)

    used = _counted(docs, slots, SLOTS)
    kind, parts = classes_of(used), max(BUCKETS, int(used.sum()) // BUCKET_WORDS)

    def triples(total: np.ndarray, raw: np.ndarray, off: np.ndarray) -> None:
        left, right, own = _context(*_slots(raw, off), kind)
        total += np.bincount((left * CLASSES + right) * CLASSES + own, minlength=CLASSES**3)

    counts = _counted(docs, triples, CLASSES**3)
    return kind, WindowNetwork().fit(counts).table(), counts, _spread_words(docs, kind), _context_counts(docs, kind, parts), parts


def scored(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, n_words, logprob (sum over all words of log p given both neighbours), mean_logprob.

    p(word | left, right) is the network's p(class | left, right) times p(word | class, left, right), which
    is the share of the word in the corpus's counts of that class in that context, smoothed by PRIOR words
    of p(word | class). In each class all words that the corpus lacks count together as one that occurs once.

    Null and empty text, and text without words, have n_words 0, logprob 0 and mean_logprob null.
    Repeated rows are scored alike; a null doc_id stays. An empty table gives an empty result.
    """
    *small, known, parts = model
    held = docs.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = held.value[0]
        for k, batch in enumerate(by_size(batches, "text", 4 << 20)):
            number = (TaskContext.get().partitionId() << 32) + k
            h, doc = _hashes(*utf8(batch.column(1)))
            left, right, _ = _context(_slot(h), doc, kind)
            context, row = left * CLASSES + right, np.repeat(np.arange(len(doc) - 1, dtype=np.int32), np.diff(doc))
            ids = batch.column(0)
            # the rows themselves go along with the words, as batch -2 - number
            head = (number % parts, -2 - number, ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), np.asarray(ids.is_null(), bool).tobytes(), np.diff(doc).astype(np.int64).tobytes())
            # a word's cells stand together, so that they compress
            order = np.lexsort((context, h))
            h, context, row = h[order], context[order], row[order]
            yield _cells([head, *_packed(number, h, context, row, _dealt(h, context, kind, parts))])

    def valued(group: pa.Table) -> pa.Table:
        kind, logp, counts, (frequent, often) = held.value
        batch = group["batch"].to_numpy()
        at = group.filter(pa.array(batch == -1))
        h, context, n = _unpacked(at["words"], np.uint64), _unpacked(at["contexts"], np.int16), _widened(at)
        words_, first = np.unique(h, return_index=True)
        number = np.repeat(np.arange(len(words_)), np.diff(np.append(first, len(h))))
        key, total = number * CLASSES**2 + context, np.add.reduceat(n, first) if len(h) else n
        out = group.filter(pa.array(batch < -1))
        asked = group.filter(pa.array(batch >= 0))
        h, context, row = _unpacked(asked["words"], np.uint64), _unpacked(asked["contexts"], np.int16), _widened(asked)
        if not len(h):
            return out
        own = kind[_slot(h)]
        word = _looked_up(words_, np.arange(len(words_)) + 1, h) - 1
        seen = np.where(own > REST, _looked_up(frequent, often, h), _looked_up(words_, total, h))
        cell = context.astype(np.int64) * CLASSES + own
        of_class = counts.reshape(-1, CLASSES).sum(axis=0)
        prior = np.maximum(seen, 1) / (of_class[own] + 1)
        value = logp[cell] + np.log((_looked_up(key, n, word * CLASSES**2 + context) + PRIOR * prior) / (counts[cell] + PRIOR))
        size = np.array([len(x) // 2 for x in asked["contexts"].to_pylist()])
        which = np.repeat(asked["batch"].to_numpy(), size)
        order = np.lexsort((row, which))
        value, row, which = value[order], row[order], which[order]
        start = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (row[1:] != row[:-1])))
        sums, row, which = np.add.reduceat(value, start), row[start], which[start]
        cut = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(which))
        part = group["part"][0].as_py()
        rows = [(part, int(which[a]), b"", row[a:b].astype(np.int32).tobytes(), sums[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.concat_tables([out, pa.Table.from_batches([_cells(rows)], out.schema)])

    def summed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("batch", "ascending"), ("part", "ascending")])
        ids, n = np.frombuffer(group["words"][0].as_py(), np.int64), np.frombuffer(group["numbers"][0].as_py(), np.int64)
        row, sums = _unpacked(group["contexts"][1:], np.int32), _unpacked(group["numbers"][1:], np.float64)
        s = np.bincount(row, sums, minlength=len(n))
        null = np.frombuffer(group["contexts"][0].as_py(), bool)
        return pa.table([pa.array(ids, mask=null), pa.array(n), pa.array(s), pa.array(s / np.maximum(n, 1), mask=n == 0)], names=["doc_id", "n_words", "logprob", "mean_logprob"])

    cells = docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, CELLS).union(known).groupBy("part").applyInArrow(valued, CELLS)
    batches = cells.groupBy(F.when(F.col("batch") < 0, -2 - F.col("batch")).otherwise(F.col("batch")).alias("of"))
    return batches.applyInArrow(summed, "doc_id long, n_words long, logprob double, mean_logprob double")


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs))
