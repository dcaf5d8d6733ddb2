"""Benchmark decontamination: a BM25 index of test items, block-max pruning, verified overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import by_size, shingle_hashes, table, utf8, word_hashes, words

K1, B = 1.2, 0.75
SHINGLE = 5
SIMILARITY = 0.8
#: A document is retrieved for an item if it has this share of the score that the item's own text has.
RETRIEVE = 0.5
#: Items of one index block; a larger benchmark is scanned block by block.
BLOCK_ITEMS = 20_000
#: Text bytes that are looked up at a time.
BATCH_BYTES = 1 << 20


def _hashed(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, off = utf8(pc.utf8_lower(pa.array(texts, pa.string())))
    starts, ends, doc = words(raw, off)
    h = word_hashes(raw, starts, ends)
    return h, doc, *shingle_hashes(h, doc, k)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what precedes it the question; one sentence is question only."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


class ItemIndex:
    """Inverted index over test items in blocks with maxima, and the items' shingles.

    A term's weight in an item is its BM25 impact over the score that the item must reach, so that one
    threshold, 1, holds for all items. Postings are kept in levels: those of a term in blocks of 512, 64, 8
    and 1 items, each entry with the largest weight in its block and the place of its entries one level down.
    """

    WIDTHS = (512, 64, 8, 1)
    #: Entries that are looked at together.
    MOST = 1 << 19

    def __init__(self, ids: list[int], texts: list[str]):
        h, doc, _, _ = _hashed(texts, SHINGLE)
        n = len(texts)
        item = np.repeat(np.arange(n), np.diff(doc))
        self.ids = np.array(ids, np.int64)
        self.terms, term = np.unique(h, return_inverse=True)
        pair, tf = np.unique(item.astype(np.int64) * max(1, len(self.terms)) + term, return_counts=True)
        p_item, p_term = pair // max(1, len(self.terms)), pair % max(1, len(self.terms))
        df = np.bincount(p_term, minlength=len(self.terms))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        length = np.diff(doc)
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1.0))
        impact = idf[p_term] * tf * (K1 + 1) / (tf + norm[p_item])
        self.need = RETRIEVE * np.bincount(p_item, impact, minlength=n)
        order = np.lexsort((p_item, p_term))
        of, block, weight = p_term[order], p_item[order], (impact / self.need[p_item])[order]
        self.block, self.weight, self.below = [], [], []
        for width in self.WIDTHS[::-1]:
            key = of * (n // width + 1) + block // width if width > 1 else np.arange(len(of))
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            self.block.insert(0, (block // width)[head])
            self.weight.insert(0, np.maximum.reduceat(weight, head) if len(head) else weight)
            self.below.insert(0, np.append(head, len(key)))
            of, block, weight = of[head], block[head], self.weight[0]
        self.first = np.searchsorted(of, np.arange(len(self.terms) + 1))
        qa = [question_and_answer(t) for t in texts]
        self.parts = [self._shingles([x[i] for x in qa]) for i in (0, 1)]
        self.whole = self._shingles(texts)

    @staticmethod
    def _shingles(texts: list[str]) -> list[tuple[int, np.ndarray]]:
        """(words of a shingle, shingles) of each text: SHINGLE words, or all words of a shorter text."""
        h, doc, s, off = _hashed(texts, SHINGLE)
        out = [(SHINGLE, np.unique(s[a:b])) for a, b in zip(off[:-1], off[1:], strict=True)]
        for i in np.flatnonzero((np.diff(doc) > 0) & (np.diff(doc) < SHINGLE)):
            k = int(doc[i + 1] - doc[i])
            out[i] = k, shingle_hashes(h[doc[i] : doc[i + 1]], np.array([0, k]), k)[0]
        return out

    def retrieve(self, term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, score) of all pairs that reach the item's threshold, in order. Term numbers, -1 for none.

        Block-max WAND, a level at a time in place of a cursor at a time, so that it is vectorised: the pivot
        test, whether the maxima of the terms that a block and the passage share add up to the threshold,
        is made for all blocks of a level and all passages together. Entries of blocks that fail are
        skipped, with all postings under them; on the last level the sum is the score.
        """
        known = np.flatnonzero(term >= 0)
        pair = np.unique(doc[known] * max(1, len(self.terms)) + term[known])
        unit, term = pair // max(1, len(self.terms)), pair % max(1, len(self.terms))
        work, found = [(0, unit, self.first[term], self.first[term + 1])], []
        while work:
            level, unit, first, last = work.pop()
            ends = np.cumsum(last - first)
            if not len(unit):
                continue
            if ends[-1] > self.MOST and unit[0] != unit[-1]:  # a unit, a passage or a block of it, stays whole
                cut = np.searchsorted(unit, unit[min(np.searchsorted(ends, ends[-1] // 2), len(unit) - 1)])
                cut = cut or np.searchsorted(unit, unit[0], "right")
                work += [(level, unit[cut:], first[cut:], last[cut:]), (level, unit[:cut], first[:cut], last[:cut])]
                continue
            size = last - first
            entry = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
            passage = unit // (self._blocks(level - 1) if level else 1)
            key = np.repeat(passage, size) * self._blocks(level) + self.block[level][entry]
            order = np.argsort(key, kind="stable")
            key, entry = key[order], entry[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            total = np.add.reduceat(self.weight[level][entry], head) if len(head) else np.zeros(0)
            good = total >= 1 - 1e-9
            if level == len(self.WIDTHS) - 1:
                found.append((key[head[good]], total[good]))
                continue
            keep = np.repeat(good, np.diff(np.append(head, len(key))))
            below = self.below[level]
            work.append((level + 1, key[keep], below[entry[keep]], below[entry[keep] + 1]))
        key, total = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(key, kind="stable")
        item = key[order] % self._blocks(-1)
        return key[order] // self._blocks(-1), item, total[order] * self.need[item]

    def _blocks(self, level: int) -> int:
        return len(self.ids) // self.WIDTHS[level] + 1

    def overlap(self, item: int, h: np.ndarray, shingles: dict[int, np.ndarray]) -> tuple[float, float, float]:
        """Shares of the item's, its question's and its answer's shingles among those of a document of these words; 1 for a part it lacks.

        ``shingles`` keeps the document's shingles of each length that was asked for, in order.
        """
        def share(k: int, own: np.ndarray) -> float:
            if not len(own):
                return 1.0
            if len(h) < k:
                return 0.0
            if k not in shingles:
                shingles[k] = np.sort(shingle_hashes(h, np.array([0, len(h)]), k)[0])
            at = np.minimum(np.searchsorted(shingles[k], own), len(shingles[k]) - 1)
            return float((shingles[k][at] == own).mean())

        return share(*self.whole[item]), share(*self.parts[0][item]), share(*self.parts[1][item])


def _find(index: ItemIndex, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", BATCH_BYTES):
            raw, off = utf8(pc.utf8_lower(batch.column(1)))
            starts, ends, doc = words(raw, off)
            h = word_hashes(raw, starts, ends)
            at = np.minimum(np.searchsorted(index.terms, h), max(0, len(index.terms) - 1))
            term = np.where(index.terms[at] == h, at, -1) if len(index.terms) else np.full(len(h), -1)
            which = np.repeat(np.arange(len(off) - 1), np.diff(doc))
            rows = []
            last, s = -1, {}
            for x, i, v in zip(*index.retrieve(term, which), strict=True):
                if x != last:
                    last, s = x, {}
                whole, question, answer = index.overlap(int(i), h[doc[x] : doc[x + 1]], s)
                if whole >= similarity or (question >= similarity and answer >= similarity):
                    rows.append((batch.column(0)[int(x)].as_py(), int(index.ids[i]), float(v), whole, question, answer))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.int64(), *[pa.float64()] * 4))], names=["doc_id", "item_id", "bm25", "overlap", "question_overlap", "answer_overlap"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Documents that hold a test item: doc_id, item_id, bm25, overlap, question_overlap, answer_overlap.

    Every document is a query to the index of items, whole, so that no item is too long and its parts may be
    apart; all items that reach half of their own score are retrieved, and verified on five-word shingles of
    the document: at least 80 % of the item's, or of its question's and of its answer's. An item or part of
    fewer words is looked for as one sequence of its own length, anywhere in the document. The index goes to
    the executors in blocks of 20,000 items, each with a scan of its own.

    Words are compared in lower case. Null and empty text, and items without words or without an id, match nothing. Items equal in text are
    all reported. Rows with equal ids are each reported. A null doc_id is reported as null. Empty tables
    give an empty result. Other columns are ignored.
    """
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id long, item_id long, bm25 double, overlap double, question_overlap double, answer_overlap double"
    text, out, block = docs.select(docs["doc_id"], docs["text"]), None, []

    def scan(rows: list) -> DataFrame:
        return text.mapInArrow(_find(ItemIndex([r[0] for r in rows], [r[1] for r in rows]), similarity), schema)

    for row in items.orderBy("item_id", "text").toLocalIterator():
        if row["text"].strip():
            block.append((row["item_id"], row["text"]))
        if len(block) == BLOCK_ITEMS:
            out, block = scan(block) if out is None else out.union(scan(block)), []
    if block:
        out = scan(block) if out is None else out.union(scan(block))
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
