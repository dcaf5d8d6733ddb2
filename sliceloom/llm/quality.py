"""Quality from compression: dictionaries of good and bad text, and the calibrated difference of sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_size, materialize, table, utf8

#: Labelled rows that the model is fitted on, the first by a hash of the id.
FIT_ROWS = 6000
#: Texts are cut end to end into pieces of so many bytes; so many of either label, the first by a hash, train a dictionary.
PIECE_BYTES, PIECES = 1000, 8000
DICTIONARY_BYTES = 64 << 10
#: Texts are compressed in blocks, so that a dictionary counts for as much at the end as at the start.
BLOCK = 256
THRESHOLD = 0.3


class QualityModel:
    """Two dictionaries, and a monotone curve from the difference of the sizes they give to a probability."""

    def __init__(self, good: bytes, bad: bytes, knots: tuple[np.ndarray, np.ndarray]):
        self.good, self.bad, self.knots = good, bad, knots
        self._ready: list[zstandard.ZstdCompressor] = []

    def __getstate__(self):
        return (self.good, self.bad, self.knots)

    def __setstate__(self, state):
        self.__init__(*state)

    def difference(self, text: bytes) -> float:
        """(size with the bad dictionary - size with the good one) / bytes of text, over all blocks; 0 for empty text."""
        if not text:
            return 0.0
        if not self._ready:
            for blob in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(blob, dict_type=zstandard.DICT_TYPE_AUTO)
                d.precompute_compress(level=3)
                self._ready.append(zstandard.ZstdCompressor(dict_data=d, level=3, write_content_size=False, write_dict_id=False))
        g, b = (sum(len(c.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for c in self._ready)
        return (b - g) / len(text)

    def score(self, differences: np.ndarray) -> np.ndarray:
        """Interpolated between the knots; beyond them the odds go on to rise or fall a little, to keep the order."""
        x, p = self.knots
        out = np.interp(differences, x, p)
        beyond = np.maximum(differences - x[-1], 0) - np.maximum(x[0] - differences, 0)
        return 1 / (1 + (1 - out) / out * np.exp(-np.clip(beyond, -20, 20)))


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; from too little text to train on, the pieces as they are."""
    if len(pieces) >= 50:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
        except zstandard.ZstdError:  # too alike
            pass
    return b"\n".join(pieces)[:DICTIONARY_BYTES].ljust(8)


def _calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray, knots: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x with weights w (pool adjacent violators over quantile groups), as knots to interpolate.

    Each group starts with half a row of either label, so no score is 0 or 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for part in np.array_split(order, min(knots, len(order))):
        pools.append([float(x[part].mean()), float((y * w)[part].sum()) + 0.5, float(w[part].sum()) + 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            n = pools[-1][2] + last[2]
            pools[-1] = [(pools[-1][0] * pools[-1][2] + last[0] * last[2]) / n, pools[-1][1] + last[1], n]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece of every text."""
    for batch in by_size(batches, "text"):
        raw, off = utf8(batch.column(2))
        rows = [(h, k, i, raw[i : min(i + PIECE_BYTES, b)].tobytes()) for h, k, a, b in zip(*(batch.column(c).to_pylist() for c in (0, 1)), off[:-1], off[1:], strict=True) for i in range(a, b, PIECE_BYTES)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["h", "label", "at", "piece"])


def _differences(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text"):
            raw, off = utf8(batch.column(2))
            x = [model.difference(raw[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(x, pa.float64())], names=["h", "label", "half", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel:
    """Fit on the whole texts of at most ``rows`` labelled rows that are not held out, the first by a hash of
    their id, half of them of either label where there are as many. One half of each makes the dictionaries:
    its texts are cut end to end, and of more than ``PIECES`` pieces the first by a hash, wherever they stand,
    are used. The other half calibrates, weighted as the labels occur in all such rows; its texts are
    compressed where they lie and only the differences are collected. With labels of one kind only the
    score is 0.5 and so predicts 1."""
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")).where(~held_out(F.col("id"))).distinct()
    picked = None
    for label in (0, 1):
        one = marks.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(rows // 2)
        picked = one if picked is None else picked.union(one)
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    picked = materialize(picked.withColumn("half", place % 2), "picked")
    texts = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(picked), docs["doc_id"] == picked["id"]).select(F.xxhash64("id").alias("h"), "label", "text", "half")
    pieces = texts.where("half = 1").mapInArrow(_cut, "h long, label int, at long, piece binary").select("label", F.xxhash64("h", "piece").alias("h"), "piece")
    first = {k: [bytes(r["piece"]) for r in pieces.where(F.col("label") == k).orderBy("h", "piece").limit(PIECES).collect()] for k in (0, 1)}
    flat = (np.zeros(1), np.full(1, 0.5))
    if not first[0] or not first[1]:
        return QualityModel(b" " * 8, b" " * 8, flat)
    model = QualityModel(_dictionary(first[1]), _dictionary(first[0]), flat)
    found = sorted((r["label"], r["half"], r["h"], r["x"]) for r in texts.mapInArrow(_differences(model), "h long, label int, half int, x double").collect())
    rest = [r for k in (0, 1) for r in [r for r in found if r[:2] == (k, 0)] or [r for r in found if r[0] == k]]
    x, y = np.array([r[3] for r in rest]), np.array([r[0] for r in rest], float)
    share = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    w = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum()) * len(y) / (share[0] + share[1])
    model.knots = _calibrate(x, y, w)
    return model


def _score(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text"):
            raw, off = utf8(batch.column(1))
            scores = model.score(np.array([model.difference(raw[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from its whole text alone.

    Null and empty text have difference 0 and so one score, the calibration's at 0. A text of any length is
    compressed in blocks to its end. A null doc_id is not held out. Repeated rows are scored alike; an empty
    table gives an empty result. Other columns, labels of that name included, are ignored.
    """
    out = docs.select(docs["doc_id"], docs["text"]).mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
