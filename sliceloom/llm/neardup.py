"""Near-duplicates: fast similarity sketching, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_size, lower_ascii, materialize, mix, shingle_hashes, table, utf8, word_hashes, words
from .components import components

COORDINATES, ROWS = 96, 4
BANDS = COORDINATES // ROWS
#: Members of each bucket that all others are compared with first. A bucket of two has one pair, however many.
HUBS = 4
#: Text bytes that are cut into shingles at a time.
BATCH_BYTES = 1 << 20


def _seed(i: int) -> np.uint64:
    return np.uint64((0xA0761D6478BD642F * (i + 1)) & ((1 << 64) - 1))


def sketches(hashes: np.ndarray, off: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """One sketch of ``t`` coordinates for each non-empty set of element hashes.

    Fast similarity sketching: in round i every element falls in a bin with a value; a bin keeps the
    least (round, value). For the first t rounds the bin is hashed, then round t + j throws every
    element into bin j, so after 2t rounds every bin is full. A set leaves after the round in which its
    last bin filled; most large sets need one or two.
    """
    docs = len(off) - 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((docs, t), full, np.uint64)
    which = np.repeat(np.arange(docs), np.diff(off))
    flat = out.reshape(-1)
    for i in range(2 * t):
        if not len(which):
            break
        h = mix(hashes ^ _seed(i))
        bins = ((h >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, which * t + bins, (np.uint64(i) << np.uint64(54)) | (mix(h) >> np.uint64(10)))
        missing = (out == full).any(axis=1)
        keep = missing[which]
        which, hashes = which[keep], hashes[keep]
    return out


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets."""
    raw, off = utf8(batch.column(1))
    raw = lower_ascii(raw)
    starts, ends, doc = words(raw, off)
    h, h_off = shingle_hashes(word_hashes(raw, starts, ends), doc, k)
    which = np.repeat(np.arange(len(off) - 1), np.diff(h_off))
    order = np.lexsort((h, which))
    h, which = h[order], which[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (which[1:] != which[:-1])
    h, which = h[first], which[first]
    return h, np.searchsorted(which, np.arange(len(off)))


def _sums(h: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Two sums of each set's elements: equal sets, and (but for 1 in 2^128) only they, share size and both."""
    return [np.add.reduceat(np.append(mix(h ^ _seed(900 + s)), np.uint64(0)), off[:-1]) if len(off) > 1 else h for s in (0, 1)]


def _sketch_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", BATCH_BYTES):
            h, off = _sets(batch, k)
            n = np.diff(off)
            some = n > 0
            sums = _sums(h, off)
            sk = np.zeros((len(n), COORDINATES), np.uint64)
            if some.any():
                sk[some] = sketches(h, np.append(off[:-1][some], off[-1]))
            acc = np.zeros((len(n), BANDS), np.uint64)
            for r in range(ROWS):
                acc = mix(acc * np.uint64(31) + sk[:, r::ROWS] + np.uint64(r))
            acc = mix(acc ^ np.arange(BANDS, dtype=np.uint64)[None, :])
            sums = [np.where(some, x, 0).view(np.int64) for x in sums]
            lists = pa.ListArray.from_arrays(np.arange(0, len(n) * BANDS + 1, BANDS, dtype=np.int32), acc.view(np.int64).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), n.astype(np.int64), *sums, lists], names=["doc_id", "n", "s1", "s2", "bands"])

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", BATCH_BYTES):
            h, off = _sets(batch, k)
            some = np.diff(off) > 0
            sums = [np.where(some, x, 0).view(np.int64) for x in _sums(h, off)]
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64) * 8), pa.py_buffer(np.ascontiguousarray(h))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums, blobs.cast(pa.binary())], names=["id", "s1", "s2", "blob"])

    return run


def _elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all sets end to end, and n + 1 offsets."""
    raw, off = utf8(column)
    return np.frombuffer(raw.tobytes(), np.uint64), off // 8


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, a), (right, b) = _elements(batch.column(2)), _elements(batch.column(3))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                merged = np.sort(np.concatenate((left[a[i] : a[i + 1]], right[b[i] : b[i + 1]])))
                same = int((merged[1:] == merged[:-1]).sum())
                ok[i] = 100 * same >= percent * (len(merged) - same)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the (u, v) pairs whose full sets are as similar as ``percent``."""
    right = sets.select(F.col("node").alias("v"), F.col("blob").alias("b"))
    left = sets.select(F.col("node").alias("u"), F.col("blob").alias("a"))
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b")
    return both.mapInArrow(_verify(percent), "u long, v long")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "blob"):
        flat, off = _elements(batch.column(2))
        flat, n = flat.view(np.int64), np.diff(off)
        ids, c, size = np.repeat(batch.column(0).to_numpy(), n), np.repeat(batch.column(1).to_numpy(), n), np.repeat(n, n)
        for a in range(0, len(flat), 1 << 17):
            b = a + (1 << 17)
            yield pa.RecordBatch.from_arrays([ids[a:b], c[a:b], size[a:b], flat[a:b]], names=["node", "c", "n", "s"])


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``sets`` (node, c, blob) of different c that may be as similar as ``percent``: none is missed.

    If two sets are that similar, the rarest n - ceil(n * percent / 100) + 1 shingles of each meet. In a
    large group of texts with edits of their own these are the edits, which no other text has, so the
    group makes few pairs although all its texts share most shingles. What two sets can still share behind
    a shingle follows from their sizes and its place in either; so sizes and places meet first, a few rows a
    shingle however many sets have it, and only sets of sizes and places that suffice make pairs.
    """
    tokens = sets.select("node", "c", "blob").mapInArrow(_tokens, "node long, c long, n long, s long")
    often = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    common = tokens.join(often, "s")
    by_node = Window.partitionBy("node")
    own = F.col("n") - F.count(F.lit(1)).over(by_node)
    place = own + F.row_number().over(by_node.orderBy("f", "s"))
    prefix = common.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("node", "c", "n", "s", "place")
    prefix = materialize(prefix, "prefixes")
    shapes = prefix.groupBy("s", "n", "place").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    other = shapes.select("s", F.col("n").alias("m"), F.col("place").alias("q"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    # where s is the first shingle that the two share, they share at most it and what follows in either
    most = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("q")) + 1
    alike = most * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    once = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("place") <= F.col("q")))
    apart = (F.col("lo") != F.col("hi2")) | (F.col("hi") != F.col("lo2"))
    meet = shapes.join(other, "s").where(alike & once & apart).select("s", "n", "place", "m", "q")
    left = prefix.select("s", "n", "place", F.col("node").alias("u"), F.col("c").alias("d")).join(meet, ["s", "n", "place"])
    right = prefix.select("s", F.col("n").alias("m"), F.col("place").alias("q"), F.col("node").alias("v"), "c")
    pairs = left.join(right, ["s", "m", "q"]).where((F.col("u") != F.col("v")) & (F.col("c") != F.col("d")))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose k-word shingle sets have 100 * |A and B| >= percent * |A or B|.

    Equal sets are one class from the start, so copies are never paired. Classes that share a band are
    candidates: first each with a few hubs of its bucket, then, where a bucket still has several
    components, those of their classes whose rarest shingles meet. Every candidate is verified on the full sets. Two classes with
    similarity 0.8 share none of 24 bands of 4 with probability 3e-6.

    Null and empty text, and text without words, have an empty set and link with nothing. Rows with a
    null doc_id stand alone with component_id null and stay. Rows with equal doc_ids are one document: it is
    linked by any of their texts. An empty table gives an empty result. Texts may have any length. Other
    columns are ignored, whatever their names.

    Returns doc_id, n_shingles, component_id, kept, one row per input row.
    """
    text = docs.select(docs["doc_id"], docs["text"])
    rows = materialize(text.mapInArrow(_sketch_rows(k), "doc_id long, n long, s1 long, s2 long, bands array<long>"), "sketches")
    live = rows.where("doc_id IS NOT NULL AND n > 0")
    classes = live.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select("node", F.explode("bands").alias("key"))
    hubs = [F.min("node")] + [F.min(F.struct(F.xxhash64("node", F.lit(r)), "node"))["node"] for r in range(1, HUBS)]
    shared = keys.groupBy("key").agg(F.array_distinct(F.array(*hubs)).alias("hubs"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "hubs")
    members = materialize(keys.join(shared, "key"), "buckets")

    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "id", "s1", "s2")
    texts = text.join(wanted.select("id").distinct(), text["doc_id"] == F.col("id"), "left_semi")
    found = texts.mapInArrow(_set_rows(k), "id long, s1 long, s2 long, blob binary").dropDuplicates(["id", "s1", "s2"])
    sets = materialize(found.join(wanted, ["id", "s1", "s2"]).select("node", "blob"), "sets")
    spokes = members.select("node", F.explode("hubs").alias("hub")).where("node != hub")
    stars = spokes.select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct()
    linked = materialize(_linked(stars, sets, percent).union(_same_id(live, classes)), "links")
    part = components(linked)

    named = members.join(part.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    split = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    open_ = materialize(named.join(split, "key").select("node", "c").distinct(), "open")
    cross = _prefix_pairs(sets.join(open_, "node"), percent)
    more = _linked(cross, sets, percent)
    final = materialize(components(linked.union(more)), "components")

    of = classes.select(F.col("node").alias("of"), F.col("id").alias("least"))
    names = final.join(of, F.col("id") == F.col("of")).groupBy("component").agg(F.min("least").alias("component_id"))
    named = final.join(names, "component").select(F.col("id").alias("node"), "component_id")
    top = classes.join(named, "node", "left").select("n", "s1", "s2", F.coalesce("component_id", "id").alias("component"))
    out = rows.join(top, ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _same_id(live: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of documents whose id has several texts."""
    kind = F.struct("n", "s1", "s2")
    several = live.groupBy("doc_id").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).where("lo != hi").select("doc_id")
    nodes = live.join(several, "doc_id", "left_semi").select("doc_id", "n", "s1", "s2").distinct().join(classes.select("n", "s1", "s2", "node"), ["n", "s1", "s2"])
    first = nodes.groupBy("doc_id").agg(F.min("node").alias("u"))
    return nodes.join(first, "doc_id").where("node != u").select("u", F.col("node").alias("v"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
