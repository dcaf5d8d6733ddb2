"""Token ids in directly addressable codes: written in doc_id order, read back, any id without decoding a block."""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_size, materialize, shared_dir, table, utf8, words
from .files import write_file

MAGIC = b"SLDAC1\0\0"
CHUNK_BITS = 8
RANK_BITS = 512
#: A file is closed when it holds this many ids.
FILE_IDS = 2 << 20
#: Words that a worker remembers the ids of, from task to task; longer words are encoded each time.
CACHE_WORDS, CACHE_BYTES = 1 << 19, 64
END = 2
_NULL = np.iinfo(np.int64).min


class Codes:
    """Directly addressable codes of unsigned ids.

    Level 0 has the lowest CHUNK_BITS of every id and a bit that says whether more follows; level k has
    the next chunk of those ids whose bit on level k - 1 is set, in order. A rank directory with the
    bits set before every RANK_BITS positions leads from a position on one level to the next.
    """

    def __init__(self, n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n, self.levels = n, levels

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        rest, levels = ids.astype(np.uint64), []
        while True:
            more = (rest >> np.uint64(CHUNK_BITS)) > 0
            bits = np.packbits(more, bitorder="little")
            padded = np.append(more, np.zeros(-len(more) % RANK_BITS, bool)).reshape(-1, RANK_BITS).sum(axis=1)
            rank = np.concatenate(([0], np.cumsum(padded))).astype(np.uint32)
            levels.append(((rest & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8), bits, rank))
            rest = rest[more] >> np.uint64(CHUNK_BITS)
            if not len(rest):
                return cls(len(ids), levels)

    def __getitem__(self, i: int) -> int:
        """The id at position i: one byte, one bit and one rank for each of its chunks."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << (k * CHUNK_BITS)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            base = i // RANK_BITS * RANK_BITS
            i = int(rank[i // RANK_BITS]) + int(np.unpackbits(bits[base >> 3 : (i >> 3) + 1], bitorder="little")[: i - base].sum())
        return value

    def all(self) -> np.ndarray:
        at, out = np.arange(self.n), np.zeros(self.n, np.uint32)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(k * CHUNK_BITS)
            at = at[np.unpackbits(bits, bitorder="little")[: len(chunks)].astype(bool)]
        return out

    def to_bytes(self) -> bytes:
        out = [struct.pack("<QQ", self.n, len(self.levels))]
        for chunks, bits, rank in self.levels:
            out += [struct.pack("<QQQ", len(chunks), len(bits), len(rank)), chunks.tobytes(), bits.tobytes(), rank.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: memoryview) -> Codes:
        n, count = struct.unpack_from("<QQ", data)
        at, levels = 16, []
        for _ in range(count):
            a, b, c = struct.unpack_from("<QQQ", data, at)
            at += 24
            levels.append((np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, np.uint32, c, at + a + b)))
            at += a + b + 4 * c
        return cls(n, levels)


def pack_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """magic, documents, their ids, their lengths, codes."""
    return b"".join((MAGIC, struct.pack("<Q", len(doc_ids)), doc_ids.astype(np.int64).tobytes(), lengths.astype(np.int64).tobytes(), Codes.encode(ids).to_bytes()))


def open_file(data: bytes) -> tuple[np.ndarray, np.ndarray, Codes]:
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<Q", data, 8)
    return np.frombuffer(data, np.int64, n, 16), np.frombuffer(data, np.int64, n, 16 + 8 * n), Codes.from_bytes(memoryview(data)[16 + 16 * n :])


#: 0 beyond ASCII, 1 letter, 2 digit, 3 other.
_KINDS = np.array([0 if b > 127 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
#: Whether a word is cut between characters of kinds a and b, at 4 * a + b.
_CUTS = np.array([a > 0 and b > 0 and (a != b or a == 2) for a in range(4) for b in range(4)])
#: Pieces that are encoded as one text.
TOGETHER = 256


class WordEncoder:
    """Ids of whole texts, from ids of their words.

    The vocabulary's normalizer makes one space of any white space and its pattern drops white space, so no
    token spans ASCII white space and a text's ids are those of its words, end to end. So are those of a
    word's pieces: see ``_pieces``. Each distinct piece of a batch is encoded once, the frequent ones once a worker.
    """

    _kept: dict[str, WordEncoder] = {}

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(vocabulary), {}
        ids = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(ids.values(), default=0) + 1, bool)  # the tokens that end a word of the model
        self.last[[i for token, i in ids.items() if token.endswith("</w>")]] = True

    @classmethod
    def of(cls, vocabulary: str) -> WordEncoder:
        """This process's encoder of the vocabulary."""
        if vocabulary not in cls._kept:
            cls._kept[vocabulary] = cls(vocabulary)
        return cls._kept[vocabulary]

    def _new_ids(self, new: list[bytes]) -> list[bytes]:
        """The ids of each piece, as the bytes of unsigned 32-bit numbers.

        Letters alone, or a digit, are one word of the model, and its last token says so: many are encoded
        as one text and taken apart there. Other pieces may be several words and are encoded one by one.
        """
        out: list[bytes] = [b""] * len(new)
        single, others = [], []
        for i, x in enumerate(new):
            (single if x.isalnum() else others).append(i)
        groups = [single[at : at + TOGETHER] for at in range(0, len(single), TOGETHER)]
        for mine, code in zip(groups, self._codes([b" ".join([new[i] for i in mine]) for mine in groups]), strict=True):
            ids, begin = np.array(code.ids, np.uint32), 0
            stops = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(stops) != len(mine):  # a vocabulary without such marks
                others += mine
                continue
            flat = ids.tobytes()
            for i, stop in zip(mine, stops.tolist(), strict=True):
                out[i] = flat[begin:stop]
                begin = stop
        for i, code in zip(others, self._codes([new[i] for i in others]), strict=True):
            out[i] = array("I", code.ids).tobytes()
        return out

    def _codes(self, texts: list[bytes]) -> list:
        return self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)

    def _word_ids(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each piece, as the bytes of unsigned 32-bit numbers."""
        out = list(map(self.known.get, distinct))
        new = [i for i, x in enumerate(out) if x is None]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {}
        for i, ids in zip(new, self._new_ids([distinct[i] for i in new]), strict=True):
            out[i] = ids
            if len(distinct[i]) <= CACHE_BYTES:
                self.known[distinct[i]] = ids
        return out

    @staticmethod
    def _pieces(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' bytes end to end, and n + 1 offsets into them of pieces and of words.

        The pattern takes runs of letters, single digits, runs of others, and contractions. Words with an
        apostrophe (contractions) or "<" (special tokens) stay whole; others are cut where two ASCII
        characters of different kinds, or two digits, meet. Characters beyond ASCII may combine or be of
        any kind, so nothing is cut next to them. Pieces of ASCII alone are put in lower case, as the
        normalizer does.
        """
        at = np.append(0, np.cumsum(ends - starts))
        solid = raw[(raw != 32) & ((raw < 9) | (raw > 13))]
        if not len(solid):
            return solid, np.zeros(1, np.int64), at
        kind = _KINDS[solid]
        cut = np.ones(len(solid) + 1, bool)
        cut[1:-1] = _CUTS[kind[:-1] * 4 + kind[1:]]
        odd = np.flatnonzero((solid == 39) | (solid == 60))
        whole = np.unique(np.searchsorted(at, odd, "right") - 1)
        size = at[whole + 1] - at[whole]
        cut[np.repeat(at[whole] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())] = False
        cut[at] = True
        off = np.flatnonzero(cut)
        kind[odd] = 0
        plain = np.minimum.reduceat(kind, off[:-1]) > 0
        upper = np.flatnonzero((solid >= 65) & (solid <= 90))
        solid[upper[plain[np.searchsorted(off, upper, "right") - 1]]] += 32
        return solid, off, at

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each followed by ``end``, and how many each has."""
        raw, off = utf8(texts)
        starts, ends, doc = words(raw, off)
        solid, at, word = self._pieces(raw, starts, ends)
        doc = np.searchsorted(at, word[doc])
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(solid)])
        coded = column.dictionary_encode()
        parts = self._word_ids(coded.dictionary.to_pylist())
        # behind each text's pieces, one more that is the end alone
        which = np.insert(coded.indices.to_numpy(), doc[1:], len(parts))
        placed = pa.array([*parts, array("I", [end]).tobytes()], pa.large_binary()).take(pa.array(which))
        _, offsets, data = placed.buffers()
        total = np.frombuffer(offsets, np.int64)[: len(which) + 1] // 4
        stops = total[doc[1:] + np.arange(1, len(doc))]
        return np.frombuffer(data, np.uint32, int(total[-1])), np.diff(stops, prepend=0)


def _encode(vocabulary: str, end: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(vocabulary)
        part, seq = TaskContext.get().partitionId(), 0
        names, sizes, ids, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal names, sizes, ids, held, seq
            name = f"{part:07d}-{seq:05d}"
            write_file(f"{folder}/{name}.dac", pack_file(np.concatenate(names), np.concatenate(sizes), np.concatenate(ids)))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held], pa.int64())], names=["file", "n"])
            names, sizes, ids, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in by_size(batches, "text", 3 << 20):
            own, length = encoder.encode(batch.column(1), end)
            names.append(batch.column(0).fill_null(_NULL).to_numpy())
            sizes.append(length)
            ids.append(own)
            held += len(own)
            if held >= FILE_IDS:
                yield close()
        if names:
            yield close()

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            names, sizes, codes = open_file(data)
            every = codes.all().astype("<u4")
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(every[a:b].tobytes()) for a, b in zip(ends - sizes, ends, strict=True)]
            file = path.rsplit("/", 1)[1].removesuffix(".dac")
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(names)), pa.array(names, mask=names == _NULL), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                names=["file", "doc_id", "begin", "n_tokens", "ids_crc32"],
            )


def write_tokens(docs: DataFrame, vocabulary: str, end: int = END) -> tuple[str, DataFrame]:
    """Token files of ``docs`` in ascending doc_id order, null first. The folder, and (file, n) of its files in order."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(docs["doc_id"], docs["text"]).repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    files = dealt.mapInArrow(_encode(vocabulary, end, folder), "file string, n long")
    return folder, materialize(files, "token-files")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files themselves."""
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    docs = spark.createDataFrame([], "file string, doc_id long, begin long, n_tokens long, ids_crc32 long")
    if not files.isEmpty():
        held = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select("path", "content")
        docs = held.mapInArrow(_decode, docs.schema)
    return docs.join(starts, "file").select("doc_id", (F.col("ahead") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """Encode, write, read back.

    Null and empty text give the end id alone. Rows with equal doc_ids follow each other in text order;
    rows without doc_id come first. An empty table writes no file and gives an empty result. Other
    columns are ignored. The vocabulary file must be at the same path on every executor.
    """
    folder, files = write_tokens(docs, vocabulary, end)
    return read_tokens(docs.sparkSession, folder, files)


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"), vocabulary_path())
