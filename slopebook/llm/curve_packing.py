"""Packing along a space-filling curve.

Each document's token counts are hashed to a signed vector, normalised and
projected to three dimensions; the cell of a fine grid gives its Hilbert key.
A range sort by (key, doc_id) puts like documents side by side on the cluster
and every range packs its documents, one after another, into sequences of
``LENGTH`` tokens, cutting documents where a sequence is full.  What is left at
a range's end is written as sequences whose lengths are powers of two, which
need no padding.  Ranges are balanced by rows, and copies (one key) are split
by doc_id, so a hot group is no hot task.

The tokenised documents are written to the shared folder before the sort: its
bounds are sampled from that file and no text is tokenised twice.

Edge cases: null texts are empty and give the end id alone; repeated rows are
packed as documents of their own; extra columns are ignored; an empty table
gives no piece.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopebook.llm.common import field, with_text_columns
from slopebook.plans.session import materialize

LENGTH = 2048
END_ID = 1
DIMS, GRID_BITS = 3, 16
HASHED = 64
#: Space-separated words remembered by a worker, in two generations: when the newer is full it becomes the older.
MAX_WORDS = 300_000
SPECIAL = "<|endoftext|>"


class ByteBpe:
    """Ids of the byte-level BPE, equal to the tokenizers file's.

    Words are encoded once per worker: between single spaces the pattern of
    the tokenizer starts a new piece, so a text's ids are its words' ids in a
    row.  Texts with runs of white space around a space, or with the special
    token, are encoded as a whole.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
        self.dtype = np.uint16 if self.bpe.max_token_value < 65536 else np.uint32
        self.code = "H" if self.dtype == np.uint16 else "I"
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.bpe.encode(text, allowed_special="all") if SPECIAL in text else self.bpe.encode_ordinary(text)
        return array(self.code, ids).tobytes()

    def _word(self, word: str) -> bytes | None:
        """A word met anew; None if it is empty or starts or ends in white space: it belongs to a run."""
        got = self.older.get(word)
        if got is None:
            if not word or word != word.strip():
                return None
            got = array(self.code, self.bpe.encode_ordinary(" " + word)).tobytes()
        if len(word) <= 40:
            if len(self.words) >= MAX_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = got
        return got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            return self._whole(text)
        first, *rest = text.split(" ")
        if not first or first != first.strip():
            return self._whole(text)
        out, missing = [], self._word
        known = self.words
        for w in rest:
            got = known.get(w)
            if got is None:
                got = missing(w)
                if got is None:
                    return self._whole(text)
                known = self.words  # a new generation may have begun
            out.append(got)
        return self._whole(first) + b"".join(out)


_LOADED: dict[tuple, ByteBpe] = {}


def byte_bpe(ranks_path: str, pattern: str) -> ByteBpe:
    key = (ranks_path, pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(*key)
    return _LOADED[key]


def projection(vocabulary: int) -> np.ndarray:
    """What one occurrence of an id adds to the hashed vector: (slot, sign) per id."""
    ids = np.arange(vocabulary, dtype=np.uint64)
    mixed = ids * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(2 * HASHED)).astype(np.int64)


_AXES = np.random.default_rng(2048).normal(size=(HASHED, DIMS))
_SLOTS = projection(65536)


def coordinates(ids: np.ndarray) -> np.ndarray:
    """Grid cell of a document: hashed token counts, projected, each axis through the normal distribution."""
    both = np.bincount(_SLOTS[ids.astype(np.int64) & 65535], minlength=2 * HASHED)
    v = (both[:HASHED] - both[HASHED:]).astype(float)
    size = np.sqrt((v * v).sum())
    at = (v / size) @ _AXES if size else np.zeros(DIMS)
    unit = 0.5 * (1 + np.tanh(at * 0.79788456 * (1 + 0.044715 * at * at)))
    return np.minimum((unit * (1 << GRID_BITS)).astype(np.int64), (1 << GRID_BITS) - 1)


def hilbert_key(cell: np.ndarray, bits: int = GRID_BITS) -> int:
    """Position of a cell on the Hilbert curve (axes to transposed index, then bits interleaved)."""
    x = [int(c) for c in cell]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def tokenized(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian words of 2 bytes; 4 for larger vocabularies), curve_key per row, the end id last."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("__text"))

    def compute(texts):
        bpe = byte_bpe(ranks_path, pattern)
        end = np.asarray([END_ID], dtype=bpe.dtype).tobytes()
        for t in texts:
            ids = bpe.encode(t)
            yield ids + end, hilbert_key(coordinates(np.frombuffer(ids, dtype=bpe.dtype)))

    return with_text_columns(slim, "__text", [field("ids", "binary"), field("curve_key", "long")], compute).drop("__text")


def _powers(left: int) -> list[int]:
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


class Packer:
    """Packs documents one after another; ``pieces`` collects finished rows."""

    def __init__(self, first_sequence: int, length: int = LENGTH):
        self.sequence, self.length = first_sequence, length
        self.open: list[tuple] = []  # pieces of the unfinished sequence: doc_id, start, ids, doc_tokens
        self.used = 0
        self.pieces: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            take = min(n - at, self.length - self.used)
            self.open.append((doc_id, at, ids[at:at + take], n))
            self.used += take
            at += take
            if self.used == self.length:
                self._write(self.open)
                self.open, self.used = [], 0

    def _write(self, parts: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in parts:
            self.pieces.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """Writes what is left as sequences of power-of-two lengths, largest first."""
        parts, self.open = self.open, []
        for size in _powers(self.used):
            now, room = [], size
            while room:
                doc_id, start, ids, n = parts.pop(0)
                now.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    parts.insert(0, (doc_id, start + room, ids[room:], n))
                room -= min(room, len(ids))
            self._write(now)
        self.used = 0


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(tokens: DataFrame, ranges: int, length: int = LENGTH, id_bytes: int = 2) -> DataFrame:
    """Pieces of ``tokens`` (doc_id, ids, curve_key), packed along the curve in ``ranges`` ranges."""
    placed = (tokens.repartitionByRange(ranges, "curve_key", "doc_id")
              .sortWithinPartitions("curve_key", "doc_id", F.xxhash64("ids")))
    schema = ", ".join(f"{c} bigint" for c in _COLUMNS)
    dtype = "<u2" if id_bytes == 2 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, length)

        def flush():
            rows, packer.pieces = packer.pieces, []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_COLUMNS))],
                                              names=list(_COLUMNS))
        for batch in batches:
            ids_col = batch.column(1)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                packer.add(doc_id, np.frombuffer(ids_col[k].as_buffer(), dtype=dtype))
            if packer.pieces:
                yield flush()
        packer.finish()
        if packer.pieces:
            yield flush()

    return placed.select("doc_id", "ids").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str = "text",
                   ranges: int | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, ranks_path, pattern, id_col, text), "tokens")
    return pack(tokens, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
