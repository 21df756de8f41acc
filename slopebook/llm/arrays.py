"""Words of Arrow texts as 64-bit hashes without a Python object per word, and compact blobs of integer arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once (arrays of eight times that size are made).
SLICE_BYTES = 2_000_000
SPACES = b" \t\n\x0b\x0c\r"

_rng = np.random.default_rng(2024)
_FACTOR = np.uint64(int(_rng.integers(0, 2 ** 62)) * 4 + 3)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 2 ** 64))
#: A random number for each byte; capital ASCII letters have those of the small ones.
_BYTE = _rng.integers(0, 2 ** 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def byte_set(of: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(of)] = True
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def combine(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its two parts (order counts)."""
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, f in enumerate((_FACTOR, _INVERSE)):
            row = np.full(n, f, dtype=np.uint64)
            row[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow text column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), offsets


def word_spans(data: np.ndarray, word: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``word`` bytes; no run passes a place of ``breaks``."""
    inside = word[data]
    before = np.concatenate([[False], inside[:-1]])
    before[breaks[(breaks >= 0) & (breaks < len(data))]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    cut = breaks[(breaks > 0) & (breaks <= len(data))] - 1
    after[cut] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def hashed_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash (capital ASCII letters as small ones) and start of every word of the texts ``data[offsets[i]:offsets[i+1]]``."""
    hashes, places = [], []
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        end = min(at + SLICE_BYTES, last)
        while end < last and word[data[end]]:  # a slice ends before a byte that is in no word
            rest = np.flatnonzero(~word[data[end:end + 65536]])
            end = end + int(rest[0]) if len(rest) else min(end + 65536, last)
        part = data[at:end]
        lo, hi = np.searchsorted(offsets, [at, end])
        starts, ends = word_spans(part, word, offsets[lo:hi + 1] - at)
        power, inverse = _powers_to(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[part] * power[:len(part)], out=total[1:])
            hashes.append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        places.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def text_slices(offsets: np.ndarray, size: int = 2 * SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) ranges of texts of about ``size`` bytes each; a longer text is a range of its own."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield start, end
        start = end


def pack(values: np.ndarray, steps: bool = False) -> bytes:
    """A blob of a numeric array; ``steps`` stores differences, which are small where it ascends."""
    raw = np.ascontiguousarray(values)
    if steps and len(raw):
        raw = np.diff(raw, prepend=raw.dtype.type(0))
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpack(blob: bytes, dtype, steps: bool = False) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    if not size:
        return np.zeros(0, dtype=dtype)
    planes = np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True), dtype=np.uint8)
    item = np.dtype(dtype).itemsize
    out = np.ascontiguousarray(planes.reshape(item, size // item).T).view(dtype).reshape(-1)
    return np.cumsum(out, dtype=dtype) if steps else out
