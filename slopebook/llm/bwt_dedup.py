"""Removal of long repeated strings by merged Burrows-Wheeler transforms.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a
smaller document, or earlier in the same one) is removed.

1. *Anchors.*  A window of ``LENGTH`` bytes has one anchor: its ``GRAM``-byte
   substring of least hash (leftmost on ties), which depends on its bytes alone.
   Windows that share an anchor occurrence form a segment.  Equal windows
   have equal anchors, so all that can match meets under the anchor's hash.
2. *Equal segments* are combined, first inside each task and then per anchor:
   all but the earliest occurrence are removed whole.  Anchors with one segment
   left are unique and end here, which is nearly all of the corpus.
   Equal windows have their anchor at one place, so a segment takes part only if
   it agrees with another one of its anchor in 82 bytes or so around the anchor.
3. *Merged transforms.*  What is left of the other anchors' distinct segments is packed
   into shards; each shard gets a suffix array (sorted to LENGTH bytes) and a
   Burrows-Wheeler transform.  The shards of a unit are merged by iterative
   interleave refinement: the interleave by the first t symbols is sorted
   stably by the symbols that precede, which gives the interleave by t+2;
   a boundary stays where symbols or blocks differ.  After LENGTH symbols the
   blocks are the intervals of common prefix >= LENGTH.  No suffix of a shard is
   ever sorted again.  In each interval all but the earliest window go.
4. Anchors whose distinct segments exceed ``GROUP_BYTES`` would not fit a unit:
   their windows are compared by a 128-bit hash in an ordinary aggregation.

Edge cases: null and empty texts have no bytes and get zeros and the hash of
nothing; texts shorter than LENGTH keep everything; a row with a null id
matches nothing; identical rows that repeat an id are one document and get the
same answer; of different texts under one id, the one of smallest hash takes
part and the others are returned whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopebook.llm.common import field, ship_package, utf8, with_text_columns
from slopebook.plans.session import materialize

LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM + 1  # grams in a window
#: Bytes of a shard, of a merge unit, and of the largest anchor group that a unit takes.
SHARD_BYTES, UNIT_BYTES, GROUP_BYTES = 192_000, 768_000, 3_000_000
#: Windows that are anchored at once, and bytes whose segments are combined in a task at once.
CHUNK, COMBINE_BYTES = 400_000, 8_000_000

_POS_BITS = np.uint64(20)
_rng = np.random.default_rng(100)
_BYTE = _rng.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_STEP = _rng.integers(0, 2 ** 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of every GRAM-byte substring."""
    with np.errstate(over="ignore"):
        h1 = _BYTE[raw]
        h2 = h1[:-1] * _STEP[0] + h1[1:]
        h4 = h2[:-2] * _STEP[1] + h2[2:]
        h8 = h4[:-4] * _STEP[2] + h4[4:]
        h16 = h8[:-8] * _STEP[3] + h8[8:]
        h = h16[:-8] * _STEP[4] + h8[16:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def segments(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first window, number of windows) arrays that tile all windows of a text."""
    last = len(raw) - LENGTH + 1
    for low in range(0, max(last, 0), CHUNK):
        n = min(CHUNK, last - low)
        h = gram_hashes(raw[low:low + n + LENGTH - 1])
        key = (h >> _POS_BITS << _POS_BITS) | np.arange(len(h), dtype=np.uint64)
        m, width = key, 1
        while width * 2 <= REACH:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[:n], m[REACH - width:REACH - width + n])
        at = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        yield h[at[first]].view(np.int64), first + low, np.diff(np.append(first, n))


_ROW = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.int64())])


def _combine(parts: list[tuple]) -> pa.RecordBatch:
    """Rows of a run of documents; all but the earliest of equal segments are flagged and dealt out by position."""
    anchor, seg, doc, at, windows = (np.concatenate([p[k] for p in parts]) for k in range(5))
    order = np.lexsort((at, doc, seg, anchor))
    anchor, seg, doc, at, windows = (x[order] for x in (anchor, seg, doc, at, windows))
    again = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (seg[1:] == seg[:-1])])
    spread = (doc * 1_000_003 + at) * np.int64(0x9E3779B97F4A7C1)
    return pa.RecordBatch.from_arrays([pa.array(np.where(again, spread, anchor)), pa.array(seg), pa.array(doc),
                                       pa.array(at << 8 | windows << 1 | again)], schema=_ROW)


def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) batches to segment rows; packed holds first window << 8, windows << 1, repeated in the task."""
    parts, held = [], 0
    for batch in batches:
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = utf8(value.as_py())
            raw = np.frombuffer(text, dtype=np.uint8)
            for anchor, at, windows in segments(raw):
                end = (at + windows + (LENGTH - 1)).tolist()
                seg = np.array([xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(at.tolist(), end)], dtype=np.uint64).view(np.int64)
                parts.append((anchor, seg, np.full(len(at), doc_id, dtype=np.int64), at, windows))
            held += len(text)
            if held >= COMBINE_BYTES and parts:
                yield _combine(parts)
                parts, held = [], 0
    if parts:
        yield _combine(parts)


_FOUND = "open boolean, anchor long, seg long, doc_id long, at long, windows int"


def settle_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segment rows of whole anchors to found rows.

    ``open`` false: the windows are repeated.  ``open`` true: the earliest of
    its equal segments, under an anchor that has other segments too.
    """
    held = None  # the last anchor's (anchor, seg, row not yet emitted or None)
    for batch in batches:
        anchor, seg, doc, packed = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        flagged = (packed & 1) == 1
        gone = [np.stack([anchor, seg, doc, packed])[:, flagged]] if flagged.any() else []
        anchor, seg, doc, packed = (x[~flagged] for x in (anchor, seg, doc, packed))
        opened = []
        n = len(anchor)
        if n:
            rows = np.stack([anchor, seg, doc, packed])
            same_anchor = np.empty(n, dtype=bool)
            same_seg = np.empty(n, dtype=bool)
            same_anchor[1:] = anchor[1:] == anchor[:-1]
            same_seg[1:] = same_anchor[1:] & (seg[1:] == seg[:-1])
            same_anchor[0] = held is not None and held[0] == anchor[0]
            same_seg[0] = bool(same_anchor[0]) and held[1] == seg[0]
            gone.append(rows[:, same_seg])
            reps = rows[:, ~same_seg]
            new_anchor = ~same_anchor[~same_seg]
            many = np.zeros(reps.shape[1], dtype=bool)
            if len(many):
                many |= ~new_anchor  # another segment came before
                many[:-1] |= ~new_anchor[1:]  # another one follows
                if held is not None and held[2] is not None and not new_anchor[0]:
                    opened.append(held[2][:, None])
                    held = (held[0], held[1], None)
                # The last one may be followed in the next batch.
                waits = None if many[-1] else reps[:, -1]
                opened.append(reps[:, many])
                held = (anchor[-1], seg[-1], waits)
        for is_open, part in ((False, gone), (True, opened)):
            got = np.concatenate(part, axis=1) if part else np.empty((4, 0), dtype=np.int64)
            if got.shape[1]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(got.shape[1], is_open)), pa.array(got[0]), pa.array(got[1]), pa.array(got[2]), pa.array(got[3] >> 8),
                     pa.array(((got[3] >> 1) & 127).astype(np.int32))], names=["open", "anchor", "seg", "doc_id", "at", "windows"])


# --- transforms ----------------------------------------------------------------

def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes sorted by at least LENGTH symbols (prefix doubling), ties by position.  The end sorts first."""
    n = len(text)
    bits = max(1, (symbols - 1).bit_length())
    depth = 62 // bits
    padded = np.concatenate([text.astype(np.int64), np.zeros(depth, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(depth):
        key = key << bits | padded[k:k + n]
    while True:
        order = np.argsort(key, kind="stable" if depth >= LENGTH else None)
        got = key[order]
        step = np.concatenate([[0], np.cumsum(got[1:] != got[:-1])])
        if depth >= LENGTH or step[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        key = rank * (n + 1)
        key[:n - depth] += rank[depth:] + 1
        depth *= 2


class Shard:
    """A text's suffix array and its transform: the two symbols that precede each suffix."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)  # the end mark
        self.order = suffix_order(text, symbols).astype(np.int32)
        before = text[self.order - 1].astype(np.uint32)
        before2 = text[self.order - 2].astype(np.uint32)
        self.pairs = before2 * np.uint32(symbols) + before  # read left to right
        if symbols * symbols <= 65536:
            self.pairs = self.pairs.astype(np.uint16)


def merge_shards(shards: list[Shard], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(entry, block): the merged order of all shards' suffixes, by ``length`` symbols.

    entry: index into the shards' suffix arrays, one after another; block: the
    same number for suffixes whose first ``length`` symbols are equal.  Every
    round sorts the interleave stably by the preceding pair of symbols.
    """
    sizes = [len(s.order) for s in shards]
    n = sum(sizes)
    pairs = np.concatenate([s.pairs for s in shards])
    source = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), sizes)
    entry = np.arange(n, dtype=np.int32)
    block = np.zeros(n, dtype=np.int32)
    place = np.arange(n, dtype=np.int32)
    for _ in range(length // 2):
        c = pairs[entry]
        by = np.argsort(c, kind="stable")
        source, block, c = source[by], block[by], c[by]
        new = np.empty(n, dtype=bool)
        new[0] = False
        np.not_equal(c[1:], c[:-1], out=new[1:])
        new[1:] |= block[1:] != block[:-1]
        block = np.cumsum(new, dtype=np.int32)
        # Within a shard the interleave keeps the order of its suffix array.
        entry = np.empty(n, dtype=np.int32)
        entry[np.argsort(source, kind="stable")] = place
    return entry, block


def repeated_windows(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(doc_id, start, end) of bytes covered by windows that an earlier row's window equals.

    rows: (doc_id, first window, windows, bytes) of distinct segments.
    """
    used = np.unique(np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8))
    code = np.zeros(256, dtype=np.uint16)
    code[used] = np.arange(1, len(used) + 1)
    shards, parts, held, doc, start, window = [], [], 0, [], [], []

    def close():
        nonlocal parts, held
        if parts:
            shards.append(Shard(code[np.frombuffer(b"".join(parts), dtype=np.uint8)], len(used) + 1))
            for a in (doc, start):
                a.append(np.zeros(1, np.int64))
            window.append(np.zeros(1, bool))
            parts, held = [], 0

    for doc_id, at, windows, raw in rows:
        n = len(raw)
        doc.append(np.full(n, doc_id, np.int64))
        start.append(at + np.arange(n, dtype=np.int64))
        window.append(np.arange(n) < windows)
        parts.append(raw)
        held += n
        if held >= SHARD_BYTES:
            close()
    close()
    doc, start, window = map(np.concatenate, (doc, start, window))
    entry, block = merge_shards(shards)
    firsts = np.concatenate([[0], np.cumsum([len(s.order) for s in shards])[:-1]])
    position = np.concatenate([s.order + f for s, f in zip(shards, firsts)])[entry]
    at = window[position]
    position, block = position[at], block[at]
    twice = np.zeros(len(block), dtype=bool)
    equal = block[1:] == block[:-1]
    twice[1:] |= equal
    twice[:-1] |= equal
    position, block = position[twice], block[twice]
    order = np.lexsort((start[position], doc[position], block))
    position, block = position[order], block[order]
    later = np.concatenate([[False], block[1:] == block[:-1]]) if len(block) else np.zeros(0, bool)
    hit = np.sort(position[later])
    if not len(hit):
        return []
    # Neighbouring windows of one segment cover one run of bytes.
    joined = np.concatenate([[False], (hit[1:] == hit[:-1] + 1) & (doc[hit[1:]] == doc[hit[:-1]]) & (start[hit[1:]] == start[hit[:-1]] + 1)])
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], len(hit)) - 1
    return list(zip(doc[hit[first]].tolist(), start[hit[first]].tolist(), (start[hit[last]] + LENGTH).tolist()))


#: Bytes before and after the anchor that a window has at least, by the anchor's place in the window.
_AROUND = [(low, REACH - 1 - high) for low, high in ((0, 18), (19, 37), (38, 56), (57, 76))]


def meeting(anchors: list[int], raws: list[bytes]) -> np.ndarray:
    """Whether each segment may have a window of another one.

    Two equal windows have the anchor at one place, and what ``_AROUND`` names
    for this place is the same in both.
    """
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    h = gram_hashes(np.frombuffer(b"".join(raws), dtype=np.uint8)).view(np.int64)
    # The anchor is the first gram of its hash in the segment: an earlier one would be the anchor.
    hit = np.flatnonzero(h == np.repeat(np.array(anchors, dtype=np.int64), sizes)[:len(h)])
    of = np.searchsorted(starts, hit, side="right") - 1
    inside = hit + GRAM <= starts[of] + sizes[of]
    found, first = np.unique(of[inside], return_index=True)
    place = (hit[inside][first] - starts[found]).tolist()
    out = np.ones(len(raws), dtype=bool)
    out[found] = False
    for before, after in _AROUND:
        whole = [(k, p) for k, p in zip(found.tolist(), place) if p >= before and sizes[k] - p - GRAM >= after]
        keys = np.array([xxhash.xxh3_64_intdigest(raws[k][p - before:p + GRAM + after]) for k, p in whole], dtype=np.uint64)
        _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        out[[k for (k, _p), many in zip(whole, (n[at] > 1).tolist()) if many]] = True
    return out


_SPAN = "doc_id long, start long, end long"


def merge_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open segments with their bytes, sorted by anchor, to repeated spans: whole anchors per unit."""
    rows, anchors, held, last = [], [], 0, None

    def settle():
        took = [r for r, may in zip(rows, meeting(anchors, [r[3] for r in rows])) if may]
        found = repeated_windows(took) if len(took) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], names=["doc_id", "start", "end"])

    for batch in batches:
        for anchor, doc_id, at, windows, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if held >= UNIT_BYTES and anchor != last:
                yield settle()
                rows, anchors, held = [], [], 0
            rows.append((doc_id, at, windows, raw))
            anchors.append(anchor)
            held += len(raw)
            last = anchor
    if rows:
        yield settle()


# --- the whole job ---------------------------------------------------------------

def _segment_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, segs) batches to rows with the segments' bytes."""
    names = ["anchor", "large", "doc_id", "at", "windows", "raw"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        out, held = [], 0
        for k in range(batch.num_rows):
            text, doc_id = utf8(batch.column(1)[k].as_py()), batch.column(0)[k].as_py()
            for s in batch.column(2)[k].as_py():
                raw = text[s["at"]:s["at"] + s["windows"] + LENGTH - 1]
                out.append((s["anchor"], s["large"], doc_id, s["at"], s["windows"], raw))
                held += len(raw)
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def _window_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of oversized anchors to one row per window: 128-bit hash, doc_id, start."""
    for batch in batches:
        hi, lo, doc, start = [], [], [], []
        for _a, doc_id, at, windows, raw in zip(*(c.to_pylist() for c in batch.columns)):
            for k in range(windows):
                d = xxhash.xxh3_128_digest(raw[k:k + LENGTH])
                hi.append(int.from_bytes(d[:8], "little", signed=True))
                lo.append(int.from_bytes(d[8:], "little", signed=True))
                doc.append(doc_id)
                start.append(at + k)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hi, lo, doc, start)], names=["hi", "lo", "doc_id", "start"])


def repeated_spans(texts: DataFrame, partitions: int) -> DataFrame:
    """doc_id, start, end of repeated bytes (overlapping spans possible) of ``texts`` (doc_id, text; one row per id)."""
    ship_package(texts.sparkSession)
    rows = texts.mapInArrow(segment_rows, "anchor long, seg long, doc_id long, packed long")
    found = materialize(rows.repartition(partitions, "anchor").sortWithinPartitions("anchor", "seg", "doc_id", "packed")
                        .mapInArrow(settle_segments, _FOUND), "segments")
    whole = found.where("not open").select("doc_id", F.col("at").alias("start"), (F.col("at") + F.col("windows") + (LENGTH - 1)).alias("end"))
    opened = found.where("open").select("anchor", "doc_id", "at", "windows")
    large = (opened.groupBy("anchor").agg(F.sum(F.col("windows") + LENGTH).alias("b")).where(F.col("b") > GROUP_BYTES)
             .select("anchor", F.lit(True).alias("large")))
    asked = (opened.join(large, "anchor", "left").withColumn("large", F.coalesce("large", F.lit(False)))
             .groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "large", "at", "windows")).alias("segs")))
    cut = materialize(texts.join(asked, "doc_id").select("doc_id", "text", "segs").mapInArrow(
        _segment_bytes, "anchor long, large boolean, doc_id long, at long, windows int, raw binary"), "segment_bytes")
    merged = (cut.where("not large").select("anchor", "doc_id", "at", "windows", "raw").repartition(partitions, "anchor")
              .sortWithinPartitions("anchor", "doc_id", "at").mapInArrow(merge_units, _SPAN))
    windows = cut.where("large").select("anchor", "doc_id", "at", "windows", "raw").mapInArrow(_window_keys, "hi long, lo long, doc_id long, start long")
    first = windows.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    late = (windows.join(first, ["hi", "lo"]).where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("start") != F.col("f.start")))
            .select("doc_id", "start", (F.col("start") + LENGTH).alias("end")))
    return whole.union(merged).union(late)


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs of the union of spans."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """doc_id, text, spans (start, end of removed byte runs) per row of ``docs``."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = slim.where("doc_id is not null and text is not null")
    repeated = materialize(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.min(F.xxhash64("text")).alias("h")).where("c > 1"), "repeated_ids")
    one = known
    if repeated.limit(1).count():
        first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
        once = (known.join(repeated, "doc_id", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("doc_id", "text"))
        one = known.join(repeated, "doc_id", "left_anti").union(once)
    spans = (repeated_spans(one, partitions).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("raw_spans")))
    mine = slim.join(spans, "doc_id", "left").join(repeated.select("doc_id", "h"), "doc_id", "left")
    applies = F.col("h").isNull() | (F.xxhash64("text") == F.col("h"))
    return mine.select("doc_id", "text", F.when(applies, F.col("raw_spans")).alias("raw_spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from ``remove_repeats``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                raw = utf8(batch.column(1)[k].as_py())
                spans = join_spans([(s["start"], s["end"]) for s in batch.column(2)[k].as_py() or ()])
                kept, at = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                out.append((batch.column(0)[k].as_py(), len(raw), sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(),) * 4 + (pa.string(),))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
