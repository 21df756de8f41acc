"""Repeated-string removal against brute force; transforms against plain sorting."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from slopebook.llm import bwt_dedup
from tests.llm.fixtures import document_rows, documents, prose


def brute(rows, length=100):
    """rows (doc_id, text), one per id."""
    seen, out = {}, {}
    texts = sorted((i, (t or "").encode()) for i, t in rows if i is not None)
    for i, raw in texts:
        for k in range(len(raw) - length + 1):
            seen.setdefault(raw[k:k + length], (i, k))
    for i, raw in texts:
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for k in range(len(raw) - length + 1):
            if seen[raw[k:k + length]] != (i, k):
                gone[k:k + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows(seed=0):
    rng = random.Random(seed)
    passages = [prose(rng, 40) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, 60)
            parts += [p[cut:], prose(rng, rng.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    base = prose(rng, 150).split()
    for i in range(120, 170):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(200, passages[0][:99]), (201, passages[0][:100]), (202, passages[0][:101]), (203, "ab" * 400), (204, "x" * 3000),
             (205, None), (206, ""), (207, "é" * 120 + passages[1]), (208, rows[3][1]), (209, rows[3][1]), (-5, rows[3][1])]
    return rows


@pytest.mark.parametrize("shard,unit,group", [(192_000, 768_000, 3_000_000), (1500, 6000, 3_000_000), (2000, 5000, 4000)])
def test_removal_matches_brute_force(spark, monkeypatch, shard, unit, group):
    monkeypatch.setattr(bwt_dedup, "GROUP_BYTES", group)
    rows = repeat_rows()
    docs = documents(spark, [(i, t, None, None, None) for i, t in rows]).repartition(5)
    # Workers import the module afresh, so its small sizes are set inside the functions that run there.
    units = bwt_dedup.merge_units

    def small_units(batches):
        bwt_dedup.SHARD_BYTES, bwt_dedup.UNIT_BYTES, bwt_dedup.COMBINE_BYTES = shard, unit, 3000
        return units(batches)

    monkeypatch.setattr(bwt_dedup, "merge_units", small_units)
    got = {r["doc_id"]: tuple(r[1:]) for r in bwt_dedup.digest(bwt_dedup.remove_repeats(docs, partitions=3)).collect()}
    want = brute(rows)
    assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 60


def test_awkward_rows(spark):
    rows = document_rows()
    got = bwt_dedup.digest(bwt_dedup.remove_repeats(documents(spark, rows), partitions=3)).collect()
    assert len(got) == len(rows)
    want = brute({r[0]: r[1] for r in rows if r[0] is not None}.items())
    for r in got:
        if r["doc_id"] is not None:
            assert tuple(r[1:]) == want[r["doc_id"]], r["doc_id"]
        else:
            assert r["n_removed"] == 0
    assert bwt_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_two_texts_under_one_id(spark):
    rng = random.Random(5)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a, None, None, None), (2, a, None, None, None), (2, b, None, None, None)]
    got = bwt_dedup.digest(bwt_dedup.remove_repeats(documents(spark, rows), partitions=2)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 2]
    whole = {r["kept_sha256"]: r["n_removed"] for r in got}
    assert whole[hashlib.sha256(b.encode()).hexdigest()] == 0


def test_merge_equals_sorting_everything():
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 4, n).astype(np.uint16) for n in (400, 300, 1, 700)]
    texts[3][100:400] = texts[0][50:350]
    shards = [bwt_dedup.Shard(t, 5) for t in texts]
    entry, block = bwt_dedup.merge_shards(shards)
    suffixes = [bytes(np.append(t, 0)[o:].astype(np.uint8)) for t, s in zip(texts, shards) for o in s.order]
    merged = [suffixes[e][:100] for e in entry]
    # Beyond a text's end the order is free, so only suffixes of at least 100 symbols are compared.
    whole = [(m, b) for m, b in zip(merged, block) if len(m) == 100 and 0 not in m]
    assert [m for m, _b in whole] == sorted(m for m, _b in whole)
    for (m1, b1), (m2, b2) in zip(whole, whole[1:]):
        assert (m1 == m2) == (b1 == b2)


def test_segments_tile_all_windows_and_depend_on_bytes_alone():
    rng = random.Random(2)
    raw = np.frombuffer((prose(rng, 900) + "y" * 700).encode(), dtype=np.uint8)
    covered = np.zeros(len(raw) - 99, dtype=int)
    anchors = {}
    for h, at, n in bwt_dedup.segments(raw):
        for x, s, k in zip(h, at, n):
            covered[s:s + k] += 1
            assert 1 <= k <= bwt_dedup.REACH
            for w in range(s, s + k):
                assert anchors.setdefault(raw[w:w + 100].tobytes(), x) == x
    assert (covered == 1).all()


def test_segments_that_meet_no_other_are_not_merged(monkeypatch):
    import pyarrow as pa
    rng = random.Random(8)
    gram = "the anchor of 24 bytes.."
    rows, key = [], int(bwt_dedup.gram_hashes(np.frombuffer(gram.encode(), dtype=np.uint8)).view(np.int64)[0])
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    left, right = word(76), word(76)
    for k in range(30):  # 77 windows: all bytes around the anchor differ
        rows.append((key, k, 0, 77, (word(76) + gram + word(76)).encode()))
    for k, (a, b) in enumerate([(left, word(76)), (left, word(76)), (word(76), right), (word(76), right),
                                (word(36) + left[36:], right[:36] + word(40)), (word(36) + left[36:], right[:36] + word(40))]):
        rows.append((key, 100 + k, 0, 77, (a + gram + b).encode()))
    seen, merge = [], bwt_dedup.repeated_windows

    def merged(taken):
        seen.append(len(taken))
        return merge(taken)
    monkeypatch.setattr(bwt_dedup, "repeated_windows", merged)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(5)], names=["anchor", "doc_id", "at", "windows", "raw"])
    got = [s for out in bwt_dedup.merge_units(iter([batch])) for s in zip(*(c.to_pylist() for c in out.columns))]
    assert sorted(got) == sorted(merge([r[1:] for r in rows]))
    assert {d for d, _s, _e in got} == {101, 103, 105}
    assert len(seen) == 1 and seen[0] < 12


def test_meeting_keeps_every_equal_window():
    rng = random.Random(9)
    base = prose(rng, 300)
    found = {}
    for k in range(40):
        at = rng.randrange(len(base) - 10)
        raw = (base[:at] + rng.choice(["x", "yy", "", "zzzz"]) + base[at + rng.randint(0, 3):]).encode() + b"ab" * 90
        for anchors, starts, windows in bwt_dedup.segments(np.frombuffer(raw, dtype=np.uint8)):
            for a, s, n in zip(anchors.tolist(), starts.tolist(), windows.tolist()):
                found[raw[s:s + n + 99]] = (a, n)
    raws = sorted(found, key=lambda r: found[r])
    may = bwt_dedup.meeting([found[r][0] for r in raws], raws)
    owners = {}
    for k, r in enumerate(raws):
        for w in range(found[r][1]):
            owners.setdefault(r[w:w + 100], set()).add(k)
    shared = {k for o in owners.values() if len(o) > 1 for k in o}
    assert shared and all(may[k] for k in shared)
