"""Phrase mining against plain counting of all runs."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from slopebook.llm import phrase_graph
from tests.llm.fixtures import SCHEMA, document_rows, documents, prose


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [p for p in (re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", low)) if p]


def model(rows, least, top, factor=2_000_000):
    out = []
    for lang in {r[2] or "und" for r in rows}:
        f = Counter()
        for r in rows:
            if (r[2] or "und") == lang:
                for p in pieces(r[1]):
                    f.update(tuple(p[i:i + k]) for k in range(1, 5) for i in range(len(p) - k + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = []
        often = [g for g, c in f.items() if len(g) > 1 and c >= least]
        for g in often:
            a = f[g]
            inside = any(len(x) > len(g) and any(x[i:i + len(g)] == g for i in range(len(x) - len(g) + 1)) and 100 * f[x] >= 80 * a for x in often)
            if not inside:
                score, _k, l, r = min((factor * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), l, r))
        found.sort()
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(found[:top], 1)]
    return sorted(out)


def check(df, rows, least=30, top=2000, **sizes):
    got = phrase_graph.mine(df, least=least, top=top, **sizes)
    want = model(rows, least, top)
    assert sorted(tuple(r)[:8] for r in got.collect()) == want
    return want


def corpus(seed=1, n=80):
    """Few words, so that runs repeat; passages that many texts hold; three languages, one of them null."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Ünï", "THE", "the", "A"]
    passage = " ".join(rng.choice(words) + str(i) for i in range(30))
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".\n", " ; ", "  "]) for _ in range(rng.randint(0, 150)))
        if i % 2:
            text += f". {passage}! the last words " + "w1 " * (i % 7)
        rows.append((i, text, ["en", "en", None, "de", "und"][i % 5], "s", 1))
    return rows + rows[:9] + [(None, "w1 w2 w3. w1 w2", "en", None, None), (500, None, "en", "s", 1), (501, "", None, "s", 1)]


@pytest.mark.parametrize("kwargs", [{"least": 5}, {"least": 3, "top": 40, "block_words": 300, "bucket_words": 200}])
def test_against_plain_counting(spark, kwargs):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("run", "word", "rank", "n", "f", "score")})
    assert len(check(df, rows, **kwargs)) > 50


def test_awkward_rows(spark):
    rows = document_rows(n=60) + [(900 + i, prose(random.Random(i), 300).replace(" the ", ".\nThe "), "en", "s", 1) for i in range(60)]
    assert check(documents(spark, rows), rows, least=8)


@pytest.mark.parametrize("rows", [[], [(0, "too few words", "en", "s", 1)], [(0, None, None, None, None)],
                                  [(0, "a b " * 50, "en", "s", 1)], [(i, "one", "en", "s", 1) for i in range(40)]])
def test_small_tables(spark, rows):
    check(spark.createDataFrame(rows, SCHEMA), rows)


def test_paths_are_compacted(spark):
    """A passage in forty texts is one path; its inner runs are no phrases."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"{prose(rng, 20)}. {passage}. {prose(rng, 5)}", "en", "s", 1) for i in range(40)]
    got = phrase_graph.mine(spark.createDataFrame(rows, SCHEMA)).where(F.col("phrase").startswith("p"))
    of_passage = [r for r in got.collect() if re.fullmatch(r"p\d+( p\d+)+", r["phrase"])]
    assert {r["phrase"].count(" ") for r in of_passage} == {3} and {r["path_words"] for r in of_passage} == {20}
    assert len(of_passage) == 17


def test_long_texts_are_cut_after_breaks():
    import pyarrow as pa
    from slopebook.llm.arrays import text_bytes
    texts = ["a b. c d", "x" * 50, "one. two, three; four five six. seven", ""]
    data, offsets = text_bytes(pa.array(texts))
    cut, text = phrase_graph.cut_long(data, offsets, 10)
    parts = [bytes(data[s:e]).decode() for s, e in zip(cut, cut[1:])]
    assert ["".join(p for p, t in zip(parts, text) if t == i) for i in range(4)] == texts
    assert sum(map(len, map(pieces, parts))) == sum(map(len, map(pieces, texts))) and len(parts) > 4


def test_exact_beyond_64_bits(spark):
    words = spark.createDataFrame([(1, "en", "x", 9 * 10 ** 15), (2, "en", "y", 9 * 10 ** 15 + 1)], "id long, lang string, word string, f long")
    grams = spark.createDataFrame([([1, 2], 8 * 10 ** 15 + 1, True)], "run array<long>, f long, kept boolean")
    got = phrase_graph.scored(grams, words).first()
    assert got["score"] == 2_000_000 * (8 * 10 ** 15 + 1) // (18 * 10 ** 15 + 1)


def test_runs_of_a_block_in_little_memory():
    import tracemalloc

    import numpy as np
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.3, 600_000) % 40_000 * 7
    ids[rng.random(len(ids)) < 0.05] = -1
    firsts = rng.random(len(ids)) < 0.05
    firsts[0] = True
    tracemalloc.start()
    columns, n = phrase_graph.longest_runs(ids, firsts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * len(ids)  # bytes; one sort of all runs takes over 100 a word
    piece = np.cumsum(firsts | np.append(False, ids[:-1] < 0))
    want = Counter()
    padded, pieces = np.append(ids, [-1] * 3), np.append(piece, [-1] * 3)
    rows = [np.where(pieces[k:k + len(ids)] == piece, padded[k:k + len(ids)], -1) for k in range(4)]
    for run in zip(*(np.where(np.all([r >= 0 for r in rows[1:k + 1]], axis=0), rows[k], -1).tolist() for k in range(4))):
        if run[0] >= 0:
            want[run] += 1
    assert dict(zip(zip(*(c.tolist() for c in columns)), n.tolist())) == want
    order = list(zip(*(c.tolist() for c in columns)))
    assert order == sorted(order)


def test_no_more_than_two_levels_are_kept(spark, monkeypatch):
    """A step's input is deleted when its output is written, and runs are shuffled in shares."""
    import os
    kept, step = [], phrase_graph.step

    def seen(df, name, done=()):
        out = step(df, name, done)
        written = spark.sparkContext._slopebook_written
        kept.append((name, {os.path.basename(p).rsplit("-", 1)[0] for p in written[start:]}))
        return out
    start = len(spark.sparkContext.__dict__.setdefault("_slopebook_written", []))
    monkeypatch.setattr(phrase_graph, "step", seen)
    rows = corpus(seed=4, n=60)
    check(documents(spark, rows), rows, least=4, block_words=300, bucket_words=500)
    big = {"phrase_blocks", "phrase_runs", "phrase_flow4", "phrase_flow3", "phrase_flow2"}
    assert all(len(there & big) <= 2 for _name, there in kept)
    assert not kept[-1][1] & (big | {"phrase_words", "phrase_often"})
    assert [name for name, _ in kept].count("phrase_runs") == phrase_graph.SHARES
