"""Katz backoff against a model made of dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from slopebook.llm import katz_lm
from tests.llm.fixtures import SCHEMA, document_rows, documents, prose


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + ["</s>"]


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


class Model:
    def __init__(self, rows):
        self.uni, self.bi, self.ctx = Counter(), Counter(), Counter()
        for r in rows:
            if not is_held_out(r[0]):
                t = ["<s>"] + tokens(r[1])
                self.uni.update(t[1:])
                self.bi.update(zip(t, t[1:]))
                self.ctx.update(t[:-1])
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.d1, self.d2 = (katz_lm.losses([sum(c == r for c in x.values()) for r in range(1, katz_lm.LARGEST + 2)]) for x in (self.uni, self.bi))
        self.unseen = 1 - sum(self.kept(self.d1, c) for c in self.uni.values()) / self.n if self.n else 1.0
        self.follow = {}
        for (h, w) in self.bi:
            self.follow.setdefault(h, []).append(w)

    @staticmethod
    def kept(d, r):
        return r - d[min(r, katz_lm.LARGEST)]

    def word(self, w):
        return self.kept(self.d1, self.uni[w]) / self.n if self.uni[w] else self.unseen

    def weight(self, h):
        if h not in self.follow:
            return 1.0
        used = sum(self.kept(self.d2, self.bi[h, w]) for w in self.follow[h]) / self.ctx[h]
        return (1 - used) / (1 - sum(map(self.word, self.follow[h])))

    def p(self, h, w):
        return self.kept(self.d2, self.bi[h, w]) / self.ctx[h] if self.bi[h, w] else self.weight(h) * self.word(w)

    def row(self, r):
        t = ["<s>"] + tokens(r[1])
        base = sum(math.log10((self.uni[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t[1:])
        return (r[0], is_held_out(r[0]), len(t) - 1, sum(self.uni[w] > 0 for w in t[1:]), self.n, base,
                sum(math.log10(self.p(h, w)) for h, w in zip(t, t[1:])))


def check(df, rows, **sizes):
    out = katz_lm.score(df, ~katz_lm.held_out(F.col("doc_id")), **sizes)
    got = [(r["doc_id"], not r["training"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out.collect()]
    model = Model(rows)
    want = [model.row(r) for r in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 4))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    return model


@pytest.mark.parametrize("sizes", [{}, {"block_tokens": 700, "bucket_tokens": 300}])
def test_against_dictionaries(spark, sizes):
    """Also in many small blocks and buckets, where the long text is cut into pieces."""
    rows = document_rows(n=60)
    check(documents(spark, rows), rows, **sizes)


def test_probabilities_of_a_context_add_up_to_one():
    model = Model(document_rows(n=60))
    for h in ["<s>", "the", "of", "never met", *list(model.follow)[:20]]:
        assert sum(model.p(h, w) for w in model.uni) + model.weight(h) * model.unseen == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("rows", [[], [(0, "only one", "en", "s", 1)], [(10, None, "en", "s", 1)],
                                  [(i, "same words here", "en", "s", 1) for i in range(40)]])
def test_small_tables(spark, rows):
    check(spark.createDataFrame(rows, SCHEMA), rows)


def test_only_held_out_rows(spark):
    held = [i for i in range(200) if is_held_out(i)]
    rows = [(i, "no training text", "en", "s", 1) for i in held]
    check(spark.createDataFrame(rows, SCHEMA), rows)


def test_held_out_text_is_better_predicted_by_pairs(spark):
    """A text whose word order the training texts share scores over the word model."""
    import random
    rng = random.Random(3)
    line = prose(rng, 60)
    held = next(i for i in range(1000) if is_held_out(i))
    rows = [(i, line if i % 2 else prose(rng, 60), "en", "s", 1) for i in range(300) if not is_held_out(i)] + [(held, line, "en", "s", 1)]
    out = katz_lm.score(spark.createDataFrame(rows, SCHEMA), ~katz_lm.held_out(F.col("doc_id"))).where(F.col("doc_id") == held).first()
    assert out["score"] > out["base_score"] / 2
    assert not out["training"]


def test_losses():
    good = katz_lm.losses([1000, 400, 200, 120, 80, 60])
    assert good[0] == 0 and all(0 < x < 1.5 for x in good[1:])
    assert katz_lm.losses([0, 0, 0, 0, 0, 0]) == [0.0] + [0.5] * 5
    assert len(katz_lm.losses([10, 4, 0, 0, 0, 0])) == katz_lm.LARGEST + 1


def test_words_of_bytes_are_told_apart():
    """Word hashes against plain splitting, over slices that cut texts and words."""
    import random

    import pyarrow as pa

    from slopebook.llm import arrays
    rng = random.Random(1)
    texts = [None, "", " ", "aB Ab ab", "x" * 300, " é▁ü 　 x y z\n\n w"] + [
        "".join(rng.choice("ab C\n") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    old = arrays.SLICE_BYTES
    try:
        for arrays.SLICE_BYTES in (50, old):
            for column, part in ((pa.array(texts), texts), (pa.array(texts).slice(3, 50), texts[3:53])):
                data, offsets = arrays.text_bytes(column)
                hashes, _starts = arrays.hashed_words(data, offsets, katz_lm.WORD)
                words = [w for t in part for w in tokens(t)[:-1]]
                seen = {}
                assert [seen.setdefault(w, h) for w, h in zip(words, hashes)] == list(hashes) and len(words) == len(hashes)
                assert len(set(seen.values())) == len(seen)
    finally:
        arrays.SLICE_BYTES = old
