"""HTML extraction, nearest neighbours and the n-gram join against known answers."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopebook.llm import ann_forest, html_blocks, ngram_join
from tests.llm.fixtures import document_rows, documents, prose


# --- HTML ------------------------------------------------------------------

def _page(rng, article, other):
    menu = "".join(f"<li><a href='/{i}'>{o}</a>" for i, o in enumerate(other[:4]))
    body = "".join(f"<p>{a}" for a in article)
    return (f"<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body>"
            f"<nav><ul>{menu}</ul></nav><!-- ad <p>no</p> --><div class=\"ad\">{other[0]}</div>"
            f"<article><h1>{article[0][:20]}</h1>{body}</article><footer>&copy; {other[-1]}</footer></body></html>")


def _sample(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        article = [prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 8))]
        out.append((_page(rng, article, [prose(rng, rng.randint(1, 6)) for _ in range(5)]), article))
    return out


@pytest.fixture(scope="module")
def model():
    return html_blocks.train([p for p, _a in _sample(1, 120)])


def test_reader_blocks():
    got = html_blocks.blocks_of("<div>a <b>b</b>c<br>d<p>e<p>f<ul><li>g<li>h &amp;&lt;&#233;</ul>x<script>no</script> y</div><!-- z --> tail < 3")
    assert [b.text for b in got] == ["a bc d", "e", "f", "g", "h &<é", "x y", "tail < 3"]
    assert html_blocks.blocks_of("<p class='a>b") and html_blocks.blocks_of("<") and html_blocks.blocks_of("</p></x><td>") == []
    assert html_blocks.blocks_of("a\x00b<3 </ p>")[0].text


def test_reader_keeps_formulas_fallbacks_and_what_follows_unclosed_controls():
    got = html_blocks.blocks_of("<p>so <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn></math> holds <svg width='1'><path d='M0'/><text>fig</text></svg> here"
                                "<object data='x'><p>old text</p></object><canvas>drawn <b>so</b></canvas><select><option>a<option>b</select>z")
    assert [b.text for b in got] == ["so x=1 holds fig here", "old text", "drawn so", "a", "b", "z"]
    assert got[-1].path == ("p",) and "button" not in html_blocks.blocks_of("<nav><button>m</nav><p>t")[-1].path
    for tag in ("button", "object", "canvas", "select", "template", "math", "svg"):
        page = f"<nav><{tag}>menu</nav><article><p>long text</p><p>and more</p></article><{tag}>end</{tag}>"
        got = html_blocks.blocks_of(page)
        assert [b.text for b in got if html_blocks.truth(b)] == ["long text", "and more"], tag


def test_reader_loses_no_stand_in_and_leaks_no_script():
    got = html_blocks.blocks_of("<article><p>one</p><noscript><p>two</p></noscript><iframe src=x><p>three</p></iframe><p>four</p></article>")
    assert [(b.text, html_blocks.truth(b)) for b in got] == [(w, True) for w in ("one", "two", "three", "four")]
    got = html_blocks.blocks_of("<p>a</p><script src='a.js'/>var x = 1;</script><STYLE/>p{}</style foo><p>b<script>never ended <p>c")
    assert [b.text for b in got] == ["a", "b"]
    inside = html_blocks.blocks_of("<article><ul class='list'><li>item</ul><ol class='comment-list'><li>reader</ol></article>")
    assert [html_blocks.truth(b) for b in inside] == [True, False]


#: Pages written by hand after common site templates: (page, its text).
HAND_WRITTEN = [
    ("""<!doctype html><html lang=en><head><meta charset=utf-8><title>Bridges</title><script async src="t.js"/></script></head><body class="home">
<div id="top"><a href="/">Home</a> <a href="/news">News</a> <a href="/shop">Shop</a></div>
<noscript>Please turn on JavaScript.</noscript>
<article class="post hentry" itemscope><h1 class=title>How old bridges are kept standing</h1>
<p>Every spring a crew of six walks the length of the river and looks at each stone from below with a lamp.</p>
<noscript><p>The map of all the bridges is shown as a list of names for readers who see no pictures here.</p></noscript>
<ul class="list"><li>The upper bridge was built of limestone and repaired after the flood.</li><li>The lower one is of brick and rests on oak piles.</li></ul>
<p>Nobody remembers when the work began, but the books of the town mention it often.</p></article>
<div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div>
<footer><p>Copyright the town. All rights reserved.</p></footer></body></html>""",
     ["How old bridges are kept standing", "Every spring a crew of six walks the length of the river and looks at each stone from below with a lamp.",
      "The map of all the bridges is shown as a list of names for readers who see no pictures here.",
      "The upper bridge was built of limestone and repaired after the flood.", "The lower one is of brick and rests on oak piles.",
      "Nobody remembers when the work began, but the books of the town mention it often."]),
    ("""<html><body><header class="site-header"><nav><ul><li><a href=/>Start</a><li><a href=/a>About</a></ul></nav></header>
<main id="main"><h2>Bread without yeast</h2><p>Flour and water stand for two days until bubbles rise and the dough smells sour.
<p>Then it is baked in a hot oven &mdash; not longer than an hour &mdash; and left to cool on a rack.
<blockquote>My grandmother used a stone that she heated in the fire before the loaf went in.</blockquote></main>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href=/1>Ten soups</a><li><a href=/2>Pies</a></ul></aside>
<section class="comments"><p>Great, I will try it soon!</p></section><form action=/s><input name=q><button>Search</button></form></body></html>""",
     ["Bread without yeast", "Flour and water stand for two days until bubbles rise and the dough smells sour.",
      "Then it is baked in a hot oven — not longer than an hour — and left to cool on a rack.",
      "My grandmother used a stone that she heated in the fire before the loaf went in."]),
]


def test_hand_written_pages(model):
    """Nearly all blocks of pages that no code of the trainer made: lost and leaked blocks are counted alike."""
    wrong = total = 0
    for page, want in HAND_WRITTEN:
        (got,) = html_blocks.main_texts([page], model)
        got = got.split("\n")
        wrong += len(set(want) ^ set(got))
        total += len(html_blocks.blocks_of(page))
    assert wrong <= 0.1 * total, (wrong, total)


def test_formulas_and_fallbacks_reach_the_text(model):
    article = ["we find <math><mi>a</mi><mo>+</mo><mi>b</mi></math> in all of these cases", "<object>the table in plain words for old readers</object>"]
    rng = random.Random(6)
    (got,) = html_blocks.main_texts([_page(rng, ["a heading of it", *article, prose(rng, 30)], [prose(rng, 4) for _ in range(5)])], model)
    assert "we find a+b in all of these cases" in got and "the table in plain words for old readers" in got


def test_held_out_pages_are_exact(model):
    pages = _sample(2, 60)
    got = html_blocks.main_texts([p for p, _a in pages], model)
    want = ["\n".join([a[0][:20].strip(), *a]) for _p, a in pages]
    assert sum(g == w for g, w in zip(got, want)) >= 59


def test_held_out_layouts(model):
    rng, npr = random.Random(8), np.random.default_rng(8)
    right = total = 0
    for _ in range(150):
        blocks, ys = html_blocks.relayout([prose(rng, rng.randint(5, 40)) for _ in range(5)],
                                          [prose(rng, rng.randint(1, 30)) for _ in range(5)], npr)
        if blocks:
            (got,) = model.label([html_blocks.features(blocks)])
            right += int((got == np.array(ys)).sum())
            total += len(ys)
    assert total > 1000 and right / total > 0.95


@pytest.mark.parametrize("box", ["<div class='content'>", "<div class='entry-content'>", "<div role='main'>", "<div class='x7'>"])
def test_pages_without_article_or_main(box):
    def put(page):
        return page.replace("<article>", box).replace("</article>", "</div>")

    fitted = html_blocks.train([put(p) for p, _a in _sample(4, 120)])
    pages = _sample(5, 40)
    got = html_blocks.main_texts([put(p) for p, _a in pages], fitted)
    want = [[a[0][:20].strip(), *a] for _p, a in pages]
    lines = [g.split("\n") if g else [] for g in got]
    kept = sum(len(set(w) & set(g)) for w, g in zip(want, lines))
    assert kept >= 0.95 * sum(len(set(w)) for w in want) and kept >= 0.95 * sum(map(len, lines))


def test_few_marked_pages_do_not_outvote_the_rest():
    def put(page):
        return page.replace("<article>", "<div class='content'>").replace("</article>", "</div>")

    fitted = html_blocks.train([p for p, _a in _sample(6, 2)] + [put(p) for p, _a in _sample(4, 120)])
    got = html_blocks.main_texts([put(p) for p, _a in _sample(5, 40)], fitted)
    assert sum(map(bool, got)) >= 38


def test_gradients_match_differences():
    m = html_blocks.Labeller(dim=5, hidden=3)
    for k in m.w:
        m.w[k] = m.w[k].astype(np.float64)
    rng = np.random.default_rng(0)
    x, mask, y = rng.normal(size=(4, 2, 5)), np.ones((4, 2)), rng.integers(0, 2, (4, 2)).astype(float)
    mask[3, 1] = 0
    grads, _ = m.gradients(x, mask, y)
    for name in ("xf", "hb", "cf", "o"):
        at = (0,) * m.w[name].ndim
        m.w[name][at] += 1e-3
        up = m.gradients(x, mask, y)[1]
        m.w[name][at] -= 2e-3
        down = m.gradients(x, mask, y)[1]
        m.w[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3


def test_extract_edge_rows(spark, model):
    pages = _sample(3, 3)
    rows = [(i, f"http://x/{i}", p, 1) for i, (p, _a) in enumerate(pages)]
    rows += [(10, None, None, 1), (11, "u", "", 1), (12, "u", "<script>", 1), (0, "http://x/0", pages[0][0], 1), (None, "u", pages[1][0], 1),
             (13, "u", "<article>" + "<p>long text here.</p>" * 3000 + "</article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").withColumn("n_chars", F.lit("x"))
    fitted = html_blocks.fit(df)
    out = html_blocks.extract(df, model).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert by[10]["text"] == by[11]["text"] == by[12]["text"] == "" and by[10]["n_chars"] == 0
    assert by[0]["text"] == "\n".join([pages[0][1][0][:20].strip(), *pages[0][1]])
    assert by[13]["text"].count("\n") == 2999
    assert html_blocks.extract(df.limit(0), html_blocks.fit(df.limit(0))).count() == 0
    assert isinstance(fitted, html_blocks.Labeller)


# --- nearest neighbours ----------------------------------------------------

def _brute(rows, every, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ok = sorted(ok)
    m = np.array([v for _i, v in ok], dtype=np.float64)
    n = np.sqrt((m * m).sum(axis=1))
    out = {}
    for i, v in ok:
        if i % every == 0:
            q = np.array(v, dtype=np.float64)
            s = (m * q).sum(axis=1) / (n * np.sqrt((q * q).sum()))
            out[i] = sorted((-x, j) for (j, _v), x in zip(ok, s) if j != i)[:k]
    return out


def _vectors(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dim))
    x = (centers[rng.integers(0, 8, n)] + 0.6 * rng.normal(size=(n, dim))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    hot = rows[50][1]
    rows += [(n + i, hot) for i in range(n // 3)]  # one vector that many rows share
    return rows + [(100_000, None), (100_050, [0.0] * dim), (100_100, [float("nan")] * dim), (100_150, [None] * dim), (None, hot), (100_200, []), rows[3]]


def test_neighbours_exact_when_all_leaves_are_searched(spark):
    rows = _vectors(400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("vec", F.lit(2))
    got = {}
    for r in ann_forest.search(df, "vec_id % 50 = 0", share=99.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = _brute(rows, 50, 5)
    assert got.keys() == want.keys()
    for q, hits in got.items():
        assert [h[0] for h in sorted(hits)] == [1, 2, 3, 4, 5]
        assert [h[1] for h in sorted(hits)] == [j for _s, j in want[q]], q
        assert all(abs(h[2] + w[0]) < 1e-12 for h, w in zip(sorted(hits), want[q]))


def test_recall_with_production_parameters(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = _brute(rows, 50, 5)
    got = {}
    for r in ann_forest.search(df, "vec_id % 50 = 0").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = sum(len(got.get(q, set()) & {j for _s, j in w}) for q, w in want.items())
    assert hit / sum(map(len, want.values())) >= 0.9


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann_forest.search(spark.createDataFrame([], schema), "vec_id % 50 = 0").count() == 0
    assert ann_forest.search(spark.createDataFrame([(0, [1.0, 2.0])], schema), "vec_id % 50 = 0").count() == 0
    two = ann_forest.search(spark.createDataFrame([(0, [1.0, 2.0]), (7, [2.0, 4.0])], schema), "vec_id % 50 = 0").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in two] == [(0, 1, 7)]


# --- n-gram join -----------------------------------------------------------

def brute_join(rows, words, percent):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    sets = [(r[0], grams(r[1])) for r in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if s and t and a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t):
                root[find(i)] = find(j)
    low = {}
    for i, (a, _s) in enumerate(sets):
        if a is not None:
            low[find(i)] = min(low.get(find(i), a), a)
    return [(a, len(s), low[find(i)] if a is not None else None) for i, (a, s) in enumerate(sets)]


def near_rows(seed=1):
    """Families of near copies at all distances, a common passage, chains, short texts."""
    rng = random.Random(seed)
    rows = document_rows()
    n = 1000
    passage = prose(rng, 60)
    for family in range(8):
        base = prose(rng, rng.choice([8, 30, 60, 150])).split()
        for _ in range(rng.randint(2, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((n, " ".join(w), None, None, None))
            n += 1
    chain = prose(rng, 120).split()
    for k in range(20):  # each links with the next, the ends do not
        rows.append((n, " ".join(chain), None, None, None))
        chain = chain[3:] + [f"c{k}a", f"c{k}b", f"c{k}c"]
        n += 1
    for k in range(60):
        rows.append((n, f"u{k} v{k} {passage} " + prose(rng, rng.choice([0, 1, 3, 60])), None, None, None))
        n += 1
    return rows


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_join_matches_brute_force(spark, words, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "MIN_FREQUENT", 5)
    rows = near_rows()
    got = ngram_join.join(documents(spark, rows), words, percent).collect()
    want = brute_join(rows, words, percent)
    key = lambda r: (r[0] is None, r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert len({w[2] for w in want}) < len(want) - 60


def test_join_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CELLS", 500)
    rows = near_rows(3)
    got = ngram_join.join(documents(spark, rows), 4, 85).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(brute_join(rows, 4, 85), key=key)


def test_keep_representatives(spark):
    rows = near_rows(2)
    docs = documents(spark, rows)
    out = ngram_join.keep_representatives(docs)
    assert out.schema == docs.schema
    want = sorted({c for _a, _n, c in brute_join(rows, 5, 80) if c is not None})
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == want
    assert ngram_join.join(documents(spark, [])).count() == 0


def test_least_overlap_is_exact():
    for percent in (80, 85):
        for n1 in range(1, 40):
            for n2 in range(1, 40):
                need = min((i for i in range(0, 100) if 100 * i >= percent * (n1 + n2 - i)))
                assert ngram_join.least_overlap(n1, n2, percent) == need


def test_sift_keeps_every_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = np.unique(rng.integers(-2 ** 63, 2 ** 63 - 1, rng.integers(1, 300)))
        for _ in range(rng.integers(1, 6)):
            gone = rng.integers(0, len(base) // 12 + 1)
            own = rng.integers(-2 ** 63, 2 ** 63 - 1, rng.integers(0, len(base) // 16 + 1))
            sets.append(np.unique(np.concatenate([rng.permutation(base)[gone:], own])))
    for percent in (80, 85):
        linked = np.array([any(i != k and 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t))
                               for k, t in enumerate(sets)) for i, s in enumerate(sets)])
        prefixes = [s[:ngram_join.prefix_length(len(s), percent)] for s in sets]
        sizes = np.array([len(s) for s in sets])
        known = [ngram_join.sketch(s) for s in sets]
        for sketches in (known, [b""] * len(sets), [b"" if k % 3 else s for k, s in enumerate(known)]):
            assert ngram_join.sift(sizes, prefixes, sketches, percent)[linked].all()
        assert 5 < linked.sum() < len(sets)
    # One bin that overflows: nothing is known of the set.
    assert ngram_join.sketch(np.arange(5000, dtype=np.int64) * 2 ** 20) == b""


def test_only_sets_that_may_link_are_moved(spark, monkeypatch):
    rng = random.Random(6)
    hub = [f"h{rng.randrange(10 ** 9)}" for _ in range(400)]
    texts = [hub, [*hub[:398], "y", "z"], *([*hub[:200], *(f"o{k}w{i}" for i in range(200))] for k in range(20))]
    places, placed = [], ngram_join.placed_sets

    def counted(docs, wanted, *rest):
        places.append(wanted.count())
        return placed(docs, wanted, *rest)
    monkeypatch.setattr(ngram_join, "placed_sets", counted)
    rows = [(i, " ".join(t), None, None, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(documents(spark, rows), 4, 85).collect()}
    assert got == {i: 0 if i < 2 else i for i in range(len(rows))}
    assert places == [2]  # half of its columns bring each of the others to the hub's group


def test_join_leaves_no_wide_tables_and_moves_only_what_may_go(spark):
    """Prefixes, sketches and columns are deleted once read; texts that stay are not shuffled when the ids that go are too many to broadcast."""
    import os
    from slopebook.plans import session
    texts = [f"{prose(random.Random(i), 30)} stays{i}" for i in range(40)]
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts + texts[:3])] + [(None, texts[0], "en", "s", 0)])
    written = spark.sparkContext.__dict__.setdefault("_slopebook_written", [])
    start = len(written)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.keep_representatives(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=lambda v: (v is None, v)) == [*range(40), None]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.index("Union") < plan.index("LeftAnti")
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in written[start:]}
    assert not left & {"ngram_rows", "ngram_nodes", "ngram_columns", "ngram_cells", "ngram_groups", "ngram_met"}
    assert not [p for p in session.ensure_checkpoint_dir(spark).split("://")[-1:] for d in os.listdir(f"{p}/materialized") if d.startswith("ngram_nodes")]
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"
