"""Plain pages without the tolerant parser (E22-E25), and page translation without a shuffle of pages."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from slopebook.operators import markup
from slopebook.operators import translate as tr
from slopebook.sources.fixtures import HOOK_PARTS, SITE_PARTS

RULES = markup.repair_rules("012-345-678", "old_shop", "@new_shop", "<b>call</b>")
PIECES = ["<p>", "</p>", "\n", "予約", "<div id=r data-langblock='ja'\n>", "</div>", "<!-- x\n -->", "&amp;", "&#x4E88;", "<", "<img alt=スキー>", "<script>", "</script>",
          "<!x", "<?y\n>", "a < b", "<textarea>", "</textarea>", "</", "<br/>", "<a title='大\n人'", "😀", "</SCRIPT >", "<style media=x>", "</style>", "<title>", "</title>",
          "<!doctype html>", "<!---->", "<!-->", "<!--->", "<!-- - -- >", "<!-- --->", "<!-- a-b -->", "<p title=\"予約&quot;\" class=x>", "<a href=x/>", "<a href=x />", "<svg/>",
          "<svg>", "</svg>", "<b a=1 A=2 id='r'>", "<b a>", "<b a=>", "<b a = 'x' b>", "<b a='x'b='y'>", "<b/a>", "<b a　b>", "<B ID=r TITLE=予約>", "</b\n>", "</b x>", "</ b>",
          "<code data-no-i18n>", "</code>", "<li/>", "<li>", "</li>", "\x00", "\x0b", "&lt;p&gt;", "&am", "&#", "</script", "<script/>", "<script src='</script>'>", "<iframe>",
          "</iframe>", "<b a==x>", "<b a=\"x>", "\"", "'", ">", "--", "-->", "<b data-LANGBLOCK=en>", "<a href='reserve.html'>", "WEB予約", "<p class='badge-label z'>",
          "<div class=booking-steps>", "<b class=access-row>営業時間 8:30</b>", "<a href=#>よくある</a>", "<ul class='utility-links'>", "</ul>",
          "<span class=content-card-title>初心者</span>", "<a class='content-card' href=q>", "</a>"]


def pages(n: int, seed: int):
    rng = random.Random(seed)
    whole = ["".join(found for (found, _wanted), *_more in HOOK_PARTS.values()), "".join(SITE_PARTS.values())]
    for i in range(n):
        if i % 4:
            yield "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14)))
        else:
            text, at = rng.choice(whole), rng.randrange(300)
            yield text[:at] + rng.choice([*PIECES, "", ""]) + text[at + rng.choice([0, 0, 1, 3]):]


def told(e: markup.Element) -> tuple:
    return e.tag, e.attrs, e.start, e.inside, e.text, e.inside_end, e.end, e.text_end, e.classes, e.parent and e.parent.start


def test_plain_pages_are_scanned_as_by_the_parser():
    plain = 0
    for text in pages(4000, 5):
        for root in (None, "r"):
            whole = markup.PageScan(text, root)
            assert markup.scan(text, root) == (whole.nodes, whole.blocks, whole.root), text
        whole, got = markup.PageScan(text, elements=True), markup.elements_of(text)
        assert [told(e) for e in got.elements] == [told(e) for e in whole.elements] and got.texts == whole.texts, text
        plain += isinstance(got, markup.PlainElements)
    assert 500 < plain < 3500


def test_plain_pages_need_no_parser(monkeypatch):
    def none(*_args, **_named):
        raise AssertionError("the tolerant parser was used")

    hook = "".join(found for (found, _wanted), *_more in HOOK_PARTS.values())
    wanted, hits = markup.apply_rules(hook, RULES)
    monkeypatch.setattr(markup, "PageScan", none)
    assert markup.apply_rules(hook, RULES) == (wanted, hits) and hits >= 9
    nodes, _blocks, _root = markup.scan_of("".join(SITE_PARTS.values()), None)
    assert len(nodes) > 3


def test_unclosed_markup_takes_no_square_time():
    """What is not plain ends the scan at once, and a long text after the last tag is read once."""
    for text in ("<script>" * 40_000, "<a b=\"" * 40_000, "<!--" * 40_000, "<p>" + "予" * 400_000, "<p" * 40_000, "</" * 40_000):
        try:
            markup.plain_tags(text)
        except markup.NotPlain:
            pass


DICT = [("ホーム", "Home", "首頁"), ("予約", "Book", "預約")]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(DICT, "ja string, en string, zh string")


def test_no_page_is_shuffled(spark, dictionary, tmp_path):
    spark.createDataFrame([(1, "<p>ホーム</p>", 3)], "id long, html string, x int").write.parquet(f"{tmp_path}/pages")
    out, _nodes = tr.translate_pages(spark.read.parquet(f"{tmp_path}/pages"), "en", dictionary)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 2 and all("strategy=broadcast" in line for line in joins)
    assert "collect_list" not in plan


def test_pages_in_small_batches(spark, dictionary):
    """Batches end within pages; pages without nodes, without text, without an id and with an id that repeats."""
    html = lambda n: "<p>x</p>" + "".join(f"<p title='予約'>ホーム<b>{i}</b></p>" for i in range(n))
    rows = [(i % 30, html(i % 9), f"v{i}") for i in range(60)] + [(100, None, "n"), (101, "", "e"), (None, html(2), "no id"), (102, "<p>予約", None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = tr.translate_pages(spark.createDataFrame(rows, "id int, html string, v string").coalesce(2), "en", dictionary)[0].collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    put = lambda i, h: h if h is None or i is None else h.replace("予約", "Book").replace("ホーム", "Home")
    assert sorted(map(tuple, got), key=str) == sorted([(i, put(i, h), v) for i, h, v in rows], key=str)


def test_rows_out_of_order_fail(spark):
    base = spark.createDataFrame([(1, "予約", 0, 1, 3, 0, 1, "text", None), (None, None, 0, 0, 3, 1, 2, "text", None)],
                                 "p0 int, p1 string, _page long, _pos int, _of int, _start int, _end int, _kind string, _text string").coalesce(1)
    with pytest.raises(Exception, match="do not follow each other|lacks rows"):
        tr._write_back(base, base.selectExpr("p0 id", "p1 html").limit(0), "html").collect()


def test_lists_are_made_by_column():
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.string())]))
    assert markup._lists([[(1, "x"), (2, None)], [], [(3, "z")]], kind).to_pylist() == [[{"a": 1, "b": "x"}, {"a": 2, "b": None}], [], [{"a": 3, "b": "z"}]]
    assert markup._lists([[], []], kind).to_pylist() == [[], []]


TEXTS = ["ホーム", " a  b ", "大人 3人目 名", "5名", "5歳 フルセット", "x　予約", "予約 ", "お子様 2人目", "3日間の予約。", "レギュラー 様", "板のレンタルなし 2名", "人目", "追加: ソリ", "a b", "予\n約"]


@pytest.mark.parametrize("lang", ["en", "zh"])
def test_terms_equal_one_replacement_after_the_other(spark, lang):
    from pyspark.sql import functions as F
    out = F.col("t")
    for pat, en, zh in tr.TERMS:
        out = F.regexp_replace(out, pat, en if lang == "en" else zh)
    space = F.regexp_replace(F.regexp_replace("t", rf"[{tr.JS_SPACE}]+", " "), rf"^[{tr.JS_SPACE}]+|[{tr.JS_SPACE}]+$", "")
    df = spark.createDataFrame([(t,) for t in [*TEXTS, *(a + b for a in TEXTS for b in TEXTS), None, "", " "]], "t string")
    for r in df.select("t", out.alias("a"), tr._terms(F.col("t"), lang).alias("b"), space.alias("c"), tr.normalise(F.col("t")).alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), r.t
