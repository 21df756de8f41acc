"""Page parsing and element rules on hand-written markup."""

from __future__ import annotations

import pytest

from slopebook.operators import markup
from slopebook.operators.markup import PageScan, Rule, apply_rules

RULES = markup.repair_rules("012-345-678", "old_ig", "@new_ig", "<b>call</b>")


@pytest.mark.parametrize("found,wanted,hits", [
    (None, None, 0),
    ("", "", 0),
    ("<p>nothing here</p>", "<p>nothing here</p>", 0),
    # A rule for a class leaves an element alone that only has the word in its text or in a longer class name.
    ("<p class='access-rows'>営業時間 8:30</p>access-row", "<p class='access-rows'>営業時間 8:30</p>access-row", 0),
    ("<p class=access-row>営業時間 8:30", "<p class=access-row>営業時間 8:00", 1),
    # Text in nested elements counts, and unclosed elements end with their parent.
    ("<div class='access-row'><p>営業<b>時間</b><li>18：00</div>18:00", "<div class='access-row'><p>営業<b>時間</b><li>17：00</div>18:00", 1),
    ('<a href="reserve.html" class="x">go</a>', '<a href="tel:012345678" class="x">📞 電話で予約する</a>', 1),
    ('<a CLASS="header-cta-btn y" HREF=reserve.html>go<i>x</i></a>', '<a CLASS="header-cta-btn y" HREF="tel:012345678"><b>call</b></a>', 1),
    # Of edits inside each other the outer one stays.
    ('<div class="booking-steps"><a href="reserve.html">x</a></div><i>',
     '<div class="tel-card"><a class="tel-num" href="tel:012345678">012-345-678</a><p class="tel-sub">受付時間 8:00〜17:00（不定休）</p></div><i>', 2),
    ('<a href="/reserve-lookup"/>x', '<a href="/reserve-lookup" style="display: none;"/>x', 1),
    ('<ul class=utility-links><li><a>プライバシー</a><li><a>よくある</ul>', '<ul class=utility-links><li><a href="pages/privacy.html">プライバシー</a><li><a href="pages/faq.html">よくある</ul>', 1),
    ('<p class="utility-ig">@old_ig, old_ig</p><p class="utility-ig">old_ig</p>', '<p class="utility-ig">@new_ig, @new_ig</p><p class="utility-ig">old_ig</p>', 1),
    ('<!-- <p class="badge-label">WEB予約</p> --><b class="badge-label">&#87;EB予約</b>', '<!-- <p class="badge-label">WEB予約</p> --><b class="badge-label">電話でご予約</b>', 1),
])
def test_repair_rules(found, wanted, hits):
    text, hit = apply_rules(found, RULES)
    assert text == wanted
    if hits != 2:
        assert hit == hits


def test_a_rule_with_cases_does_the_first_that_fits():
    rule = Rule("r", [("a", [("attr", "title", 'x"y')]), (None, [("text", "<none>")])], css="c")
    assert apply_rules('<p class="c">a</p><p class="c">b</p>', [rule]) == ('<p class="c" title="x&quot;y">a</p><p class="c">&lt;none&gt;</p>', 1)


def test_one_scan_gives_nodes_blocks_and_root():
    text = '<div id=r>\n<p title="予約">予約</p><div data-langblock="ja">日本<p data-langblock="en">x</p></div></div>予'
    s = PageScan(text, "r")
    assert [(text[a:b], kind) for a, b, kind, _raw in s.nodes] == [("予約", "attr:title"), ("予約", "text"), ("予", "text")]
    assert [(text[a:b], lang) for a, b, lang in sorted(s.blocks, reverse=True)] == [
        ('<p data-langblock="en">x</p>', "en"), ('<div data-langblock="ja">日本<p data-langblock="en">x</p></div>', "ja")]
    assert text[slice(*s.root)].startswith("\n<p title") and text[slice(*s.root)].endswith("</p></div>")


def test_cuts_inside_each_other_count_once(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("abcdefgh", [(1, 5), (2, 3), (6, 7)]), ("日本語", []), (None, [])], "t string, c array<struct<start:int,end:int>>")
    assert [r[0] for r in df.select(markup.without(F.col("t"), F.col("c"))).collect()] == ["afh", "日本語", None]


def test_scan_of_a_table_keeps_its_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>予約"), (4, "<b id=q>x")], "id int, html string")
    got = markup.scanned(df, "html", "q").orderBy("id").collect()
    assert [(r.id, len(r.nodes), r.root and tuple(r.root)) for r in got] == [(1, 0, None), (2, 0, None), (3, 1, None), (4, 0, (8, 9))]
    assert markup.scanned(df.limit(0), "html").count() == 0
