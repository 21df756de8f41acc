"""E21-E23 on hand-written Japanese (the driver's tables contain none)."""

from __future__ import annotations

import pytest

from slopebook.operators import translate as tr

DICT = [("ホーム", "Home", "首頁"), ("予約する", "Book Now", "立即預約"), ("アクセス", "Access", "交通方式"),
        ("空欄", "", "空白")]

CASES = [
    ("ホーム", "Home", "首頁"),
    ("  ホーム  ", "Home", "首頁"),
    ("📍 アクセス ›", "📍 Access ›", "📍 交通方式 ›"),
    ("お子様 2人目", "Child #2", "兒童 第2位"),
    ("165cm / スキー / 滑走セット ・ ", "165cm / Ski / Riding Set ・", "165cm / 雙板滑雪 / 滑行組 ・"),
    ("追加: ヘルメット・ゴーグル / 男性 / 30歳", "Add-ons: Helmet・Goggles / Male / 30 yrs",
     "追加： 安全帽・護目鏡 / 男性 / 30歲"),
    ("hello", None, None),
    ("これは文章です。スキー", None, None),
    ("2025-01-05 〜 2025-01-07（3日間）", "2025-01-05 – 2025-01-07 (3 days)", "2025-01-05 〜 2025-01-07（3天）"),
    ("未知の言葉", None, None),
    ("・", None, None),
    ("予約する ›", "Book Now ›", "立即預約 ›"),
    ("Customer 様", "Customer", "Customer"),
    ("ホーム　", "Home", "首頁"),          # U+3000 is whitespace in JavaScript
    ("空欄", None, "空白"),                     # empty dictionary value falls through
    ("スキー" * 25, None, None),                # core longer than 60 units: no term replacement
]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(DICT, "ja string, en string, zh string")


@pytest.mark.parametrize("lang", ["en", "zh"])
def test_translate_cases(spark, dictionary, lang):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = {r.i: (r.translated, r.display) for r in tr.translate(df, "t", lang, dictionary).collect()}
    for i, (src, en, zh) in enumerate(CASES):
        want = en if lang == "en" else zh
        assert got[i][0] == want, (src, got[i][0], want)
        if want is None:
            assert got[i][1] == src
        else:
            assert got[i][1].strip() == want.strip()


def test_display_keeps_padding(spark, dictionary):
    df = spark.createDataFrame([(1, "  ホーム \n")], "i int, t string")
    r = tr.translate(df, "t", "en", dictionary).collect()[0]
    assert r.display == "  Home \n"


def test_japanese_source_language_is_untranslated(spark, dictionary):
    df = spark.createDataFrame([(1, "ホーム")], "i int, t string")
    r = tr.translate(df, "t", "ja", dictionary).collect()[0]
    assert r.translated is None and r.display == "ホーム"


PAGE = ('<div title="ホーム"><p> ホーム </p><script>var x="ホーム";</script>'
        '<span data-no-i18n>ホーム</span><code>ホーム</code><img alt="アクセス">'
        '<div data-langblock="en"><p>EN</p></div><div data-langblock="ja"><p>日本<b>語</b></p></div></div>')


def test_translate_pages_skips_script_and_marked_blocks(spark, dictionary):
    pg = spark.createDataFrame([(1, PAGE)], "id long, html string")
    out, nodes = tr.translate_pages(pg, "en", dictionary)
    html = out.collect()[0].html
    assert html.startswith('<div title="Home"><p> Home </p><script>var x="ホーム";</script>')
    assert "<span data-no-i18n>ホーム</span>" in html and "<code>ホーム</code>" in html
    assert '<img alt="Access">' in html
    kinds = sorted(r.kind for r in nodes.collect())
    assert kinds == ["attr:alt", "attr:title", "text"]


def test_language_blocks(spark):
    pg = spark.createDataFrame([(1, PAGE)], "id long, html string")
    en = tr.select_language_blocks(pg, "en").collect()[0].html
    assert '<div data-langblock="en"><p>EN</p></div>' in en and "日本" not in en
    ja = tr.select_language_blocks(pg, "ja").collect()[0].html
    assert "EN" not in ja and '<div data-langblock="ja"><p>日本<b>語</b></p></div>' in ja
