"""Cases that once gave wrong answers: each with the input that showed it."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slopebook.operators import maintenance as mt
from slopebook.operators import occupancy, pages, translate
from slopebook.sources import schemas
from slopebook.streaming import admission as stream
from tests.test_rules import RES_COLS, res_row

D = dt.date


def test_return_before_rental_occupies_nothing(spark):
    res = spark.createDataFrame([res_row(1, D(2025, 1, 10), D(2025, 1, 5)), res_row(2, D(2025, 1, 10), D(2025, 1, 11))], RES_COLS)
    mem = spark.createDataFrame([(1, 1, "ski"), (2, 1, "ski")], "reservation_id int, member_no int, board_type string")
    got = {r.day: r.used for r in occupancy.daily_occupancy(res, mem).collect()}
    assert got == {D(2025, 1, 10): 1, D(2025, 1, 11): 1}


def test_stream_counts_use_on_every_day(spark):
    """A booking two years ahead is current use like any other."""
    day = D(2027, 1, 1)
    res = spark.createDataFrame([res_row(1, day)], RES_COLS)
    mem = spark.createDataFrame([(1, 1, "ski")], "reservation_id int, member_no int, board_type string")
    rows = stream.seeds(res, mem).collect()
    assert [(r.slot, r.n) for r in rows] == [(day.weekday(), 1)]


def test_load_reads_older_files_without_new_columns(spark, tmp_path):
    path = str(tmp_path / "equipment_items.parquet")
    spark.createDataFrame([(1, 1, "ski", "a", 2)], "id int, shop_id int, category string, size_label string, total_quantity int").write.parquet(path)
    (spark.createDataFrame([(2, 1, "ski", "b", 2, False)],
                           "id int, shop_id int, category string, size_label string, total_quantity int, is_active boolean")
     .write.mode("append").parquet(path))
    got = {r.id: r.is_active for r in schemas.load(spark, str(tmp_path), "equipment_items").collect()}
    assert got == {1: True, 2: False}


def test_conform_rejects_values_of_another_type(spark):
    df = spark.createDataFrame([("1", "x9", "maybe")], "id string, total_quantity string, is_active string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        schemas.conform(df, schemas.EQUIPMENT_ITEMS, schemas.DEFAULTS["equipment_items"]).collect()


@pytest.mark.parametrize("html,want", [
    ('<div ID="page-root">x</div>', "x"),
    ('<div id = "page-root">x</div>', "x"),
    ('<div id="page-root"><ul><li>a<li>b</ul><p>q</div><footer>f</footer>', "<ul><li>a<li>b</ul><p>q"),
    ('<div id="page-root">a</span>b<br/>c</div>d', "a</span>b<br/>c"),
    ("<p>none</p>", None),
])
def test_root_extraction(spark, html, want):
    df = spark.createDataFrame([(html,)], "html string")
    assert pages.extract_root_html(df).first().root_html == want


DICT = [("スキー", "Ski", "滑雪"), ("スキー", "Ski set", "滑雪套装")]


def test_duplicate_dictionary_keys_last_wins(spark):
    d = spark.createDataFrame(DICT, "ja string, en string, zh string").coalesce(1)
    got = translate.translate(spark.createDataFrame([("スキー",)], "t string"), "t", "en", d).collect()
    assert [r.translated for r in got] == ["Ski set"]


@pytest.mark.parametrize("html,want", [
    ("<img alt=スキー>", '<img alt="Ski set">'),
    ("<p>&#x30B9;&#x30AD;&#x30FC;</p>", "<p>Ski set</p>"),
    ('<img alt="スキー">', '<img alt="Ski set">'),
])
def test_pages_translated_whole(spark, html, want):
    d = spark.createDataFrame(DICT, "ja string, en string, zh string").coalesce(1)
    out, _nodes = translate.translate_pages(spark.createDataFrame([(1, html)], "id int, html string"), "en", d)
    assert out.first().html == want


def test_language_blocks_in_any_case(spark):
    df = spark.createDataFrame([('<div DATA-LANGBLOCK="en">E</div><div data-langblock="ja">J</div>',)], "html string")
    assert translate.select_language_blocks(df, "ja").first().html == '<div data-langblock="ja">J</div>'


def test_null_sizes_are_invalid(spark):
    eq = spark.createDataFrame([], "category string, size_label string")
    feed = spark.createDataFrame([(1, "ski", None, 3), (2, "ski", None, 3)], "feed_no int, category string, size_label string, total_quantity int")
    assert {r.status for r in mt.equipment_feed_report(eq, feed).collect()} == {"INVALID_SIZE"}


def test_upsert_keeps_columns_it_does_not_name(spark):
    target = spark.createDataFrame([("a", "old", "me", 1), ("b", "old", "you", 1)], "page_key string, html string, updated_by string, v int")
    changes = spark.createDataFrame([("a", "new", 2), ("c", "new", 3)], "page_key string, html string, v int")
    got = {r.page_key: (r.html, r.updated_by, r.v) for r in mt.upsert(target, changes, "page_key", "v").collect()}
    assert got == {"a": ("new", "me", 2), "b": ("old", "you", 1), "c": ("new", None, 3)}


def test_hours_are_rewritten_in_their_row_only(spark):
    html = ('<div class="access-row"><b>営業時間</b> 8:30〜18:00 (8：30)</div><div class="access-row">バス 18:00</div><p>営業時間 18:00</p>')
    out = pages.rewrite_html(spark.createDataFrame([(html,)], "html string"), pages.default_rewrite_rules("070-0000-0000", "old_ig", "@new")).first()
    assert out.html == ('<div class="access-row"><b>営業時間</b> 8:00〜17:00 (8：00)</div><div class="access-row">バス 18:00</div><p>営業時間 18:00</p>')
    assert out.n_rules_hit == 2


def test_one_shared_folder_per_session(spark):
    from slopebook.plans.session import ensure_checkpoint_dir
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_materialized_folders_can_be_dropped(spark):
    from slopebook.plans.session import drop_materialized, file_system, materialize
    df = materialize(spark.range(3), "drop-test")
    (path,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    assert df.count() == 3 and drop_materialized(spark) >= 1
    fs, p = file_system(spark, path)
    assert not fs.exists(p)


def test_lookups_and_cancellations_stay_in_their_shop(spark):
    from slopebook.operators import lifecycle
    res = spark.createDataFrame([res_row(1, D(2025, 1, 10), shop=1, code="YR-1"), res_row(2, D(2025, 1, 10), shop=2, code="YR-1")], RES_COLS)
    asked = spark.createDataFrame([(7, 2, dt.datetime(2025, 1, 2), "yr-1", "09012345678")],
                                  "request_id int, shop_id int, requested_at timestamp, code string, phone string")
    _results, after = lifecycle.cancel(asked, res)
    assert {r.id: r.status for r in after.collect()} == {1: "pending", 2: "cancelled"}
    members = spark.createDataFrame([], schemas.RESERVATION_MEMBERS)
    found = lifecycle.lookup_v2(asked.withColumnRenamed("request_id", "lookup_id"), res, members)
    assert found.count() == 1
    assert lifecycle.lookup_v2(asked.withColumnRenamed("request_id", "lookup_id").drop("shop_id"), res, members).count() == 2


def test_a_size_is_a_duplicate_in_its_shop_only(spark):
    cols = "feed_no int, shop_id int, category string, size_label string, total_quantity int"
    eq = spark.createDataFrame([(1, "ski", "160")], "shop_id int, category string, size_label string")
    feed = spark.createDataFrame([(1, 1, "ski", "160", 1), (2, 2, "ski", " 160 ", 1), (3, 2, "ski", "160", 1)], cols)
    got = {r.feed_no: r.status for r in mt.equipment_feed_report(eq, feed).collect()}
    assert got == {1: "DUPLICATE", 2: "ACCEPTED", 3: "DUPLICATE"}


def test_members_from_json_bodies(spark):
    from slopebook.operators import requests as rq
    bodies = ['[{"height_cm": 170, "shoe_cm": 26.5, "board_type": "ski", "is_child": true, "addons": ["helmet", "sled"]}]',
              '[{"height_cm": "150", "board_type": null, "addons": "helmet"}, {}]', '{"height_cm": 1}', "[]", "oops", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {r.id: r.m for r in df.select("id", rq.members_from_json(F.col("body")).alias("m")).collect()}
    assert [tuple(m[f] for f in ("height_cm", "shoe_cm", "board_type", "is_child", "addons")) for m in got[0]] == [("170", "26.5", "ski", "true", ["helmet", "sled"])]
    assert [(m["height_cm"], m["board_type"], m["addons"]) for m in got[1]] == [("150", None, []), (None, None, [])]
    assert got[2] is None and got[3] == [] and got[5] is None and not got[4]
