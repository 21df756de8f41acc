"""Hand cases for the exact rules of SURVEY §2.5, each on a tiny table."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slopebook.operators import lifecycle, lists, notify, occupancy, pricing
from slopebook.operators import requests as rq
from slopebook.sources import schemas

D = dt.date
AS_OF = D(2025, 1, 10)
RES_COLS = ("id int, shop_id int, reservation_code string, rental_date date, return_date date, "
            "eve_pickup boolean, status string, customer_name string, customer_phone string, "
            "customer_email string, party_size int, adults int, children int, notes string, "
            "created_at timestamp, updated_at timestamp, cancelled_at timestamp")


def res_row(i, start, end=None, eve=False, status="pending", shop=1, phone="09012345678", code=None, email=None):
    ts = dt.datetime(2025, 1, 1)
    return (i, shop, code or f"YR-{i:06d}", start, end, eve, status, "N", phone, email, 1, None, None, None,
            ts, ts, None)


@pytest.fixture
def base(spark):
    eq = spark.createDataFrame([
        (1, 1, "ski", "160cm", 3, True), (2, 1, "ski", "170cm", 1, True), (3, 1, "snowboard", "150cm", 2, False),
        (4, 1, "boots", "25cm", 5, True), (5, 2, "snowboard", "150cm", 1, True),
    ], "id int, shop_id int, category string, size_label string, total_quantity int, is_active boolean")
    res = spark.createDataFrame([
        res_row(10, D(2025, 1, 12)),                         # NULL return: one day
        res_row(11, D(2025, 1, 13), D(2025, 1, 14), eve=True),  # eve: occupies the 12th too
        res_row(12, D(2025, 1, 12), D(2025, 1, 15), status="cancelled"),
        res_row(13, D(2025, 1, 12), D(2025, 1, 12), shop=2),
    ], RES_COLS)
    mem = spark.createDataFrame([
        (10, 1, "ski"), (10, 2, "ski"), (11, 1, "ski"), (11, 2, "snowboard"), (12, 1, "ski"), (13, 1, "snowboard"),
        (13, 2, "snowboard"), (11, 3, "none"),
    ], "reservation_id int, member_no int, board_type string")
    return eq, res, mem


def test_occupancy_null_return_eve_and_cancelled(spark, base):
    eq, res, mem = base
    occ = {(r.shop_id, r.category, r.day): r.used for r in
           occupancy.daily_occupancy(res, mem, D(2025, 1, 1), D(2025, 1, 31)).collect()}
    assert occ == {(1, "ski", D(2025, 1, 12)): 3, (1, "ski", D(2025, 1, 13)): 1, (1, "ski", D(2025, 1, 14)): 1,
                   (1, "snowboard", D(2025, 1, 12)): 1, (1, "snowboard", D(2025, 1, 13)): 1,
                   (1, "snowboard", D(2025, 1, 14)): 1, (2, "snowboard", D(2025, 1, 12)): 2}


def test_availability_negative_missing_category_and_invalid(spark, base):
    eq, res, mem = base
    win = spark.createDataFrame([(1, 1, D(2025, 1, 12), D(2025, 1, 12), False),
                                 (2, 1, D(2025, 1, 14), D(2025, 1, 20), True),
                                 (3, 2, D(2025, 1, 12), D(2025, 1, 12), False),
                                 (4, 1, D(2025, 1, 12), D(2025, 1, 11), False),
                                 (5, 1, None, D(2025, 1, 11), False)],
                                "window_id int, shop_id int, start date, end date, eve boolean")
    got = {(r.window_id, r.category): (r.remaining, r.error)
           for r in occupancy.availability_by_category(eq, res, mem, win).collect()}
    # ski stock 4, snowboard row inactive in shop 1 -> snowboard missing there
    assert got[(1, "ski")] == (1, None)
    assert (1, "snowboard") not in got
    assert got[(2, "ski")] == (3, None)           # eve window starts on the 13th: peak 1
    assert got[(3, "snowboard")] == (-1, None)    # negative remaining is kept
    assert got[(4, None)] == (None, "INVALID_DATES") and got[(5, None)] == (None, "INVALID_DATES")


def test_availability_by_size_one_day_items_only(spark, base):
    eq, res, _ = base
    items = spark.createDataFrame([(10, 1, 2), (12, 1, 1), (11, 2, 1)],
                                  "reservation_id int, equipment_item_id int, quantity int")
    dates = spark.createDataFrame([(1, D(2025, 1, 12)), (1, D(2025, 1, 13))], "shop_id int, date date")
    got = {(r.date, r.equipment_item_id): r.remaining
           for r in occupancy.availability_by_size(eq, res, items, dates).collect()}
    # item 1: 3 - 2 on the 12th (cancelled reservation 12 not counted); item 2 booked on the 13th only
    assert got == {(D(2025, 1, 12), 1): 1, (D(2025, 1, 12), 2): 1, (D(2025, 1, 12), 4): 5,
                   (D(2025, 1, 13), 1): 3, (D(2025, 1, 13), 4): 5}


def member(bt, h="150", shoe="25.5", child="false", age=""):
    return {"height_cm": h, "shoe_cm": shoe, "board_type": bt, "is_child": child, "age": age, "gender": None,
            "stance": None, "nickname": None, "set_type": None, "addons": None}


def req(i, start, end, members, eve=False, adults=None, phone="09012345678", name="Sato"):
    n = len(members) if members is not None else 0
    return {"request_id": i, "shop_id": 1, "requested_at": dt.datetime(2025, 1, 1, 0, i), "start": start,
            "end": end, "name": name, "phone": phone, "email": None, "adults": n if adults is None else adults,
            "children": 0, "members": members, "notes": None, "eve_pickup": eve}


def test_validate_v2_order_and_limits(spark):
    closed = spark.createDataFrame([(1, D(2025, 1, 20)), (2, D(2025, 1, 11)), (2, D(2025, 2, 10))], "shop_id int, closed_date date")
    rows = [
        req(1, D(2025, 2, 1), D(2025, 3, 3), [member("ski")]),             # 30 days: ok
        req(2, D(2025, 2, 1), D(2025, 3, 4), [member("ski")]),             # 31 days: too long
        req(3, D(2025, 1, 9), D(2025, 1, 9), [member("ski")]),             # past
        req(4, D(2025, 1, 10), D(2025, 1, 10), [member("ski")], eve=True),  # eve in past
        req(5, D(2025, 1, 21), D(2025, 1, 21), [member("ski")], eve=True),  # eve closed
        req(6, D(2025, 1, 19), D(2025, 1, 21), [member("ski")]),           # closed inside
        req(7, D(2025, 1, 11), D(2025, 1, 11), [member(None)]),            # NULL type passes E5
        req(8, D(2025, 1, 11), D(2025, 1, 11), [member("sled")]),          # invalid type
        req(9, D(2025, 1, 11), D(2025, 1, 11), [member("ski")], phone=" 090123 "),
        req(10, D(2025, 1, 11), D(2025, 1, 11), [member("ski")], adults=3),
        req(11, D(2025, 1, 11), D(2025, 1, 11), []),
        req(12, D(2025, 1, 11), D(2025, 1, 11), [member("ski")], name="   "),
    ]
    df = spark.createDataFrame(rows, schemas.REQUESTS_V2)
    got = {r.request_id: r.code for r in rq.validate_requests_v2(df, closed, AS_OF).collect()}
    assert got == {1: None, 2: "PERIOD_TOO_LONG", 3: "DATE_IN_PAST", 4: "EVE_IN_PAST", 5: "EVE_CLOSED",
                   6: "SHOP_CLOSED_ON_DATE", 7: None, 8: "INVALID_BOARD_TYPE", 9: "INVALID_CONTACT",
                   10: "MEMBER_COUNT_MISMATCH", 11: "INVALID_MEMBERS", 12: "INVALID_CONTACT"}


def test_null_board_type_is_out_of_stock(spark, base):
    eq, res, mem = base
    df = spark.createDataFrame([req(7, D(2025, 1, 11), D(2025, 1, 11), [member(None), member("ski")])],
                               schemas.REQUESTS_V2)
    r = rq.capacity_check(df, eq, res, mem).collect()[0]
    assert r.code == "OUT_OF_STOCK:<NULL>:2025-01-11"


def test_member_rows_rounding_and_boolean_text(spark):
    df = spark.createDataFrame([req(1, D(2025, 1, 11), D(2025, 1, 11), [
        member("ski", shoe="26.55", child="yes", age="7"), member("snowboard", h=" 150 ", child="of"),
        member("none", child=None)])], schemas.REQUESTS_V2)
    rows = sorted(rq.member_rows(df).collect(), key=lambda r: r.member_no)
    assert [r.member_no for r in rows] == [1, 2, 3]
    assert rows[0].shoe_cm == Decimal("26.6") and rows[0].is_child is True and rows[0].age == 7
    assert rows[1].height_cm == 150 and rows[1].is_child is False
    assert rows[2].is_child is False and rows[2].addons == []
    ok = rq.member_rows_ok(df).collect()[0]
    assert ok.members_ok is True
    bad = spark.createDataFrame([req(2, D(2025, 1, 11), D(2025, 1, 11), [member("ski", shoe="13.94")])],
                                schemas.REQUESTS_V2)
    assert rq.member_rows_ok(bad).collect()[0].members_ok is False


def test_v1_duplicate_lines_faithful_vs_summed(spark):
    eq = spark.createDataFrame([(1, 1, "ski", "160cm", 3, True)],
                               "id int, shop_id int, category string, size_label string, total_quantity int, "
                               "is_active boolean")
    res = spark.createDataFrame([res_row(10, D(2025, 1, 12))], RES_COLS)
    items = spark.createDataFrame([(10, 1, 1)], "reservation_id int, equipment_item_id int, quantity int")
    closed = spark.createDataFrame([], "shop_id int, closed_date date")
    r = spark.createDataFrame([(1, 1, dt.datetime(2025, 1, 1), D(2025, 1, 12), "N", "0901", None, 2,
                                [{"equipment_item_id": "1", "quantity": "2"}, {"equipment_item_id": "1",
                                                                                "quantity": "2"}], None)],
                              schemas.REQUESTS_V1)
    faithful = rq.validate_requests_v1(r, closed, eq, res, items, AS_OF).collect()[0]
    summed = rq.validate_requests_v1(r, closed, eq, res, items, AS_OF, faithful=False).collect()[0]
    assert faithful.code is None                       # each line alone: 1 + 2 <= 3 (reference overbooks)
    assert summed.code == "OUT_OF_STOCK:1" and summed.item_pos == 1


def test_lookup_v2_untrimmed_v1_phone_never_found(spark):
    res = spark.createDataFrame([res_row(1, D(2025, 1, 12), phone="090 1234 5678 ", code="YR-ABC123")], RES_COLS)
    mem = spark.createDataFrame([], schemas.RESERVATION_MEMBERS)
    lk = spark.createDataFrame([(1, " yr-abc123", "090 1234 5678 "), (2, "YR-ABC123", "090 1234 5678")],
                               "lookup_id int, code string, phone string")
    got = {r.lookup_id: r.reservation_code for r in lifecycle.lookup_v2(lk, res, mem).collect()}
    assert got == {1: None, 2: None}


def test_cancel_batch_later_duplicates_see_earlier(spark):
    res = spark.createDataFrame([res_row(1, D(2025, 1, 12), code="YR-000001"),
                                 res_row(2, D(2025, 1, 12), code="YR-000002", status="cancelled")], RES_COLS)
    reqs = spark.createDataFrame([(1, dt.datetime(2025, 1, 2), "yr-000001", "09012345678"),
                                  (2, dt.datetime(2025, 1, 1), "YR-000001 ", " 09012345678"),
                                  (3, dt.datetime(2025, 1, 1), "YR-000002", "09012345678"),
                                  (4, dt.datetime(2025, 1, 1), "YR-000003", "09012345678")],
                                 "request_id long, requested_at timestamp, code string, phone string")
    out, upd = lifecycle.cancel(reqs, res)
    assert {r.request_id: r.result for r in out.collect()} == {1: "ALREADY_CANCELLED", 2: "OK",
                                                             3: "ALREADY_CANCELLED", 4: "NOT_FOUND"}
    u = {r.id: (r.status, r.cancelled_at) for r in upd.collect()}
    assert u[1] == ("cancelled", dt.datetime(2025, 1, 1))


def test_status_changes_confirm_after_cancel_ignored(spark):
    res = spark.createDataFrame([res_row(1, D(2025, 1, 12)), res_row(2, D(2025, 1, 12), status="confirmed")],
                                RES_COLS)
    ch = spark.createDataFrame([(1, 1, dt.datetime(2025, 1, 2), "cancel"), (2, 1, dt.datetime(2025, 1, 3), "confirm"),
                                (3, 2, dt.datetime(2025, 1, 2), "confirm")],
                               "event_id long, reservation_id int, ts timestamp, action string")
    got = {r.id: r.status for r in lifecycle.apply_status_changes(res, ch).collect()}
    assert got == {1: "cancelled", 2: "confirmed"}


def test_prices(spark):
    res = spark.createDataFrame([res_row(1, D(2025, 1, 12), D(2025, 1, 17)), res_row(2, D(2025, 1, 12))], RES_COLS)
    mem = spark.createDataFrame([
        (1, 1, "full", False, ["helmet", "helmet", "unknown"]),   # 6 days: 22000 + 2*5500 + 2000*6
        (1, 2, "gliding", True, []),                             # 6000 + 2*2000
        (2, 1, "none", False, []),                               # NULL
        (2, 2, "none", False, ["sled"]),                          # 500 * 1
        (2, 3, None, False, []),                                 # NULL
    ], "reservation_id int, member_no int, set_type string, is_child boolean, addons array<string>")
    got = {(r.reservation_id, r.member_no): r.price for r in pricing.price_members(res, mem).collect()}
    assert got == {(1, 1): 45000, (1, 2): 10000, (2, 1): None, (2, 2): 500, (2, 3): None}
    tot = {r.reservation_id: (r.total, r.all_priced) for r in pricing.price_reservations(res, mem).collect()}
    assert tot == {1: (55000, True), 2: (None, False)}


def test_member_line_null_parts_print_empty(spark):
    mem = spark.createDataFrame([(1, 1, None, 25.0, "ski", None, None, "gliding", [], "kid")],
                                "reservation_id int, member_no int, height_cm int, shoe_cm double, board_type string,"
                                " is_child boolean, age int, set_type string, addons array<string>, nickname string")
    mem = mem.withColumn("shoe_cm", F.col("shoe_cm").cast("decimal(4,1)"))
    html = notify.member_lines(mem).collect()[0].html
    assert html == "1. 大人（kid） ／ 身長cm・靴25.0cm ／ スキー・滑走セット"


def test_reject_message_order(spark):
    df = spark.createDataFrame([("EQUIPMENT_NOT_FOUND",), ("NOT_FOUND",), ("OUT_OF_STOCK:ski:2025-01-01",), (None,)],
                               "code string")
    got = [r.m for r in df.select(lists.reject_message(F.col("code")).alias("m")).collect()]
    assert got[0] == "選択した用具は現在ご利用いただけません。"
    assert got[1].startswith("予約が見つかりませんでした")
    assert got[2].startswith("ご希望の期間・用具は満数")
    assert got[3] == lists.REJECT_DEFAULT


def test_very_long_window_is_clipped_not_exploded(spark, base):
    eq, res, mem = base
    win = spark.createDataFrame([(9, 1, D(1900, 1, 1), D(2100, 1, 1), False)],
                                "window_id int, shop_id int, start date, end date, eve boolean")
    got = {r.category: r.remaining for r in occupancy.availability_by_category(eq, res, mem, win).collect()}
    assert got == {"ski": 1}


def test_sku_rows(spark):
    from slopebook.operators import catalog
    goods = spark.createDataFrame([("cap", 2, "Cap", 2800, ["knit", "baseball"]),
                                   ("badge", 1, "Badge", 400, ["A", "B", "C", "D"])],
                                  "category string, position int, name string, price int, variants array<string>")
    rows = [(r.category, r.variant_no, r.name) for r in catalog.sku_rows(goods).collect()]
    assert rows[:2] == [("badge", 1, "Badge A"), ("badge", 2, "Badge B")] and rows[-1] == ("cap", 2, "Cap baseball")
    assert len(rows) == 6


def test_asset_name_and_yen(spark):
    from slopebook.functions import pgcompat as pg
    df = spark.createDataFrame([("雪 photo (1).JPG", 1234567), ("a😀b.png", 0)], "n string, v long")
    got = [(r.a, r.y) for r in df.select(pg.safe_asset_name(F.col("n")).alias("a"),
                                         pg.yen(F.col("v")).alias("y")).collect()]
    assert got == [("__photo__1_.JPG", "¥1,234,567"), ("a__b.png", "¥0")]


def test_hot_shop_gives_same_occupancy_as_spread_keys(spark):
    """A third of all reservations in one shop: same per-cell counts as a direct count."""
    rows, mem = [], []
    for i in range(300):
        shop = 0 if i % 3 == 0 else i % 7 + 1
        rows.append(res_row(i, D(2025, 1, 10 + i % 5), D(2025, 1, 12 + i % 5), shop=shop))
        mem.append((i, 1, "ski"))
    res = spark.createDataFrame(rows, RES_COLS)
    m = spark.createDataFrame(mem, "reservation_id int, member_no int, board_type string")
    got = {(r.shop_id, r.day): r.used for r in
           occupancy.daily_occupancy(res, m, D(2025, 1, 1), D(2025, 1, 31)).collect()}
    want = {}
    for r in rows:
        d = r[3]
        while d <= r[4]:
            want[(r[1], d)] = want.get((r[1], d), 0) + 1
            d += dt.timedelta(days=1)
    assert got == want


def test_root_extraction_handles_nesting(spark):
    from slopebook.operators import pages
    html = ('<html><body><div id="page-root"><div class="a"><p>x</p><br><img src="y"></div>'
            '<div>z</div></div><div>after</div></body></html>')
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "id long, html string")
    got = {r.id: r.root_html for r in pages.extract_root_html(df).collect()}
    assert got == {1: '<div class="a"><p>x</p><br><img src="y"></div><div>z</div>', 2: None}
