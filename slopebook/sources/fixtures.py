"""Booking tables derived deterministically from the driver's parquet.

The reference has one shop and no test data; FIXTURES.md §3 defines how the
driver's TPC-H-like tables become equipment, reservations, members, items and
closed days for many shops (``shop_id`` is the scale-out key).  Each derived
table exists twice: as a Spark DataFrame (``fx_*``) and as SQL text for the
DuckDB oracle (``FX_SQL``), built from the same definitions.

Rental dates are folded into a 120-day season starting 2024-12-01 so that
(shop, category, day) cells are contended.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slopebook.sources import schemas

# Fixed parameters of the derivation (FIXTURES.md §3).
SEASON_START = dt.date(2024, 12, 1)
SEASON_DAYS = 120
DAY_ZERO = dt.date(1995, 1, 1)
N_SHOPS = 25
# "today" for validation and lists: a few days into the season, so that some
# requests are in the past and eve pickups on the first day are rejected.
AS_OF = dt.date(2024, 12, 10)
SEASON_END = SEASON_START + dt.timedelta(days=SEASON_DAYS + 6)


#: The key by which a source table's rows are dealt to tasks; its size per task in bytes.
_DEALT_BY = {"part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "pages": "page_id"}
BYTES_PER_TASK = 16 << 20


def _tasks(spark: SparkSession, d: str, name: str) -> int:
    """Tasks that derive a table: two a core, and more as its source or ``lineitem``, the largest of its kind, grows.

    So ``orders`` and ``lineitem`` have the same number, and their rows of equal keys meet without another shuffle.
    """
    from slopebook.plans.session import file_system
    size = 0
    for source in {name, "lineitem"}:
        fs, p = file_system(spark, f"{d}/{source}.parquet")
        size = max(size, fs.getContentSummary(p).getLength() if fs.exists(p) else 0)
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // BYTES_PER_TASK))


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A source table, dealt by its key: a source may be one file with few row groups, but what is
    derived from it is made, and stored, by all cores.

    Only the source columns that a derivation needs are shuffled, not the (wider) rows that it makes,
    and dealing by a key needs no sort, as an even deal of whole rows does.
    """
    return spark.read.parquet(f"{d}/{name}.parquet").repartition(_tasks(spark, d, name), _DEALT_BY[name])


def _days(c):
    return F.datediff(c, F.lit(DAY_ZERO))


def _season(offset):
    return F.date_add(F.lit(SEASON_START), offset.cast("int"))


def fx_equipment(spark: SparkSession, d: str) -> DataFrame:
    p = _read(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        k.cast("int").alias("id"),
        (k % N_SHOPS).cast("int").alias("shop_id"),
        F.when(F.col("p_size") % 3 == 0, "ski").when(F.col("p_size") % 3 == 1, "snowboard")
        .otherwise("boots").alias("category"),
        F.concat(k.cast("string"), F.lit("cm")).alias("size_label"),
        (k % 3).cast("int").alias("total_quantity"),
        (k % 11 != 0).alias("is_active"),
    )


def fx_reservations(spark: SparkSession, d: str) -> DataFrame:
    return _reservations(spark, d).drop("o_orderkey")


def _reservations(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fold = _days(F.col("o_orderdate")) % SEASON_DAYS
    return o.select(
        k, k.cast("int").alias("id"),
        (c % N_SHOPS).cast("int").alias("shop_id"),
        F.concat(F.lit("YR-"), F.lpad(k.cast("string"), 6, "0")).alias("reservation_code"),
        _season(fold).alias("rental_date"),
        F.when(k % 7 == 0, F.lit(None).cast("date")).otherwise(_season(fold + k % 6)).alias("return_date"),
        (k % 5 == 0).alias("eve_pickup"),
        F.concat(F.lit("Customer "), c.cast("string")).alias("customer_name"),
        F.concat(F.lit("090"), F.lpad(c.cast("string"), 8, "0")).alias("customer_phone"),
        F.when(c % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("c"), c.cast("string"), F.lit("@example.com"))).alias("customer_email"),
        (1 + k % 4).cast("int").alias("party_size"),
        F.lit(None).cast("int").alias("adults"),
        F.lit(None).cast("int").alias("children"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "confirmed")
        .otherwise("cancelled").alias("status"),
        F.when(k % 9 == 0, F.concat(F.lit("<b>"), F.col("o_orderpriority"), F.lit("</b> & 'x'")))
        .alias("notes"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.lit(None).cast("timestamp").alias("cancelled_at"),
    )


_MEMBER_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def fx_members(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).drop("l_orderkey")


def _members(spark: SparkSession, d: str) -> DataFrame:
    li = _read(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*_MEMBER_ORDER)
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        "l_orderkey", F.col("l_orderkey").cast("int").alias("reservation_id"),
        F.row_number().over(w).cast("int").alias("member_no"),
        (80 + pk % 141).cast("int").alias("height_cm"),
        (14 + (sk % 39) * 0.5).cast("decimal(4,1)").alias("shoe_cm"),
        F.when(F.col("l_linenumber") % 3 == 0, "ski").when(F.col("l_linenumber") % 3 == 1, "snowboard")
        .otherwise("none").alias("board_type"),
        (F.col("l_returnflag") == "R").alias("is_child"),
        F.col("l_quantity").cast("int").alias("age"),
        F.when(sk % 3 == 0, "male").when(sk % 3 == 1, "female").alias("gender"),
        F.when(pk % 3 == 0, "regular").when(pk % 3 == 1, "goofy").otherwise("unknown").alias("stance"),
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("K<"), sk.cast("string"), F.lit(">")))
        .alias("nickname"),
        F.when(pk % 4 == 0, "gliding").when(pk % 4 == 1, "full").when(pk % 4 == 2, "none")
        .alias("set_type"),
        F.array_compact(F.array(
            F.when(sk % 2 == 1, F.lit("helmet")),
            F.when(sk % 3 == 1, F.lit("goggle")),
            F.when(sk % 5 == 1, F.lit("sled")),
        )).alias("addons"),
    )


def fx_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).drop("l_orderkey")


def _items(spark: SparkSession, d: str) -> DataFrame:
    li = _read(spark, d, "lineitem")
    return li.select(
        "l_orderkey", F.col("l_orderkey").cast("int").alias("reservation_id"),
        F.col("l_partkey").cast("int").alias("equipment_item_id"),
        (1 + F.col("l_linenumber") % 2).cast("int").alias("quantity"),
    )


def fx_closed_dates(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders")
    fold = _days(F.col("o_orderdate")) % SEASON_DAYS
    shop = (F.col("o_custkey") % N_SHOPS).cast("int")
    return o.where((fold + shop) % 17 == 3).select(shop.alias("shop_id"), _season(fold).alias("closed_date")).distinct()


def fx_requests_v2(spark: SparkSession, d: str) -> DataFrame:
    """Booking requests: every derived reservation re-submitted with its members.

    ``end`` is the raw return date, so legacy one-day rows (NULL) fail with
    INVALID_DATES; the adult count is off by one for every 13th order to reach
    MEMBER_COUNT_MISMATCH.  Member values arrive as text, as in a JSON body.
    """
    r = _reservations(spark, d)
    # Grouped and joined by the source's keys, as their rows are dealt: no other shuffle.
    m = _members(spark, d)
    per = m.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(
            "member_no",
            F.col("height_cm").cast("string").alias("height_cm"),
            F.col("shoe_cm").cast("string").alias("shoe_cm"),
            "board_type",
            F.col("is_child").cast("string").alias("is_child"),
            F.col("age").cast("string").alias("age"),
            "gender", "stance", "nickname", "set_type", "addons",
        ))).alias("ms"),
        F.sum(F.when(F.col("is_child"), 0).otherwise(1)).cast("int").alias("n_adults"),
        F.sum(F.when(F.col("is_child"), 1).otherwise(0)).cast("int").alias("n_children"),
    )
    j = r.join(per, r.o_orderkey == per.l_orderkey, "left")
    return j.select(
        F.col("id").alias("request_id"), "shop_id", F.col("created_at").alias("requested_at"),
        F.col("rental_date").alias("start"), F.col("return_date").alias("end"),
        F.col("customer_name").alias("name"), F.col("customer_phone").alias("phone"),
        F.col("customer_email").alias("email"),
        (F.col("n_adults") + F.when(F.col("id") % 13 == 0, 1).otherwise(0)).cast("int").alias("adults"),
        F.col("n_children").alias("children"),
        F.transform("ms", lambda x: x.dropFields("member_no")).alias("members"),
        F.col("notes"), F.col("eve_pickup"),
    )


def fx_requests_v1(spark: SparkSession, d: str) -> DataFrame:
    """v1 requests: one rental day, items as (equipment id, quantity) text pairs."""
    r = _reservations(spark, d)
    it = _items(spark, d)
    per = it.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(
        F.struct("equipment_item_id", "quantity"))).alias("items"))
    per = per.withColumn("items", F.transform("items", lambda x: F.struct(
        x["equipment_item_id"].cast("string").alias("equipment_item_id"),
        x["quantity"].cast("string").alias("quantity"))))
    j = r.join(per, r.o_orderkey == per.l_orderkey, "left")
    return j.select(
        F.col("id").alias("request_id"), "shop_id", F.col("created_at").alias("requested_at"),
        "rental_date", "customer_name", "customer_phone", "customer_email", "party_size",
        "items", "notes",
    )


def fx_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Lookup keys typed by customers: lower case and padded; every 4th phone is wrong."""
    o = _read(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.cast("int").alias("lookup_id"),
        F.concat(F.lit(" "), F.lower(F.concat(F.lit("yr-"), F.lpad(k.cast("string"), 6, "0"))), F.lit(" "))
        .alias("code"),
        F.concat(F.lit(" 090"), F.lpad((c + F.when(k % 4 == 0, 1).otherwise(0)).cast("string"), 8, "0"),
                 F.lit("  ")).alias("phone"),
    )


def fx_status_events(spark: SparkSession, d: str) -> DataFrame:
    """Reservation change events from ``events`` (FIXTURES.md §3).

    signup -> created (insert), purchase -> confirm, error -> cancel; view and
    click carry no status.  Ordered per reservation by (ts, event_id).
    """
    e = _read(spark, d, "events")
    kind = (F.when(F.col("event_type") == "signup", "created")
            .when(F.col("event_type") == "purchase", "confirm")
            .when(F.col("event_type") == "error", "cancel"))
    return (e.where(F.col("event_type").isin("signup", "purchase", "error"))
            .select(F.col("event_id").cast("long").alias("event_id"),
                    F.col("user_id").cast("int").alias("reservation_id"),
                    F.col("ts"), kind.alias("action")))


def fx_cancel_requests(spark: SparkSession, d: str) -> DataFrame:
    """Customer cancellations: every ``error`` event asks to cancel reservation user_id,
    typing the code in lower case; every 10th types a wrong phone."""
    e = _read(spark, d, "events").where(F.col("event_type") == "error")
    o = _read(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = e.join(o, e.user_id == o.o_orderkey, "left")
    wrong = F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    return j.select(
        F.col("event_id").cast("long").alias("request_id"), F.col("ts").alias("requested_at"),
        F.concat(F.lit("yr-"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(" ")).alias("code"),
        F.concat(F.lit("090"), F.lpad((F.col("o_custkey") + wrong).cast("string"), 8, "0")).alias("phone"),
    )


def fx_equipment_feed(spark: SparkSession, d: str) -> DataFrame:
    """New equipment rows typed by staff: sizes repeat (``p_size``), some invalid."""
    p = _read(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        k.cast("long").alias("feed_no"),
        (F.when(k % 2 == 0, F.col("p_size")).otherwise(k) % N_SHOPS).cast("int").alias("shop_id"),
        F.when(F.col("p_size") % 3 == 0, "ski").when(F.col("p_size") % 3 == 1, "snowboard")
        .otherwise("boots").alias("category"),
        F.when(k % 29 == 0, F.lit("  ")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("cm")))
        .alias("size_label"),
        (k % 7 - 1).cast("int").alias("total_quantity"),
    )


def fx_equipment_changes(spark: SparkSession, d: str) -> DataFrame:
    """Staff stepper clicks and toggles per equipment item, in change_no order."""
    li = _read(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("long").alias("change_no"),
        F.col("l_partkey").cast("int").alias("equipment_item_id"),
        F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(1).cast("int").alias("delta"),
        ((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)).alias("toggle"),
    )


def fx_pages(spark: SparkSession, d: str) -> DataFrame:
    """Published page versions: page_key = page_id % 40, version order = page_id."""
    p = _read(spark, d, "pages")
    return p.select(
        F.col("page_id").cast("long").alias("id"),
        F.concat(F.lit("page-"), (F.col("page_id") % 40).cast("string")).alias("page_key"),
        F.col("html"),
        F.regexp_extract("html", r"(?s)<style[^>]*>(.*?)</style>", 1).alias("css"),
        F.lit("{}").alias("project_data"),
        F.timestamp_add("SECOND", F.col("page_id"), F.lit(dt.datetime(2025, 1, 1))).alias("created_at"),
        F.lit("staff").alias("created_by"),
    )


#: A published page per reservation, as parts: (text, or the name of a column that is filled in).
#: Every rule of the page operators has something to act on, and the expected result of each is
#: the same parts with some replaced.
SITE_PARTS = {
    "head": "<html><head><style>.b{width:",
    "width": "width",
    "body": "}</style></head><body>",
    "root": "root",
    "list": "<ul><li>",
    "guest": "guest",
    "item": "<li>",
    "code": "code",
    "note": "note",
    "end_list": "</ul>",
    "hours": '<div class="access-row">営業時間 8:30〜18:00</div>',
    "bus": '<div class="access-row">バス 18:00</div>',
    "en": '<div data-langblock="en">Hello</div>',
    "ja": '<div DATA-LANGBLOCK="ja">こんにちは</div>',
    "link": '<a href="reserve.html?x=1">',
    "handle": "@old_shop",
    "end_link": "</a>",
    "image": "<img alt=スキー>",
    "script": '<script>var s="予約番号";</script>',
    "open": "<p>x",
    "end_root": "</div>",
    "footer": '<footer><a href="#">よくある質問</a></footer></body></html>',
}


#: The root element's start tag as different editors write it.
SITE_ROOTS = ['<div ID = "page-root">', "<div class='x' id='page-root'>", "<div id=page-root data-a>", '<DIV\n id="page-root"\tclass="y z">']

#: Parts of a home page as (found, wanted) texts; ``{k}`` is the row's key.  A part with several pairs changes from row to row.
HOOK_PARTS = {
    "head": [("<html><body><!-- {k} -->", "<html><body><!-- {k} -->")],
    "footer": [('<ul class="utility-links"><li><a href="#">よくある質問</a><li><a class=x href=\'#\'>お問い合わせ {k}</a></ul>',
                '<ul class="utility-links"><li><a href="pages/faq.html">よくある質問</a><li><a class=x href=\'tel:00000000000\'>お問い合わせ {k}</a></ul>'),
               ('<div class="a utility-links b"><p><a>プライバシー &amp; {k}</a></p><a href=#>会社</a></div>',
                '<div class="a utility-links b"><p><a href="pages/privacy.html">プライバシー &amp; {k}</a></p><a href=#>会社</a></div>')],
    "outside": [('<a href="#">よくある質問</a>', '<a href="#">よくある質問</a>')],
    "card": [('<a class="content-card" href="#"><span class="content-card-title">初心者ガイド</span></a>',
              '<a class="content-card" href="pages/beginner-guide.html"><span class="content-card-title">初心者ガイド</span></a>'),
             ('<a href=guide.html class="content-card wide"><b><i class=content-card-title>&#x521D;心者 {k}</i></b>初</a>',
              '<a href="pages/beginner-guide.html" class="content-card wide"><b><i class=content-card-title>&#x521D;心者 {k}</i></b>初</a>')],
    "other_card": [('<a class="content-card" href="s.html"><span class="content-card-title">上級</span>初心者</a>',
                    '<a class="content-card" href="s.html"><span class="content-card-title">上級</span>初心者</a>')],
    "hours": [('<div class="access-row"><b>営業時間</b> 8:30〜18:00 8：30</div>', '<div class="access-row"><b>営業時間</b> 8:00〜17:00 8：00</div>'),
              ('<p class="access-row">営業<b>時間</b>8:30-18:30</p>', '<p class="access-row">営業<b>時間</b>8:00-17:00</p>')],
    "bus": [('<div class="access-row">バス 8:30 18:00</div>', '<div class="access-row">バス 8:30 18:00</div>')],
    "handle": [('<p class="utility-ig">@old_shop <b>old_shop</b></p><p class="utility-ig">@old_shop</p>',
                '<p class="utility-ig">@new_shop <b>@new_shop</b></p><p class="utility-ig">@old_shop</p>')],
    "lookup": [('<a href="reserve-lookup.html?k={k}">確認</a>', '<a href="reserve-lookup.html?k={k}" style="display: none;">確認</a>'),
               ('<a style="color:red" href=\'/reserve-lookup\'>確認</a>', '<a style="color:red; display: none;" href=\'/reserve-lookup\'>確認</a>')],
    "button": [('<a class="header-cta-btn" href="reserve.html"><i>WEB</i></a>', '<a class="header-cta-btn" href="tel:00000000000"><svg/>TEL</a>')],
    "booking": [('<a href="x/reserve.html?n={k}">予約<b>する</b></a>', '<a href="tel:00000000000">📞 電話で予約する</a>')],
    "title": [('<h3 class="booking-card-title">WEB<br>予約</h3>', '<h3 class="booking-card-title">ご予約・お問い合わせ</h3>'),
              ('<h3 class="booking-card-title">電話</h3>', '<h3 class="booking-card-title">電話</h3>')],
    "steps": [('<div class="booking-steps"><div><a href="reserve.html">1</a></div>{k}</div>',
               '<div class="tel-card"><a class="tel-num" href="tel:00000000000">000-0000-0000</a><p class="tel-sub">受付時間 8:00〜17:00（不定休）</p></div>')],
    "badge": [('<span class="badge-label">WEB予約 {k}</span>', '<span class="badge-label">電話でご予約</span>')],
    "script": [('<script>var a=\'<p class="badge-label">WEB予約</p>\';</script></body></html>',
                '<script>var a=\'<p class="badge-label">WEB予約</p>\';</script></body></html>')],
}


def fx_hook_pages(spark: SparkSession, d: str) -> DataFrame:
    """One home page per order from ``HOOK_PARTS``; part number i takes its pair number (key / (i + 1)) in turn."""
    k = F.col("o_orderkey")
    parts = [F.element_at(F.array(*[F.lit(found) for found, _wanted in pairs]), (F.floor(k / (i + 1)) % len(pairs) + 1).cast("int"))
             for i, pairs in enumerate(HOOK_PARTS.values())]
    return _read(spark, d, "orders").select(
        k.cast("long").alias("id"), F.replace(F.concat(*parts), F.lit("{k}"), k.cast("string")).alias("html"))


def hook_sql() -> str:
    """SQL for the wanted text of ``fx_hook_pages``."""
    def q(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"
    parts = [f"list_extract([{', '.join(q(wanted) for _found, wanted in pairs)}], cast((o_orderkey // {i + 1}) % {len(pairs)} + 1 as int))"
             for i, pairs in enumerate(HOOK_PARTS.values())]
    return f"replace({' || '.join(parts)}, '{{k}}', cast(o_orderkey as varchar))"


def fx_site_pages(spark: SparkSession, d: str) -> DataFrame:
    """One page per order from ``SITE_PARTS``; every 17th is empty."""
    k = F.col("o_orderkey")
    filled = {"width": F.when(k % 3 == 0, "760px").otherwise("90%"),
              "root": F.element_at(F.array(*map(F.lit, SITE_ROOTS)), (k % len(SITE_ROOTS) + 1).cast("int")),
              "code": F.when(k % 2 == 0, "予約番号").otherwise("&#x4E88;約&#30058;号"),
              "note": F.concat(F.lit("<p\n data-n='"), k.cast("string"), F.lit("'>No. "), k.cast("string"), F.lit(" &amp; <b>more<i>!</b></p>")),
              "guest": F.concat(F.lit("利用者"), (k % 5 + 1).cast("string"), F.lit("（大人）"))}
    parts = [filled.get(v, F.lit(v)) for v in SITE_PARTS.values()]
    return _read(spark, d, "orders").select(
        k.cast("long").alias("id"), F.when(k % 17 == 0, "").otherwise(F.concat(*parts)).alias("html"))


def fx_site_texts(spark: SparkSession, d: str) -> DataFrame:
    """One text per order, of the kinds that the translator tells apart."""
    k = F.col("o_orderkey")
    n = (k % 5 + 1).cast("string")
    kinds = [F.concat(F.lit("利用者"), n, F.lit("（お子様）")), F.lit("  予約番号 "), F.lit("★予約番号 ›"),
             F.concat(F.lit("大人 "), n, F.lit("人目")), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("（日帰り）")),
             F.lit("フルセット・スキー"), F.concat(F.lit("plain "), n), F.concat(F.lit("不明な文"), n)]
    text = F.element_at(F.array(*kinds), (k % 8 + 1).cast("int"))
    return _read(spark, d, "orders").select(k.cast("long").alias("id"), text.alias("text"))


class Tables(Mapping):
    """The booking tables by name; each is derived when it is first asked for, so a query waits only for its own."""

    _CONFORMED = {"equipment": (schemas.EQUIPMENT_ITEMS, "equipment_items"), "reservations": (schemas.RESERVATIONS, "reservations"),
                  "members": (schemas.RESERVATION_MEMBERS, "reservation_members")}
    _NAMES = ("equipment", "reservations", "members", "items", "closed_dates")

    def __init__(self, spark: SparkSession, d: str):
        self._spark, self._d, self._made = spark, d, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._NAMES:
            raise KeyError(name)
        if name not in self._made:
            df = table(self._spark, self._d, f"fx_{name}")
            if name in self._CONFORMED:
                schema, defaults = self._CONFORMED[name]
                df = schemas.conform(df, schema, schemas.DEFAULTS[defaults])
            self._made[name] = df
        return self._made[name]

    def __iter__(self):
        return iter(self._NAMES)

    def __len__(self) -> int:
        return len(self._NAMES)


def load_all(spark: SparkSession, d: str) -> Tables:
    return Tables(spark, d)


# ---------------------------------------------------------------------------
# Materialisation: each derived table is written once per input dataset as
# parquet under the session's shared checkpoint folder and read back, so
# queries scan stored booking tables (as a deployment would) and lineage is
# cut.  The folder name carries a fingerprint of the source files.
# ---------------------------------------------------------------------------

_SOURCES = {
    "fx_equipment": ["part"], "fx_reservations": ["orders"], "fx_members": ["lineitem"],
    "fx_items": ["lineitem"], "fx_closed_dates": ["orders"], "fx_requests_v2": ["orders", "lineitem"],
    "fx_requests_v1": ["orders", "lineitem"], "fx_lookups": ["orders"], "fx_status_events": ["events"],
    "fx_cancel_requests": ["events", "orders"], "fx_equipment_feed": ["part"],
    "fx_equipment_changes": ["lineitem"], "fx_pages": ["pages"], "fx_site_pages": ["orders"],
    "fx_site_texts": ["orders"], "fx_hook_pages": ["orders"],
}
DERIVED = tuple(_SOURCES)

# Bump when a derivation changes, so stale copies are not reused.
_VERSION = "6"


def _fingerprint(spark: SparkSession, d: str, name: str) -> str:
    """Of a derivation and its source files (their place, sizes and times), wherever they are stored."""
    import hashlib

    from slopebook.plans.session import file_system
    h = hashlib.sha256(f"{_VERSION}|{name}".encode())
    for src in _SOURCES[name]:
        fs, p = file_system(spark, f"{d}/{src}.parquet")
        st = fs.getFileStatus(p)
        h.update(f"|{st.getPath()}:{fs.getContentSummary(p).getLength()}:{st.getModificationTime()}".encode())
    return h.hexdigest()[:16]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The derived table ``name`` for dataset ``d``, see :func:`stored`."""
    return spark.read.parquet(stored(spark, d, name))


def stored(spark: SparkSession, d: str, name: str) -> str:
    """The folder of the derived table ``name`` for dataset ``d``, materialised once.

    Written to a unique folder and renamed into place, so two jobs deriving
    the same table at once cannot corrupt it (the first rename wins; if no
    rename went through, reading fails).
    """
    import uuid

    from slopebook.plans.session import ensure_checkpoint_dir, file_system
    path = f"{ensure_checkpoint_dir(spark)}/fixtures/{name}-{_fingerprint(spark, d, name)}"
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        tmp = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
        globals()[name](spark, d).write.parquet(tmp)
        fs.rename(file_system(spark, tmp)[1], p)
    return path


# ---------------------------------------------------------------------------
# The same derivations as DuckDB SQL (oracle side).  DAYS(x) = days since
# 1995-01-01.  Each entry is a CTE body; ``with_fixtures`` prefixes the ones a
# query names.
# ---------------------------------------------------------------------------

def _days_sql(x: str) -> str:
    return f"datediff('day', date '1995-01-01', cast({x} as date))"


_FOLD = f"({_days_sql('o_orderdate')} % 120)"

FX_SQL: dict[str, str] = {
    "fx_equipment": """
select cast(p_partkey as int) as id, cast(p_partkey % 25 as int) as shop_id,
  case p_size % 3 when 0 then 'ski' when 1 then 'snowboard' else 'boots' end as category,
  concat(cast(p_partkey as varchar), 'cm') as size_label,
  cast(p_partkey % 3 as int) as total_quantity, p_partkey % 11 <> 0 as is_active
from part""",
    "fx_reservations": f"""
select cast(o_orderkey as int) as id, cast(o_custkey % 25 as int) as shop_id,
  concat('YR-', lpad(cast(o_orderkey as varchar), 6, '0')) as reservation_code,
  cast(date '2024-12-01' + cast({_FOLD} as int) as date) as rental_date,
  case when o_orderkey % 7 = 0 then null
       else cast(date '2024-12-01' + cast({_FOLD} + o_orderkey % 6 as int) as date) end as return_date,
  o_orderkey % 5 = 0 as eve_pickup,
  concat('Customer ', cast(o_custkey as varchar)) as customer_name,
  concat('090', lpad(cast(o_custkey as varchar), 8, '0')) as customer_phone,
  case when o_custkey % 3 = 0 then null else concat('c', cast(o_custkey as varchar), '@example.com') end
    as customer_email,
  cast(1 + o_orderkey % 4 as int) as party_size,
  cast(null as int) as adults, cast(null as int) as children,
  case o_orderstatus when 'P' then 'pending' when 'O' then 'confirmed' else 'cancelled' end as status,
  case when o_orderkey % 9 = 0 then concat('<b>', o_orderpriority, '</b> & ''x''') end as notes,
  o_orderdate as created_at, o_orderdate as updated_at, cast(null as timestamp) as cancelled_at
from orders""",
    "fx_members": """
select cast(l_orderkey as int) as reservation_id,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as int) as member_no,
  cast(80 + l_partkey % 141 as int) as height_cm,
  cast(14 + (l_suppkey % 39) * 0.5 as decimal(4,1)) as shoe_cm,
  case l_linenumber % 3 when 0 then 'ski' when 1 then 'snowboard' else 'none' end as board_type,
  l_returnflag = 'R' as is_child, cast(l_quantity as int) as age,
  case l_suppkey % 3 when 0 then 'male' when 1 then 'female' end as gender,
  case l_partkey % 3 when 0 then 'regular' when 1 then 'goofy' else 'unknown' end as stance,
  case when l_linenumber = 1 then concat('K<', cast(l_suppkey as varchar), '>') end as nickname,
  case l_partkey % 4 when 0 then 'gliding' when 1 then 'full' when 2 then 'none' else null end as set_type,
  list_filter([case when l_suppkey % 2 = 1 then 'helmet' end, case when l_suppkey % 3 = 1 then 'goggle' end,
               case when l_suppkey % 5 = 1 then 'sled' end], lambda x: x is not null) as addons
from lineitem""",
    "fx_items": """
select cast(l_orderkey as int) as reservation_id, cast(l_partkey as int) as equipment_item_id,
  cast(1 + l_linenumber % 2 as int) as quantity
from lineitem""",
    "fx_closed_dates": f"""
select distinct cast(o_custkey % 25 as int) as shop_id, cast(date '2024-12-01' + cast({_FOLD} as int) as date) as closed_date
from orders where ({_FOLD} + o_custkey % 25) % 17 = 3""",
    "fx_lookups": """
select cast(o_orderkey as int) as lookup_id,
  concat(' ', lower(concat('yr-', lpad(cast(o_orderkey as varchar), 6, '0'))), ' ') as code,
  concat(' 090', lpad(cast(o_custkey + case when o_orderkey % 4 = 0 then 1 else 0 end as varchar), 8, '0'), '  ')
    as phone
from orders""",
    "fx_status_events": """
select cast(event_id as bigint) as event_id, cast(user_id as int) as reservation_id, ts,
  case event_type when 'signup' then 'created' when 'purchase' then 'confirm' else 'cancel' end as action
from events where event_type in ('signup', 'purchase', 'error')""",
    "fx_cancel_requests": """
select cast(e.event_id as bigint) as request_id, e.ts as requested_at,
  concat('yr-', lpad(cast(e.user_id as varchar), 6, '0'), ' ') as code,
  concat('090', lpad(cast(o.o_custkey + case when e.event_id % 10 = 0 then 1 else 0 end as varchar), 8, '0'))
    as phone
from events e left join orders o on o.o_orderkey = e.user_id
where e.event_type = 'error'""",
    "fx_equipment_feed": """
select cast(p_partkey as bigint) as feed_no, cast(case when p_partkey % 2 = 0 then p_size else p_partkey end % 25 as int) as shop_id,
  case p_size % 3 when 0 then 'ski' when 1 then 'snowboard' else 'boots' end as category,
  case when p_partkey % 29 = 0 then '  ' else concat(cast(p_size as varchar), 'cm') end as size_label,
  cast(p_partkey % 7 - 1 as int) as total_quantity
from part""",
    "fx_equipment_changes": """
select cast(l_orderkey * 100 + l_linenumber as bigint) as change_no, cast(l_partkey as int) as equipment_item_id,
  cast(case when l_linenumber % 3 = 0 then -1 else 1 end as int) as delta,
  (l_returnflag = 'A' and l_linenumber = 1) as toggle
from lineitem""",
    "fx_pages": """
select cast(page_id as bigint) as id, concat('page-', cast(page_id % 40 as varchar)) as page_key, html,
  coalesce(regexp_extract(html, '(?s)<style[^>]*>(.*?)</style>', 1), '') as css, '{}' as project_data,
  timestamp '2025-01-01 00:00:00' + to_seconds(page_id) as created_at, 'staff' as created_by
from pages""",
}


def site_sql(replaced: dict[str, str] | None = None, parts: list[str] | None = None) -> str:
    """SQL for a site page's text, with some parts replaced by SQL expressions, or for some of its parts only."""
    def sql(part: str, value: str) -> str:
        if part in (replaced or {}):
            return replaced[part]
        if part == "width":
            return "case when o_orderkey % 3 = 0 then '760px' else '90%' end"
        if part == "guest":
            return "'利用者' || (o_orderkey % 5 + 1) || '（大人）'"
        if part == "root":
            return f"list_extract([{', '.join(quoted(r) for r in SITE_ROOTS)}], cast(o_orderkey % {len(SITE_ROOTS)} + 1 as int))"
        if part == "code":
            return "case when o_orderkey % 2 = 0 then '予約番号' else '&#x4E88;約&#30058;号' end"
        if part == "note":
            return "'<p\n data-n=" + 2 * chr(39) + "' || o_orderkey || '" + 2 * chr(39) + ">No. ' || o_orderkey || ' &amp; <b>more<i>!</b></p>'"
        return quoted(value)

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"
    return " || ".join(sql(k, v) for k, v in SITE_PARTS.items() if parts is None or k in parts)


def with_fixtures(body: str, *names: str) -> str:
    ctes = ",\n".join(f"{n} as ({FX_SQL[n]})" for n in names)
    return f"with {ctes}\n{body}"
