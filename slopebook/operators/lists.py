"""Staff and customer lists: B1-B5 (lists and row visibility), C9 (children
embedded in parents), E16 (list and card texts), E17 (reject messages).

Texts are built with column expressions (``concat``/``when``/maps), so the
whole card is one projection after a single join of the per-reservation
child aggregates.  Children per reservation are bounded (at most 20 members
by rule; items per reservation are few), so ``collect_list`` per
reservation is safe.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopebook.functions import pgcompat as pg
from slopebook.operators import pricing

# Staff-page labels.
STATUS_LABEL = {"pending": "受付中", "confirmed": "確定", "cancelled": "キャンセル"}
LOOKUP_STATUS_LABEL = {"pending": "予約受付中", "confirmed": "予約確定", "cancelled": "キャンセル済み"}
BOARD_LABEL = {"ski": "スキー", "snowboard": "スノーボード", "none": "板レンタルなし"}
LOOKUP_BOARD_LABEL = {"ski": "スキー", "snowboard": "スノーボード", "none": "板のレンタルなし"}
GENDER_LABEL = {"male": "男性", "female": "女性"}
STANCE_LABEL = {"regular": "レギュラー(左足前)", "goofy": "グーフィー(右足前)", "unknown": "スタンス未定"}
LOOKUP_STANCE_LABEL = {"regular": "レギュラー", "goofy": "グーフィー", "unknown": "スタンス未定"}
SET_LABEL = {"gliding": "滑走セット", "full": "フルセット(ウェア付)", "none": "セットなし(単品のみ)"}
CATEGORY_LABEL = {"ski": "スキー", "snowboard": "スノーボード", "boots": "ブーツ"}

# Reject code -> message, ordered "contains" rules, first hit wins.
REJECT_RULES = [
    (("OUT_OF_STOCK",), "ご希望の期間・用具は満数になりました。日程を変えるか、お電話でご相談ください。"),
    (("EVE_CLOSED",), "前日は休業日のため、前日受け取りはご利用いただけません。当日受け取りでご予約いただくか、お電話でご相談ください。"),
    (("EVE_IN_PAST",), "前日受け取りができない日程です（前日がすでに過去の日付になっています）。開始日を1日後にずらしてください。"),
    (("SHOP_CLOSED_ON_DATE",), "期間内に休業日が含まれています。別の日をお選びください。"),
    (("DATE_IN_PAST",), "過去の日付は予約できません。"),
    (("INVALID_DATES",), "利用日の指定が正しくありません。開始日と返却日をご確認ください。"),
    (("PERIOD_TOO_LONG",), "レンタル期間が長すぎます。30日以内でお選びください。"),
    (("INVALID_CONTACT",), "お名前と、当日つながる電話番号（10桁以上）をご入力ください。"),
    (("MEMBER_COUNT_MISMATCH",), "人数と、入力された利用者の数が一致していません。"),
    (("INVALID_MEMBERS", "INVALID_BOARD_TYPE"), "利用者の情報をご確認ください。"),
    (("INVALID_QUANTITY",), "数量の指定が正しくありません。"),
    (("INVALID_INPUT",), "入力内容を確認してください。"),
    (("EQUIPMENT_NOT_FOUND", "EQUIPMENT_INACTIVE"), "選択した用具は現在ご利用いただけません。"),
    (("ALREADY_CANCELLED",), "この予約はすでにキャンセル済みです。"),
    (("NOT_FOUND",), "予約が見つかりませんでした。予約番号と電話番号をご確認ください。"),
]
REJECT_DEFAULT = "通信エラーが発生しました。時間をおいて再度お試しください。"

# B2: rows each role may read.  Staff policies are permissive "using (true)"
# and OR-ed with the public ones, so staff see everything.
ANON_VISIBLE = {
    "equipment_items": "is_active = true",
    "closed_dates": "true",
    "business_settings": "true",
    "site_pages": "true",
}


def _label(c: Column, mapping: dict, fallback: Column | None = None) -> Column:
    out = fallback if fallback is not None else F.lit(None).cast("string")
    for k, v in reversed(list(mapping.items())):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def reject_message(code: Column) -> Column:
    """Message for an error text; EQUIPMENT_NOT_FOUND is tested before NOT_FOUND."""
    out = F.lit(REJECT_DEFAULT)
    msg = F.coalesce(code, F.lit(""))
    for tokens, text in reversed(REJECT_RULES):
        hit = F.lit(False)
        for t in tokens:
            hit = hit | msg.contains(t)
        out = F.when(hit, F.lit(text)).otherwise(out)
    return out


def visible(df: DataFrame, table: str, role: str) -> DataFrame:
    """B2: rows ``role`` ('anon' or 'staff') can read from ``table``."""
    if role == "staff":
        return df
    cond = ANON_VISIBLE.get(table)
    if cond is None:
        return df.limit(0)
    return df.where(F.expr(cond))


def inventory_list(equipment: DataFrame) -> DataFrame:
    """B1: each shop's equipment ordered by category, size_label (text order), with its ``position``."""
    own = Window.partitionBy("shop_id").orderBy("category", "size_label", "id")
    return equipment.withColumn("position", F.row_number().over(own))


def upcoming_closed(closed_dates: DataFrame, as_of: dt.date) -> DataFrame:
    """Closed days of every shop from ``as_of`` on, with their ``position`` in the shop's list."""
    return (closed_dates.where(F.col("closed_date") >= F.lit(as_of))
            .withColumn("position", F.row_number().over(Window.partitionBy("shop_id").orderBy("closed_date"))))


def staff_filter(reservations: DataFrame, day: dt.date | None, status: str = "active") -> DataFrame:
    """B4 filter: day inside [rental, return] (NULL return drops out, as in the
    reference), or an eve pickup on the next day's rental; status active/all/one."""
    r = reservations
    if day is not None:
        d = F.lit(day)
        r = r.where(((F.col("rental_date") <= d) & (F.col("return_date") >= d))
                    | (F.col("eve_pickup") & (F.col("rental_date") == F.date_add(d, 1))))
    if status == "active":
        r = r.where(F.col("status").isin("pending", "confirmed"))
    elif status != "all":
        r = r.where(F.col("status") == status)
    return r


def day_list(reservations: DataFrame, items: DataFrame, equipment: DataFrame, day: dt.date | None) -> DataFrame:
    """Dashboard list, one rental day or all, every status, ascending, with the
    items text of the card (C9) and the ``position`` in the shop's list."""
    r = reservations if day is None else reservations.where(F.col("rental_date") == F.lit(day))
    its = item_texts(r.select(F.col("id").alias("reservation_id")), items, equipment)
    own = Window.partitionBy("shop_id").orderBy("rental_date", "created_at", "id")
    return (r.join(its, r.id == its.reservation_id, "left").drop("reservation_id")
            .withColumn("items_text", F.coalesce(F.nullif("items_text", F.lit("")), F.lit("—")))
            .withColumn("position", F.row_number().over(own)))


def item_texts(wanted: DataFrame, items: DataFrame, equipment: DataFrame) -> DataFrame:
    """reservation_id, items_text of the wanted reservations' items (by equipment id, quantity)."""
    text = F.concat(F.coalesce(_label(F.col("category"), CATEGORY_LABEL, F.col("category")), F.lit("?")),
                    F.lit(" "), F.coalesce("size_label", F.lit("")), F.lit(" ×"), F.col("quantity").cast("string"))
    return (items.join(wanted, "reservation_id", "left_semi")
            .join(equipment.select(F.col("id").alias("equipment_item_id"), "category", "size_label"),
                  "equipment_item_id", "left")
            .groupBy("reservation_id")
            .agg(F.sort_array(F.collect_list(F.struct("equipment_item_id", "quantity", text.alias("t")))).alias("its"))
            .select("reservation_id", F.array_join(F.col("its.t"), "、").alias("items_text")))


def list_count(reservations: DataFrame, day: dt.date | None, status: str = "active") -> DataFrame:
    """How many reservations each shop's staff list shows."""
    return staff_filter(reservations, day, status).groupBy("shop_id").agg(F.count(F.lit(1)).alias("n_listed"))


def js_number(c: Column) -> Column:
    """A numeric(4,1) as JavaScript prints the JSON number: 25.0 -> '25', 25.5 -> '25.5'."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def period_text(rental: Column, ret: Column) -> Column:
    """``start（日帰り）`` or ``start 〜 end（N日間）``."""
    end = F.coalesce(ret, rental)
    days = F.datediff(end, rental) + 1
    s, e = F.date_format(rental, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd")
    return F.when(rental == end, F.concat(s, F.lit("（日帰り）"))) \
        .otherwise(F.concat(s, F.lit(" 〜 "), e, F.lit("（"), days.cast("string"), F.lit("日間）")))


def party_text(adults: Column, children: Column, party_size: Column) -> Column:
    kids = F.when(F.coalesce(children, F.lit(0)) != 0,
                  F.concat(F.lit(" / 子供"), children.cast("string"), F.lit("名"))).otherwise("")
    return F.when(adults.isNotNull(), F.concat(F.lit("大人"), adults.cast("string"), F.lit("名"), kids)) \
        .otherwise(F.concat(pg_text_or_empty(party_size), F.lit("名")))


def pg_text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def staff_member_line(m, days: Column) -> Column:
    """One member row of the staff card (text inside the row's div).

    ``m`` maps member field names to columns (plain member-row columns, so the
    expression is code-generated).
    """
    esc = pg.html_escape
    who = F.concat(F.when(m["is_child"], "子供").otherwise("大人"),
                   F.when(F.coalesce(m["nickname"], F.lit("")) != "",
                          F.concat(F.lit("・"), esc(m["nickname"]))).otherwise(""))
    addon_labels = {k: v[0] for k, v in pricing.ADDONS.items()}
    addons = F.coalesce(m["addons"], F.array().cast("array<string>"))
    extra = F.array_compact(F.array(
        F.when(F.coalesce(m["set_type"], F.lit("")) != "",
               esc(_label(m["set_type"], SET_LABEL, m["set_type"]))),
        F.when(F.size(addons) > 0, F.concat(F.lit("追加:"), F.array_join(
            F.transform(addons, lambda k: esc(_label(k, addon_labels, k))), "・"))),
        F.when(F.coalesce(m["gender"], F.lit("")) != "",
               esc(_label(m["gender"], GENDER_LABEL, m["gender"]))),
        F.when(m["age"].isNotNull(), F.concat(m["age"].cast("string"), F.lit("歳"))),
        F.when((m["board_type"] == "snowboard") & (F.coalesce(m["stance"], F.lit("")) != ""),
               esc(_label(m["stance"], STANCE_LABEL, m["stance"]))),
    ))
    extra_s = F.when(F.size(extra) > 0, F.concat(F.lit("｜"), F.array_join(extra, "｜"))).otherwise("")
    price = pricing.member_price(m["set_type"], m["is_child"], m["addons"], days)
    price_s = F.when(price.isNotNull(), F.concat(F.lit("｜<b>"), pg.yen(price), F.lit("</b>"))).otherwise("")
    return F.concat(F.lit("・<b>"), who, F.lit("</b>｜身長 "), pg_text_or_empty(m["height_cm"]),
                    F.lit("cm｜靴 "), F.coalesce(js_number(m["shoe_cm"]), F.lit("null")), F.lit("cm｜"),
                    esc(_label(m["board_type"], BOARD_LABEL, m["board_type"])), extra_s, price_s)


def staff_list(reservations: DataFrame, members: DataFrame, items: DataFrame, equipment: DataFrame,
               day: dt.date | None, status: str = "active") -> DataFrame:
    """B4 + C9 + E13 + E16: the staff reservation list with card texts.

    Children are aggregated per reservation only for the listed reservations
    (semi-join first), then embedded with one left join each.
    """
    r = staff_filter(reservations, day, status)
    rd = r.select(F.col("id").alias("reservation_id"),
                  pricing.rental_days(F.col("rental_date"), F.col("return_date")).alias("days"))
    # Each member's line and price are plain columns of the member row (code
    # generated); only finished strings are collected per reservation.
    mj = members.join(rd, "reservation_id")
    mc = {c: F.col(c) for c in members.columns}
    price = pricing.member_price(F.col("set_type"), F.col("is_child"), F.col("addons"), F.col("days"))
    ms = (mj.select("reservation_id", "member_no", staff_member_line(mc, F.col("days")).alias("line"),
                    price.alias("price"))
          .groupBy("reservation_id")
          .agg(F.sort_array(F.collect_list(F.struct("member_no", "line"))).alias("ls"),
               F.count(F.lit(1)).alias("n_members"),
               F.bool_and(F.col("price").isNotNull()).alias("all_set"),
               F.sum("price").alias("total")))
    it = item_texts(rd, items, equipment)
    j = (r.join(ms, r.id == ms.reservation_id, "left").drop("reservation_id")
         .join(it, r.id == it.reservation_id, "left").drop("reservation_id"))
    n_members = F.coalesce(F.col("n_members"), F.lit(0)).cast("int")
    detail = F.when(n_members > 0, F.concat(
        F.lit("ご利用者（"), n_members.cast("string"), F.lit("名）"),
        F.array_join(F.col("ls.line"), "\n"),
        F.lit("\n合計（目安・現金）："), F.when(F.col("all_set"), pg.yen(F.col("total"))).otherwise(F.lit("—")))
    ).otherwise(F.concat(F.lit("用具: "), F.coalesce(
        F.nullif("items_text", F.lit("")), F.lit("—"))))
    own = Window.partitionBy("shop_id").orderBy(F.col("rental_date").desc(), F.col("created_at").desc(), "id")
    return (j.withColumn("position", F.row_number().over(own))
            .select("id", "shop_id", "position", "reservation_code", "rental_date", "return_date", "status",
                    F.concat(pg.html_escape(F.col("customer_name")), F.lit(" 様")).alias("name_text"),
                    period_text(F.col("rental_date"), F.col("return_date")).alias("period_text"),
                    party_text(F.col("adults"), F.col("children"), F.col("party_size")).alias("party_text"),
                    _label(F.col("status"), STATUS_LABEL).alias("status_label"),
                    F.col("eve_pickup").alias("eve_badge"),
                    n_members.alias("n_members"), detail.alias("detail"),
                    F.when(F.coalesce("notes", F.lit("")) != "",
                           F.concat(F.lit("ご要望: "), pg.html_escape(F.col("notes")))).alias("notes_text"),
                    (F.col("status") == "pending").alias("can_confirm"),
                    (F.col("status") != "cancelled").alias("can_cancel")))


def lookup_member_row(m) -> Column:
    """E16 (lookup page): one member row without its position prefix:
    ``<height>cm / <shoe>cm［<board>］`` then `` / ``-joined extras (gender,
    age when non-zero, stance for snowboarders).  Member fields are not
    escaped on that page; shoe sizes print as JavaScript numbers."""
    extra = F.array_compact(F.array(
        F.when(F.coalesce(m["gender"], F.lit("")) != "", _label(m["gender"], GENDER_LABEL, m["gender"])),
        F.when(F.coalesce(m["age"], F.lit(0)) != 0, F.concat(m["age"].cast("string"), F.lit("歳"))),
        F.when((m["board_type"] == "snowboard") & (F.coalesce(m["stance"], F.lit("")) != ""),
               _label(m["stance"], LOOKUP_STANCE_LABEL, m["stance"])),
    ))
    return F.concat(pg_text_or_empty(m["height_cm"]), F.lit("cm / "),
                    F.coalesce(js_number(m["shoe_cm"]), F.lit("null")), F.lit("cm［"),
                    F.coalesce(_label(m["board_type"], LOOKUP_BOARD_LABEL, m["board_type"]), F.lit("undefined")),
                    F.lit("］"),
                    F.when(F.size(extra) > 0, F.concat(F.lit("｜"), F.array_join(extra, " / "))).otherwise(""))


def lookup_card(lookups: DataFrame, reservations: DataFrame, members: DataFrame) -> DataFrame:
    """E16 (lookup page): the card shown for a found (code, phone) lookup.

    Matching as in E10; member rows are numbered by their position in
    member_no order.  Only the customer name is escaped (4 characters).
    """
    from slopebook.operators import lifecycle
    m = lifecycle._matched(lookups, reservations, "inner")
    ids = m.select("reservation_id").distinct()
    mrow = {c: F.col(c) for c in members.columns}
    ms = (members.join(ids, "reservation_id", "left_semi")
          .select("reservation_id", "member_no", F.col("is_child"), lookup_member_row(mrow).alias("row"))
          .groupBy("reservation_id")
          .agg(F.sort_array(F.collect_list(F.struct("member_no", "is_child", "row"))).alias("ms")))
    rows = F.transform("ms", lambda x, i: F.concat(
        F.lit("利用者"), (i + 1).cast("string"), F.lit("（"),
        F.when(x["is_child"], "お子様").otherwise("大人"), F.lit("）｜"), x["row"]))
    adults = F.col("adults")
    kids = F.coalesce(F.col("children"), F.lit(0))
    party = F.when(adults.isNotNull(), F.concat(
        F.lit("大人 "), adults.cast("string"), F.lit("名"),
        F.when(kids != 0, F.concat(F.lit(" / 子供 "), kids.cast("string"), F.lit("名"))).otherwise(""))) \
        .otherwise("")
    return (m.join(ms, "reservation_id", "left")
            .select("lookup_id", F.col("k_code").alias("reservation_code"),
                    F.coalesce(_label(F.col("status"), LOOKUP_STATUS_LABEL), F.col("status")).alias("status_label"),
                    period_text(F.col("rental_date"), F.col("return_date")).alias("period_text"),
                    F.when(F.col("eve_pickup"), F.lit("前日受け取り: 希望する")).alias("eve_text"),
                    F.concat(pg.html_escape(F.col("customer_name"), quotes=False), F.lit(" 様")).alias("name_text"),
                    party.alias("party_text"),
                    F.coalesce(F.array_join(rows, "\n"), F.lit("")).alias("members_text"),
                    (F.col("status") != "cancelled").alias("can_cancel")))
