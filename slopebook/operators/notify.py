"""E14 member lines and E15 notification outbox.

The reference formats mails in row triggers and posts them over HTTP; we
produce the outbox rows (recipient, subject, html) as a DataFrame.  Sending
is outside Spark.  Shop identity (name, phone, hours, notification address)
is per shop, from a ``shops`` DataFrame joined on ``shop_id``.

PostgreSQL ``format('%s', NULL)`` prints '' while Spark's ``format_string``
prints 'null', so every part is built with ``concat`` over coalesced values.
Deliberate deviation (tested): the created mail lists the members, which the
reference's AFTER INSERT trigger fires too early to see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mail texts and labels.
BOARD_MAIL = {"ski": "スキー", "snowboard": "スノーボード"}
BOARD_MAIL_OTHER = "板レンタルなし"
SET_MAIL = {"gliding": "・滑走セット", "full": "・フルセット", "none": "・セットなし"}
CHILD, ADULT = "子供", "大人"
EVE_MAIL = "<br>前日受け取り: 希望する（前日午後2時〜）"
DAY_TRIP = "（日帰り）"
CUSTOMER_CREATED_SUBJECT = "ご予約を受け付けました"
CUSTOMER_CANCELLED_SUBJECT = "ご予約をキャンセルしました"
SHOP_CREATED_SUBJECT = "【新規予約】"


def _s(c: Column) -> Column:
    """``format('%s', x)``: NULL prints as ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def _case(c: Column, mapping: dict, other: str) -> Column:
    out = F.lit(other)
    for k, v in reversed(list(mapping.items())):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def member_line(m: dict[str, Column]) -> Column:
    nick = F.when(m["nickname"].isNotNull(), F.concat(F.lit("（"), m["nickname"], F.lit("）"))).otherwise("")
    addons = F.when(m["addons"].isNotNull() & (F.size(m["addons"]) > 0),
                    F.concat(F.lit("・追加("), F.array_join(m["addons"], "・"), F.lit(")"))).otherwise("")
    return F.concat(
        _s(m["member_no"]), F.lit(". "), F.when(m["is_child"], CHILD).otherwise(ADULT), nick,
        F.lit(" ／ 身長"), _s(m["height_cm"]), F.lit("cm・靴"), _s(m["shoe_cm"]), F.lit("cm ／ "),
        _case(m["board_type"], BOARD_MAIL, BOARD_MAIL_OTHER), _case(m["set_type"], SET_MAIL, ""), addons)


def member_lines(members: DataFrame) -> DataFrame:
    """reservation_id, html - member lines joined by ``<br>`` in member_no order.

    Members per reservation are at most 20 by rule, so the per-reservation
    list is bounded.
    """
    cols = {c: F.col(c) for c in members.columns}
    return (members.groupBy("reservation_id")
            .agg(F.sort_array(F.collect_list(F.struct("member_no", member_line(cols).alias("line"))))
                 .alias("ls"))
            .select("reservation_id", F.array_join(F.transform("ls", lambda x: x["line"]), "<br>").alias("html")))


def period_text(rental: Column, ret: Column) -> Column:
    return F.concat(F.date_format(rental, "yyyy/MM/dd"),
                    F.when(ret.isNotNull() & (ret != rental), F.concat(F.lit(" 〜 "), F.date_format(ret, "yyyy/MM/dd")))
                    .otherwise(F.lit(DAY_TRIP)))


def notification_outbox(changes: DataFrame, reservations: DataFrame, members: DataFrame, shops: DataFrame,
                        sending_configured: bool = True) -> DataFrame:
    """event_id, reservation_id, recipient, kind, subject, html.

    ``changes``: event_id, reservation_id, op (insert|update), old_status,
    new_status.  Insert -> customer mail if the reservation has an email,
    shop mail if the shop has a notification address.  Update to cancelled
    from any other (or unknown) status -> customer mail if email.  Nothing
    when sending is not configured.
    """
    if not sending_configured:
        return changes.limit(0).select(
            "event_id", "reservation_id", F.lit(None).cast("string").alias("recipient"),
            F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("subject"),
            F.lit(None).cast("string").alias("html"))
    created = changes.where(F.col("op") == "insert").select("event_id", "reservation_id",
                                                            F.lit("created").alias("what"))
    cancelled = changes.where((F.col("op") == "update") & (F.col("new_status") == "cancelled")
                              & ~F.col("old_status").eqNullSafe(F.lit("cancelled"))) \
        .select("event_id", "reservation_id", F.lit("cancelled").alias("what"))
    ev = created.unionByName(cancelled)
    r = reservations.select(F.col("id").alias("reservation_id"), "shop_id", "reservation_code", "rental_date",
                            "return_date", "eve_pickup", "customer_name", "customer_phone", "customer_email",
                            "party_size", "adults", "children", "notes")
    # Member lines only for reservations that get mail (semi-join first).
    mem = members.join(ev.select("reservation_id").distinct(), "reservation_id", "left_semi")
    j = (ev.join(r, "reservation_id")
         .join(shops, "shop_id", "left")
         .join(member_lines(mem).withColumnRenamed("html", "members_html"), "reservation_id", "left"))
    period = period_text(F.col("rental_date"), F.col("return_date"))
    eve = F.when(F.col("eve_pickup"), F.lit(EVE_MAIL)).otherwise(F.lit(""))
    mem = F.coalesce("members_html", F.lit(""))
    adults = _s(F.coalesce("adults", "party_size"))
    kids = F.when(F.coalesce("children", F.lit(0)) > 0,
                  F.concat(F.lit(" / 子供"), F.col("children").cast("string"), F.lit("名"))).otherwise("")
    code = _s(F.col("reservation_code"))
    name = _s(F.col("customer_name"))
    tag = F.concat(F.lit("【"), _s(F.col("shop_name")), F.lit("】"))
    customer_html = F.concat(
        F.lit("ご予約ありがとうございます。<br><br>予約番号: <b>"), code, F.lit("</b><br>ご利用期間: "), period, eve,
        F.lit("<br>お名前: "), name, F.lit(" 様<br>人数: 大人"), adults, F.lit("名"), kids,
        F.lit("<br><br>【ご利用者】<br>"), mem,
        F.lit("<br><br>お支払いは当日ご来店時に現金でお願いします。<br>営業時間 "), _s(F.col("shop_hours")),
        F.lit("／お電話 "), _s(F.col("shop_phone")))
    shop_html = F.concat(
        F.lit("新規予約が入りました。<br><br>予約番号: "), code, F.lit("<br>ご利用期間: "), period, eve,
        F.lit("<br>お名前: "), name, F.lit(" 様<br>電話: "), _s(F.col("customer_phone")),
        F.lit("<br>メール: "), F.coalesce("customer_email", F.lit("（未入力）")),
        F.lit("<br>人数: 大人"), adults, F.lit("名"), kids,
        F.lit("<br>ご要望: "), F.coalesce("notes", F.lit("（なし）")),
        F.lit("<br><br>【ご利用者】<br>"), mem)
    cancel_html = F.concat(F.lit("予約番号 "), code, F.lit(" のご予約をキャンセルしました。またのご利用をお待ちしております。"))
    has_email = F.col("customer_email").isNotNull()
    rows = F.filter(F.array(
        F.when((F.col("what") == "created") & has_email, F.struct(
            F.col("customer_email").alias("recipient"), F.lit("customer_created").alias("kind"),
            F.concat(tag, F.lit(CUSTOMER_CREATED_SUBJECT + " ("), code, F.lit(")")).alias("subject"),
            customer_html.alias("html"))),
        F.when((F.col("what") == "created") & F.col("shop_email").isNotNull(), F.struct(
            F.col("shop_email").alias("recipient"), F.lit("shop_created").alias("kind"),
            F.concat(F.lit(SHOP_CREATED_SUBJECT), period, F.lit(" "), name, F.lit("様")).alias("subject"),
            shop_html.alias("html"))),
        F.when((F.col("what") == "cancelled") & has_email, F.struct(
            F.col("customer_email").alias("recipient"), F.lit("customer_cancelled").alias("kind"),
            F.concat(tag, F.lit(CUSTOMER_CANCELLED_SUBJECT + " ("), code, F.lit(")")).alias("subject"),
            cancel_html.alias("html"))),
    ), lambda x: x.isNotNull())
    return (j.select("event_id", "reservation_id", F.explode(rows).alias("o"))
            .select("event_id", "reservation_id", "o.recipient", "o.kind", "o.subject", "o.html"))


def shops_from(reservations: DataFrame) -> DataFrame:
    """Per-shop mail identity derived from the shop ids in use (test data has none)."""
    s = reservations.select("shop_id").distinct()
    return s.select(
        "shop_id",
        F.concat(F.lit("Shop "), F.col("shop_id").cast("string")).alias("shop_name"),
        F.concat(F.lit("000-0000-"), F.lpad(F.col("shop_id").cast("string"), 4, "0")).alias("shop_phone"),
        F.lit("8:00〜17:00").alias("shop_hours"),
        F.when(F.col("shop_id") % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("shop"), F.col("shop_id").cast("string"), F.lit("@example.com")))
        .alias("shop_email"))
