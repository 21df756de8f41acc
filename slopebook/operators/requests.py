"""Booking-request checks: E4 (v1), E5 (v2), E6 (capacity alone), A8 (rows
from a nested request) and member insert checks.

Every function maps a DataFrame of requests to a DataFrame of answers; the
reference's per-call PL/pgSQL checks become one ordered ``when`` chain.
Closed days are one sorted array per shop, tested inside the request's row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopebook.functions import pgcompat as pg
from slopebook.operators import occupancy as occ
from slopebook.sources import schemas

BOARD_TYPES = ("ski", "snowboard", "none")
MAX_PERIOD_DAYS = 30
MAX_MEMBERS = 20


def _lit_date(v: dt.date | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _members_n() -> Column:
    return F.when(F.col("members").isNull(), F.lit(None)).otherwise(F.size("members"))


def closed_days(closed_dates: DataFrame) -> DataFrame:
    """shop_id, _closed: the closed days of every shop as one sorted array.

    A row per shop, each bounded by the calendar.  A shop's days close that shop only.
    """
    return closed_dates.groupBy("shop_id").agg(F.array_sort(F.collect_set("closed_date")).alias("_closed"))


def with_v2_code(requests: DataFrame, closed_dates: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """E5 as a column: ``requests`` plus ``code`` (first failing check before the
    stock loop; NULL = passes).

    Order: INVALID_DATES, DATE_IN_PAST, PERIOD_TOO_LONG, INVALID_CONTACT,
    INVALID_MEMBERS, MEMBER_COUNT_MISMATCH, SHOP_CLOSED_ON_DATE, EVE_IN_PAST,
    EVE_CLOSED, INVALID_BOARD_TYPE.  A NULL board type is not
    INVALID_BOARD_TYPE (``NULL NOT IN (...)`` is not true).
    """
    return coded_v2(requests.join(closed_days(closed_dates), "shop_id", "left"), as_of).select(*requests.columns, "code")


def coded_v2(requests: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """``requests`` (with their shop's closed days as ``_closed``, NULL if none) plus ``code``."""
    today = _lit_date(as_of)
    days = F.coalesce("_closed", F.array().cast("array<date>"))
    n = _members_n()
    eve = F.coalesce(F.col("eve_pickup"), F.lit(False))
    bad_type = F.exists("members", lambda m: ~m["board_type"].isin(*BOARD_TYPES))
    code = (F.when(F.col("start").isNull() | F.col("end").isNull() | (F.col("end") < F.col("start")),
                   "INVALID_DATES")
            .when(F.col("start") < today, "DATE_IN_PAST")
            .when(F.datediff("end", "start") > MAX_PERIOD_DAYS, "PERIOD_TOO_LONG")
            .when(F.col("name").isNull() | (F.length(F.trim("name")) == 0) | F.col("phone").isNull()
                  | (F.length(F.trim("phone")) < 10), "INVALID_CONTACT")
            .when(n.isNull() | (n == 0) | (n > MAX_MEMBERS), "INVALID_MEMBERS")
            .when(F.coalesce("adults", F.lit(0)) + F.coalesce("children", F.lit(0)) != n,
                  "MEMBER_COUNT_MISMATCH")
            .when(F.exists(days, lambda d: d.between(F.col("start"), F.col("end"))), "SHOP_CLOSED_ON_DATE")
            .when(eve & (F.date_sub("start", 1) < today), "EVE_IN_PAST")
            .when(eve & F.array_contains(days, F.date_sub("start", 1)), "EVE_CLOSED")
            .when(bad_type, "INVALID_BOARD_TYPE"))
    return requests.withColumn("code", code)


def validate_requests_v2(requests: DataFrame, closed_dates: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """E5: request_id, code (see :func:`with_v2_code`)."""
    return with_v2_code(requests, closed_dates, as_of).select("request_id", "code")


def members_ok() -> Column:
    """Would every member row of the request insert (casts, NOT NULL, CHECKs)?

    height 80-220 (int text), shoe 14-33 after rounding to numeric(4,1),
    board type in the list, is_child boolean text, age integer text or ''.
    A row-level expression over the ``members`` array.
    """
    def ok(m):
        h = pg.pg_int(m["height_cm"])
        shoe = F.trim(m["shoe_cm"]).try_cast("decimal(4,1)")
        age_txt = F.nullif(m["age"], F.lit(""))
        return (h.isNotNull() & h.between(80, 220)
                & shoe.isNotNull() & shoe.between(14, 33)
                & m["board_type"].isNotNull() & m["board_type"].isin(*BOARD_TYPES)
                & pg.pg_bool_valid(m["is_child"])
                & pg.pg_int_valid(age_txt))
    return F.coalesce(F.forall("members", ok), F.lit(False))


def member_rows_ok(requests: DataFrame) -> DataFrame:
    """Per request: ``members_ok`` (see :func:`members_ok`)."""
    return requests.select("request_id", members_ok().alias("members_ok"))


def type_needs() -> Column:
    """D8 as a column: array of (category, need) for the request's board types
    ('none' rents nothing; a NULL type is kept).  Array functions over the
    request's own members: no explode, no shuffle."""
    types = F.array_distinct(F.transform(F.filter("members", lambda m: m["board_type"].isNull()
                                                  | (m["board_type"] != "none")), lambda m: m["board_type"]))
    return F.transform(types, lambda t: F.struct(
        t.alias("category"),
        F.size(F.filter("members", lambda m: m["board_type"].eqNullSafe(t))).cast("int").alias("need")))


def cells_from_needs(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(request, category, day) rows from ``from``/``end``/``needs`` columns."""
    per = df.select("request_id", "shop_id", "requested_at", *keep, "from", "end",
                    F.explode("needs").alias("cn"))
    return per.select("request_id", "shop_id", "requested_at", *keep, F.col("cn.category").alias("category"),
                      F.col("cn.need").alias("need"), F.explode(F.sequence("from", "end")).alias("day"))


def request_cells(requests: DataFrame) -> DataFrame:
    """(request, category, day) cells a request would occupy, with its need.

    Expects requests that passed E5 (range valid and at most 31 days).
    """
    extra = tuple(c for c in ("consumer",) if c in requests.columns)
    slim = requests.select("request_id", "shop_id", "requested_at", *extra,
                           occ.occupied_from(F.col("eve_pickup"), F.col("start")).alias("from"), "end",
                           type_needs().alias("needs"))
    return cells_from_needs(slim, extra)


def cells_with_state(cells: DataFrame, equipment: DataFrame, reservations: DataFrame,
                     members: DataFrame) -> DataFrame:
    """Attach stock (0 when the shop has no active row of the type) and current use."""
    stock = occ.category_stock(equipment)
    used = occ.daily_occupancy(reservations, members)  # one pass over the bookings, one row per cell in use
    return (cells.join(stock, ["shop_id", "category"], "left")
            .join(used, ["shop_id", "category", "day"], "left")
            .withColumn("total", F.coalesce("total", F.lit(0)))
            .withColumn("used", F.coalesce("used", F.lit(0))))


def out_of_stock_code(category: Column, day: Column) -> Column:
    return F.concat(F.lit("OUT_OF_STOCK:"), pg.pg_text(category), F.lit(":"),
                    F.date_format(day, "yyyy-MM-dd"))


def capacity_check(requests: DataFrame, equipment: DataFrame, reservations: DataFrame,
                   members: DataFrame) -> DataFrame:
    """Would each request fit the current bookings on its own?

    Returns request_id, code (NULL = fits), category, day of the first failing
    cell in (category, day) order (NULL category last).
    """
    cells = cells_with_state(request_cells(requests), equipment, reservations, members)
    fail = (cells.where(F.col("used") + F.col("need") > F.col("total"))
            .groupBy("request_id")
            .agg(F.min(F.struct(F.col("category").isNull().alias("cat_null"), "category", "day"))
                 .alias("f")))
    return (requests.select("request_id").join(fail, "request_id", "left")
            .select("request_id", out_of_stock_code(F.col("f.category"), F.col("f.day"))
                    .alias("code"), F.col("f.category").alias("category"), F.col("f.day").alias("day"))
            .withColumn("code", F.when(F.col("day").isNotNull(), F.col("code"))))


# ---------------------------------------------------------------------------
# v1 (single day, explicit equipment items)
# ---------------------------------------------------------------------------

def with_v1_code(requests: DataFrame, closed_dates: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """``requests`` plus ``code``: INVALID_INPUT, DATE_IN_PAST, SHOP_CLOSED_ON_DATE or NULL."""
    closed = (closed_dates.select("shop_id", F.col("closed_date").alias("rental_date")).distinct()
              .withColumn("is_closed", F.lit(True)))
    n_items = F.when(F.col("items").isNull(), F.lit(None)).otherwise(F.size("items"))
    code = (F.when(F.col("rental_date").isNull() | F.col("party_size").isNull()
                   | (F.col("party_size") <= 0) | n_items.isNull() | (n_items == 0), "INVALID_INPUT")
            .when(F.col("rental_date") < _lit_date(as_of), "DATE_IN_PAST")
            .when(F.coalesce("is_closed", F.lit(False)), "SHOP_CLOSED_ON_DATE"))
    return requests.join(closed, ["shop_id", "rental_date"], "left").withColumn("code", code).drop("is_closed")


def v1_lines(requests: DataFrame, closed_dates: DataFrame, equipment: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """Item lines of the requests that pass their own checks: place (text order of the item id, then
    position), qty, the item's stock, and line_code if the line is wrong in itself."""
    eq = equipment.select(F.col("id").cast("string").alias("eid_text"), F.col("id").alias("equipment_item_id"),
                          "total_quantity", "is_active")
    lines = (with_v1_code(requests, closed_dates, as_of).where(F.col("code").isNull())
             .select("request_id", "shop_id", "requested_at", "rental_date", F.posexplode("items").alias("pos", "it"))
             .select("request_id", "shop_id", "requested_at", "rental_date", F.col("it.equipment_item_id").alias("eid_text"),
                     F.struct(F.col("it.equipment_item_id").isNull().alias("no_item"), F.col("it.equipment_item_id").alias("item"), "pos").alias("place"),
                     pg.pg_int(F.col("it.quantity")).alias("qty")))
    bad = (F.when(F.col("qty").isNull() | (F.col("qty") <= 0), "INVALID_QUANTITY")
           .when(F.col("total_quantity").isNull(), "EQUIPMENT_NOT_FOUND")
           .when(~F.col("is_active"), "EQUIPMENT_INACTIVE"))
    return lines.join(eq, "eid_text", "left").withColumn("line_code", bad)


def validate_requests_v1(requests: DataFrame, closed_dates: DataFrame, equipment: DataFrame,
                         reservations: DataFrame, items: DataFrame, as_of: dt.date | Column,
                         faithful: bool = True) -> DataFrame:
    """First failing code of create_reservation (v1) against current bookings.

    Request checks first (INVALID_INPUT, DATE_IN_PAST, SHOP_CLOSED_ON_DATE);
    then items in text order of their equipment id: INVALID_QUANTITY,
    EQUIPMENT_NOT_FOUND, EQUIPMENT_INACTIVE, OUT_OF_STOCK:<id>.  ``item_pos``
    is the 1-based array position of the failing item.  ``faithful`` keeps
    the reference's check of each line alone (two lines of one item can
    overbook); ``faithful=False`` checks the request's total per item.
    """
    r = with_v1_code(requests, closed_dates, as_of).select("request_id", "rental_date", "items", F.col("code").alias("req_code"))

    lines = (r.where(F.col("req_code").isNull())
             .select("request_id", "rental_date", F.posexplode("items").alias("pos", "it"))
             .select("request_id", "rental_date", (F.col("pos") + 1).alias("item_pos"),
                     F.col("it.equipment_item_id").alias("eid_text"),
                     pg.pg_int(F.col("it.quantity")).alias("qty"),
                     F.col("it.quantity").alias("qty_text")))
    if not faithful:
        per_item = Window.partitionBy("request_id", "eid_text")
        lines = lines.withColumn("qty_check", F.sum("qty").over(per_item))
    else:
        lines = lines.withColumn("qty_check", F.col("qty"))
    eq = equipment.select(F.col("id").cast("string").alias("eid_text"),
                          F.col("id").alias("equipment_item_id"), "total_quantity", "is_active")
    booked = occ.booked_items(reservations, items, r.select(F.col("rental_date").alias("date"))).select(
        "equipment_item_id", F.col("date").alias("rental_date"), "booked")
    li = (lines.join(eq, "eid_text", "left")
          .join(booked, ["equipment_item_id", "rental_date"], "left"))
    item_code = (F.when(F.col("qty").isNull() | (F.col("qty") <= 0), "INVALID_QUANTITY")
                 .when(F.col("total_quantity").isNull(), "EQUIPMENT_NOT_FOUND")
                 .when(~F.col("is_active"), "EQUIPMENT_INACTIVE")
                 .when(F.coalesce("booked", F.lit(0)) + F.col("qty_check") > F.col("total_quantity"),
                       F.concat(F.lit("OUT_OF_STOCK:"), F.col("eid_text"))))
    first = (li.where(item_code.isNotNull())
             .groupBy("request_id")
             .agg(F.min(F.struct(F.col("eid_text").isNull().alias("eid_null"), "eid_text", "item_pos",
                                 item_code.alias("code"))).alias("f")))
    return (r.join(first, "request_id", "left")
            .select("request_id", F.coalesce("req_code", F.col("f.code")).alias("code"),
                    F.when(F.col("req_code").isNull(), F.col("f.item_pos")).alias("item_pos")))


# ---------------------------------------------------------------------------
# Rows written for an accepted request
# ---------------------------------------------------------------------------

def reservation_rows(requests: DataFrame) -> DataFrame:
    """A8 (parent): the reservations row create_reservation_v2 inserts."""
    return requests.select(
        F.col("request_id").alias("id"), "shop_id",
        pg.reservation_code(F.col("request_id")).alias("reservation_code"),
        F.col("start").alias("rental_date"), F.col("end").alias("return_date"),
        F.trim("name").alias("customer_name"), F.trim("phone").alias("customer_phone"),
        pg.nullif_trim(F.col("email")).alias("customer_email"),
        _members_n().cast("int").alias("party_size"),
        F.coalesce("adults", F.lit(0)).alias("adults"), F.coalesce("children", F.lit(0)).alias("children"),
        F.col("notes"), F.lit("pending").alias("status"),
        F.coalesce("eve_pickup", F.lit(False)).alias("eve_pickup"),
        F.col("requested_at").alias("created_at"),
    )


def members_from_json(body: Column) -> Column:
    """The members array of a JSON request body: every value as its text (numbers and
    booleans too), addons only if they are an array, NULL if the body is no array."""
    fields = [f.name for f in schemas.MEMBER_REQUEST.fields]
    text = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in fields]))

    def addons(m):
        return F.when(m["addons"].startswith("["), F.from_json(m["addons"], T.ArrayType(T.StringType()))).otherwise(F.array().cast("array<string>"))
    parsed = F.when(F.ltrim(body).startswith("["), F.from_json(body, text))
    return F.transform(parsed, lambda m: F.struct(*[(addons(m) if f == "addons" else m[f]).alias(f) for f in fields]))


def member_rows(requests: DataFrame) -> DataFrame:
    """A8 (children): one member row per array element, member_no from 1."""
    m = requests.select(F.col("request_id").alias("reservation_id"),
                        F.posexplode("members").alias("pos", "m"))
    return m.select(
        "reservation_id", (F.col("pos") + 1).cast("int").alias("member_no"),
        pg.pg_int(F.col("m.height_cm")).alias("height_cm"),
        F.trim(F.col("m.shoe_cm")).try_cast("decimal(4,1)").alias("shoe_cm"),
        F.col("m.board_type").alias("board_type"),
        F.coalesce(pg.pg_bool(F.col("m.is_child")), F.lit(False)).alias("is_child"),
        pg.pg_int(pg.nullif_blank(F.col("m.age"))).alias("age"),
        pg.nullif_blank(F.col("m.gender")).alias("gender"),
        pg.nullif_blank(F.col("m.stance")).alias("stance"),
        pg.nullif_trim(F.col("m.nickname")).alias("nickname"),
        pg.nullif_blank(F.col("m.set_type")).alias("set_type"),
        F.coalesce(F.col("m.addons"), F.array().cast("array<string>")).alias("addons"),
    )


def item_rows(requests: DataFrame) -> DataFrame:
    """A8 (v1 children): one reservation item row per line of the request, in array order."""
    m = requests.select(F.col("request_id").alias("reservation_id"), F.posexplode("items").alias("pos", "it"))
    return m.select("reservation_id", (F.col("pos") + 1).cast("int").alias("item_pos"),
                    pg.pg_int(F.col("it.equipment_item_id")).alias("equipment_item_id"),
                    pg.pg_int(F.col("it.quantity")).alias("quantity"))


def distinct_code(code: Column, request_id: Column, first: Column) -> Column:
    """A code as it is for the first to have it; for others with their id after it, which no other code can equal."""
    return F.when(first, code).otherwise(F.concat(code, F.lit("-"), request_id.cast("string")))


def distinct_codes(requests: DataFrame, known: DataFrame | None = None, order: tuple[str, ...] = ("requested_at", "request_id")) -> DataFrame:
    """E8 without collisions: ``requests`` plus ``reservation_code``.

    The first request of a code (by ``order``) has it as it is, unless one of the
    ``known`` reservations (id, reservation_code) has it; others get their id after
    it.  A request that is stored already keeps its code, so a retry never changes
    one.  Windows are over equal codes: a few rows each.
    """
    r = requests.withColumn("_code", pg.reservation_code(F.col("request_id")))
    if known is not None and "reservation_code" in known.columns:
        stored = known.groupBy(F.col("id").alias("request_id")).agg(F.min("reservation_code").alias("_old"))
        taken = known.select(F.col("reservation_code").alias("_code")).distinct().withColumn("_taken", F.lit(True))
        r = r.join(stored, "request_id", "left").join(taken, "_code", "left")
    else:
        r = r.withColumns({"_old": F.lit(None).cast("string"), "_taken": F.lit(None).cast("boolean")})
    earlier = Window.partitionBy("_code").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    is_new = F.col("_taken").isNull() & (F.coalesce(F.sum(F.when(F.col("_old").isNull(), 1)).over(earlier), F.lit(0)) == 0)
    code = F.coalesce("_old", distinct_code(F.col("_code"), F.col("request_id"), is_new))
    return r.withColumn("reservation_code", code).drop("_code", "_old", "_taken")


def code_collisions(reservations: DataFrame) -> DataFrame:
    """E8 audit: reservation codes used by more than one reservation."""
    return (reservations.groupBy("reservation_code")
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
            .where(F.col("n") > 1))
