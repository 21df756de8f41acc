"""Stock and availability: E1 (per size, one day), E2 (per category over a
window), E3 (members in use per shop, category and day).

Plan notes (100 TB view)
* Members are counted per (reservation, category) first.  A booking is then two
  rows, +n on its first day and -n on the day after its last, whatever its
  length; they are summed per (shop, category, day) with map-side combining and
  a running sum over the (few) days of change gives the use.  Only E3, whose
  result has a row per day, expands the segments, after aggregation.
* E2 reads a window's peak from two cells of a table of maxima over 1, 2, 4, ...
  days, made once per (shop, category); windows are never expanded to days.
  Both joins are equi-joins; no theta or nested-loop join.
* Day lists per (shop, category) are bounded by the calendar, not by the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("pending", "confirmed")
BOARD_CATEGORIES = ("ski", "snowboard")


def occupied_from(eve: Column, start: Column) -> Column:
    """First occupied day: an eve pickup takes the board one day early."""
    return F.when(F.coalesce(eve, F.lit(False)), F.date_sub(start, 1)).otherwise(start)


def member_counts(members: DataFrame) -> DataFrame:
    """Board-renting members per (reservation, category); 'none' rents nothing."""
    return (members.where(F.col("board_type").isin(*BOARD_CATEGORIES))
            .groupBy("reservation_id", F.col("board_type").alias("category"))
            .agg(F.count(F.lit(1)).cast("int").alias("n")))


def occupancy_segments(reservations: DataFrame, members: DataFrame,
                       lo: dt.date | Column | None = None, hi: dt.date | Column | None = None) -> DataFrame:
    """shop_id, category, day, until, used: stretches of days (``until`` is the day after) of equal use.

    A sweep line: +n where a booking begins, -n after it ends, summed per day
    before the running sum, so the rows shuffled do not depend on how long
    bookings are.  Stretches without use between others are included.
    """
    r, first, last = _active_spans(reservations), F.col("s"), F.col("e")
    if lo is not None:
        lo_c = lo if isinstance(lo, Column) else F.lit(lo)
        r, first = r.where(F.col("e") >= lo_c), F.greatest(first, lo_c)
    if hi is not None:
        hi_c = hi if isinstance(hi, Column) else F.lit(hi)
        r, last = r.where(F.col("s") <= hi_c), F.least(last, hi_c)
    ends = F.array(F.struct(first.alias("day"), F.col("n").alias("delta")),
                   F.struct(F.date_add(last, 1).alias("day"), (-F.col("n")).alias("delta")))
    deltas = (r.join(member_counts(members), "reservation_id")
              .select("shop_id", "category", F.explode(ends).alias("d"))
              .groupBy("shop_id", "category", F.col("d.day").alias("day")).agg(F.sum("d.delta").alias("delta")))
    by_day = Window.partitionBy("shop_id", "category").orderBy("day")
    return (deltas.select("shop_id", "category", "day", F.lead("day").over(by_day).alias("until"),
                          F.sum("delta").over(by_day).cast("int").alias("used"))
            .where("until is not null"))


def daily_occupancy(reservations: DataFrame, members: DataFrame,
                    lo: dt.date | Column | None = None, hi: dt.date | Column | None = None) -> DataFrame:
    """Members in use per (shop_id, category, day), for days in [lo, hi]
    where bounds are given.

    Active reservations only; an eve pickup occupies the day before; a NULL
    return date is a one-day rental.
    """
    used = occupancy_segments(reservations, members, lo, hi).where("used > 0")
    return used.select("shop_id", "category", F.explode(F.sequence("day", F.date_sub("until", 1))).alias("day"), "used")


def range_maxima(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, maxima): per (shop_id, category) the first and last day of ``segments``, and
    (level, day, peak): the largest use in the 2**level days from ``day`` on.

    One row per (shop, category) holds its days (a calendar's worth); each level
    comes from the one below by comparing it with itself 2**(level-1) days on.
    """
    days = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("day", "until", "used"))),
                                 lambda x: F.array_repeat(x["used"], F.datediff(x["until"], x["day"]))))
    base = segments.groupBy("shop_id", "category").agg(F.min("day").alias("h_lo"), F.date_sub(F.max("until"), 1).alias("h_hi"), days.alias("days"))

    def doubled(levels: Column, k: Column) -> Column:
        below = F.element_at(levels, -1)
        step = F.pow(F.lit(2), k - 1).cast("int")
        row = F.transform(F.sequence(F.lit(0), F.size(below) - 1 - step), lambda i: F.greatest(below[i], below[i + step]))
        return F.concat(levels, F.array(row))
    top = _log2(F.size("days"))
    levels = F.when(top > 0, F.aggregate(F.sequence(F.lit(1), top), F.array("days"), doubled)).otherwise(F.array("days"))
    cells = (base.select("shop_id", "category", "h_lo", F.posexplode(levels).alias("level", "row"))
             .select("shop_id", "category", "h_lo", "level", F.posexplode("row").alias("at", "peak"))
             .where("peak > 0").select("shop_id", "category", "level", F.date_add("h_lo", F.col("at")).alias("day"), "peak"))
    return base.select("shop_id", "category", "h_lo", "h_hi"), cells


def _log2(n: Column) -> Column:
    """floor(log2(n)) of a positive whole number, exactly."""
    return F.length(F.bin(n)) - 1


def _active_spans(reservations: DataFrame) -> DataFrame:
    """Active reservations with their occupied span [s, e]; a return before
    the first day occupies nothing."""
    return (reservations.where(F.col("status").isin(*ACTIVE))
            .select(F.col("id").alias("reservation_id"), "shop_id",
                    occupied_from(F.col("eve_pickup"), F.col("rental_date")).alias("s"),
                    F.coalesce(F.col("return_date"), F.col("rental_date")).alias("e"))
            .where("s <= e"))


def category_stock(equipment: DataFrame) -> DataFrame:
    """Active stock per (shop, category) for ski and snowboard."""
    return (equipment.where(F.col("is_active") & F.col("category").isin(*BOARD_CATEGORIES))
            .groupBy("shop_id", "category")
            .agg(F.sum("total_quantity").cast("int").alias("total")))


def availability_by_category(equipment: DataFrame, reservations: DataFrame, members: DataFrame,
                             windows: DataFrame) -> DataFrame:
    """Per window (window_id, shop_id, start, end, eve) and category, stock minus peak use.

    Invalid windows (NULL bound or end < start) give one row with error
    INVALID_DATES.  A category without active stock is missing (not 0).  No
    ``> 0`` filter: remaining may be negative.
    """
    w = windows.select("window_id", "shop_id", "start", "end",
                       occupied_from(F.col("eve"), F.col("start")).alias("from"))
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("end") < F.col("start"))
    invalid = w.where(bad).select(
        "window_id", "shop_id", F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("int").alias("remaining"), F.lit("INVALID_DATES").alias("error"))
    ok = w.where(~bad)
    stock = category_stock(equipment)
    spans, maxima = range_maxima(occupancy_segments(reservations, members))
    lo, hi = F.greatest("from", "h_lo"), F.least("end", "h_hi")
    level = _log2(F.datediff(hi, lo) + 1)
    two = F.array_distinct(F.array(lo, F.date_sub(hi, F.pow(F.lit(2), level).cast("int") - 1)))
    # A window that leaves its shop's days in use is clipped to them; two cells of one level cover the rest.
    probes = (ok.join(spans, "shop_id").where(lo <= hi)
              .select("window_id", "shop_id", "category", level.alias("level"), F.explode(two).alias("day")))
    peak = (probes.join(maxima, ["shop_id", "category", "level", "day"])
            .groupBy("window_id", "category").agg(F.max("peak").alias("peak")))
    res = (ok.select("window_id", "shop_id").join(stock, "shop_id")
           .join(peak, ["window_id", "category"], "left")
           .select("window_id", "shop_id", "category",
                   (F.col("total") - F.coalesce(F.col("peak"), F.lit(0))).cast("int").alias("remaining"),
                   F.lit(None).cast("string").alias("error")))
    return res.unionByName(invalid)


def booked_items(reservations: DataFrame, items: DataFrame, dates: DataFrame) -> DataFrame:
    """Quantity booked per (equipment item, rental day) by active reservations, on the given ``date``s."""
    r = (reservations.where(F.col("status").isin(*ACTIVE))
         .select(F.col("id").alias("reservation_id"), F.col("rental_date").alias("date"))
         .join(dates.select("date").distinct(), "date", "left_semi"))
    return (items.join(r, "reservation_id")
            .groupBy("equipment_item_id", "date")
            .agg(F.sum("quantity").cast("int").alias("booked")))


def availability_by_size(equipment: DataFrame, reservations: DataFrame, items: DataFrame,
                         dates: DataFrame) -> DataFrame:
    """For each asked (shop_id, date), active sizes of that shop with stock left > 0,
    with their ``position`` by category, size_label.

    One day only, reservation items only (members never count here).  Only
    bookings of asked dates are summed.
    """
    booked = booked_items(reservations, items, dates.select("date"))
    eq = equipment.where(F.col("is_active")).select(
        F.col("id").alias("equipment_item_id"), "shop_id", "category", "size_label", "total_quantity")
    asked = dates.select("shop_id", "date").distinct()
    grid = asked.join(eq, "shop_id")
    return (grid.join(booked, ["equipment_item_id", "date"], "left")
            .select("date", "shop_id", "equipment_item_id", "category", "size_label",
                    (F.col("total_quantity") - F.coalesce(F.col("booked"), F.lit(0))).cast("int")
                    .alias("remaining"))
            .where(F.col("remaining") > 0)
            .withColumn("position", F.row_number().over(
                Window.partitionBy("shop_id", "date").orderBy("category", "size_label", "equipment_item_id"))))
