"""Reservation lookup and status changes: E9 (lookup v1), E10 (lookup v2),
E11 (customer cancel), E12 (staff confirm / cancel), B6 (key normalisation).

Lookups first match on the normalised (code, phone) key (an equi-join), then
fetch children only for matched reservations (semi-join before the
aggregate), so the child aggregation never runs over the whole table when
few reservations are asked about.  "First cancel wins" is a per-reservation
``min`` (partial aggregation, safe for a hot reservation) joined back,
instead of a window over all requests of one reservation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_code(code: Column) -> Column:
    """``upper(trim(code))``."""
    return F.upper(F.trim(code))


def lookup_phone(phone: Column) -> Column:
    """``trim(phone)`` (the database side)."""
    return F.trim(phone)


def phone_digits(phone: Column) -> Column:
    """The lookup page keeps digits only before sending."""
    return F.regexp_replace(phone, r"[^0-9]", "")


def _shop_key(asked: DataFrame) -> list[str]:
    """Requests that name their shop match within it; those that do not match in any."""
    return ["shop_id"] if "shop_id" in asked.columns else []


def _matched(lookups: DataFrame, reservations: DataFrame, how: str) -> DataFrame:
    shop = _shop_key(lookups)
    keys = lookups.select("lookup_id", *shop, lookup_code(F.col("code")).alias("k_code"),
                          lookup_phone(F.col("phone")).alias("k_phone"))
    r = reservations.select(F.col("id").alias("reservation_id"), F.col("reservation_code").alias("k_code"),
                            F.col("customer_phone").alias("k_phone"), *[
                                c for c in reservations.columns
                                if c not in ("id", "reservation_code", "customer_phone")])
    return keys.join(r, ["k_code", "k_phone", *shop], how)


def _null_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def lookup_v1(lookups: DataFrame, reservations: DataFrame, items: DataFrame, equipment: DataFrame) -> DataFrame:
    """Header + items of the reservation matching (code, phone); no row if none.

    Items are (category, size_label, quantity); an item whose equipment row is
    gone keeps NULL category/size.  The JSON array is rendered as text sorted
    by its elements (the reference's aggregate has no order).
    """
    m = _matched(lookups, reservations, "inner")
    ids = m.select("reservation_id").distinct()
    it = (items.join(ids, "reservation_id", "left_semi")
          .join(equipment.select(F.col("id").alias("equipment_item_id"), "category", "size_label"),
                "equipment_item_id", "left")
          .groupBy("reservation_id")
          .agg(F.sort_array(F.collect_list(F.concat_ws(
              ":", _null_text(F.col("category")), _null_text(F.col("size_label")),
              F.col("quantity").cast("string")))).alias("lines")))
    return (m.join(it, "reservation_id", "left")
            .select("lookup_id", "reservation_id", F.col("k_code").alias("reservation_code"),
                    "rental_date", "customer_name", "party_size", "status",
                    F.coalesce(F.array_join("lines", ";"), F.lit("")).alias("items"),
                    F.coalesce(F.size("lines"), F.lit(0)).alias("n_items")))


def member_text(m) -> Column:
    """One member of the v2 answer as ``no:height:shoe:board:child:age:gender:stance:nick:set:addons``."""
    return F.concat_ws(":", *[_null_text(m[f]) for f in (
        "member_no", "height_cm", "shoe_cm", "board_type", "is_child", "age", "gender", "stance",
        "nickname", "set_type")], F.array_join(F.coalesce(m["addons"], F.array().cast("array<string>")), "+"))


def lookup_v2(lookups: DataFrame, reservations: DataFrame, members: DataFrame) -> DataFrame:
    """One answer per lookup; NULL answer columns when (code, phone) match nothing.

    Members are ordered by member_no; return_date is coalesced to the rental
    date; eve_pickup defaults to false.
    """
    m = _matched(lookups, reservations, "left")
    ids = m.where(F.col("reservation_id").isNotNull()).select("reservation_id").distinct()
    # Member text is built on the member row (code generated), then collected.
    mrow = {c: F.col(c) for c in members.columns}
    ms = (members.join(ids, "reservation_id", "left_semi")
          .select("reservation_id", "member_no", member_text(mrow).alias("t"))
          .groupBy("reservation_id")
          .agg(F.sort_array(F.collect_list(F.struct("member_no", "t"))).alias("ms")))
    found = F.col("reservation_id").isNotNull()
    texts = F.col("ms.t")
    return (m.join(ms, "reservation_id", "left")
            .select("lookup_id",
                    F.when(found, F.col("k_code")).alias("reservation_code"), "status", "rental_date",
                    F.coalesce("return_date", "rental_date").alias("return_date"),
                    F.when(found, F.coalesce("eve_pickup", F.lit(False))).alias("eve_pickup"),
                    "customer_name", "adults", "children",
                    F.when(found, F.coalesce(F.array_join(texts, "|"), F.lit(""))).alias("members"),
                    F.when(found, F.coalesce(F.size("ms"), F.lit(0))).alias("n_members")))


def cancel(requests: DataFrame, reservations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customer cancellations (request_id, requested_at, code, phone).

    Result per request: OK for the first request (by requested_at, request_id)
    on a reservation that is not cancelled; ALREADY_CANCELLED for the others
    and for reservations cancelled before; NOT_FOUND when nothing matches.
    Returns (results, updated reservations) - the second has status and
    cancelled_at / updated_at set from the winning request.
    """
    shop = _shop_key(requests)
    keys = requests.select("request_id", "requested_at", *shop, lookup_code(F.col("code")).alias("k_code"),
                           lookup_phone(F.col("phone")).alias("k_phone"))
    r = reservations.select(F.col("id").alias("reservation_id"), F.col("reservation_code").alias("k_code"), *shop,
                            F.col("customer_phone").alias("k_phone"), F.col("status").alias("old_status"))
    m = keys.join(r, ["k_code", "k_phone", *shop], "left")
    first = (m.where(F.col("reservation_id").isNotNull() & (F.col("old_status") != "cancelled"))
             .groupBy("reservation_id")
             .agg(F.min(F.struct("requested_at", "request_id")).alias("w")))
    res = (m.join(first, "reservation_id", "left")
           .select("request_id",
                   F.when(F.col("reservation_id").isNull(), "NOT_FOUND")
                   .when(F.col("w.request_id") == F.col("request_id"), "OK")
                   .otherwise("ALREADY_CANCELLED").alias("result")))
    won = first.select("reservation_id", F.col("w.requested_at").alias("at"))
    upd = (reservations.join(won, reservations.id == won.reservation_id, "left")
           .withColumn("status", F.when(F.col("at").isNotNull(), F.lit("cancelled")).otherwise(F.col("status")))
           .withColumn("cancelled_at", F.coalesce("at", "cancelled_at"))
           .withColumn("updated_at", F.coalesce("at", "updated_at"))
           .drop("reservation_id", "at"))
    return res, upd


def apply_status_changes(reservations: DataFrame, changes: DataFrame) -> DataFrame:
    """Fold staff actions (reservation_id, ts, event_id, action confirm|cancel) in order.

    Confirm is offered only while pending; cancel unless already cancelled;
    after a cancel nothing changes.  So the result is decided by the first
    cancel and the first confirm before it - two ``min`` aggregates.
    """
    key = F.struct("ts", "event_id")
    agg = (changes.groupBy("reservation_id")
           .agg(F.min(F.when(F.col("action") == "cancel", key)).alias("c"),
                F.min(F.when(F.col("action") == "confirm", key)).alias("k")))
    j = reservations.join(agg, reservations.id == agg.reservation_id, "left")
    cancel_now = (F.col("status") != "cancelled") & F.col("c").isNotNull()
    confirm_now = ((F.col("status") == "pending") & F.col("k").isNotNull()
                   & (F.col("c").isNull() | (F.col("k") < F.col("c"))))
    return (j.withColumn("updated_at", F.when(cancel_now, F.col("c.ts"))
                         .when(confirm_now, F.col("k.ts")).otherwise(F.col("updated_at")))
            .withColumn("cancelled_at", F.when(cancel_now, F.col("c.ts")).otherwise(F.col("cancelled_at")))
            .withColumn("status", F.when(cancel_now, F.lit("cancelled"))
                        .when(confirm_now, F.lit("confirmed")).otherwise(F.col("status")))
            .drop("reservation_id", "c", "k"))


def change_events(events: DataFrame) -> DataFrame:
    """Row changes from status events: created -> insert(pending), confirm -> update(confirmed),
    cancel -> update(cancelled); old status = the previous event's new status."""
    from pyspark.sql import Window
    new = (F.when(F.col("action") == "created", "pending").when(F.col("action") == "confirm", "confirmed")
           .otherwise("cancelled"))
    w = Window.partitionBy("reservation_id").orderBy("ts", "event_id")
    e = events.select("event_id", "reservation_id", "ts",
                      F.when(F.col("action") == "created", "insert").otherwise("update").alias("op"),
                      new.alias("new_status"))
    return e.withColumn("old_status", F.lag("new_status").over(w))


def status_transitions(events: DataFrame, reservations: DataFrame) -> DataFrame:
    """Batch counterpart of the J2 stream: one row per event with old/new status.

    The first confirm applies only to a pending reservation and only before
    the first cancel; the first cancel applies unless the reservation was
    cancelled already; every other event changes nothing.  So the status
    before an event follows from two per-reservation minima (partial
    aggregates) - no per-key fold.
    """
    key = F.struct("ts", "event_id")
    base = reservations.select(F.col("id").alias("reservation_id"), F.col("status").alias("base"))
    agg = (events.groupBy("reservation_id")
           .agg(F.min(F.when(F.col("action") == "cancel", key)).alias("c"),
                F.min(F.when(F.col("action") == "confirm", key)).alias("k")))
    e = events.join(base, "reservation_id", "left").join(agg, "reservation_id", "left")
    confirm_at = F.when((F.col("base") == "pending") & F.col("k").isNotNull()
                        & (F.col("c").isNull() | (F.col("k") < F.col("c"))), F.col("k"))
    cancel_at = F.when(F.col("base").isNotNull() & (F.col("base") != "cancelled"), F.col("c"))
    e = e.withColumn("_me", key).withColumn("_confirm_at", confirm_at).withColumn("_cancel_at", cancel_at)
    before = (F.when(F.col("_cancel_at").isNotNull() & (F.col("_me") > F.col("_cancel_at")), F.lit("cancelled"))
              .when(F.col("_confirm_at").isNotNull() & (F.col("_me") > F.col("_confirm_at")), F.lit("confirmed"))
              .otherwise(F.col("base")))
    is_confirm = (F.col("action") == "confirm") & (F.col("_me") == F.col("_confirm_at"))
    is_cancel = (F.col("action") == "cancel") & (F.col("_me") == F.col("_cancel_at"))
    applied = F.coalesce(is_confirm, F.lit(False)) | F.coalesce(is_cancel, F.lit(False))
    new = (F.when(F.coalesce(is_confirm, F.lit(False)), F.lit("confirmed"))
           .when(F.coalesce(is_cancel, F.lit(False)), F.lit("cancelled")).otherwise(F.col("old_status")))
    result = (F.when(F.col("action") == "confirm", F.when(F.col("applied"), "OK").otherwise("NOT_PENDING"))
              .when(F.col("action") == "cancel",
                    F.when(F.col("old_status").isNull(), "NOT_FOUND").when(F.col("applied"), "OK")
                    .otherwise("ALREADY_CANCELLED"))
              .otherwise("NO_CHANGE"))
    return (e.withColumn("old_status", before).withColumn("applied", applied)
            .withColumn("new_status", new).withColumn("result", result)
            .select("event_id", "reservation_id", "ts", "action", "old_status", "new_status", "applied", "result"))
