"""Table maintenance as snapshot transforms: A3 (constraint audit), A4
(insert-if-absent), A5 (insert with duplicate report), A6 (upsert, last
write wins), A7 (append), A9 (equipment changes), A10 (guarded delete), A11
(cascading delete), A12 (delete by key), A13 (stamp updated_at).

Plain parquet has no MERGE, so each write produces a new snapshot
DataFrame; callers write it to a new path.  "First row wins" and "last
write wins" are per-key ``min``/``max_by`` aggregates joined back (partial
aggregation survives a hot key), not windows over a whole key group.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopebook.plans.session import materialize

CATEGORIES = ("ski", "snowboard", "boots")
STATUSES = ("pending", "confirmed", "cancelled")


def _row_checks(df: DataFrame, table: str, key: Column, checks: list[tuple[str, Column]]) -> DataFrame:
    """All row-level checks of one table in one pass: an array of the violated
    constraint names per row, exploded."""
    names = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull())
    return (df.select(key.cast("string").alias("key"), F.explode(names).alias("constraint_name"))
            .select(F.lit(table).alias("table_name"), "constraint_name", "key"))


def _dupes(df: DataFrame, table: str, name: str, cols: list[str]) -> DataFrame:
    """Keys that occur twice.  A key with a NULL in it is never a duplicate (as in a
    UNIQUE constraint); the not_null check reports it."""
    g = df.dropna(subset=cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return g.select(F.lit(table).alias("table_name"), F.lit(name).alias("constraint_name"),
                    F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])
                    .alias("key"))


def _orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str, table: str, name: str) -> DataFrame:
    p = parent.select(F.col(pk).alias(fk)).distinct()
    return (child.join(p, fk, "left_anti")
            .select(F.lit(table).alias("table_name"), F.lit(name).alias("constraint_name"),
                    F.col(fk).cast("string").alias("key")))


def audit(equipment: DataFrame, reservations: DataFrame, items: DataFrame, members: DataFrame,
          closed_dates: DataFrame) -> DataFrame:
    """A3: one row per (table, constraint, key) violated.

    Declared keys, NOT NULL, CHECK and foreign keys of the schema scripts;
    uniqueness of (category, size_label) is per shop.  Row-level checks of a
    table are one pass; keys are aggregates; foreign keys are anti-joins.
    """
    e, r, i, m = equipment, reservations, items, members
    member_key = F.concat_ws("|", F.col("reservation_id").cast("string"), F.col("member_no").cast("string"))
    parts = [
        _dupes(e, "equipment_items", "pk_id", ["id"]),
        _dupes(e, "equipment_items", "unique_category_size", ["shop_id", "category", "size_label"]),
        _row_checks(e, "equipment_items", F.col("id"), [
            ("check_category", ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))),
            ("check_total_quantity", F.col("total_quantity") < 0),
            ("not_null", F.col("size_label").isNull() | F.col("total_quantity").isNull()
             | F.col("is_active").isNull()),
        ]),
        _dupes(r, "reservations", "pk_id", ["id"]),
        _dupes(r, "reservations", "unique_reservation_code", ["reservation_code"]),
        _row_checks(r, "reservations", F.col("id"), [
            ("check_party_size", F.col("party_size") <= 0),
            ("check_status", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))),
            ("not_null", F.col("reservation_code").isNull() | F.col("rental_date").isNull()
             | F.col("customer_name").isNull() | F.col("customer_phone").isNull()
             | F.col("party_size").isNull() | F.col("eve_pickup").isNull()),
        ]),
        _row_checks(i, "reservation_items", F.col("reservation_id"), [("check_quantity", F.col("quantity") <= 0)]),
        _orphans(i, r, "reservation_id", "id", "reservation_items", "fk_reservation"),
        _orphans(i, e, "equipment_item_id", "id", "reservation_items", "fk_equipment"),
        _row_checks(m, "reservation_members", member_key, [
            ("check_height", ~F.col("height_cm").between(80, 220)),
            ("check_shoe", ~F.col("shoe_cm").between(14, 33)),
            ("check_board_type", ~F.coalesce(F.col("board_type").isin("ski", "snowboard", "none"), F.lit(False))),
            ("not_null", F.col("member_no").isNull() | F.col("height_cm").isNull() | F.col("shoe_cm").isNull()),
        ]),
        _orphans(m, r, "reservation_id", "id", "reservation_members", "fk_reservation"),
        _dupes(closed_dates, "closed_dates", "pk_closed_date", ["shop_id", "closed_date"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_site(settings: DataFrame, pages: DataFrame, versions: DataFrame) -> DataFrame:
    """A3 for the settings (one row per shop, whose id is 1), the published pages and their versions."""
    def missing(*cols: str) -> Column:
        out = F.lit(False)
        for c in cols:
            out = out | F.col(c).isNull()
        return out
    parts = [
        _dupes(settings, "business_settings", "pk_id", ["shop_id", "id"]),
        _row_checks(settings, "business_settings", F.col("shop_id"), [
            ("check_single_row", F.col("id") != 1), ("not_null", missing("id", "open_time", "close_time", "max_advance_days"))]),
        _dupes(pages, "site_pages", "pk_page_key", ["page_key"]),
        _row_checks(pages, "site_pages", F.col("page_key"), [("not_null", missing("page_key", "html", "css", "project_data"))]),
        _dupes(versions, "site_page_versions", "pk_id", ["id"]),
        _row_checks(versions, "site_page_versions", F.col("id"), [("not_null", missing("id", "page_key", "html", "css", "project_data", "created_at"))]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _first_per_key(feed: DataFrame, keys: list[str], order: str) -> DataFrame:
    first = feed.groupBy(*keys).agg(F.min(order).alias("_first"))
    return feed.join(first, keys).where(F.col(order) == F.col("_first")).drop("_first")


def insert_ignore(target: DataFrame, feed: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A4: ``insert ... on conflict do nothing``: first feed row per key wins,
    keys already in the target are skipped.  Returns the new snapshot with a
    ``source`` column (existing | inserted)."""
    cols = [c for c in target.columns]
    fresh = _first_per_key(feed, keys, order).join(target.select(*keys).distinct(), keys, "left_anti")
    return (target.select(*cols, F.lit("existing").alias("source"))
            .unionByName(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).alias(c) for c in cols],
                                      F.lit("inserted").alias("source"))))


def insert_report(target: DataFrame, feed: DataFrame, keys: list[str], order: str,
                  checks: list[tuple[Column, str]]) -> DataFrame:
    """A5: status per feed row: the first failing client check's code, else
    DUPLICATE (key in target, or an earlier accepted row of the batch), else
    ACCEPTED."""
    invalid = F.lit(None).cast("string")
    for cond, code in reversed(checks):
        invalid = F.when(cond, F.lit(code)).otherwise(invalid)
    f = feed.withColumn("_invalid", invalid)
    ok = f.where(F.col("_invalid").isNull())
    first = ok.groupBy(*keys).agg(F.min(order).alias("_first"))
    known = target.select(*keys).distinct().withColumn("_in_target", F.lit(True))
    j = f.join(first, keys, "left").join(known, keys, "left")
    status = (F.when(F.col("_invalid").isNotNull(), F.col("_invalid"))
              .when(F.coalesce("_in_target", F.lit(False)) | (F.col(order) != F.col("_first")), "DUPLICATE")
              .otherwise("ACCEPTED"))
    return j.select(order, *keys, status.alias("status"))


def equipment_feed_report(equipment: DataFrame, feed: DataFrame) -> DataFrame:
    """A5 for equipment: size is trimmed; blank or NULL size -> INVALID_SIZE; quantity
    NULL or < 0 -> INVALID_QUANTITY; duplicate (category, size) -> DUPLICATE."""
    f = feed.withColumn("size_label", F.trim("size_label"))
    shop = ["shop_id"] if "shop_id" in feed.columns else []  # a size belongs to its shop where the feed names one
    return insert_report(equipment, f, [*shop, "category", "size_label"], "feed_no", [
        (F.coalesce("size_label", F.lit("")) == "", "INVALID_SIZE"),
        (F.col("total_quantity").isNull() | (F.col("total_quantity") < 0), "INVALID_QUANTITY"),
    ])


def closed_day_report(closed_dates: DataFrame, feed: DataFrame) -> DataFrame:
    """A5 for closed days (feed_no, shop_id, closed_date): no date -> INVALID_DATE; a day on which
    the shop is closed already, or earlier in the feed -> DUPLICATE."""
    return insert_report(closed_dates, feed, ["shop_id", "closed_date"], "feed_no", [(F.col("closed_date").isNull(), "INVALID_DATE")])


def upsert(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last write per key wins (target rows order before all changes).

    Columns that the changes do not name keep the target's value."""
    cols = target.columns
    both = (target.select(*cols, F.lit(0).alias("_src"))
            .unionByName(changes.select(*[F.col(c) if c in changes.columns else F.lit(None).alias(c) for c in cols],
                                        F.lit(1).alias("_src"))))
    rank = F.struct("_src", order)
    kept = [c for c in cols if c not in changes.columns]
    aggs = [F.max_by(F.struct(*[c for c in cols if c != key and c not in kept]), rank).alias("_row")]
    if kept:
        aggs.append(F.max_by(F.struct(*kept), F.when(F.col("_src") == 0, F.lit(0))).alias("_kept"))
    rows = both.groupBy(key).agg(*aggs)
    return rows.select(key, *[F.col(f"_kept.{c}" if c in kept else f"_row.{c}") for c in cols if c != key])


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows (a new version per publish)."""
    return target.unionByName(rows.select(*target.columns))


def apply_equipment_changes(equipment: DataFrame, changes: DataFrame) -> DataFrame:
    """Staff steppers and toggles, in order per item (change_no).

    A step is +1 or -1; a -1 at 0 is ignored, so q <- max(q + d, 0): a
    Lindley recursion, whose final value is ``max(q0 + S_n, S_n - min_k S_k)``
    with S_k the running sum of steps.  Sum and least prefix combine from
    stretches to the whole, so changes are cut into blocks by their number: the
    running sums stay within (item, block), and the few blocks of an item are
    combined after.  An item with most of the changes is no task of its own.
    Toggles flip is_active; only their parity matters.
    """
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = materialize(changes.select("equipment_item_id", "change_no", F.coalesce("delta", F.lit(0)).cast("long").alias("d"),
                                       F.coalesce("toggle", F.lit(False)).cast("int").alias("flip"))
                        .repartitionByRange(parts, "change_no").withColumn("block", F.spark_partition_id()), "equipment-steps")
    within = (Window.partitionBy("equipment_item_id", "block").orderBy("change_no")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = (steps.withColumn("s_k", F.sum("d").over(within)).groupBy("equipment_item_id", "block")
              .agg(F.sum("d").alias("s"), F.min("s_k").alias("low"), F.sum("flip").alias("flips")))
    before = Window.partitionBy("equipment_item_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = (blocks.withColumn("low", F.col("low") + F.coalesce(F.sum("s").over(before), F.lit(0))).groupBy("equipment_item_id")
           .agg(F.sum("s").alias("s_n"), F.min("low").alias("min_s"), F.sum("flips").alias("flips")))
    j = equipment.join(per, equipment.id == per.equipment_item_id, "left")
    qty = F.greatest(F.col("total_quantity") + F.col("s_n"), F.col("s_n") - F.col("min_s"))
    return (j.withColumn("total_quantity", F.coalesce(qty, F.col("total_quantity")).cast("int"))
            .withColumn("is_active", F.when(F.coalesce("flips", F.lit(0)) % 2 == 1, ~F.col("is_active"))
                        .otherwise(F.col("is_active")))
            .drop("equipment_item_id", "s_n", "min_s", "flips"))


def guarded_delete(equipment: DataFrame, items: DataFrame, delete_ids: DataFrame) -> DataFrame:
    """A10: delete requests per equipment id: REFUSED when any reservation item
    references it (FK restrict), NOT_FOUND when absent, else DELETED."""
    used = items.select(F.col("equipment_item_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    known = equipment.select("id").withColumn("_known", F.lit(True))
    j = delete_ids.join(known, "id", "left").join(used, "id", "left")
    return j.select("id", F.when(F.col("_known").isNull(), "NOT_FOUND")
                    .when(F.coalesce("_used", F.lit(False)), "REFUSED").otherwise("DELETED").alias("result"))


def cascade_delete(reservations: DataFrame, children: DataFrame, delete_ids: DataFrame) -> DataFrame:
    """Children left after deleting reservations (ON DELETE CASCADE)."""
    gone = delete_ids.select(F.col("id").alias("reservation_id")).distinct()
    return children.join(gone, "reservation_id", "left_anti")


def delete_by_key(table: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows left after deleting the given keys (of one or more columns)."""
    on = [key] if isinstance(key, str) else key
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def stamp_updated_at(table: DataFrame, changed: DataFrame, key: str, at: Column | dt.datetime) -> DataFrame:
    """Every row present in the change set gets updated_at = ``at``
    (the trigger stamps every UPDATE, even one that changes nothing)."""
    at_c = at if isinstance(at, Column) else F.lit(at)
    hit = changed.select(key).distinct().withColumn("_hit", F.lit(True))
    return (table.join(hit, key, "left")
            .withColumn("updated_at", F.when(F.col("_hit"), at_c).otherwise(F.col("updated_at")))
            .drop("_hit"))
