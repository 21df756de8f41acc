"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver's tables through the fixture derivations
(``slopebook.sources.fixtures``) and runs one operator over the whole data.
The oracle SQL for the same names lives in ``slopebook.oracle``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopebook.operators import occupancy
from slopebook.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _base(spark, d):
    return fx.load_all(spark, d)


@register("e3_daily_occupancy")
def q_e3(spark, d):
    t = _base(spark, d)
    return occupancy.daily_occupancy(t["reservations"], t["members"])


def windows_from_reservations(reservations: DataFrame) -> DataFrame:
    """Availability questions: each reservation's own period asked again (raw end)."""
    return reservations.select(F.col("id").alias("window_id"), "shop_id",
                               F.col("rental_date").alias("start"), F.col("return_date").alias("end"),
                               F.col("eve_pickup").alias("eve"))


@register("e2_availability_by_category")
def q_e2(spark, d):
    t = _base(spark, d)
    return occupancy.availability_by_category(t["equipment"], t["reservations"], t["members"],
                                              windows_from_reservations(t["reservations"]))


@register("e1_availability_by_size")
def q_e1(spark, d):
    t = _base(spark, d)
    dates = t["reservations"].select("shop_id", F.col("rental_date").alias("date"))
    return occupancy.availability_by_size(t["equipment"], t["reservations"], t["items"], dates)


# --- requests: validation, capacity, admission (E4-E8, A8) -----------------

from slopebook.operators import admission, requests as rq  # noqa: E402

# New requests arrive from the middle of the tables' years on; bookings made before that are the state.
CUTOFF = dt.datetime(1998, 1, 1)


@register("e5_validate_v2")
def q_e5(spark, d):
    return rq.validate_requests_v2(fx.table(spark, d, "fx_requests_v2"), fx.table(spark, d, "fx_closed_dates"), fx.AS_OF)


def _valid_v2(spark, d):
    req = fx.table(spark, d, "fx_requests_v2")
    return rq.with_v2_code(req, fx.table(spark, d, "fx_closed_dates"), fx.AS_OF).where(F.col("code").isNull()).drop("code")


@register("e6_capacity_check")
def q_e6(spark, d):
    t = _base(spark, d)
    return rq.capacity_check(_valid_v2(spark, d), t["equipment"], t["reservations"], t["members"])


@register("e4_validate_v1")
def q_e4(spark, d):
    t = _base(spark, d)
    return rq.validate_requests_v1(fx.table(spark, d, "fx_requests_v1"), t["closed_dates"], t["equipment"],
                                   t["reservations"], t["items"], fx.AS_OF)


@register("e4_validate_v1_summed")
def q_e4s(spark, d):
    t = _base(spark, d)
    return rq.validate_requests_v1(fx.table(spark, d, "fx_requests_v1"), t["closed_dates"], t["equipment"],
                                   t["reservations"], t["items"], fx.AS_OF, faithful=False)


@register("e7_admit")
def q_e7(spark, d):
    t = _base(spark, d)
    req = fx.table(spark, d, "fx_requests_v2").where(F.col("requested_at") >= F.lit(CUTOFF))
    state = t["reservations"].where(F.col("created_at") < F.lit(CUTOFF))
    return admission.admit(req, t["equipment"], state, t["members"], t["closed_dates"], fx.AS_OF)


def _v1_admission(spark, d, faithful):
    t = _base(spark, d)
    req = fx.table(spark, d, "fx_requests_v1").where(F.col("requested_at") >= F.lit(CUTOFF))
    state = t["reservations"].where(F.col("created_at") < F.lit(CUTOFF))
    return admission.admit_v1(req, t["equipment"], state, t["items"], t["closed_dates"], fx.AS_OF, faithful)


@register("e7_admit_v1")
def q_e7v1(spark, d):
    return _v1_admission(spark, d, True)


@register("e7_admit_v1_summed")
def q_e7v1s(spark, d):
    return _v1_admission(spark, d, False)


@register("e8_code_collisions")
def q_e8(spark, d):
    return rq.code_collisions(rq.reservation_rows(fx.table(spark, d, "fx_requests_v2")))


@register("e8_unique_codes")
def q_e8u(spark, d):
    """Codes of all requests next to the stored reservations made before them: none is given twice."""
    req = fx.table(spark, d, "fx_requests_v2").where(F.col("requested_at") >= F.lit(CUTOFF))
    known = fx.table(spark, d, "fx_requests_v2").where(F.col("requested_at") < F.lit(CUTOFF))
    stored = rq.reservation_rows(known).select("id", "reservation_code").dropDuplicates(["reservation_code"])
    return rq.distinct_codes(req, stored).select("request_id", "reservation_code")


@register("a8_reservation_rows")
def q_a8r(spark, d):
    return rq.reservation_rows(fx.table(spark, d, "fx_requests_v2"))


@register("a8_member_rows")
def q_a8m(spark, d):
    m = rq.member_rows(fx.table(spark, d, "fx_requests_v2"))
    # Compared columns are scalars: addons as text, the numeric(4,1) as text.
    return m.withColumn("addons", F.concat_ws(",", "addons")).withColumn("shoe_cm", F.col("shoe_cm").cast("string"))


@register("a8_member_rows_json")
def q_a8j(spark, d):
    """Member rows of requests whose members arrive as JSON text."""
    bodies = fx.table(spark, d, "fx_requests_v2").select("request_id", F.to_json("members").alias("body"))
    m = rq.member_rows(bodies.select("request_id", rq.members_from_json(F.col("body")).alias("members")))
    return m.withColumn("addons", F.concat_ws(",", "addons")).withColumn("shoe_cm", F.col("shoe_cm").cast("string"))


# --- lookup, cancel, status, pricing, notifications (E9-E15, B6) -----------

from slopebook.operators import lifecycle, notify, pricing  # noqa: E402


@register("b6_lookup_keys")
def q_b6(spark, d):
    lk = fx.table(spark, d, "fx_lookups")
    return lk.select("lookup_id", lifecycle.lookup_code(F.col("code")).alias("code"),
                     lifecycle.lookup_phone(F.col("phone")).alias("phone"),
                     lifecycle.phone_digits(F.col("phone")).alias("phone_digits"))


@register("e9_lookup_v1")
def q_e9(spark, d):
    t = _base(spark, d)
    return lifecycle.lookup_v1(fx.table(spark, d, "fx_lookups"), t["reservations"], t["items"], t["equipment"])


@register("e10_lookup_v2")
def q_e10(spark, d):
    t = _base(spark, d)
    return lifecycle.lookup_v2(fx.table(spark, d, "fx_lookups"), t["reservations"], t["members"])


@register("e11_cancel_results")
def q_e11r(spark, d):
    t = _base(spark, d)
    return lifecycle.cancel(fx.table(spark, d, "fx_cancel_requests"), t["reservations"])[0]


@register("e11_cancel_reservations")
def q_e11u(spark, d):
    t = _base(spark, d)
    upd = lifecycle.cancel(fx.table(spark, d, "fx_cancel_requests"), t["reservations"])[1]
    return upd.select("id", "status", "cancelled_at", "updated_at")


def _staff_changes(spark, d):
    return fx.table(spark, d, "fx_status_events").where(F.col("action").isin("confirm", "cancel"))


@register("e12_status_changes")
def q_e12(spark, d):
    t = _base(spark, d)
    upd = lifecycle.apply_status_changes(t["reservations"], _staff_changes(spark, d))
    return upd.select("id", "status", "cancelled_at", "updated_at")


@register("e13_price_members")
def q_e13m(spark, d):
    t = _base(spark, d)
    return pricing.price_members(t["reservations"], t["members"])


@register("e13_price_reservations")
def q_e13r(spark, d):
    t = _base(spark, d)
    return pricing.price_reservations(t["reservations"], t["members"])


@register("e14_member_lines")
def q_e14(spark, d):
    t = _base(spark, d)
    return notify.member_lines(t["members"])


@register("e15_notification_outbox")
def q_e15(spark, d):
    t = _base(spark, d)
    changes = lifecycle.change_events(fx.table(spark, d, "fx_status_events"))
    return notify.notification_outbox(changes, t["reservations"], t["members"],
                                      notify.shops_from(t["reservations"]))


# --- table maintenance (A1-A13) ---------------------------------------------

from slopebook.functions import pgcompat as pg  # noqa: E402
from slopebook.operators import lists, maintenance as mt, pages  # noqa: E402
from slopebook.sources import schemas, store  # noqa: E402

STAMP_AT = dt.datetime(2025, 1, 1)
STAFF_DAY = dt.date(2025, 1, 15)


@register("a2_conform_legacy_reservations")
def q_a2(spark, d):
    legacy = fx.table(spark, d, "fx_reservations").select(
        "id", "shop_id", "reservation_code", "rental_date", "customer_name", "customer_phone",
        "customer_email", "party_size", "status", "notes", "created_at", "updated_at", "cancelled_at")
    return schemas.conform(legacy, schemas.RESERVATIONS, schemas.DEFAULTS["reservations"])


@register("a3_constraint_audit")
def q_a3(spark, d):
    t = _base(spark, d)
    # Audit the rows a batch of v2 requests would write next to the base tables.
    req = fx.table(spark, d, "fx_requests_v2")
    res = rq.reservation_rows(req)
    return mt.audit(t["equipment"], res, t["items"], rq.member_rows(req), t["closed_dates"])


@register("a3_broken_audit")
def q_a3b(spark, d):
    """The audit over tables with defects planted by id: every constraint is broken somewhere."""
    t = _base(spark, d)
    i, rid, eid = F.col("id"), F.col("reservation_id"), F.col("equipment_item_id")
    eq = t["equipment"].select(
        F.when(i % 31 == 0, i - 1).otherwise(i).alias("id"), "shop_id",
        F.when(i % 37 == 0, "sled").otherwise(F.col("category")).alias("category"),
        F.when(i % 29 == 0, "dup").when(i % 61 != 0, F.col("size_label")).alias("size_label"),
        F.when(i % 41 == 0, -1).when(i % 43 != 0, F.col("total_quantity")).alias("total_quantity"), "is_active")
    res = t["reservations"].select(
        "id", F.when(i % 53 == 0, "YR-DUP").otherwise(F.col("reservation_code")).alias("reservation_code"), "rental_date", "customer_name",
        F.when(i % 61 != 0, F.col("customer_phone")).alias("customer_phone"),
        F.when(i % 19 == 0, 0).otherwise(F.col("party_size")).alias("party_size"),
        F.when(i % 23 == 0, "lost").when(i % 59 != 0, F.col("status")).alias("status"), "eve_pickup")
    items = t["items"].select(
        F.when(rid % 73 == 0, -rid).otherwise(rid).alias("reservation_id"), F.when(eid % 79 == 0, -eid).otherwise(eid).alias("equipment_item_id"),
        F.when(rid % 71 == 0, 0).otherwise(F.col("quantity")).alias("quantity"))
    mem = t["members"].select(
        F.when(rid % 53 == 0, -rid).otherwise(rid).alias("reservation_id"), F.when(rid % 59 != 0, F.col("member_no")).alias("member_no"),
        F.when(rid % 31 == 0, 300).when(rid % 37 != 0, F.col("height_cm")).alias("height_cm"),
        F.when(rid % 41 == 0, F.lit(33.5).cast("decimal(4,1)")).otherwise(F.col("shoe_cm")).alias("shoe_cm"),
        F.when(rid % 43 == 0, "sled").when(rid % 47 != 0, F.col("board_type")).alias("board_type"))
    closed = t["closed_dates"].select("shop_id", "closed_date")
    return mt.audit(eq, res.union(res.where(i % 67 == 0)), items, mem, closed.union(closed.where(F.dayofmonth("closed_date") % 2 == 0)))


def _valid_feed(spark, d):
    f = fx.table(spark, d, "fx_equipment_feed").withColumn("size_label", F.trim("size_label"))
    return f.where((F.col("size_label") != "") & (F.col("total_quantity") >= 0))


@register("a4_insert_ignore")
def q_a4(spark, d):
    t = _base(spark, d)
    target = t["equipment"].select("shop_id", "category", "size_label", "total_quantity")
    return mt.insert_ignore(target, _valid_feed(spark, d), ["shop_id", "category", "size_label"], "feed_no")


@register("a5_insert_report")
def q_a5(spark, d):
    t = _base(spark, d)
    return mt.equipment_feed_report(t["equipment"], fx.table(spark, d, "fx_equipment_feed"))


#: A third of the versions, in every part of the table, are changes to the rest.
_CHANGED, _KEPT = "id % 3 = 0", "id % 3 <> 0"


@register("a6_upsert_pages")
def q_a6(spark, d):
    pv = fx.table(spark, d, "fx_pages")
    target = pv.where(_KEPT).select("page_key", "html", F.col("id").alias("version_id"))
    changes = pv.where(_CHANGED).select("page_key", "html", F.col("id").alias("version_id"))
    return mt.upsert(target, changes, "page_key", "version_id")


@register("a9_equipment_changes")
def q_a9(spark, d):
    t = _base(spark, d)
    out = mt.apply_equipment_changes(t["equipment"], fx.table(spark, d, "fx_equipment_changes"))
    return out.select("id", "total_quantity", "is_active")


def _delete_ids(spark, d):
    e = fx.table(spark, d, "fx_equipment")
    return (e.where(~F.col("is_active")).select("id")
            .unionByName(e.where(F.col("id") % 50 == 0).select((F.col("id") + 1000000).alias("id"))))


@register("a10_guarded_delete")
def q_a10(spark, d):
    t = _base(spark, d)
    return mt.guarded_delete(t["equipment"], t["items"], _delete_ids(spark, d))


@register("a11_cascade_delete")
def q_a11(spark, d):
    t = _base(spark, d)
    gone = t["reservations"].where(F.col("status") == "cancelled").select("id")
    return mt.cascade_delete(t["reservations"], t["members"], gone).select("reservation_id", "member_no")


@register("a11_cascade_parents_and_items")
def q_a11p(spark, d):
    t = _base(spark, d)
    gone = t["reservations"].where(F.col("status") == "cancelled").select("id")
    left = mt.delete_by_key(t["reservations"], gone, "id").select("id")
    items = mt.cascade_delete(t["reservations"], t["items"], gone)
    return (left.select(F.lit("reservations").alias("table_name"), "id", F.lit(None).cast("int").alias("equipment_item_id"))
            .unionByName(items.select(F.lit("reservation_items").alias("table_name"), F.col("reservation_id").alias("id"), "equipment_item_id")))


@register("a5_closed_day_report")
def q_a5c(spark, d):
    feed = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").cast("long").alias("feed_no"), (F.col("o_custkey") % fx.N_SHOPS).cast("int").alias("shop_id"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate").cast("date")).alias("closed_date"))
    return mt.closed_day_report(fx.table(spark, d, "fx_closed_dates"), feed)


@register("a8_item_rows")
def q_a8i(spark, d):
    return rq.item_rows(fx.table(spark, d, "fx_requests_v1"))


@register("a12_delete_closed_days")
def q_a12(spark, d):
    c = fx.table(spark, d, "fx_closed_dates")
    return mt.delete_by_key(c, c.where(F.col("closed_date") < F.lit(fx.AS_OF)), ["shop_id", "closed_date"])


@register("a13_stamp_updated_at")
def q_a13(spark, d):
    t = _base(spark, d)
    changed = fx.table(spark, d, "fx_status_events").select(F.col("reservation_id").alias("id"))
    return mt.stamp_updated_at(t["reservations"], changed, "id", STAMP_AT).select("id", "updated_at")


# --- lists and texts (B1-B5, E16, E17) ----------------------------------------

@register("b1_inventory_list")
def q_b1(spark, d):
    return lists.inventory_list(_base(spark, d)["equipment"]).select(
        "id", "shop_id", "position", "category", "size_label", "total_quantity", "is_active")


@register("b2_visible_anon_equipment")
def q_b2(spark, d):
    return lists.visible(_base(spark, d)["equipment"], "equipment_items", "anon").select(
        "id", "category", "size_label", "total_quantity")


@register("b3_upcoming_closed")
def q_b3(spark, d):
    return lists.upcoming_closed(fx.table(spark, d, "fx_closed_dates"), fx.AS_OF)


@register("b4_staff_list")
def q_b4(spark, d):
    t = _base(spark, d)
    return lists.staff_list(t["reservations"], t["members"], t["items"], t["equipment"], STAFF_DAY, "active")


@register("b4_staff_list_all")
def q_b4a(spark, d):
    t = _base(spark, d)
    return lists.staff_list(t["reservations"], t["members"], t["items"], t["equipment"], None, "all")


@register("b5_day_list")
def q_b5(spark, d):
    t = _base(spark, d)
    r = lists.day_list(t["reservations"], t["items"], t["equipment"], STAFF_DAY)
    return r.select("id", "shop_id", "position", "reservation_code", "rental_date", "customer_name", "customer_phone",
                    "party_size", "status", "items_text")


@register("d11_list_count")
def q_d11(spark, d):
    return lists.list_count(_base(spark, d)["reservations"], STAFF_DAY)


@register("e17_reject_messages")
def q_e17(spark, d):
    codes = rq.validate_requests_v2(fx.table(spark, d, "fx_requests_v2"), fx.table(spark, d, "fx_closed_dates"), fx.AS_OF)
    return codes.where(F.col("code").isNotNull()).select(
        "request_id", "code", lists.reject_message(F.col("code")).alias("message"))


# --- pages (B7, B8, E18-E20, E24, E25, E27) -----------------------------------

def _empty_pages(spark):
    return spark.createDataFrame([], "page_key string, html string, css string, project_data string, "
                                     "updated_at timestamp, updated_by string, version_id bigint")


@register("e18_publish_pages")
def q_e18(spark, d):
    pv = fx.table(spark, d, "fx_pages")
    cur, _ = pages.publish(_empty_pages(spark), pv.limit(0), pv)
    return cur.select("page_key", "version_id", "updated_at", "html", "css")


@register("e19_latest_versions")
def q_e19(spark, d):
    return pages.latest_versions(fx.table(spark, d, "fx_pages"), 20)


@register("e20_restore_version")
def q_e20(spark, d):
    pv = fx.table(spark, d, "fx_pages")
    cur, _ = pages.publish(_empty_pages(spark), pv.limit(0), pv)
    reqs = pv.where(F.col("id") % 7 == 0).select(
        (F.col("id") + 1000000).alias("request_id"), F.col("id").alias("version_id"),
        (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("requested_at"), F.lit("staff").alias("requested_by"))
    restored, _ = pages.restore(cur, pv, reqs)
    return restored.select("page_key", "version_id", "updated_at")


@register("b7_page_by_key")
def q_b7(spark, d):
    pv = fx.table(spark, d, "fx_pages")
    cur, _ = pages.publish(_empty_pages(spark), pv.limit(0), pv)
    keys = spark.read.parquet(f"{d}/pages.parquet").select(
        F.concat(F.lit("page-"), (F.col("page_id") % 50).cast("string")).alias("page_key")).distinct()
    return pages.page_by_key(cur, keys).select("page_key", "version_id")


@register("b7_version_by_id")
def q_b7v(spark, d):
    ids = spark.read.parquet(f"{d}/pages.parquet").select((F.col("page_id") * 2).cast("long").alias("id"))
    return pages.version_by_id(fx.table(spark, d, "fx_pages"), ids).select("id", "page_key", "created_at")


@register("b8_layout_class")
def q_b8(spark, d):
    pv = fx.table(spark, d, "fx_pages")
    return pv.select("id", pages.layout_class(F.col("html"), F.col("css")).alias("layout"))


REWRITE_RULES = dict(phone="000-0000-0000", old_handle="old_shop", new_handle="@new_shop")


@register("e24_rewrite_html")
def q_e24(spark, d):
    pv = fx.table(spark, d, "fx_pages").select("id", "html")
    return pages.rewrite_html(pv, pages.default_rewrite_rules(**REWRITE_RULES))


@register("e25_first_style")
def q_e25s(spark, d):
    return fx.table(spark, d, "fx_pages").select("id", pages.first_style(F.col("html")).alias("style"))


@register("e25_root_html")
def q_e25r(spark, d):
    return pages.extract_root_html(fx.table(spark, d, "fx_pages").select("id", "html")).select("id", "root_html")


@register("e27_version_nav")
def q_e27(spark, d):
    return pages.version_nav(fx.table(spark, d, "fx_pages"))


# --- translation (E21-E23) ----------------------------------------------------

from slopebook.operators import markup, translate as tr  # noqa: E402
from slopebook.sources.dictionary import sample_dictionary  # noqa: E402


@register("e21_translate_documents")
def q_e21(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return tr.translate(docs, "text", "en", sample_dictionary(spark)).select("doc_id", "translated", "display")


@register("e22_translate_pages")
def q_e22(spark, d):
    pv = fx.table(spark, d, "fx_pages").select("id", "html")
    out, _nodes = tr.translate_pages(pv, "en", sample_dictionary(spark))
    return out.select("id", "html")


@register("e23_language_blocks")
def q_e23(spark, d):
    return tr.select_language_blocks(fx.table(spark, d, "fx_pages").select("id", "html"), "en")


# --- site pages: pages that every page rule acts on -------------------------------

def _site_pages(spark, d):
    return fx.table(spark, d, "fx_site_pages")


@register("b8_site_layout")
def q_b8s(spark, d):
    return _site_pages(spark, d).select("id", pages.layout_class(F.col("html"), F.lit("")).alias("layout"))


@register("e21_site_texts")
def q_e21s(spark, d):
    texts = fx.table(spark, d, "fx_site_texts")
    return tr.translate(texts, "text", "en", sample_dictionary(spark)).select("id", "translated", "display")


@register("e22_site_translate")
def q_e22s(spark, d):
    return tr.translate_pages(_site_pages(spark, d), "en", sample_dictionary(spark))[0].select("id", "html")


@register("e23_site_blocks")
def q_e23s(spark, d):
    return tr.select_language_blocks(_site_pages(spark, d), "en").select("id", "html")


@register("e24_site_rewrite")
def q_e24s(spark, d):
    return pages.rewrite_html(_site_pages(spark, d), pages.default_rewrite_rules(**REWRITE_RULES)).select("id", "html", "n_rules_hit")


@register("e24_site_elements")
def q_e24e(spark, d):
    return markup.rewrite_elements(fx.table(spark, d, "fx_hook_pages"), markup.repair_rules(**REWRITE_RULES, button_html="<svg/>TEL"))


@register("e25_site_style")
def q_e25ss(spark, d):
    return _site_pages(spark, d).select("id", pages.first_style(F.col("html")).alias("style"))


@register("e25_site_root")
def q_e25sr(spark, d):
    return pages.extract_root_html(_site_pages(spark, d)).select("id", "root_html")


# --- status transitions and streaming jobs (J1-J3) ------------------------------

from slopebook.sources import schemas as _schemas  # noqa: E402
from slopebook.streaming import admission as s_adm, files as s_files, outbox as s_out, status as s_st  # noqa: E402


@register("e12_status_transitions")
def q_e12t(spark, d):
    t = _base(spark, d)
    return lifecycle.status_transitions(fx.table(spark, d, "fx_status_events"), t["reservations"])


@register("j2_status_stream")
def q_j2(spark, d):
    t = _base(spark, d)
    root = s_files.scratch(spark, "j2")
    s_files.write_in_time_order(fx.table(spark, d, "fx_status_events"), f"{root}/in", "ts", "event_id")
    return s_st.run_status_stream(spark, f"{root}/in", t["reservations"], f"{root}/out", f"{root}/ckpt", s_files.files_at_once(spark))


@register("j1_outbox_stream")
def q_j1(spark, d):
    t = _base(spark, d)
    root = s_files.scratch(spark, "j1")
    s_files.write_in_time_order(fx.table(spark, d, "fx_status_events"), f"{root}/in", "ts", "event_id")
    return s_out.run_outbox_stream(spark, f"{root}/in", t["reservations"], t["members"],
                                   notify.shops_from(t["reservations"]), f"{root}/outbox", f"{root}/ckpt", s_files.files_at_once(spark))


@register("j3_admission_stream")
def q_j3(spark, d):
    t = _base(spark, d)
    root = s_files.scratch(spark, "j3")
    req = fx.table(spark, d, "fx_requests_v2").where(F.col("requested_at") >= F.lit(CUTOFF))
    s_files.write_in_time_order(req, f"{root}/in", "requested_at", "request_id")
    state = t["reservations"].where(F.col("created_at") < F.lit(CUTOFF))
    schema = fx.table(spark, d, "fx_requests_v2").schema
    out = s_adm.run_admission_stream(spark, f"{root}/in", schema, t["equipment"], state, t["members"],
                                     t["closed_dates"], fx.AS_OF, f"{root}/out", f"{root}/ckpt", s_files.files_at_once(spark))
    return out.select("request_id", "shop_id", "accepted", "code", "reservation_code")


# --- typed scan and version append (A1, A7) --------------------------------------

@register("a1_scan_equipment")
def q_a1(spark, d):
    return schemas.scan(spark, fx.stored(spark, d, "fx_equipment"), "equipment_items")


@register("a7_append_versions")
def q_a7(spark, d):
    pv = fx.table(spark, d, "fx_pages")
    cols = ["id", "page_key", "created_at"]
    return mt.append(pv.where(_KEPT).select(*cols), pv.where(_CHANGED).select(*cols))


@register("a7_stored_versions")
def q_a7s(spark, d):
    """The stored version table after two publishes: the second only adds files."""
    folder = _published(spark, d)
    return store.read(spark, f"{folder}/versions", store.VERSIONS).select("id", "page_key", "created_at")


@register("e18_stored_pages")
def q_e18s(spark, d):
    """The stored pages after two publishes: the second rewrites the partitions of its pages."""
    folder = _published(spark, d)
    return store.read(spark, f"{folder}/pages", store.CURRENT).select("page_key", "version_id", "updated_at", "html", "css")


def _published(spark, d):
    pv = fx.table(spark, d, "fx_pages")
    folder = s_files.scratch(spark, "pages")
    store.create_pages(spark, folder)
    store.publish(spark, folder, pv.where(_KEPT))
    store.publish(spark, folder, pv.where(_CHANGED))
    return folder


@register("a3_site_audit")
def q_a3s(spark, d):
    """The audit of settings, pages and versions, with defects planted by id."""
    pv = fx.table(spark, d, "fx_pages")
    i = F.col("id")
    versions = pv.select(F.when(i % 11 == 0, i - 1).otherwise(i).alias("id"), F.when(i % 13 != 0, F.col("page_key")).alias("page_key"),
                         F.when(i % 7 != 0, F.col("html")).alias("html"), "css", F.when(i % 17 != 0, F.col("project_data")).alias("project_data"), "created_at")
    site = pv.select("page_key", F.when(i % 5 != 0, F.col("html")).alias("html"), "css", "project_data").where(i < 60)
    settings = pv.select(F.when(i % 9 == 0, 2).otherwise(1).cast("smallint").alias("id"), F.when(i % 4 != 0, F.lit("08:30")).alias("open_time"),
                         F.lit("18:00").alias("close_time"), F.lit(90).alias("max_advance_days"), (i % 25).cast("int").alias("shop_id"))
    return mt.audit_site(settings, site, versions)


@register("b2_visible_rows")
def q_b2r(spark, d):
    """How many rows of every table each role can read."""
    t = _base(spark, d)
    pv = fx.table(spark, d, "fx_pages")
    tables = {"equipment_items": t["equipment"], "closed_dates": t["closed_dates"], "reservations": t["reservations"], "reservation_items": t["items"],
              "reservation_members": t["members"], "site_pages": pv.select("page_key").distinct(), "site_page_versions": pv}
    out = [lists.visible(df, name, role).select(F.lit(name).alias("table_name"), F.lit(role).alias("role")).groupBy("table_name", "role")
           .agg(F.count(F.lit(1)).alias("n")) for name, df in tables.items() for role in ("anon", "staff")]
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    return both


@register("asset_names")
def q_assets(spark, d):
    """Safe storage names of files that are called after pages' urls."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", pg.safe_asset_name(F.col("url")).alias("name"))

@register("e16_lookup_card")
def q_e16l(spark, d):
    t = _base(spark, d)
    return lists.lookup_card(fx.table(spark, d, "fx_lookups"), t["reservations"], t["members"])
