"""Declared schemas of the booking tables (A1) and schema evolution (A2).

The tables are plain row tables with a fixed schema that grows by adding
nullable columns with defaults.  ``load`` reads parquet in the declared
schema (a column missing in some files reads as NULL there and ``conform``
fills its default); ``conform`` brings any DataFrame to a target schema.
``shop_id`` is our scale-out key: every shop-scoped table carries it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, B, D, TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.DateType(), T.TimestampType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


# Key columns are kept as strings in the reference (uuid).  Fixtures use ints;
# ``conform`` casts to the declared type, so both work.
EQUIPMENT_ITEMS = T.StructType([
    _f("id", I, False), _f("shop_id", I), _f("category", S, False), _f("size_label", S, False),
    _f("total_quantity", I, False), _f("is_active", B, False), _f("notes", S),
    _f("created_at", TS), _f("updated_at", TS),
])

CLOSED_DATES = T.StructType([_f("shop_id", I), _f("closed_date", D, False), _f("reason", S), _f("created_at", TS)])

BUSINESS_SETTINGS = T.StructType([
    _f("id", T.ShortType(), False), _f("open_time", S, False), _f("close_time", S, False),
    _f("max_advance_days", I, False), _f("updated_at", TS),
])

RESERVATIONS = T.StructType([
    _f("id", I, False), _f("shop_id", I), _f("reservation_code", S, False), _f("rental_date", D, False),
    _f("return_date", D), _f("eve_pickup", B, False),
    _f("customer_name", S, False), _f("customer_phone", S, False), _f("customer_email", S),
    _f("party_size", I), _f("adults", I), _f("children", I), _f("status", S, False), _f("notes", S),
    _f("created_at", TS), _f("updated_at", TS), _f("cancelled_at", TS),
])

RESERVATION_ITEMS = T.StructType([
    _f("reservation_id", I, False), _f("equipment_item_id", I, False), _f("quantity", I, False),
])

RESERVATION_MEMBERS = T.StructType([
    _f("reservation_id", I, False), _f("member_no", I, False), _f("height_cm", I, False),
    _f("shoe_cm", T.DecimalType(4, 1), False), _f("board_type", S, False), _f("is_child", B, False),
    _f("age", I), _f("gender", S), _f("stance", S), _f("nickname", S), _f("set_type", S),
    _f("addons", T.ArrayType(S), False),
])

SITE_PAGES = T.StructType([
    _f("page_key", S, False), _f("html", S, False), _f("css", S, False), _f("project_data", S, False),
    _f("updated_at", TS), _f("updated_by", S),
])

SITE_PAGE_VERSIONS = T.StructType([
    _f("id", T.LongType(), False), _f("page_key", S, False), _f("html", S, False), _f("css", S, False),
    _f("project_data", S, False), _f("created_at", TS), _f("created_by", S),
])

MEMBER_REQUEST = T.StructType([
    _f("height_cm", S), _f("shoe_cm", S), _f("board_type", S), _f("is_child", S), _f("age", S),
    _f("gender", S), _f("stance", S), _f("nickname", S), _f("set_type", S), _f("addons", T.ArrayType(S)),
])

REQUESTS_V2 = T.StructType([
    _f("request_id", I, False), _f("shop_id", I), _f("requested_at", TS), _f("start", D), _f("end", D),
    _f("name", S), _f("phone", S), _f("email", S), _f("adults", I), _f("children", I),
    _f("members", T.ArrayType(MEMBER_REQUEST)), _f("notes", S), _f("eve_pickup", B),
])

REQUESTS_V1 = T.StructType([
    _f("request_id", I, False), _f("shop_id", I), _f("requested_at", TS), _f("rental_date", D),
    _f("customer_name", S), _f("customer_phone", S), _f("customer_email", S), _f("party_size", I),
    _f("items", T.ArrayType(T.StructType([_f("equipment_item_id", S), _f("quantity", S)]))),
    _f("notes", S),
])

TABLES = {
    "equipment_items": EQUIPMENT_ITEMS,
    "closed_dates": CLOSED_DATES,
    "business_settings": BUSINESS_SETTINGS,
    "reservations": RESERVATIONS,
    "reservation_items": RESERVATION_ITEMS,
    "reservation_members": RESERVATION_MEMBERS,
    "site_pages": SITE_PAGES,
    "site_page_versions": SITE_PAGE_VERSIONS,
}

# Defaults of columns added by later schema versions (fixed values of the
# reference's ``add column if not exists ... default``).
DEFAULTS: dict[str, dict[str, object]] = {
    "equipment_items": {"is_active": True},
    "reservations": {"eve_pickup": False, "status": "pending"},
    "reservation_members": {"addons": [], "is_child": False},
    "business_settings": {"open_time": "08:30", "close_time": "18:00", "max_advance_days": 90},
}


def _default_col(value: object, dtype: T.DataType) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast(dtype)
    return F.lit(value).cast(dtype)


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """A2: project ``df`` onto ``schema``: cast present columns, add missing ones.

    Missing columns get their default, else NULL.  Present-but-NULL values of a
    column with a default also take the default (``not null default`` columns).
    A value that does not fit its type is an error, as in an insert: it never
    becomes a default or NULL.  Extra columns are dropped.  Pure projection: no shuffle, stays in codegen.
    """
    defaults = defaults or {}
    have = {c.lower(): c for c in df.columns}
    cols = []
    for field in schema.fields:
        src = have.get(field.name.lower())
        default = _default_col(defaults[field.name], field.dataType) if field.name in defaults else None
        if src is None:
            expr = default if default is not None else F.lit(None)
        else:
            expr = F.col(src)
            if default is not None:
                expr = F.coalesce(expr.cast(field.dataType), default)
        cols.append(expr.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A1: scan the files of one base table in its declared schema.

    The schema is given, so no file's footer is read to find it; a file
    written before a column was added has NULL there, which takes the default.
    """
    schema = TABLES[name]
    return conform(spark.read.schema(schema).parquet(path), schema, DEFAULTS.get(name))


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A1: :func:`scan` of a base table in a directory of tables."""
    return scan(spark, f"{directory}/{name}.parquet", name)
