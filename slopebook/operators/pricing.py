"""Member and reservation prices.

The price tables are fixed and tiny, so they are literal map expressions
(no join, no broadcast): every price is computed in the member row's own
projection, inside whole-stage codegen.  Addon sums use ``aggregate`` over
the addon array (unknown key = 0, a repeated key counts each time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (JPY).  Set price for 1..4 days, then a per-day add from day 5.
SET_PRICES = {
    "full": {"adult": [6500, 12000, 17000, 22000], "child": [4000, 7000, 9500, 12000],
             "add_adult": 5500, "add_child": 3000},
    "gliding": {"adult": [3500, 6000, 8000, 10000], "child": [2500, 4000, 5000, 6000],
                "add_adult": 2500, "add_child": 2000},
}
# Fixed values (JPY per day) and staff-list labels of the addons.
ADDONS = {
    "wear_top": ("ウェア（上）", 2000),
    "wear_btm": ("ウェア（下）", 2000),
    "helmet": ("ヘルメット", 1000),
    "goggle": ("ゴーグル", 1000),
    "sled": ("ソリ", 500),
    "snowshoe": ("スノーシュー", 2000),
    "harness": ("キッズ用ハーネス", 1500),
}


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def rental_days(rental_date: Column, return_date: Column) -> Column:
    """Days charged: return - rental + 1 (NULL return = one day); the eve day is free."""
    return F.datediff(F.coalesce(return_date, rental_date), rental_date) + 1


def addon_sum(addons: Column) -> Column:
    prices = _map({k: v[1] for k, v in ADDONS.items()})
    return F.aggregate(F.coalesce(addons, F.array().cast("array<string>")), F.lit(0),
                       lambda acc, k: acc + F.coalesce(F.element_at(prices, k), F.lit(0)))


def member_price(set_type: Column, is_child: Column, addons: Column, days: Column) -> Column:
    """Price of one member for ``days`` days, NULL when it cannot be priced."""
    adults = {k: F.array(*[F.lit(x) for x in v["adult"]]) for k, v in SET_PRICES.items()}
    childs = {k: F.array(*[F.lit(x) for x in v["child"]]) for k, v in SET_PRICES.items()}
    base = F.lit(None).cast("array<int>")
    add = F.lit(None).cast("int")
    for k in SET_PRICES:
        base = F.when(set_type == k, F.when(is_child, childs[k]).otherwise(adults[k])).otherwise(base)
        add = F.when(set_type == k, F.when(is_child, F.lit(SET_PRICES[k]["add_child"]))
                     .otherwise(F.lit(SET_PRICES[k]["add_adult"]))).otherwise(add)
    set_price = F.when(days <= 4, F.element_at(base, F.greatest(days, F.lit(1)))) \
        .otherwise(F.element_at(base, 4) + (days - 4) * add)
    n_addons = F.coalesce(F.size(addons), F.lit(0))
    priced = (F.when(days.isNull() | (days < 1), F.lit(None))
              .when(set_type == "none", F.when(n_addons == 0, F.lit(None)).otherwise(addon_sum(addons) * days))
              .when(set_type.isin(*SET_PRICES), set_price + addon_sum(addons) * days))
    return priced.cast("long")


def price_members(reservations: DataFrame, members: DataFrame) -> DataFrame:
    """reservation_id, member_no, price."""
    r = reservations.select(F.col("id").alias("reservation_id"),
                            rental_days(F.col("rental_date"), F.col("return_date")).alias("days"))
    return (members.join(r, "reservation_id")
            .select("reservation_id", "member_no",
                    member_price(F.col("set_type"), F.col("is_child"), F.col("addons"), F.col("days"))
                    .alias("price")))


def price_reservations(reservations: DataFrame, members: DataFrame) -> DataFrame:
    """Total shown only when every member has a price; reservations with members only."""
    p = price_members(reservations, members)
    return (p.groupBy("reservation_id")
            .agg(F.sum("price").alias("s"), F.bool_and(F.col("price").isNotNull()).alias("all_priced"))
            .select("reservation_id", F.when(F.col("all_priced"), F.col("s")).alias("total"), "all_priced"))
