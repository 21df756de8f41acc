"""Goods catalogue -> SKU rows.

The reference keeps its catalogue as a page constant (categories in a fixed
order, each with four variants).  Here the catalogue is a DataFrame
(category, position, name, price, variants array), so any shop's catalogue
table works; one SKU row per variant, numbered from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sku_rows(goods: DataFrame) -> DataFrame:
    """category, variant_no, name (category name + variant), price, in catalogue order."""
    return (goods.select("category", "position", "name", "price", F.posexplode("variants").alias("i", "variant"))
            .select("category", "position", (F.col("i") + 1).alias("variant_no"),
                    F.concat_ws(" ", "name", "variant").alias("name"), "price")
            .orderBy("position", "variant_no"))
