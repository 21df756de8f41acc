"""A small ja -> en / zh dictionary for the translator.

The translator takes its dictionary as a DataFrame parameter; this sample
covers the staff and booking labels used by this package.  Sites load their
own dictionary table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLE = [
    ("予約一覧", "Reservations", "預約列表"),
    ("受付中", "Pending", "受理中"),
    ("確定", "Confirmed", "已確認"),
    ("キャンセル", "Cancel", "取消"),
    ("予約番号", "Booking code", "預約編號"),
    ("ご利用期間", "Rental period", "租借期間"),
    ("お名前", "Name", "姓名"),
    ("人数", "Party", "人數"),
    ("前日受け取り", "Day-before pickup", "前一天取件"),
    ("在庫", "Stock", "庫存"),
]


def sample_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE, "ja string, en string, zh string")
