"""Stored tables that grow and change: partitioned snapshots, real appends, publishing one page.

A table is a folder of parquet files partitioned by ``bucket``, a hash of its
key (or by any column).  An append adds files; an upsert reads and rewrites
only the partitions that hold changed keys, by dynamic partition overwrite.  A
reader that lists a partition while it is replaced may see the old or the new
files; callers that need snapshots publish from one writer, as the site does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopebook.operators import maintenance as mt
from slopebook.plans.session import materialize

#: Partitions of a page table; a publish rewrites those of its keys.
BUCKETS = 64
BUCKET = "bucket"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def save(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a table anew, one task a partition."""
    df.withColumn(BUCKET, bucket_of(F.col(key), buckets)).repartition(buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def append(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Add rows; no stored file is read or rewritten."""
    rows.withColumn(BUCKET, bucket_of(F.col(key), buckets)).repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: a stored table in its declared schema (no footer is read for it); ``bucket`` prunes folders."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)


def upsert(spark: SparkSession, path: str, schema: T.StructType, changes: DataFrame, key: str, order: str, buckets: int = BUCKETS) -> list[int]:
    """A6 on a stored table: the last write per key stays; returns the partitions that were rewritten.

    ``order`` (a column of the table too) tells which of several changes is the last.
    """
    changes = materialize(changes.withColumn(BUCKET, bucket_of(F.col(key), buckets)), "store-changes")
    touched = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    kept = read(spark, path, schema).where(F.col(BUCKET).isin(touched))
    new = materialize(mt.upsert(kept.drop(BUCKET), changes.drop(BUCKET), key, order), "store-upsert")
    (new.withColumn(BUCKET, bucket_of(F.col(key), buckets)).repartition(len(touched), BUCKET)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))
    return touched


#: The stored page tables: the current page per key, and every version.
CURRENT = T.StructType([T.StructField("page_key", T.StringType()), T.StructField("html", T.StringType()), T.StructField("css", T.StringType()),
                        T.StructField("project_data", T.StringType()), T.StructField("updated_at", T.TimestampType()),
                        T.StructField("updated_by", T.StringType()), T.StructField("version_id", T.LongType())])
VERSIONS = T.StructType([T.StructField("id", T.LongType()), T.StructField("page_key", T.StringType()), T.StructField("html", T.StringType()),
                         T.StructField("css", T.StringType()), T.StructField("project_data", T.StringType()),
                         T.StructField("created_at", T.TimestampType()), T.StructField("created_by", T.StringType())])


def create_pages(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
    """Empty page tables."""
    for name, schema in (("pages", CURRENT), ("versions", VERSIONS)):
        spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).write.mode("overwrite").parquet(f"{folder}/{name}")


def publish(spark: SparkSession, folder: str, changes: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """E18 on stored tables: append every change as a version, then rewrite the partitions of its pages."""
    rows = materialize(changes.select(*[F.col(f.name).cast(f.dataType) for f in VERSIONS.fields]), "store-publish")
    append(rows, f"{folder}/versions", "page_key", buckets)
    cur = rows.select("page_key", "html", "css", "project_data", F.col("created_at").alias("updated_at"), F.col("created_by").alias("updated_by"),
                      F.col("id").alias("version_id"))
    return upsert(spark, f"{folder}/pages", CURRENT, cur, "page_key", "version_id", buckets)
