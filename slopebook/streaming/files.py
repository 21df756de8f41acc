"""Feeding streaming jobs from stored tables: files that arrive in time order."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from slopebook.plans.session import ensure_checkpoint_dir, file_system


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of one input file, about; a micro-batch has as many times the files it takes, however large the table.
ROWS_PER_FILE = 100_000


def files_at_once(spark: SparkSession) -> int:
    """Files of one micro-batch: one a core, so that reading it is not one task.  Its size follows the cluster, not the table."""
    return spark.sparkContext.defaultParallelism


def write_in_time_order(df: DataFrame, path: str, *order: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Write ``df`` as files of about ``rows_per_file`` rows, each holding the next stretch by ``order``; how many.

    One range-partitioned job: more rows make more files, not larger ones, and
    rows of one time are split by the next column of ``order``.  A file source
    takes files by their times, so these are set to follow the order (the store
    must keep times that are set, as HDFS and local disks do).
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // rows_per_file))
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(path)
    fs, p = file_system(spark, path)
    files = sorted((f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    first = int(time.time() * 1000) - 1000 * len(files)
    for k, file in enumerate(files):
        fs.setTimes(file, first + 1000 * k, -1)
    return len(files)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def write_once(df: DataFrame, path: str) -> str:
    """Write ``df`` to ``path`` unless an earlier run did: what a restarted stream reads must not change."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return path


def next_run(spark: SparkSession, path: str) -> int:
    """The number of this run of a stream, counted from 0 by folders under ``path``."""
    fs, p = file_system(spark, path)
    done = [int(f.getPath().getName()) for f in fs.listStatus(p)] if fs.exists(p) else []
    run = max(done, default=-1) + 1
    fs.mkdirs(file_system(spark, f"{path}/{run}")[1])
    return run


#: Bytes of seeds, as stored, that one state partition takes.
SEED_BYTES = 32 << 20


def start(writer: DataStreamWriter, spark: SparkSession, seeds: str) -> StreamingQuery:
    """Start a stream with two state partitions a core, and more as its seeds grow.

    Every micro-batch opens and commits each state partition of each keyed operator, so their number is not that
    of the largest batch shuffle.  A restarted stream keeps the number it began with.
    """
    fs, p = file_system(spark, seeds)
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-fs.getContentSummary(p).getLength() // SEED_BYTES))
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(parts))
    try:
        return writer.start()   # takes a copy of the settings
    finally:
        spark.conf.set(key, before)


def batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows under ``path``, one folder a micro-batch (without the column that numbers them); empty if none was written."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*[F.col(f.name) for f in schema.fields])
