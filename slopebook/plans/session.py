"""Spark session settings shared by tests, bench and the registry.

Everything here is ordinary session configuration: AQE on (runtime join
strategy, partition coalescing, skew-join splitting), UTC session zone, UI
off, Arrow for the pandas paths.  The checkpoint folder is taken from the
session when the cluster names one (``spark.checkpoint.dir``); only when it
is unset (local tests) do we point it at a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "slopebook") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SLOPEBOOK_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates, the same for every call of a session.

    ``spark.checkpoint.dir`` of the session; else the folder set on the
    context; else (local tests only) a new scratch folder.
    """
    sc = spark.sparkContext
    current = (spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_slopebook_shared", None)
               or sc.getCheckpointDir() or tempfile.mkdtemp(prefix="slopebook-ckpt-"))
    sc._slopebook_shared = current
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and its path object: the one that Spark itself reads through."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as parquet in the shared checkpoint folder.

    Columnar and compressed, so cheaper than ``Dataset.checkpoint()`` (which
    serialises rows); like it, the result survives executor loss.  Each call
    writes a fresh folder.
    """
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/materialized/{name}-{uuid.uuid4().hex[:12]}"
    spark.sparkContext.__dict__.setdefault("_slopebook_written", []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    # With the schema given, an empty result reads back as an empty table.
    out = spark.read.schema(df.schema).parquet(path)
    out._slopebook_path = path
    return out


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def step(df, name: str, done=()):
    """``materialize``, for jobs of many steps: the shuffle files of the write go when it ends, and
    what was written for the frames ``done``, which nothing reads after ``df``, is deleted."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        out = materialize(df, name)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    discard(*done)
    return out


def discard(*frames) -> None:
    """Delete what ``materialize`` wrote for these frames (as it returned them)."""
    for df in frames:
        fs, p = file_system(df.sparkSession, df._slopebook_path)
        fs.delete(p, True)
        written = df.sparkSession.sparkContext.__dict__.get("_slopebook_written", [])
        if df._slopebook_path in written:
            written.remove(df._slopebook_path)


def drop_materialized(spark: SparkSession) -> int:
    """Delete what ``materialize`` wrote in this session, once no result that reads it is needed; how many folders."""
    written = spark.sparkContext.__dict__.pop("_slopebook_written", [])
    for path in written:
        fs, p = file_system(spark, path)
        fs.delete(p, True)
    return len(written)


def ship_package(spark: SparkSession) -> None:
    """Make ``slopebook`` importable in Python workers (pandas UDFs, grouped
    maps, streaming state functions): zip the package once per session and
    ``addPyFile`` it, so Spark copies it to every executor."""
    import hashlib
    import zipfile
    sc = spark.sparkContext
    if getattr(sc, "_slopebook_shipped", False):
        return
    pkg = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    files = sorted(os.path.join(r, f) for r, _d, fs in os.walk(pkg) for f in fs if f.endswith(".py"))
    digest = hashlib.sha256()
    for f in files:
        with open(f, "rb") as fh:
            digest.update(f.encode() + fh.read())
    root = ensure_checkpoint_dir(spark)
    folder = root if "://" not in root else tempfile.mkdtemp(prefix="slopebook-pyfiles-")
    os.makedirs(os.path.join(folder, "pyfiles"), exist_ok=True)
    path = os.path.join(folder, "pyfiles", f"slopebook-{digest.hexdigest()[:16]}.zip")
    if not os.path.exists(path):
        tmp = path + ".part"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, os.path.join("slopebook", os.path.relpath(f, pkg)))
        os.replace(tmp, path)
    sc.addPyFile(path)
    sc._slopebook_shipped = True


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prefer_rocksdb_state(spark: SparkSession) -> None:
    """Keyed streaming state (one entry per reservation or shop) can grow to
    many millions of keys: use the RocksDB state store (off-heap, incremental
    checkpoints) unless the cluster already chose a provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if not current or current.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB_PROVIDER)
