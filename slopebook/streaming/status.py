"""Reservation status machine as a Structured Streaming job.

Change events (event_id, reservation_id, ts, action in created | confirm |
cancel) stream in; each reservation's state is one row of a streaming
aggregation keyed by reservation_id.  The state is seeded once: the stored
reservations are the first rows of the stream (a second file source, read by the
first micro-batch and never again), so no micro-batch reads the reservations
table.  Rules, as on the staff page: confirm applies only to a pending
reservation, cancel to any reservation not yet cancelled (a repeat cancel is
rejected); 'created' carries no status change.

A status follows from the stored one and from whether a confirm and a cancel
came since, in whatever order: the state is these two counts, the stored status,
and the events of the last micro-batch that had any.  The counts without those
of the micro-batch give the status before it, the places of its first confirm
and cancel that of every event.  Only the events of a micro-batch pass through
Python, once a partition; no reservation is a group there.

An event that is delivered again, in whatever later file, is dropped: event ids
are kept in the state store for ``SEEN_DAYS`` after their first arrival.

Within a micro-batch events are applied in (ts, event_id) order; across
micro-batches in arrival order, so the result equals the batch fold (E12)
when input files arrive in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopebook.streaming.files import batches, next_run, start, write_once

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("reservation_id", T.IntegerType()),
    T.StructField("ts", T.TimestampType()), T.StructField("action", T.StringType()),
])

TRANSITION_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("reservation_id", T.IntegerType()),
    T.StructField("ts", T.TimestampType()), T.StructField("action", T.StringType()),
    T.StructField("old_status", T.StringType()), T.StructField("new_status", T.StringType()),
    T.StructField("applied", T.BooleanType()), T.StructField("result", T.StringType()),
])

#: facts: what a consumer of the transitions wants to know of the reservation, as one text.
SEED_SCHEMA = T.StructType([T.StructField("reservation_id", T.IntegerType()), T.StructField("status", T.StringType()),
                            T.StructField("facts", T.StringType())])
OUT_SCHEMA = T.StructType([*TRANSITION_SCHEMA.fields, T.StructField("facts", T.StringType())])
GROUPED_SCHEMA = "reservation_id int, events array<struct<ts: timestamp, event_id: bigint, action: string>>"
#: Days for which an event's id is remembered.
SEEN_DAYS = 60


def _by_reservation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events of one partition of a micro-batch, as one row a reservation that lists them in (ts, event_id) order."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    keys = ("reservation_id", "ts", "event_id")
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(k, "ascending") for k in keys], null_placement="at_start"))
    ids = rows["reservation_id"]
    number = pc.fill_null(pc.cast(ids, pa.int64()), 1 << 40).to_numpy()  # no int is that large
    firsts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    names = ("ts", "event_id", "action")
    events = pa.StructArray.from_arrays([pa.concat_arrays(rows[c].chunks) for c in names], names)
    lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(number)), pa.int32()), events)
    yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids.take(pa.array(firsts)).chunks), lists], names=["reservation_id", "events"])


def seeds(reservations: DataFrame, facts: Column | None = None) -> DataFrame:
    """The rows that a stream starts with: every stored reservation, its status and ``facts``."""
    text = F.lit(None).cast("string") if facts is None else facts
    return reservations.select(F.col("id").cast("int").alias("reservation_id"), "status", text.alias("facts"))


def once_each(events: DataFrame, key: str, days: int = SEEN_DAYS) -> DataFrame:
    """``events`` without those whose ``key`` arrived before (by arrival, so no event is ever too late)."""
    return (events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", f"{days} days")
            .dropDuplicatesWithinWatermark([key]).drop("_arrived"))


def _count(action: str) -> Column:
    return F.size(F.filter("events", lambda e: e.action == action)).cast("long")


def status_transitions(events: DataFrame, seed_rows: DataFrame, run: int = 0) -> DataFrame:
    """Streaming events -> one transition row per event (with the reservation's facts); to be run in update mode.

    ``run`` numbers the runs of one stream: it ranks what a micro-batch brings above all that came before, also
    where the clock of another driver is behind.
    """
    now = F.struct(F.lit(run).alias("run"), F.current_timestamp().alias("at"))
    changes = (once_each(events, "event_id").select("reservation_id", "ts", "event_id", "action").repartition("reservation_id")
               .mapInArrow(_by_reservation, GROUPED_SCHEMA)
               .select("reservation_id", now.alias("came"), "events", _count("confirm").alias("confirms"), _count("cancel").alias("cancels"),
                       F.lit(None).cast(T.StructType(SEED_SCHEMA.fields[1:])).alias("base")))
    first = seed_rows.select("reservation_id", F.struct("status", "facts").alias("base"))
    known = changes.unionByName(first, allowMissingColumns=True).groupBy("reservation_id").agg(
        F.max("came").alias("came"), F.max_by("events", "came").alias("events"), F.sum("confirms").alias("confirms"),
        F.sum("cancels").alias("cancels"), F.max("base").alias("base"))
    # A row comes out when its micro-batch had events for it, or its seed; a clock set back within a run would mix them up.
    own = F.when(F.col("came") == now, F.col("events")).otherwise(F.raise_error(F.lit("the clock went back; start the stream again")))
    known = known.where("came is not null").withColumn("events", own)
    status, actions = F.col("base.status"), F.transform("events", lambda e: e.action)
    before = (F.when(status.isNull(), None).when(F.col("cancels") > _count("cancel"), "cancelled")
              .when((status == "pending") & (F.col("confirms") > _count("confirm")), "confirmed").otherwise(status))
    per = known.select("reservation_id", before.alias("before"), F.col("base.facts").alias("facts"),
                       *(F.array_position(actions, a).alias(a) for a in ("confirm", "cancel")), F.posexplode("events").alias("nth", "e"))

    def earlier(action):
        return (F.col(action) > 0) & (F.col("nth") >= F.col(action))   # nth counts from 0, the place of the action from 1
    old, action = F.col("old_status"), F.col("action")
    per = per.select("e.event_id", "reservation_id", "e.ts", "e.action", "facts",
                     F.when(F.col("before").isNull(), None).when(earlier("cancel"), "cancelled")
                     .when((F.col("before") == "pending") & earlier("confirm"), "confirmed").otherwise(F.col("before")).alias("old_status"))
    applied = F.coalesce(((action == "confirm") & (old == "pending")) | ((action == "cancel") & (old != "cancelled")), F.lit(False))
    new = F.when(F.col("applied"), F.when(action == "confirm", "confirmed").otherwise("cancelled")).otherwise(old)
    result = (F.when(F.col("applied"), "OK").when(action == "confirm", "NOT_PENDING")
              .when(action == "cancel", F.when(old.isNull(), "NOT_FOUND").otherwise("ALREADY_CANCELLED")).otherwise("NO_CHANGE"))
    return per.withColumn("applied", applied).withColumn("new_status", new).withColumn("result", result).select(*OUT_SCHEMA.fieldNames())


def transition_stream(spark: SparkSession, events_dir: str, seed_rows: DataFrame, checkpoint: str, max_files_per_trigger: int) -> DataFrame:
    """The transitions of the files in ``events_dir``; ``seed_rows`` are written beside the checkpoint once and read by the first micro-batch."""
    from slopebook.plans.session import prefer_rocksdb_state
    prefer_rocksdb_state(spark)
    first = spark.readStream.schema(SEED_SCHEMA).parquet(write_once(seed_rows, f"{checkpoint}-seeds"))
    events = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(events_dir)
    return status_transitions(events, first, next_run(spark, f"{checkpoint}-runs"))


def run_status_stream(spark: SparkSession, events_dir: str, reservations: DataFrame, out_dir: str, checkpoint: str,
                      max_files_per_trigger: int = 1) -> DataFrame:
    """Run J2 over the files in ``events_dir`` until they are consumed; return the transitions.

    A micro-batch writes its own ``batch_id=<epoch>`` folder with overwrite, so one replayed replaces its output.
    """
    transitions = transition_stream(spark, events_dir, seeds(reservations), checkpoint, max_files_per_trigger).drop("facts")

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out_dir}/batch_id={epoch}")
    q = start(transitions.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
              .trigger(availableNow=True), spark, f"{checkpoint}-seeds")
    q.awaitTermination()
    return batches(spark, out_dir, TRANSITION_SCHEMA)
