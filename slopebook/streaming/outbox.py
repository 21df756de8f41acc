"""Notification outbox fed by the status stream.

Each micro-batch of transitions becomes change rows (inserts for 'created'
events, updates for applied status changes) and goes through the batch
operator E15 inside ``foreachBatch``.  What a mail says of its reservation and
members travels with the keyed state (seeded once from the stored tables), so a
micro-batch reads neither table.

A mail is sent once: a micro-batch writes its rows to its own
``batch_id=<epoch>`` folder with overwrite, so one replayed after a failure
replaces its own output, and an event delivered again in a later file is
dropped by its id before it reaches the state.  No event is too late: a late one
still produces its mail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopebook.operators import notify
from slopebook.plans.session import materialize
from slopebook.streaming import status as st
from slopebook.streaming.files import batches, start

OUTBOX_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("reservation_id", T.IntegerType()), T.StructField("recipient", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("html", T.StringType()),
])
OUTBOX_COLUMNS = [f.name for f in OUTBOX_SCHEMA.fields]
RESERVATION_FACTS = ("shop_id", "reservation_code", "rental_date", "return_date", "eve_pickup", "customer_name", "customer_phone",
                     "customer_email", "party_size", "adults", "children", "notes")
MEMBER_FACTS = ("member_no", "is_child", "nickname", "height_cm", "shoe_cm", "board_type", "set_type", "addons")


def changes_from_transitions(tr: DataFrame) -> DataFrame:
    ins = tr.where(F.col("action") == "created").select(
        "event_id", "reservation_id", F.lit("insert").alias("op"),
        F.lit(None).cast("string").alias("old_status"), F.col("new_status"))
    upd = tr.where(F.col("applied")).select(
        "event_id", "reservation_id", F.lit("update").alias("op"), "old_status", "new_status")
    return ins.unionByName(upd)


def facts_type(reservations: DataFrame, members: DataFrame) -> T.StructType:
    """What the stream carries of a reservation: its own columns and its members (at most 20 by rule)."""
    of = T.StructType([members.schema[c] for c in MEMBER_FACTS])
    return T.StructType([*(reservations.schema[c] for c in RESERVATION_FACTS), T.StructField("members", T.ArrayType(of))])


def seeds(reservations: DataFrame, members: DataFrame) -> DataFrame:
    per = members.groupBy("reservation_id").agg(F.collect_list(F.struct(*MEMBER_FACTS)).alias("members"))
    whole = reservations.join(per, reservations.id == per.reservation_id, "left").drop("reservation_id")
    return st.seeds(whole, F.to_json(F.struct(*RESERVATION_FACTS, "members")))


def write_outbox_batch(batch: DataFrame, epoch: int, outbox_dir: str, facts: T.StructType, shops: DataFrame) -> None:
    # Written first: the batch is read several times below, and its state must be stepped once.
    rows = materialize(batch.where("action = 'created' or applied"), "outbox-batch")
    told = (rows.where("facts is not null").select("reservation_id", "facts").dropDuplicates(["reservation_id"])
            .select("reservation_id", F.from_json("facts", facts).alias("f")))
    reservations = told.select(F.col("reservation_id").alias("id"), *(F.col(f"f.{c}").alias(c) for c in RESERVATION_FACTS))
    members = told.select("reservation_id", F.explode("f.members").alias("m")).select("reservation_id", *(F.col(f"m.{c}").alias(c) for c in MEMBER_FACTS))
    mails = notify.notification_outbox(changes_from_transitions(rows), reservations, members, shops)
    mails.select(*OUTBOX_COLUMNS).write.mode("overwrite").parquet(f"{outbox_dir}/batch_id={epoch}")


def run_outbox_stream(spark: SparkSession, events_dir: str, reservations: DataFrame, members: DataFrame,
                      shops: DataFrame, outbox_dir: str, checkpoint: str,
                      max_files_per_trigger: int = 1) -> DataFrame:
    """Run J1 over the files in ``events_dir`` until they are consumed; return the outbox."""
    transitions = st.transition_stream(spark, events_dir, seeds(reservations, members), checkpoint, max_files_per_trigger)
    facts, shops = facts_type(reservations, members), materialize(shops, "outbox-shops")
    q = start(transitions.writeStream.foreachBatch(lambda df, epoch: write_outbox_batch(df, epoch, outbox_dir, facts, shops))
              .outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True), spark, f"{checkpoint}-seeds")
    q.awaitTermination()
    return batches(spark, outbox_dir, OUTBOX_SCHEMA)
