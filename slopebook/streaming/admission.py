"""Streaming admission of v2 booking requests, state per day of a shop's category.

Each micro-batch does three things:

1. Stateless: the row-level checks of E5 (closed days of the request's own shop
   included), and the cells (shop, category, day) that a request needs.
2. Keyed state, as streaming aggregations: the members booked per cell, and the
   codes given out before.  The stored reservations and their codes are the first
   rows of both.  A request touches its cells with nothing booked, so their use
   comes out; no request passes through a group, and no key is a shop.
3. ``foreachBatch``: the micro-batch is decided by the rounds of
   :func:`slopebook.operators.admission.settle`, as a batch would be.  The
   decisions go to ``batch_id=<epoch>``, and the bookings of the accepted to the
   feedback folder, a second source of the same stream: the next micro-batch
   adds them to its cells.

A micro-batch starts after the one before has ended, so it always sees all
bookings made before it.  One replayed after a failure overwrites its own
folders, from the same state.  A request id that arrives again gives no second
decision for ``SEEN_DAYS``; its cells and its code are read without that check,
which changes neither.  There is no watermark on request times: a late request is
decided, never dropped.  Without a fixed ``as_of`` every micro-batch uses its own
current date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopebook.functions import pgcompat as pg
from slopebook.operators import admission as adm
from slopebook.operators import occupancy as occ
from slopebook.operators import requests as rq
from slopebook.plans.session import materialize
from slopebook.streaming.files import batches, next_run, start, write_once
from slopebook.streaming.status import once_each

DECISION_SCHEMA = T.StructType([
    T.StructField("request_id", T.IntegerType()), T.StructField("shop_id", T.IntegerType()), T.StructField("accepted", T.BooleanType()),
    T.StructField("code", T.StringType()), T.StructField("reservation_code", T.StringType()),
])
#: One row of a micro-batch.  request: a request as such, with what it needs; code: a code that nobody had before;
#: used: the members booked on a cell before this micro-batch.
ROW_SCHEMA = ("kind string, request_id int, shop_id int, requested_at timestamp, consumer boolean, code string, from date, end date, "
              "needs array<struct<category: string, need: int>>, week string, slot int, n long, reservation_code string")
FEEDBACK_SCHEMA = T.StructType([T.StructField("week", T.StringType()), T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())])
CODE_SCHEMA = T.StructType([T.StructField("reservation_code", T.StringType())])
#: Days for which a request's id is remembered.
SEEN_DAYS = 150
MONDAY = dt.date(2000, 1, 3)


def week_key(category, day):
    number = F.floor(F.datediff(day, F.lit(MONDAY)) / 7).cast("string")
    return F.concat_ws("|", F.coalesce(F.col("shop_id").cast("string"), F.lit("<NULL>")), F.coalesce(category, F.lit("<NULL>")), number)


def slot_of(day):
    return F.pmod(F.datediff(day, F.lit(MONDAY)), F.lit(7)).cast("int")


def seeds(reservations: DataFrame, members: DataFrame) -> DataFrame:
    """week, slot, n: members booked per day by the stored reservations."""
    day = F.col("day")
    return occ.daily_occupancy(reservations, members).select(week_key(F.col("category"), day).alias("week"), slot_of(day).alias("slot"),
                                                             F.col("used").cast("long").alias("n"))


def typed(rows: DataFrame, **columns) -> DataFrame:
    """``rows`` with the columns of ROW_SCHEMA; those that are not given come from ``rows`` or are empty."""
    return rows.select(*[columns.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in T._parse_datatype_string(ROW_SCHEMA).fields])


def prepare(requests: DataFrame, closed: DataFrame, as_of: dt.date | None) -> DataFrame:
    """Per request what is decided without the stock: its code, whether its member rows insert, its needs and its first reservation code."""
    today = F.current_date() if as_of is None else F.lit(as_of)
    return rq.coded_v2(requests.join(closed, "shop_id", "left"), today).select(
        "request_id", "shop_id", "requested_at", "code", occ.occupied_from(F.col("eve_pickup"), F.col("start")).alias("from"), "end",
        rq.members_ok().alias("consumer"), rq.type_needs().alias("needs"), pg.reservation_code(F.col("request_id")).alias("reservation_code"))


def needed_cells(prepared: DataFrame) -> DataFrame:
    """One row per cell that a request needs, of those that passed the checks before the stock."""
    per = (prepared.where("code is null").select("request_id", "shop_id", "requested_at", "consumer", "from", "end", F.explode("needs").alias("c"))
           .select("*", F.explode(F.sequence("from", "end")).alias("day")))
    day = F.col("day")
    return per.select("request_id", "shop_id", "requested_at", "consumer", "day", F.col("c.category").alias("category"),
                      F.col("c.need").cast("int").alias("need"), week_key(F.col("c.category"), day).alias("week"), slot_of(day).alias("slot"))


def cells_in_use(booked: DataFrame, asked: DataFrame) -> DataFrame:
    """week, slot, n: the members booked on every cell that ``booked`` changes or ``asked`` needs in a micro-batch."""
    touched = asked.select("week", "slot", F.lit(0).cast("long").alias("n"))
    return booked.select("week", "slot", "n").unionByName(touched).groupBy("week", "slot").agg(F.sum("n").alias("n"))


def new_codes(asked: DataFrame, stored: DataFrame, run: int) -> DataFrame:
    """reservation_code: those of ``asked`` that neither ``stored`` nor an earlier micro-batch has (``run``: see J2)."""
    now = F.struct(F.lit(run).alias("run"), F.current_timestamp().alias("at"))
    rows = (asked.select("reservation_code", now.alias("came"), F.lit(False).alias("stored"))
            .unionByName(stored.select("reservation_code", F.lit(True).alias("stored")), allowMissingColumns=True))
    known = rows.groupBy("reservation_code").agg(F.min("came").alias("first"), F.max("came").alias("last"), F.max("stored").alias("stored"))
    return known.where((F.col("first") == now) & (F.col("last") == now) & ~F.col("stored")).select("reservation_code")


def decide(batch: DataFrame, epoch: int, stock: DataFrame, out_dir: str, feedback_dir: str) -> None:
    """Decide one micro-batch and book what it accepts."""
    rows = materialize(batch, "j3-batch")   # written once: reading the batch again would step the state again
    asked = rows.where("kind = 'request'").select("request_id", "shop_id", "requested_at", "code", "reservation_code", "consumer", "from", "end", "needs")
    if asked.limit(1).count() == 0:
        return
    fresh = rows.where("kind = 'code'").select("reservation_code").distinct().withColumn("is_new", F.lit(True))
    first = Window.partitionBy("reservation_code").orderBy(*adm.ORDER)
    coded = (asked.join(fresh, "reservation_code", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)) & (F.row_number().over(first) == 1))
             .withColumn("reservation_code", rq.distinct_code(F.col("reservation_code"), F.col("request_id"), F.col("is_new"))))
    used = rows.where("kind = 'used'").select("week", "slot", F.col("n").cast("int").alias("used"))
    needs = needed_cells(asked)
    state = needs.join(used, ["week", "slot"]).join(stock, ["shop_id", "category"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    own = F.when(F.col("code").isNull() & ~F.col("consumer"), F.lit(adm.MEMBER_ROWS_REJECTED))
    codes = adm.settle(adm.unsafe(adm.v2_cells(state)))
    answers = materialize(adm.answer(coded.select("request_id", "shop_id", "code", "reservation_code", own.alias("own")), codes), "j3-answers")
    answers.select(*[F.col(f.name).cast(f.dataType) for f in DECISION_SCHEMA.fields]).write.mode("overwrite").parquet(f"{out_dir}/batch_id={epoch}")
    booked = needs.join(answers.where("accepted").select("request_id"), "request_id", "left_semi")
    booked.groupBy("week", "slot").agg(F.sum("need").cast("long").alias("n")).write.mode("overwrite").parquet(f"{feedback_dir}/batch_id={epoch}")


def run_admission_stream(spark: SparkSession, requests_dir: str, schema: T.StructType, equipment: DataFrame,
                         reservations: DataFrame, members: DataFrame, closed_dates: DataFrame,
                         as_of: dt.date | None, out_dir: str, checkpoint: str,
                         max_files_per_trigger: int = 1) -> DataFrame:
    """Run J3 until all files in ``requests_dir`` are decided; return the decisions."""
    from slopebook.plans.session import prefer_rocksdb_state
    prefer_rocksdb_state(spark)
    feedback = f"{checkpoint}-feedback"
    # The stored bookings are the first ones of the folder that later micro-batches write to.
    write_once(seeds(reservations, members), f"{feedback}/batch_id=-1")
    known = reservations.select("reservation_code") if "reservation_code" in reservations.columns else spark.createDataFrame([], CODE_SCHEMA)
    stored_codes = spark.readStream.schema(CODE_SCHEMA).parquet(write_once(known.where("reservation_code is not null"), f"{checkpoint}-codes"))
    closed, stock = (materialize(x, f"j3-{n}") for n, x in (("closed", rq.closed_days(closed_dates)), ("stock", occ.category_stock(equipment))))
    arrived = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(requests_dir)
    requests = typed(prepare(once_each(arrived, "request_id", SEEN_DAYS), closed, as_of), kind=F.lit("request"))
    booked = spark.readStream.schema(FEEDBACK_SCHEMA).parquet(feedback)
    used = typed(cells_in_use(booked, needed_cells(prepare(arrived, closed, as_of))), kind=F.lit("used"))
    asked_codes = arrived.select(pg.reservation_code(F.col("request_id")).alias("reservation_code"))
    codes = typed(new_codes(asked_codes, stored_codes, next_run(spark, f"{checkpoint}-runs")), kind=F.lit("code"))
    rows = requests.unionByName(used).unionByName(codes)
    # Bookings come back through the feedback folder, so the stream runs until neither source has more.
    q = start(rows.writeStream.foreachBatch(lambda df, epoch: decide(df, epoch, stock, out_dir, feedback)).outputMode("update")
              .option("checkpointLocation", checkpoint), spark, f"{checkpoint}-codes")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return batches(spark, out_dir, DECISION_SCHEMA)
