"""Sequential admission of booking requests (v2 by members, v1 by items).

The reference serialises every booking behind one global lock: each accepted
request uses stock that later requests see.  The answer depends on order,
so a plain aggregate is wrong.  Exact plan, the same for both versions:

1. The row-level checks give codes to requests that fail before the stock loop.
2. The rest expand to cells - (shop, category, day) for v2, (item, day) for v1 -
   with their need.  A *consumer* is a request whose rows would insert if the
   stock suffices; others are checked against stock but never use it.
3. A cell is *safe* when current use plus the need of all consumers touching it,
   plus the largest need of a non-consumer touching it, fits the stock: it can
   reject nobody.  Only the rows of unsafe cells go on.
4. Rounds over the unsafe cells (``settle``): a consumer is accepted when even
   all undecided requests before it leave room in each of its cells, and
   rejected when the accepted ones before it alone leave none in one of them.
   The earliest undecided request is decided in every round, so rounds end;
   each is one running sum per cell, and no shop is a group.  When at most
   ``PASS_ROWS`` rows are undecided, one ordered pass decides them.
   Running sums have two levels: rows are cut into blocks by request order, a
   row's sum is the one within its (cell, block) plus the cell's blocks before,
   so a cell that most requests ask for is no task of its own.
5. With the accepted known, one running sum per cell gives every other
   request its first failing cell, and so its code.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopebook.operators import occupancy as occ
from slopebook.operators import requests as rq
from slopebook.plans.session import materialize

MEMBER_ROWS_REJECTED = "INVALID_MEMBER_DATA"
#: Undecided rows that the ordered pass takes; with more, another round is run.
PASS_ROWS = 100_000
ORDER = ("requested_at", "request_id")


def _ordered_pass(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Accepted request ids of one lane's rows, which come sorted by (requested_at, request_id)."""
    extra: dict[str, int] = {}
    accepted: list[int] = []
    current, cells, fits, last = None, [], True, None

    def finish():
        if current is not None and fits:
            for cell, add in cells:
                extra[cell] = extra.get(cell, 0) + add
            accepted.append(current)

    for pdf in rows:
        columns = (pdf[c].to_numpy() for c in ("request_id", "requested_at", "cell", "need", "add", "used", "total"))
        for rid, at, cell, need, add, used, total in zip(*columns):
            if last is not None and (at, rid) < last:
                raise RuntimeError("admission rows are not in request order")
            last = (at, rid)
            if current != rid:
                finish()
                current, cells, fits = int(rid), [], True
            fits = fits and used + extra.get(cell, 0) + need <= total
            cells.append((cell, int(add)))
    finish()
    yield pd.DataFrame({"request_id": pd.Series(accepted, dtype="int64")})


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``, ascending in request order; blocks are of about equal size and span all cells.

    To be written before use: the number of a block is that of its partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *ORDER).withColumn("block", F.spark_partition_id())


def with_sums_before(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` (cell, block and the order columns) with, for each name, the sum of its value over the
    rows of the same cell that come earlier in request order."""
    of = {f"_{k}": F.coalesce(v, F.lit(0)) for k, v in values.items()}
    rows = rows.withColumns(of)
    before = Window.partitionBy("cell").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (rows.groupBy("cell", "block").agg(*(F.sum(c).alias(c) for c in of))
              .select("cell", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in of)))
    within = Window.partitionBy("cell", "block").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({k: F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)) for k in values})
    return (local.join(blocks, ["cell", "block"]).withColumns({k: F.col(k) + F.col(f"__{k}") for k in values})
            .drop(*of, *(f"_{c}" for c in of)))


def settle(cells: DataFrame) -> DataFrame:
    """request_id, code of every request of ``cells``: NULL if its stock suffices in request order.

    cells: request_id, lane (requests that share a cell share it), requested_at,
    consumer, cell (text), block (see :func:`in_blocks`), place (sorts a request's cells),
    fail (the code if this cell fails), need (tested), add (used when accepted), used, total.
    """
    rows = materialize(cells.where("consumer").select("request_id", "lane", "requested_at", "cell", "block", "need", "add", "used", "total",
                                                      F.lit(False).alias("accepted")), "admission-round")
    while rows.where("not accepted").count() > PASS_ROWS:
        tested = with_sums_before(rows, low=F.when(F.col("accepted"), F.col("add")), high=F.col("add")).where("not accepted")
        decided = (tested.groupBy("request_id").agg(F.max(F.col("used") + F.col("low") + F.col("need") > F.col("total")).alias("out"),
                                                    F.min(F.col("used") + F.col("high") + F.col("need") <= F.col("total")).alias("in")))
        rows = materialize(rows.join(decided, "request_id", "left").where(~F.coalesce("out", F.lit(False)))
                           .withColumn("accepted", F.col("accepted") | F.coalesce("in", F.lit(False))).drop("out", "in"), "admission-round")
    open_rows = (with_sums_before(rows, low=F.when(F.col("accepted"), F.col("add"))).withColumn("used", F.col("used") + F.col("low"))
                 .where("not accepted").drop("low", "block"))
    passed = (open_rows.repartition("lane").sortWithinPartitions("lane", *ORDER)
              .groupBy("lane").applyInPandas(_ordered_pass, "request_id long"))
    accepted = rows.where("accepted").select("request_id").distinct().union(passed).withColumn("accepted", F.lit(True))
    known = cells.join(accepted, "request_id", "left")
    failed = (with_sums_before(known, low=F.when(F.col("accepted"), F.col("add")))
              .where(F.col("accepted").isNull() & (F.col("used") + F.col("low") + F.col("need") > F.col("total"))))
    codes = failed.groupBy("request_id").agg(F.min(F.struct("place", "fail")).alias("f"))
    return cells.select("request_id").distinct().join(codes, "request_id", "left").select("request_id", F.col("f.fail").alias("code"))


def unsafe(cells: DataFrame) -> DataFrame:
    """The rows of cells that may reject somebody: demand per cell first, then only their rows are read."""
    demand = (cells.groupBy("cell").agg(
        F.sum(F.when(F.col("consumer"), F.col("add")).otherwise(0)).alias("demand"),
        F.max(F.when(F.col("consumer"), F.col("need") - F.col("add")).otherwise(F.col("need"))).alias("probe"),
        F.max("used").alias("u"), F.min("total").alias("t"))
        .where(F.col("u") + F.col("demand") + F.greatest("probe", F.lit(0)) > F.col("t")).select("cell"))
    return materialize(in_blocks(materialize(cells.join(demand, "cell", "left_semi"), "admission-unsafe")), "admission-cells")


def answer(requests: DataFrame, codes: DataFrame) -> DataFrame:
    """Admission rows of ``requests`` (request_id, shop_id, code before the stock, own: code after it, reservation_code)."""
    return (requests.join(codes.withColumnRenamed("code", "stock"), "request_id", "left")
            .select("request_id", "shop_id", F.coalesce("code", "stock", "own").alias("code"), "reservation_code")
            .select("request_id", "shop_id", F.col("code").isNull().alias("accepted"), "code",
                    F.when(F.col("code").isNull(), F.col("reservation_code")).alias("reservation_code")))


def v2_cells(state: DataFrame) -> DataFrame:
    """The input of :func:`settle` (without block) from (request, category, day) rows with their need, use and stock."""
    return state.select(
        "request_id", F.col("shop_id").alias("lane"), "requested_at", "consumer", "used", "total", "need", F.col("need").alias("add"),
        F.concat_ws("|", "shop_id", F.coalesce("category", F.lit("<NULL>")), "day").alias("cell"),
        F.struct(F.col("category").isNull().alias("no_category"), "category", "day").alias("place"),
        rq.out_of_stock_code(F.col("category"), F.col("day")).alias("fail"))


def admit(requests: DataFrame, equipment: DataFrame, reservations: DataFrame, members: DataFrame,
          closed_dates: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """Decide every v2 request in (requested_at, request_id) order per shop.

    Returns request_id, shop_id, accepted, code, reservation_code (E8, only
    for accepted requests; no two requests or stored reservations share one).
    """
    # Request-level facts, computed once (the member checks are array
    # lambdas) and written, so the members arrays are read once.
    req = materialize(
        rq.with_v2_code(requests, closed_dates, as_of)
        .select("request_id", "shop_id", "requested_at", "code", "end",
                occ.occupied_from(F.col("eve_pickup"), F.col("start")).alias("from"),
                rq.members_ok().alias("consumer"), rq.type_needs().alias("needs")),
        "admission-requests")
    cand = req.where(F.col("code").isNull())
    state = rq.cells_with_state(rq.cells_from_needs(cand, ("consumer",)), equipment, reservations, members)
    own = F.when(F.col("code").isNull() & ~F.col("consumer"), F.lit(MEMBER_ROWS_REJECTED))
    coded = rq.distinct_codes(req, reservations)
    return answer(coded.select("request_id", "shop_id", "code", "reservation_code", own.alias("own")), settle(unsafe(v2_cells(state))))


def admit_v1(requests: DataFrame, equipment: DataFrame, reservations: DataFrame, items: DataFrame,
             closed_dates: DataFrame, as_of: dt.date | Column, faithful: bool = True) -> DataFrame:
    """E7 for v1 requests (one day, explicit items).

    ``faithful`` tests each line alone, as the reference does, so that two lines
    of one item can overbook it; otherwise the request's total per item is tested.
    A line that is wrong in itself ends the request there: items after it (in
    text order of their id) are not tested.
    """
    lines = rq.v1_lines(requests, closed_dates, equipment, as_of)
    first_bad = lines.where("line_code is not null").groupBy("request_id").agg(F.min(F.struct("place", "line_code")).alias("bad"))
    known = lines.where("line_code is null").join(first_bad, "request_id", "left")
    tested = known.where(F.col("bad").isNull() | (F.col("place") < F.col("bad.place")))
    used = occ.booked_items(reservations, items, requests.select(F.col("rental_date").alias("date")))
    cells = (tested.groupBy("request_id", "requested_at", "equipment_item_id", "rental_date", F.col("bad").isNull().alias("consumer"))
             .agg(F.min("place").alias("place"), (F.max("qty") if faithful else F.sum("qty")).alias("need"), F.sum("qty").alias("add"),
                  F.min("total_quantity").alias("total"))
             .join(used.select("equipment_item_id", F.col("date").alias("rental_date"), F.col("booked").alias("used")),
                   ["equipment_item_id", "rental_date"], "left")
             # A request may ask for items of several shops, so the (bounded) ordered pass is one lane.
             .select("request_id", F.lit(0).alias("lane"), "requested_at", "consumer", "place", "need", "add", "total",
                     F.coalesce("used", F.lit(0)).alias("used"), F.concat_ws("|", "equipment_item_id", "rental_date").alias("cell"),
                     F.concat(F.lit("OUT_OF_STOCK:"), F.col("equipment_item_id").cast("string")).alias("fail")))
    req = (rq.distinct_codes(rq.with_v1_code(requests, closed_dates, as_of), reservations).join(first_bad, "request_id", "left")
           .select("request_id", "shop_id", "code", "reservation_code", F.when(F.col("code").isNull(), F.col("bad.line_code")).alias("own")))
    return answer(req, settle(unsafe(cells)))
