"""Streaming jobs equal their batch operators."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from tests import test_admission as TA  # noqa: E402
from slopebook.operators import admission as adm
from slopebook.operators import lifecycle, notify
from slopebook.sources import fixtures as fx
from slopebook.sources import schemas
from slopebook.streaming import admission as sadm
from slopebook.streaming import outbox as sout
from slopebook.streaming import status as sst
from slopebook.streaming.files import write_in_time_order

SF = "/root/testdata/sf0.001"


def _scratch():
    return tempfile.mkdtemp(prefix="slopebook-stream-", dir=os.environ.get("TMPDIR", "/tmp"))


def _write_in_time_order(df, path, order_col, n_files=4):
    """At least ``n_files`` files, so that the stream has several micro-batches."""
    then = "event_id" if "event_id" in df.columns else "request_id"
    assert write_in_time_order(df, path, order_col, then, rows_per_file=max(1, df.count() // n_files)) >= n_files - 1


def test_status_stream_equals_batch_fold(spark):
    t = fx.load_all(spark, SF)
    events = fx.table(spark, SF, "fx_status_events")
    d = _scratch()
    _write_in_time_order(events, f"{d}/in", "ts")
    out = sst.run_status_stream(spark, f"{d}/in", t["reservations"], f"{d}/out", f"{d}/ckpt")
    assert out.count() == events.count()
    last = (out.groupBy("reservation_id").agg(F.max_by("new_status", F.struct("ts", "event_id")).alias("s")))
    batch = lifecycle.apply_status_changes(t["reservations"], events.where(F.col("action") != "created"))
    want = {r.id: r.status for r in batch.join(last, batch.id == last.reservation_id).collect()}
    got = {r.reservation_id: r.s for r in last.collect()}
    assert got == want


def test_outbox_stream_dedupes_and_matches_batch(spark):
    t = fx.load_all(spark, SF)
    events = fx.table(spark, SF, "fx_status_events")
    shops = notify.shops_from(t["reservations"])
    d = _scratch()
    _write_in_time_order(events, f"{d}/in", "ts")
    got = sout.run_outbox_stream(spark, f"{d}/in", t["reservations"], t["members"], shops, f"{d}/outbox",
                                 f"{d}/ckpt")
    rows = got.select("event_id", "kind").collect()
    assert len(rows) == len(set(rows))
    # Batch: the same transitions computed set-based.
    tr = lifecycle.status_transitions(events, t["reservations"])
    want = notify.notification_outbox(sout.changes_from_transitions(tr), t["reservations"], t["members"], shops)
    assert sorted(map(tuple, got.select(*sout.OUTBOX_COLUMNS).collect())) == \
        sorted(map(tuple, want.select(*sout.OUTBOX_COLUMNS).collect()))


def test_status_stream_transitions_equal_batch_transitions(spark):
    t = fx.load_all(spark, SF)
    events = fx.table(spark, SF, "fx_status_events")
    d = _scratch()
    _write_in_time_order(events, f"{d}/in", "ts", n_files=3)
    got = sst.run_status_stream(spark, f"{d}/in", t["reservations"], f"{d}/out", f"{d}/ckpt")
    want = lifecycle.status_transitions(events, t["reservations"])
    cols = [f.name for f in sst.TRANSITION_SCHEMA.fields]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_admission_stream_equals_model(spark):
    data = TA.generate(7)
    want = TA.model(*data)
    req, eq, res, mem, cl = TA._frames(spark, *data)
    d = _scratch()
    _write_in_time_order(req, f"{d}/in", "requested_at")
    got_df = sadm.run_admission_stream(spark, f"{d}/in", schemas.REQUESTS_V2, eq, res, mem, cl, TA.AS_OF,
                                       f"{d}/out", f"{d}/ckpt")
    got = {r.request_id: (r.accepted, r.code) for r in got_df.collect()}
    assert got == want


def test_files_keep_their_size_and_split_ties(spark):
    """Seventy of a hundred rows have one time: no file is larger for it, and the order is total."""
    rows = [(i, 1, dt.datetime(2025, 1, 1) + dt.timedelta(hours=0 if i < 70 else i), "confirm") for i in range(100)]
    events = spark.createDataFrame(rows, sst.EVENT_SCHEMA)
    for per in (10, 25):
        d = _scratch()
        n = write_in_time_order(events, f"{d}/in", "ts", "event_id", rows_per_file=per)
        assert n >= 100 // per - 1
        by_file = events.sparkSession.read.parquet(f"{d}/in").groupBy(F.input_file_name().alias("f")).agg(
            F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).orderBy("f").collect()
        assert max(r.n for r in by_file) <= 2 * per
        assert all(a.hi < b.lo for a, b in zip(by_file, by_file[1:]))


def _stored(spark, n=6):
    from tests.test_rules import RES_COLS, res_row
    return spark.createDataFrame([res_row(i, dt.date(2025, 1, 12)) for i in range(1, n + 1)], RES_COLS)


def test_redelivered_events_change_nothing(spark):
    """An event that comes again in a later file gives no second transition and no second mail; a restart sends nothing."""
    t = fx.load_all(spark, SF)
    events = fx.table(spark, SF, "fx_status_events").orderBy("ts", "event_id").limit(60)
    shops = notify.shops_from(t["reservations"])
    d = _scratch()
    write_in_time_order(events, f"{d}/in", "ts", "event_id", rows_per_file=20)
    run = lambda: sout.run_outbox_stream(spark, f"{d}/in", t["reservations"], t["members"], shops, f"{d}/outbox", f"{d}/ckpt")
    first = sorted(map(tuple, run().collect()))
    assert first
    again = events.where(F.col("action") == "created").union(events.limit(10))
    assert again.count() > 10
    again.coalesce(1).write.mode("append").parquet(f"{d}/in")
    assert sorted(map(tuple, run().collect())) == first


def test_status_survives_a_restart(spark):
    """A second run goes on from the state of the first; the stored status does not come back."""
    schema = sst.EVENT_SCHEMA
    at = dt.datetime(2025, 1, 1)
    res = _stored(spark).select("id", F.lit("pending").alias("status"))
    d = _scratch()
    spark.createDataFrame([(1, 1, at, "confirm"), (2, 2, at, "cancel")], schema).coalesce(1).write.parquet(f"{d}/in")
    sst.run_status_stream(spark, f"{d}/in", res, f"{d}/out", f"{d}/ckpt")
    later = at + dt.timedelta(days=1)
    spark.createDataFrame([(3, 1, later, "confirm"), (4, 2, later, "cancel"), (5, 3, later, "confirm"), (6, 99, later, "cancel")],
                          schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    out = sst.run_status_stream(spark, f"{d}/in", res, f"{d}/out", f"{d}/ckpt")
    got = {r.event_id: (r.old_status, r.new_status, r.result) for r in out.collect()}
    assert got == {1: ("pending", "confirmed", "OK"), 2: ("pending", "cancelled", "OK"), 3: ("confirmed", "confirmed", "NOT_PENDING"),
                   4: ("cancelled", "cancelled", "ALREADY_CANCELLED"), 5: ("pending", "confirmed", "OK"), 6: (None, None, "NOT_FOUND")}


def test_no_micro_batch_reads_the_stored_tables(spark):
    """The plan of the stream scans the events and the seeds, nothing else."""
    t = fx.load_all(spark, SF)
    d = _scratch()
    _write_in_time_order(fx.table(spark, SF, "fx_status_events"), f"{d}/in", "ts")
    stream = sst.transition_stream(spark, f"{d}/in", sout.seeds(t["reservations"], t["members"]), f"{d}/ckpt", 1)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert plan.count("StreamingRelation") == 2 and "Join" not in plan


def test_empty_outbox(spark):
    t = fx.load_all(spark, SF)
    d = _scratch()
    spark.createDataFrame([], sst.EVENT_SCHEMA).write.parquet(f"{d}/in")
    out = sout.run_outbox_stream(spark, f"{d}/in", t["reservations"].limit(0), t["members"].limit(0), notify.shops_from(t["reservations"]),
                                 f"{d}/outbox", f"{d}/ckpt")
    assert out.columns == sout.OUTBOX_COLUMNS and out.count() == 0


def test_admission_stream_with_a_hot_shop_and_a_restart(spark):
    """A third of the requests ask one shop; the stream is stopped between files, and a file comes again."""
    data = TA.generate(13)
    for k, q in enumerate(data[0]):
        q["shop_id"] = 0 if k % 3 else 1 + k % 2
    want = TA.model(*data)
    req, eq, res, mem, cl = TA._frames(spark, *data)
    rows = sorted(data[0], key=lambda q: (q["requested_at"], q["request_id"]))
    d = _scratch()

    def run():
        out = sadm.run_admission_stream(spark, f"{d}/in", schemas.REQUESTS_V2, eq, res, mem, cl, TA.AS_OF, f"{d}/out", f"{d}/ckpt")
        return {r.request_id: (r.accepted, r.code, r.reservation_code) for r in out.collect()}, out.count()

    spark.createDataFrame(rows[:70], schemas.REQUESTS_V2).coalesce(1).write.mode("append").parquet(f"{d}/in")
    first, n = run()
    assert n == 70
    spark.createDataFrame(rows[40:], schemas.REQUESTS_V2).coalesce(1).write.mode("append").parquet(f"{d}/in")
    both, n = run()
    assert n == len(want) and {k: v[:2] for k, v in both.items()} == want
    assert all(both[k] == v for k, v in first.items())
    codes = [v[2] for v in both.values() if v[0]]
    assert len(codes) == len(set(codes)) and None not in codes


def test_no_code_is_given_twice(spark):
    """The first request of a code keeps it if no stored reservation has it; a retry keeps its own."""
    from slopebook.operators import requests as rq
    at = dt.datetime(2025, 1, 1)
    req = spark.createDataFrame([(7, at + dt.timedelta(hours=2)), (8, at), (9, at)], "request_id int, requested_at timestamp")
    plain = {r.request_id: r.reservation_code for r in rq.distinct_codes(req).collect()}
    assert all(len(c) == 9 for c in plain.values())
    known = spark.createDataFrame([(1, plain[7]), (8, "YR-KEPT00")], "id int, reservation_code string")
    got = {r.request_id: r.reservation_code for r in rq.distinct_codes(req, known).collect()}
    assert got == {7: f"{plain[7]}-7", 8: "YR-KEPT00", 9: plain[9]}


def test_stream_gives_no_code_twice(spark, monkeypatch):
    """Every request has one and the same code, which a stored reservation has too."""
    data = TA.generate(13)
    req, eq, res, mem, cl = TA._frames(spark, *data)
    monkeypatch.setattr(sadm.pg, "reservation_code", lambda c: F.lit("YR-SAME00"))
    d = _scratch()
    _write_in_time_order(req, f"{d}/in", "requested_at", n_files=2)
    res = res.withColumn("reservation_code", F.lit("YR-SAME00"))
    out = sadm.run_admission_stream(spark, f"{d}/in", schemas.REQUESTS_V2, eq, res, mem, cl, TA.AS_OF, f"{d}/out", f"{d}/ckpt")
    got = {r.request_id: r.reservation_code for r in out.collect()}
    codes = [c for c in got.values() if c]
    assert len(codes) == len(set(codes)) > 3 and "YR-SAME00" not in codes
    assert got == {r.request_id: r.reservation_code for r in adm.admit(req, eq, res, mem, cl, TA.AS_OF).collect()}


def _fold(rows, stored):
    """event_id -> (old, new, result), by the rules one event after the other."""
    now, out = dict(stored), {}
    for event, rid, _at, action in rows:
        old = now.get(rid)
        if action == "confirm":
            new, result = ("confirmed", "OK") if old == "pending" else (old, "NOT_PENDING")
        elif action == "cancel":
            new, result = (old, "NOT_FOUND") if old is None else (old, "ALREADY_CANCELLED") if old == "cancelled" else ("cancelled", "OK")
        else:
            new, result = old, "NO_CHANGE"
        now[rid], out[event] = new, (old, new, result)
    return out


def test_status_stream_over_many_micro_batches_equals_the_fold(spark):
    """Every stored status, none and unknown reservations, ties in time, and no reservation that is a Python group."""
    import random
    rnd = random.Random(5)
    stored = {i: s for i, s in enumerate(("pending", "pending", "confirmed", "cancelled", "other", None))}
    at = dt.datetime(2025, 1, 1)
    rows = [(k, rnd.randrange(8), at + dt.timedelta(hours=k // 3), rnd.choice(("created", "confirm", "cancel", "confirm"))) for k in range(90)]
    res = spark.createDataFrame(list(stored.items()), "id int, status string")
    d = _scratch()
    write_in_time_order(spark.createDataFrame(rows, sst.EVENT_SCHEMA), f"{d}/in", "ts", "event_id", rows_per_file=20)
    out = sst.run_status_stream(spark, f"{d}/in", res, f"{d}/out", f"{d}/ckpt")
    assert {r.event_id: (r.old_status, r.new_status, r.result) for r in out.collect()} == _fold(rows, stored)
    plan = sst.transition_stream(spark, f"{d}/in", sst.seeds(res), f"{d}/other", 1)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroups" not in plan and "Aggregate" in plan


def test_status_stream_goes_on_where_the_clock_is_behind(spark):
    """What a later run brings ranks above what came before, whatever the time; each run has its own number."""
    from slopebook.streaming.files import next_run
    d = _scratch()
    assert [next_run(spark, f"{d}/runs") for _ in range(3)] == [0, 1, 2]


def test_streams_keep_few_states_of_few_partitions(spark, monkeypatch):
    """J3 has three keyed operators, none in Python, with two state partitions a core; the session's setting stays."""
    from slopebook.streaming import files
    data = TA.generate(7)
    req, eq, res, mem, cl = TA._frames(spark, *data)
    d = _scratch()
    _write_in_time_order(req, f"{d}/in", "requested_at", n_files=1)
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []

    def kept(*args):
        seen.append(files.start(*args))
        return seen[-1]
    monkeypatch.setattr(sadm, "start", kept)
    out = sadm.run_admission_stream(spark, f"{d}/in", schemas.REQUESTS_V2, eq, res, mem, cl, TA.AS_OF, f"{d}/out", f"{d}/ckpt")
    assert out.count() == len(data[0])
    states = seen[0].recentProgress[0]["stateOperators"]
    assert sorted(s["operatorName"] for s in states) == ["dedupeWithinWatermark", "stateStoreSave", "stateStoreSave"]
    assert {s["numShufflePartitions"] for s in states} == {2 * spark.sparkContext.defaultParallelism}
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_stream_knows_the_stored_codes(spark):
    """A code of many stored reservations is never given out as it is."""
    data = TA.generate(13)
    req, eq, res, mem, cl = TA._frames(spark, *data)
    from slopebook.functions import pgcompat as pg
    codes = req.select(pg.reservation_code(F.col("request_id")).alias("reservation_code")).distinct()
    stored = res.drop("reservation_code").crossJoin(codes) if res.count() else res
    first = res.select(F.min("id")).first()[0]
    stored = stored.where(F.col("id") == first)   # one reservation, read once a code: the codes are all taken
    d = _scratch()
    _write_in_time_order(req, f"{d}/in", "requested_at", n_files=2)
    out = sadm.run_admission_stream(spark, f"{d}/in", schemas.REQUESTS_V2, eq, stored, mem.limit(0), cl, TA.AS_OF, f"{d}/out", f"{d}/ckpt")
    got = {r.request_id: r.reservation_code for r in out.collect() if r.accepted}
    assert got and all(c.endswith(f"-{k}") for k, c in got.items())
