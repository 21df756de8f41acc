"""E7 for v1 requests against a row-by-row model, and both versions decided by rounds alone."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from slopebook.operators import admission
from slopebook.sources import schemas
from tests import test_admission as v2

AS_OF = dt.date(2025, 1, 10)
DAYS = [dt.date(2025, 1, 9) + dt.timedelta(days=k) for k in range(5)]
EQ = "id int, shop_id int, category string, size_label string, total_quantity int, is_active boolean"


def generate(seed: int, n: int = 120):
    rng = random.Random(seed)
    equipment = [(i, 1 + i % 2, "ski", f"{i}", rng.randint(0, 6), rng.random() < 0.9) for i in (1, 2, 3, 10, 11, 20)]
    ids = [str(e[0]) for e in equipment] + ["99", None]
    requests = []
    for k in range(n):
        items = [(rng.choice(ids), rng.choice(["1", "1", "2", "3", "0", "x", " 2 "])) for _ in range(rng.randint(0, 4))]
        requests.append((k, 1 + k % 2, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=rng.randint(0, 40)), rng.choice(DAYS), "N", "090", None,
                         rng.choice([1, 2, 0, None]) if rng.random() < 0.2 else 2, items if rng.random() < 0.95 else None, None))
    return requests, equipment


def model(requests, equipment, booked, closed, faithful):
    eq = {str(e[0]): e for e in equipment}
    used = dict(booked)
    out = {}
    for r in sorted(requests, key=lambda r: (r[2], r[0])):
        rid, day, party, items = r[0], r[3], r[7], r[8]
        code = None
        if day is None or party is None or party <= 0 or not items:
            code = "INVALID_INPUT"
        elif day < AS_OF:
            code = "DATE_IN_PAST"
        elif (r[1], day) in closed:
            code = "SHOP_CLOSED_ON_DATE"
        else:
            totals = {}
            for e, q in items:
                if q.strip().isdigit():
                    totals[e] = totals.get(e, 0) + int(q)
            for _pos, (e, q) in sorted(enumerate(items), key=lambda x: (x[1][0] is None, x[1][0] or "", x[0])):
                qty = int(q) if q.strip().isdigit() else None
                if qty is None or qty <= 0:
                    code = "INVALID_QUANTITY"
                elif e not in eq:
                    code = "EQUIPMENT_NOT_FOUND"
                elif not eq[e][5]:
                    code = "EQUIPMENT_INACTIVE"
                elif used.get((e, day), 0) + (qty if faithful else totals[e]) > eq[e][4]:
                    code = f"OUT_OF_STOCK:{e}"
                if code:
                    break
            if code is None:
                for e, q in items:
                    used[e, day] = used.get((e, day), 0) + int(q)
        out[rid] = (code is None, code)
    return out


@pytest.mark.parametrize("seed,faithful,pass_rows", [(1, True, 100_000), (2, False, 100_000), (3, True, 0), (4, False, 0)])
def test_v1_equals_model(spark, monkeypatch, seed, faithful, pass_rows):
    monkeypatch.setattr(admission, "PASS_ROWS", pass_rows)
    requests, equipment = generate(seed)
    req = spark.createDataFrame(requests, schemas.REQUESTS_V1)
    res = spark.createDataFrame([(500, 1, DAYS[2], "pending"), (501, 1, DAYS[3], "cancelled")], "id int, shop_id int, rental_date date, status string")
    items = spark.createDataFrame([(500, 2, 1), (500, 10, 1), (501, 3, 5)], "reservation_id int, equipment_item_id int, quantity int")
    closed = spark.createDataFrame([(1, DAYS[4], None, None), (2, DAYS[1], None, None)], schemas.CLOSED_DATES)
    got = admission.admit_v1(req, spark.createDataFrame(equipment, EQ), res, items, closed, AS_OF, faithful)
    want = model(requests, equipment, {("2", DAYS[2]): 1, ("10", DAYS[2]): 1}, {(1, DAYS[4]), (2, DAYS[1])}, faithful)
    assert {r.request_id: (r.accepted, r.code) for r in got.collect()} == want
    kinds = {c.split(":")[0] for _a, c in want.values() if c}
    assert kinds >= {"OUT_OF_STOCK", "INVALID_QUANTITY", "EQUIPMENT_NOT_FOUND", "INVALID_INPUT"} and any(a for a, _c in want.values())


@pytest.mark.parametrize("seed", [1, 5])
def test_v2_by_rounds_alone_equals_model(spark, monkeypatch, seed):
    monkeypatch.setattr(admission, "PASS_ROWS", 0)
    data = v2.generate(seed)
    req, eq, res, mem, cl = v2._frames(spark, *data)
    got = {r.request_id: (r.accepted, r.code) for r in admission.admit(req, eq, res, mem, cl, v2.AS_OF).collect()}
    assert got == v2.model(*data)
