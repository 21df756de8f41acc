"""Work that a query must not do: tables it does not ask for, wide rows shuffled, large batches as Python objects."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slopebook.operators import markup, translate as tr
from slopebook.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_derived_when_asked_for(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(fx, "stored", lambda s, d, name: asked.append(name) or f"{d}/part.parquet")
    monkeypatch.setattr(fx.schemas, "conform", lambda df, *a: df)
    t = fx.load_all(spark, SF)
    assert t["equipment"] is t["equipment"] and asked == ["fx_equipment"]
    assert sorted(t) == ["closed_dates", "equipment", "items", "members", "reservations"]
    with pytest.raises(KeyError):
        t["other"]


@pytest.mark.parametrize("name", ["fx_requests_v2", "fx_requests_v1", "fx_members", "fx_hook_pages", "fx_site_pages"])
def test_only_source_columns_are_shuffled(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(getattr(fx, name)(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("Exchange hashpartitioning") == (2 if "requests" in name else 1)
    assert "RoundRobin" not in p and "hashpartitioning(reservation_id" not in p
    below = p[p.index("Exchange hashpartitioning"):]
    assert "html" not in below and "o_comment" not in below


def test_more_source_makes_more_tasks_not_larger_ones(spark, monkeypatch):
    few = fx._tasks(spark, SF, "orders")
    assert few == 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(fx, "BYTES_PER_TASK", 1000)
    assert fx._tasks(spark, SF, "orders") == fx._tasks(spark, SF, "lineitem") > few


def test_texts_are_not_shuffled_to_meet_the_dictionary(spark):
    d = spark.createDataFrame([("予約番号", "Booking no.", "號碼")], "ja string, en string, zh string")
    texts = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "予約番号").when(F.col("id") % 3 == 1, "plain").alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tr.translate(texts, "text", "en", d)
        p = plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(_k_probe" not in p and "hashpartitioning(_core" not in p
    assert {(r.text, r.translated) for r in out.collect()} == {("予約番号", "Booking no."), ("plain", None), (None, None)}


def test_page_batches_are_taken_in_slices(monkeypatch):
    monkeypatch.setattr(markup, "SLICE_BYTES", 10)
    texts = ["a" * 4, None, "b" * 6, "c" * 30, "", "d", None]
    parts = list(markup.slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["html"]), 0))
    assert [v for p in parts for v in p.column(0).to_pylist()] == texts
    assert [p.num_rows for p in parts] == [3, 1, 3]
    assert list(markup.slices(pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["html"]), 0)) == []


def test_positions_equal_those_by_line_and_column():
    class ByLine(markup.PageScan):
        def __init__(self, text):
            self.line_starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
            super().__init__(text, "r")

        updatepos = markup.html.parser.HTMLParser.updatepos

        def _pos(self):
            line, col = self.getpos()
            return self.line_starts[line - 1] + col

    rng = random.Random(3)
    pieces = ["<p>", "</p>", "\n", "予約", "<div id=r data-langblock='ja'\n>", "</div>", "<!-- x\n -->", "&amp;", "&#x4E88;", "<", "<img alt=スキー>", "<script>",
              "</script>", "<!x", "<?y\n>", "a < b", "<textarea>", "</textarea>", "</", "<br/>", "<a title='大\n人'", "😀"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        new, old = markup.PageScan(text, "r"), ByLine(text)
        assert (new.nodes, new.blocks, new.root) == (old.nodes, old.blocks, old.root), text
