"""The registered opN_ queries and the pipeline, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from oracle_check import digest, duck, spark_rows
from slopebook.llm.common import table
from slopebook.llm.queries import ORACLE, QUERIES
from slopebook.plans.session import materialize

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(entry.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    counts = [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 14)]
    assert max(counts) == 1 and sum(counts) == len(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    a = digest(*spark_rows(spark, QUERIES[name], SF))
    b = digest(*duck(SF, ORACLE[name]))
    assert a[:3] == b[:3]


def test_pipeline_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"test_{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4] > 0
    pieces = corpus_pipeline.run(spark, SF)
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    got = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"] for r in got} == kept
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in got)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    from tests.llm.fixtures import SCHEMA, document_rows
    for rows in (document_rows(), []):
        folder = tmp_path / f"n{len(rows)}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        labels = [(r[0], i % 2) for i, r in enumerate(rows)]
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        assert (out.count() > 0) == bool(rows)
