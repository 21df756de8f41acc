"""Stored tables: what a write touches."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys

from slopebook.sources import store

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _files(path):
    return {os.path.join(r, f): os.path.getmtime(os.path.join(r, f)) for r, _d, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def _changes(spark, rows):
    return spark.createDataFrame([(i, k, h, "", "{}", dt.datetime(2025, 1, 1, 0, 0, i), "staff") for i, k, h in rows], store.VERSIONS)


def test_publishing_one_page_rewrites_one_partition(spark, tmp_path):
    folder = str(tmp_path)
    store.create_pages(spark, folder)
    assert store.publish(spark, folder, _changes(spark, [])) == []
    store.publish(spark, folder, _changes(spark, [(i, f"page-{i}", f"v{i}") for i in range(40)]))
    pages, versions = _files(f"{folder}/pages"), _files(f"{folder}/versions")
    touched = store.publish(spark, folder, _changes(spark, [(50, "page-7", "new"), (49, "page-7", "older")]))
    assert len(touched) == 1
    now, grown = _files(f"{folder}/pages"), _files(f"{folder}/versions")
    mark = f"bucket={touched[0]}/"
    assert {f for f in pages if mark not in f} == {f for f in now if mark not in f}
    assert all(grown[f] == t for f, t in versions.items()) and len(grown) > len(versions)
    got = {r.page_key: (r.html, r.version_id) for r in store.read(spark, f"{folder}/pages", store.CURRENT).collect()}
    assert len(got) == 40 and got["page-7"] == ("new", 50) and got["page-8"] == ("v8", 8)
    assert store.read(spark, f"{folder}/versions", store.VERSIONS).count() == 42


def test_save_and_read_prune_by_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    store.save(_changes(spark, [(i, f"k{i % 9}", "h") for i in range(30)]), path, "page_key", buckets=4)
    df = store.read(spark, path, store.VERSIONS)
    assert df.count() == 30 and len(df.where("bucket = 1").inputFiles()) <= len(df.inputFiles())


def test_entry_works_without_the_training_part():
    """With a library of the training-data operators missing, or their folder, all other queries are still there."""
    code = ("import sys; sys.modules['{}'] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
            "assert len(q) >= 80 and not any(n.startswith('op') or n == 'pipeline' for n in q), sorted(q); "
            "assert len(o) >= 70 and set(o) <= set(q)")
    for module in ("public_tokenizers", "slopebook.llm", "corpus_pipeline"):
        subprocess.run([sys.executable, "-c", code.format(module)], cwd=ROOT, check=True, timeout=120)
