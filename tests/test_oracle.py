"""Every registered query against its DuckDB oracle on the smallest data set."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from oracle_check import digest, duck, spark_rows

SF = "/root/testdata/sf0.001"
ORACLE = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    scols, srows = spark_rows(spark, E.queries()[name], SF)
    dcols, drows = duck(SF, ORACLE[name])
    a, b = digest(scols, srows), digest(dcols, drows)
    assert a[0] == b[0], (a[0], b[0])
    assert a[1] == b[1]
    assert a[2] == b[2], (sorted(set(a[3]) - set(b[3]))[:3], sorted(set(b[3]) - set(a[3]))[:3])


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["window_id", "shop_id", "category", "remaining", "error"]
    assert df.count() > 0


def test_every_constraint_is_broken_somewhere(spark):
    got = E.queries()["a3_broken_audit"](spark, SF).select("table_name", "constraint_name").distinct().count()
    assert got >= 18
