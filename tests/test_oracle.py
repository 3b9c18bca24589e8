"""Every query with check SQL gives the rows the SQL gives, by a sound plan."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import difference, plan_faults
from textprov.catalog import ORACLES, QUERIES

ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, con, name):
    df = queries()[name](spark, sf)
    assert plan_faults(name, df) == []
    assert difference(df, con, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, sf, name):
    df = queries()[name](spark, sf)
    assert plan_faults(name, df) == []
    assert df.count() > 0


def test_entry_names():
    assert QUERIES.items() <= queries().items() and ORACLES.items() <= oracle_sql().items()
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r["fold"] for r in rows} == {"train", "valid"}
    assert all(0.0 <= r["auc"] <= 1.0 for r in rows)
