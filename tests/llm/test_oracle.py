"""Queries of this subpackage give the rows of their check SQL."""

import pytest

from tests.compare import difference
from textprov.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
