"""Filters and column lists reach the scans."""

from __spark_entry__ import queries
from tests.compare import plan_text


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_text(queries()["class_filter"](spark, sf))
    assert "EqualTo(quality,1)" in plan and "toxic" not in plan
    assert "lang" not in plan_text(queries()["drop_null_text"](spark, sf))
    assert "LessThanOrEqual" in plan_text(queries()["prompt_filter"](spark, sf)) or "<= 8" in plan_text(
        queries()["prompt_filter"](spark, sf)
    )
