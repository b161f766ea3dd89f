"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, differences
from conftest import DATA
from plans import final_plan, summary

import __spark_entry__ as entry_points
from workload import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("key", QUERIES)
def test_query_equals_sql(spark, con, key):
    assert differences(spark, con, DATA, key) == []


# Queries whose plan differs once the input is large.
@pytest.mark.parametrize("key", ["agg_median", "bar_stacked_total"])
def test_query_equals_sql_at_scale(spark, con, scale_out, key):
    assert differences(spark, con, DATA, key) == []


def test_each_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert QUERIES.keys() <= entry_points.queries().keys()
    assert ORACLE_SQL.keys() <= entry_points.oracle_sql().keys()
    assert entry_points.oracle_sql().keys() <= entry_points.queries().keys()


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["x", "series", "y"]
    assert df.count() > 0


def test_no_plan_has_python_or_nested_loops(spark):
    for key in ("line_grouped", "bar_stacked", "heatmap_bins", "retention_intensity", "funnel_dropoff", "agg_median"):
        counts = summary(final_plan(entry_points.queries()[key](spark, DATA)))
        assert counts["scans"] == 1
        assert "python" not in counts and "nested loops" not in counts
