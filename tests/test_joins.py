"""Joins of sources against plain Python and Spark's own join."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from conftest import plan_of, tuples
from pyspark.sql import functions as F

import chartmill as cm
from chartmill.operators.joins import heavy_keys

HOWS = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}


@pytest.fixture(scope="module")
def sides(spark):
    left = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 and i % 2 else f"k{i % 40}", i % 7 * 0.5) for i in range(900)]
    left += [(5, "hot", 1.0)] * 200
    right = [("hot", 1, "a"), ("hot", 2, None), (None, 3, "c"), ("only right", 4, "d")]
    right += [(f"k{i}", i, "e") for i in range(0, 40, 3)]
    return (
        spark.createDataFrame(left, "id long, `my key` string, v double").repartition(6),
        spark.createDataFrame(right, "key string, n int, `a.b` string"),
    )


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("large", [True, False])
def test_equals_the_plain_join(sides, how, large):
    left, right = sides
    got = cm.join_sources(left, right, {"my key": "key"}, how, large=large)
    expected = left.join(right, left["my key"] == right["key"], HOWS[how]).drop("key")
    assert got.columns == expected.columns
    assert Counter(tuples(got)) == Counter(tuples(expected))


def test_rows_of_a_heavy_key_spread_over_tasks(spark, sides):
    left, right = sides
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = cm.join_sources(left, right.hint("merge"), {"my key": "key"}, "left", large=True)
        own = joined.filter("`my key` = 'hot' AND n = 1").groupBy(F.spark_partition_id().alias("p")).count()
        counts = [row["count"] for row in own.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(counts) == 500
    assert len(counts) >= 4 and max(counts) < 300


def test_heavy_keys_are_those_above_a_share(spark):
    rows = [(1,)] * 600 + [(2,)] * 250 + [(k,) for k in range(3, 153)]
    found = tuples(heavy_keys(spark.createDataFrame(rows, "digest long").repartition(3), 8))
    assert dict(found).keys() == {1, 2}
    assert dict(found)[1] == 5 and dict(found)[2] == 2


@pytest.mark.parametrize("how", HOWS)
def test_empty_sides(sides, how):
    left, right = sides
    for a, b in ((left.limit(0), right), (left, right.limit(0))):
        n = cm.join_sources(a, b, {"my key": "key"}, how, large=True).count()
        assert n == (a.count() if how in ("left", "anti") else 0)


def test_key_types_and_names(spark):
    small = spark.createDataFrame([(1, 0.0), (2, -0.0), (3, float("nan"))], "k int, d double")
    wide = spark.createDataFrame([(1, 0.0, "x"), (2, 0.0, "y"), (3, float("nan"), "z")], "k long, d double, K2 string")
    got = tuples(cm.join_sources(small, wide, ["k", "d"], "inner", large=True).select("k", "K2"))
    assert sorted(got) == [(1, "x"), (2, "y"), (3, "z")]
    with pytest.raises(ValueError, match="both sides have d"):
        cm.join_sources(small, wide, "k")
    assert cm.join_sources(small, wide, "k", prefix="w_").columns == ["k", "d", "w_d", "w_K2"]
    with pytest.raises(ValueError, match="cannot be compared"):
        cm.join_sources(small, wide, {"k": "K2"})
    with pytest.raises(ValueError, match="unknown join"):
        cm.join_sources(small, wide, "k", "full")
    with pytest.raises(ValueError, match="at least one key"):
        cm.join_sources(small, wide, [])


def test_few_columns_are_read(load):
    lines, orders = load("lineitem"), load("orders")
    joined = cm.join_sources(lines, orders, {"l_orderkey": "o_orderkey"}, large=True)
    plan = plan_of(joined.groupBy("o_orderpriority").agg(F.sum("l_quantity")))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>\n", plan)
    read = {field.split(":")[0] for schema in schemas for field in schema.split(",")}
    assert {"l_orderkey", "l_quantity", "o_orderkey", "o_orderpriority"} <= read
    assert not read & {"l_returnflag", "l_linestatus", "l_shipdate", "o_totalprice", "o_custkey", "o_orderdate"}


def spec(sources, default="j"):
    chart = {"type": "bar", "title": "t", "x": "x", "y": "y", "agg": "sum"}
    return {"data": {"default": default, "sources": sources}, "charts": [chart]}


def test_joins_in_specs(spark):
    tables = {
        "a": spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0)], "k int, y double"),
        "b": spark.createDataFrame([(1, "one"), (2, "two")], "k int, x string"),
    }
    join = {"left": "a", "right": "b", "on": "k", "how": "inner"}
    for given in (spec({"j": join}), spec({}, join), spec({"i": join, "j": {"left": "i", "right": "b", "on": "k", "prefix": "p_"}})):
        batch = cm.chart_batch(spark, given, tables=tables)
        assert not batch.errors
        assert sorted(tuples(batch.build("t-bar"))) == [("one", 5.0), ("two", 5.0)]


def test_broken_joins_in_specs(spark):
    tables = {"a": spark.createDataFrame([(1, 2.0)], "k int, y double")}
    cases = {
        "is joined with itself": {"j": {"left": "a", "right": "j", "on": "k"}},
        "needs a 'path'": {"j": {"left": "a", "on": "k"}},
        "unknown: keys": {"j": {"left": "a", "right": "a", "on": "k", "keys": "k"}},
    }
    for reason, sources in cases.items():
        batch = cm.chart_batch(spark, spec(sources), tables=tables)
        assert reason in batch.errors["t-bar"]


def test_default_source_with_a_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x,y\n007,1\n008,2\n")
    given = spec({}, {"path": str(tmp_path / "t.csv"), "schema": "x STRING, y DOUBLE"})
    assert sorted(tuples(cm.chart_batch(spark, given).build("t-bar"))) == [("007", 1.0), ("008", 2.0)]
