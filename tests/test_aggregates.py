from __future__ import annotations

import random
import statistics
from collections import defaultdict

import pytest
from conftest import plan_of, tuples
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chartmill import aggregate, aggregate_all, sort_limit, transform
from chartmill.operators import median as medians
from chartmill.operators import running
from chartmill.operators.running import ranged_total, running_total


@pytest.fixture(scope="module")
def rows(spark):
    data = [("a", 1, 5.0), ("a", 2, None), ("a", 4, 7.0), ("b", 3, 1.0), ("c", 9, None)]
    return spark.createDataFrame(data, "key string, n int, y double")


@pytest.mark.parametrize(
    ("agg", "expected"),
    [
        ("sum", {"a": 12.0, "b": 1.0, "c": None}),
        ("mean", {"a": 6.0, "b": 1.0, "c": None}),
        ("count", {"a": 2, "b": 1, "c": 0}),
        ("min", {"a": 5.0, "b": 1.0, "c": None}),
        ("max", {"a": 7.0, "b": 1.0, "c": None}),
        ("median", {"a": 6.0, "b": 1.0, "c": None}),
    ],
)
def test_six_functions(rows, agg, expected):
    result = aggregate(rows, "key", "y", agg)
    assert result.columns == ["key", "y"]
    assert dict(tuples(result)) == expected


def test_without_function_rows_pass_through(rows):
    assert aggregate(rows, "key", "y", None) is rows


def test_wrong_use_is_rejected(rows):
    with pytest.raises(ValueError, match="average"):
        aggregate(rows, "key", "y", "average")
    with pytest.raises(ValueError, match="numeric"):
        aggregate(rows, "n", "key", "sum")
    with pytest.raises(ValueError):
        aggregate(rows, ["key", "y"], "y", "sum")
    with pytest.raises(ValueError):
        aggregate(rows, [], "y", "sum")


@pytest.mark.parametrize("agg", ["sum", "median"])
def test_all_numeric_columns(rows, agg):
    result = aggregate_all(rows.withColumn("text", rows["key"]), "key", agg)
    assert result.columns == ["key", "n", "y"]
    found = {key: (n, y) for key, n, y in tuples(result)}
    assert found["a"] == ((7, 12.0) if agg == "sum" else (2, 6.0))


def test_all_columns_median_at_scale(rows, scale_out):
    found = {key: (n, y) for key, n, y in tuples(aggregate_all(rows, "key", "median"))}
    assert found == {"a": (2.0, 6.0), "b": (3.0, 1.0), "c": (9.0, None)}


def test_all_columns_median_gathers_no_group_in_one_task(rows, load, scale_out):
    """Asked for the lean plan, a large input is not given Spark's median, which keeps a group's values together."""
    names = ["l_returnflag", "l_quantity", "l_extendedprice"]
    lines = load("lineitem").select(*names)
    medians = aggregate_all(lines, "l_returnflag", "median", large=False)
    assert "percentile(" not in plan_of(medians) and "median(" not in plan_of(medians)
    groups = defaultdict(list)
    for flag, *values in tuples(lines):
        groups[flag].append(values)
    expected = {flag: tuple(map(statistics.median, zip(*group))) for flag, group in groups.items()}
    assert {flag: pytest.approx(values) for flag, *values in tuples(medians)} == {k: list(v) for k, v in expected.items()}
    assert dict((k, v) for k, *v in tuples(aggregate_all(rows, "key", "median", large=False)))["c"] == [9.0, None]


def test_all_columns_include_text_where_it_makes_sense(rows):
    found = {row["n"]: row["key"] for row in aggregate_all(rows, "n", "max").collect()}
    assert found[9] == "c"


def test_extremes_of_all_columns_with_a_null_key(spark):
    data = [(None, 1, "a"), (None, 5, "b"), ("k", 2, None), ("k", None, "z")]
    rows = spark.createDataFrame(data, "key string, n int, s string")
    assert sorted(tuples(aggregate_all(rows, "key", "max")), key=str) == [("k", 2, "z"), (None, 5, "b")]
    assert sorted(tuples(aggregate_all(rows, "key", "min")), key=str) == [("k", 2, "z"), (None, 1, "a")]


def test_extremes_sort_only_the_texts(load):
    plan = plan_of(aggregate_all(load("lineitem"), "l_linestatus", "max"))
    scans = [part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:]]
    assert len(scans) == 2
    assert "l_returnflag:string,l_linestatus:string" in scans
    assert "Sort [l_linestatus" in plan and "HashAggregate" in plan


def test_aggregation_is_partial_before_the_shuffle(load):
    plan = plan_of(aggregate(load("lineitem"), "l_returnflag", "l_quantity", "sum"))
    assert plan.count("HashAggregate") >= 2
    assert plan.count("Exchange") == 1
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def _skewed(seed: int, n: int = 3000):
    """A third of the rows in one group, a third of those with one value, NULLs, a NULL key."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, f"k{i % 40}"])
        value = 7.0 if i % 9 == 0 else rng.choice([None, rng.uniform(-5, 5), float(rng.randint(0, 3))])
        data.append((key, value))
    return data + [("empty", None), ("single", 4.25)]


def _brute(data):
    groups = defaultdict(list)
    for key, value in data:
        groups[key]
        if value is not None:
            groups[key].append(value)
    return {key: statistics.median(values) if values else None for key, values in groups.items()}


@pytest.mark.parametrize("joined", ["broadcast", "shuffled"])
def test_selected_median_equals_brute_force(spark, scale_out, monkeypatch, joined):
    if joined == "shuffled":
        monkeypatch.setattr(medians, "BROADCAST_BYTES", 0)
    data = _skewed(5)
    result = aggregate(spark.createDataFrame(data, "k string, v double"), "k", "v", "median")
    assert dict(tuples(result)) == pytest.approx(_brute(data))


def test_selected_median_survives_a_useless_sketch(spark, scale_out, monkeypatch):
    """A bracket far off the middle makes the plan slower, not wrong."""
    monkeypatch.setattr(medians, "BRACKET", 0.0)
    monkeypatch.setattr(medians, "SKETCH_ACCURACY", 2)
    data = _skewed(11)
    result = aggregate(spark.createDataFrame(data, "k string, v double"), "k", "v", "median")
    assert dict(tuples(result)) == pytest.approx(_brute(data))


@pytest.mark.parametrize("cut", [0, running.MAX_WINDOW_ROWS])
def test_selected_median_on_the_test_table(load, scale_out, monkeypatch, cut):
    monkeypatch.setattr(running, "MAX_WINDOW_ROWS", cut)
    rows = load("lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    found = {row[:2]: row[2] for row in tuples(aggregate(rows, keys, "l_extendedprice", "median"))}
    groups = defaultdict(list)
    for flag, status, price in tuples(rows.select(*keys, "l_extendedprice")):
        groups[flag, status].append(price)
    assert found == pytest.approx({key: statistics.median(values) for key, values in groups.items()})


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("xy"), st.integers(-3, 3)), min_size=1, max_size=30))
def test_selected_median_property(spark, scale_out, data):
    result = aggregate(spark.createDataFrame(data, "k string, v long"), "k", "v", "median")
    assert dict(tuples(result)) == _brute(data)


@pytest.mark.parametrize("build", [running_total, ranged_total])
def test_running_total(spark, scale_out, build):
    rng = random.Random(3)
    data = [("hot" if i % 2 else f"g{i % 5}", i, rng.randint(1, 9)) for i in range(2000)] + [(None, 1, 4), (None, 2, 5)]
    rng.shuffle(data)
    rows = spark.createDataFrame(data, "g string, o int, v long").repartition(7)
    totals = defaultdict(int)
    expected = []
    for group, order, value in sorted(data, key=lambda row: (row[0] or "", row[1])):
        expected.append((group, order, value, totals[group], totals[group] + value))
        totals[group] += value
    found = sorted(tuples(build(rows, ["g"], ["o"], "v")), key=lambda row: (row[0] or "", row[1]))
    assert found == expected


def test_running_total_without_groups(spark, scale_out):
    rows = spark.createDataFrame([(f"s{i:03}", i) for i in range(200)], "s string, v long").repartition(5)
    found = sorted(tuples(ranged_total(rows, [], ["s"], "v")))
    assert [row[3] for row in found] == [sum(range(i + 1)) for i in range(200)]


def test_sort_first_key_is_primary(rows):
    ordered = sort_limit(rows.select("key", "n"), [("key", False), ("n", True)])
    assert tuples(ordered) == [("c", 9), ("b", 3), ("a", 1), ("a", 2), ("a", 4)]


def test_limit_needs_no_sort_to_be_stable(rows):
    shuffled = rows.repartition(3)
    assert tuples(sort_limit(shuffled.select("n"), (), 2)) == [(1,), (2,)]
    with pytest.raises(ValueError):
        sort_limit(rows, (), -1)


def test_sort_and_limit_plan_as_top_k(load):
    assert "TakeOrderedAndProject" in plan_of(sort_limit(load("orders"), [("o_totalprice", False)], 10))


def test_stage_order(rows):
    """Filters see source columns, derived columns come next, the limit cuts the aggregates."""
    result = transform(
        rows,
        filter={"expression": "n < 9"},
        derive={"half": "n % 2"},
        y="n",
        group_by="half",
        agg="sum",
        sort=[{"column": "n", "ascending": False}],
        limit=1,
    )
    assert tuples(result) == [(0, 6)]


def test_grouping_by_x_by_default(rows):
    assert dict(tuples(transform(rows, x="key", y="n", agg="max"))) == {"a": 4, "b": 3, "c": 9}
    with pytest.raises(ValueError):
        transform(rows, y="n", agg="max")
