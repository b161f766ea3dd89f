from __future__ import annotations

import datetime as dt
from collections import defaultdict

import pytest
from conftest import plan_of, tuples
from plans import final_plan
from pyspark.sql import functions as F

import chartmill as cm


@pytest.fixture(scope="module")
def segments(spark):
    first = {"A": 150, "B": 200, "C": 120, "D": 180}
    second = {"A": 100, "B": 150, "C": 80, "D": 120}
    data = [(x, y, "Group1") for x, y in first.items()] + [(x, y, "Group2") for x, y in second.items()]
    return spark.createDataFrame(data, "category string, value int, segment string")


@pytest.fixture(scope="module")
def sparse(spark):
    data = [(1, "a", 2.0), (1, "a", 3.0), (1, "c", 4.0), (2, "b", 1.0), (3, "a", None), (3, None, 6.0)]
    return spark.createDataFrame(data, "x int, g string, y double")


def test_line(segments):
    assert tuples(cm.line_series(segments, "category", "value")) == [
        ("A", 250.0),
        ("B", 350.0),
        ("C", 200.0),
        ("D", 300.0),
    ]


def test_grouped_line_keeps_x_and_series(sparse):
    assert tuples(cm.line_series(sparse, "x", "y", "g")) == [
        (1, "a", 5.0),
        (1, "c", 4.0),
        (2, "b", 1.0),
        (3, None, 6.0),
        (3, "a", 0.0),
    ]


def test_text_values_are_an_error(segments):
    with pytest.raises(ValueError, match="numeric"):
        cm.bar_series(segments, "category", "segment")
    assert tuples(cm.bar_series(segments, "segment", "category", agg="count")) == [("Group1", 4.0), ("Group2", 4.0)]


def test_stack_golden(segments):
    stack = {row[:2]: row[3:] for row in tuples(cm.stacked_bar(segments, "value", "segment", "category"))}
    assert stack["A", "Group1"] == (0.0, 150.0)
    assert stack["A", "Group2"] == (150.0, 250.0)
    assert stack["B", "Group2"] == (200.0, 350.0)
    assert stack["C", "Group2"] == (120.0, 200.0)
    assert stack["D", "Group2"] == (180.0, 300.0)


def test_stack_fills_missing_cells_and_joins_up(sparse):
    stack = tuples(cm.bar_series(sparse, "x", "y", "g", stacked=True))
    assert len(stack) == 3 * 4
    by_x = defaultdict(list)
    for x, series, y, start, end in stack:
        by_x[x].append((series, y, start, end))
    for cells in by_x.values():
        assert [cell[0] for cell in cells] == [None, "a", "b", "c"]
        assert cells[0][2] == 0.0
        for (_, _, _, end), (_, _, start, _) in zip(cells, cells[1:]):
            assert end == start
        assert cells[-1][3] == sum(cell[1] for cell in cells)


def test_stack_without_x(segments, scale_out):
    expected = [("Group1", 650.0, 0.0, 650.0), ("Group2", 450.0, 650.0, 1100.0)]
    assert tuples(cm.stacked_bar(segments, "value", "segment")) == expected


def test_flat_stacks_are_empty(spark):
    flat = spark.createDataFrame([(1, "a", 0.0), (2, "b", -1.0)], "x int, g string, y double")
    assert tuples(cm.stacked_bar(flat, "y", "g", "x")) == []
    assert tuples(cm.stacked_bar(flat, "y", "g")) == []


def test_shares(spark, sparse):
    data = [("2024-01-01", "organic", 1000), ("2024-01-01", "paid", 500), ("2024-01-02", "paid", 0)]
    rows = spark.createDataFrame(data, "date string, channel string, users int")
    shares = [row[3] for row in tuples(cm.area_series(rows, "date", "users", "channel", normalize=True))]
    assert shares == pytest.approx([66.6667, 33.3333, 0.0], abs=1e-4)


def test_normalised_stack_reaches_100(load):
    rows = cm.derive(load("events"), {"day": "to_date(ts)"})
    stack = cm.area_series(rows, "day", "value", "event_type", stacked=True, normalize=True)
    tops = stack.groupBy("x").agg(F.max("y_end")).collect()
    assert len(tops) == 30
    assert [top[1] for top in tops] == pytest.approx([100.0] * 30)


def test_cap_cuts_the_result_not_the_input(load):
    bars = cm.bar_series(load("lineitem"), "l_suppkey", "l_quantity", max_points=3)
    full = cm.bar_series(load("lineitem"), "l_suppkey", "l_quantity")
    assert tuples(bars) == tuples(full)[:3]
    assert "TakeOrderedAndProject" in plan_of(bars)


@pytest.mark.parametrize("chart", ["stack", "total", "normalised", "retention", "heatmap"])
def test_one_scan_no_cross_product(load, chart):
    if chart == "stack":
        df = cm.stacked_bar(load("lineitem"), "l_quantity", "l_returnflag", "l_suppkey")
    elif chart == "total":
        df = cm.stacked_bar(load("lineitem"), "l_quantity", "l_suppkey")
    elif chart == "normalised":
        df = cm.area_series(load("part"), "p_size", "p_retailprice", "p_brand", stacked=True, normalize=True)
    elif chart == "retention":
        cells = cm.cohorts(load("orders"), "o_custkey", "o_orderdate", "year")
        df = cm.with_retention_intensity(cm.retention(cells, "cohort", "period_number", "users"))
    else:
        df = cm.heatmap(load("lineitem"), "l_shipdate", "l_returnflag", "l_quantity")
    plan = final_plan(df)
    assert plan.count("FileScan") == 1
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan


def test_value_extent(spark, segments):
    extent = cm.value_extent(cm.bar_series(segments, "category", "value"))
    assert extent.first()["y_lo"] == 0.0
    assert extent.first()["y_hi"] == pytest.approx(385.0)
    below = spark.createDataFrame([(-5.0,)], "y double")
    assert tuples(cm.value_extent(below)) == [(0.0, 0.0)]
    assert tuples(cm.value_extent(below.filter("y > 0"))) == [(0.0, 0.0)]


def test_heatmap_intensity_and_bins(spark):
    cells = spark.createDataFrame(
        [("a", 1, 8.0), ("b", 1, 200.0), ("b", 1, 20.0), ("b", 2, 114.0), ("c", 1, None)],
        "x string, y int, z double",
    )
    found = {row[:2]: row[2:] for row in tuples(cm.heatmap(cells, "x", "y", "z"))}
    assert found == {("a", 1): (8.0, 0.0, 1), ("b", 1): (220.0, 1.0, 10), ("b", 2): (114.0, 0.5, 6)}


def test_flat_and_negative_heatmaps(spark):
    flat = spark.createDataFrame([(1, 1, 3.0), (2, 2, 3.0)], "x int, y int, z double")
    assert {row[3:] for row in tuples(cm.heatmap(flat, "x", "y", "z"))} == {(0.5, 6)}
    below = spark.createDataFrame([(1, 1, -4.0), (2, 2, -1.0)], "x int, y int, z double")
    found = {row[0]: row[3] for row in tuples(cm.heatmap(below, "x", "y", "z"))}
    assert found == {1: 0.0, 2: 0.75}


@pytest.mark.parametrize("bins", [1, 101])
def test_bins_are_checked(segments, bins):
    with pytest.raises(ValueError, match="bins"):
        cm.heatmap(segments, "category", "segment", "value", bins=bins)


def test_scatter(spark):
    rows = spark.createDataFrame([(10, 18, "A"), (66, None, "B"), (None, 3, "A")], "a int, b int, c string")
    points = cm.scatter_points(rows, "a", "b", "c")
    assert sorted(tuples(points)) == [(10.0, 18.0, "A"), (66.0, 0.0, "B")]
    assert tuples(cm.scatter_points(rows, "a", "b", max_points=1)) == [(10.0, 18.0)]
    with pytest.raises(ValueError, match="numeric"):
        cm.scatter_points(rows, "c", "b")


def test_scatter_extent_golden(spark):
    points = spark.createDataFrame([(10, 20), (66, 62), (18, 18), (55, 65)], "x int, y int")
    assert tuples(cm.scatter_extent(points))[0] == pytest.approx((4.4, 71.6, 13.3, 69.7))


STEPS = ["Visited", "Viewed", "Added", "Started", "Bought"]


@pytest.fixture(scope="module")
def visits(spark):
    totals = dict(zip(STEPS, [10000, 5000, 2000, 1000, 500]))
    data = [(step, part) for step, value in totals.items() for part in (value - 1, 1)] + [("Other", 7)]
    return spark.createDataFrame(data, "step string, value int").repartition(3)


def test_funnel_golden(visits):
    rates = tuples(cm.funnel_conversion(visits, STEPS, "step", "value"))
    assert [row[:3] for row in rates] == [
        (0, "Visited", 10000.0),
        (1, "Viewed", 5000.0),
        (2, "Added", 2000.0),
        (3, "Started", 1000.0),
        (4, "Bought", 500.0),
    ]
    assert [row[3] for row in rates] == [None, 50.0, 40.0, 50.0, 50.0]
    assert [row[4] for row in rates] == [100.0, 50.0, 20.0, 10.0, 5.0]
    assert [row[5] for row in rates] == [1.0, 0.5, 0.2, 0.1, 0.05]
    assert [row[6] for row in rates] == [5000.0, 3000.0, 1000.0, 500.0, None]
    assert [row[7] for row in rates] == [50.0, 60.0, 50.0, 50.0, None]


def test_funnel_orders(visits):
    given = ["Bought", "missing", "Visited"]
    assert tuples(cm.funnel(visits, given, "step", "value", "given")) == [
        (0, "Bought", 500.0),
        (1, "missing", 0.0),
        (2, "Visited", 10000.0),
    ]
    assert [row[1] for row in tuples(cm.funnel(visits, given, "step", "value"))] == ["Visited", "Bought", "missing"]
    assert [row[1] for row in tuples(cm.funnel(visits, given, "step", "value", [1, 2, 0]))] == [
        "missing",
        "Visited",
        "Bought",
    ]


def test_equal_steps_stay_in_the_given_order(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "step string, value int")
    assert [row[1] for row in tuples(cm.funnel(rows, ["b", "a", "c"], "step", "value"))] == ["c", "b", "a"]


@pytest.mark.parametrize("order", [[0], [0, 1, 3], [0, 0, 1]])
def test_bad_step_order(visits, order):
    with pytest.raises(ValueError, match="step order"):
        cm.funnel(visits, STEPS[:3], "step", "value", order)


def test_funnel_without_values_has_no_shape(visits):
    assert tuples(cm.funnel_conversion(visits, ["x", "y"], "step", "value")) == []


def test_funnel_is_one_pass(load):
    plan = plan_of(cm.funnel_conversion(load("events"), ["view", "click"], "event_type", "value"))
    assert plan.count("Exchange") == 1
    assert "Join" not in plan and "Window" not in plan
    assert "In(event_type, [" in plan


def test_funnel_counts_distinct_users(spark):
    data = [("view", 1), ("view", 1), ("view", 2), ("buy", 1), ("buy", None), ("other", 3)]
    events = spark.createDataFrame(data, "kind string, who int")
    assert tuples(cm.funnel_counts(events, ["view", "buy", "none"], "kind", "who")) == [
        (0, "view", 2),
        (1, "buy", 1),
        (2, "none", 0),
    ]


USERS = {
    dt.date(2024, 1, 1): [1000, 800, 600, 400, 300],
    dt.date(2024, 1, 8): [1200, 900, 650, 450],
    dt.date(2024, 1, 15): [1100, 850, 620],
    dt.date(2024, 1, 22): [1300, 950],
    dt.date(2024, 1, 29): [1400],
}


@pytest.fixture(scope="module")
def cohort_rows(spark):
    data = [(day, period, n) for day, users in USERS.items() for period, n in enumerate(users)]
    return spark.createDataFrame(data, "cohort_date date, period_number int, users int")


def test_retention_golden(cohort_rows):
    matrix = tuples(cm.retention(cohort_rows, "cohort_date", "period_number", "users"))
    assert len(matrix) == 25
    rows = defaultdict(list)
    for cohort, _, _, size, pct in matrix:
        assert size == USERS[cohort][0]
        rows[cohort].append(pct)
    assert rows[dt.date(2024, 1, 1)] == pytest.approx([100, 80, 60, 40, 30])
    assert rows[dt.date(2024, 1, 8)] == pytest.approx([100, 75, 54.1667, 37.5, 0], abs=1e-4)
    assert rows[dt.date(2024, 1, 15)] == pytest.approx([100, 77.2727, 56.3636, 0, 0], abs=1e-4)
    assert rows[dt.date(2024, 1, 22)] == pytest.approx([100, 73.0769, 0, 0, 0], abs=1e-4)
    assert rows[dt.date(2024, 1, 29)] == pytest.approx([100, 0, 0, 0, 0])


def test_retention_absolute_and_wide(cohort_rows):
    counts = cm.retention(cohort_rows, "cohort_date", "period_number", "users", percentage=False)
    assert counts.columns == ["cohort", "period", "users"]
    wide = cm.retention_table(counts, "users")
    assert wide.columns == ["cohort"] + [f"period_{n}" for n in range(5)]
    assert tuples(wide)[3] == (dt.date(2024, 1, 22), 1300.0, 950.0, 0.0, 0.0, 0.0)
    assert cm.retention_table(counts, "users", periods=[0, 1]).columns == ["cohort", "period_0", "period_1"]
    with pytest.raises(Exception, match="no column for period"):
        cm.retention_table(counts, "users", periods=[0, 1]).collect()
    assert tuples(cm.retention_table(counts, "users", periods=range(5))) == tuples(wide)


def test_baseline_is_the_earliest_period_present(spark):
    rows = spark.createDataFrame([("a", 2, 50), ("a", 3, 25), ("b", 0, 0), ("b", 1, 5)], "c string, p int, u int")
    matrix = {row[:2]: row[3:] for row in tuples(cm.retention(rows, "c", "p", "u"))}
    assert matrix["a", 0] == (50.0, 0.0)
    assert matrix["a", 2] == (50.0, 100.0)
    assert matrix["a", 3] == (50.0, 50.0)
    assert matrix["b", 1] == (0.0, 0.0)


def test_retention_intensity(cohort_rows):
    shaded = cm.with_retention_intensity(cm.retention(cohort_rows, "cohort_date", "period_number", "users"))
    values = [row["intensity"] for row in shaded.collect()]
    assert max(values) == 1.0 and min(values) == 0.0
    at_once = cm.retention(cohort_rows, "cohort_date", "period_number", "users", intensity=True)
    assert tuples(at_once) == tuples(shaded)


def test_missing_period_is_an_error(spark):
    rows = spark.createDataFrame([("a", None, 5), ("a", 0, 5)], "c string, p int, u int")
    with pytest.raises(Exception, match="rows without a period number"):
        cm.retention(rows, "c", "p", "u").collect()


def test_cohorts_with_a_hot_user(spark):
    data = [(1, f"2024-01-{day:02} 10:00:00") for day in range(1, 29) for _ in range(5)]
    data += [(2, "2024-01-09 00:00:00"), (2, "2024-01-23 00:00:00")]
    data += [(3, "2024-01-10 00:00:00"), (None, "2024-01-01 00:00:00")]
    texts = spark.createDataFrame(data, "who int, at string")
    events = texts.select("who", F.col("at").cast("timestamp_ntz").alias("at"))
    found = sorted(tuples(cm.cohorts(events, "who", "at", "week")))
    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 8)
    assert found == [(first, 0, 1), (first, 1, 1), (first, 2, 1), (first, 3, 1), (second, 0, 2), (second, 2, 1)]


def test_hour_weekday(load):
    counts = tuples(cm.hour_weekday(load("events"), "ts"))
    assert all(0 <= hour < 24 and 0 <= weekday < 7 for hour, weekday, _ in counts)
    assert sum(row[2] for row in counts) == load("events").count()
