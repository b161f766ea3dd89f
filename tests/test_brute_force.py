"""Chart datasets against plain Python on random rows with NULL keys and a hot key."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from conftest import plan_of, tuples

import chartmill as cm
from chartmill.operators import running


def random_rows(seed: int, n: int = 400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = 1 if i % 3 == 0 else rng.choice([None, 2, 3, 4, rng.randint(5, 9)])
        series = rng.choice(["a", "b", None, "c", f"s{rng.randint(0, 4)}"])
        y = rng.choice([None, float(rng.randint(-5, 20)), float(rng.randint(0, 9))])
        rows.append((x, series, y))
    return rows + [(10, "only null", None)]


def summed(rows):
    cells = {}
    for x, series, y in rows:
        cells[x, series] = cells.get((x, series), 0.0) + (y or 0.0)
    return cells


def nulls_first(key):
    return (key is not None, key)


@pytest.fixture(params=[1, 2])
def rows(request):
    return random_rows(request.param)


@pytest.fixture
def frame(spark, rows):
    return spark.createDataFrame(rows, "x int, g string, y double").repartition(5)


def test_grouped(rows, frame):
    found = tuples(cm.line_series(frame, "x", "y", "g"))
    expected = summed(rows)
    assert {row[:2]: row[2] for row in found} == expected
    assert [row[:2] for row in found] == sorted(expected, key=lambda key: tuple(map(nulls_first, key)))


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_stacked(spark, rows, frame, threshold):
    """With the small sides broadcast by AQE, and with shuffle joins only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = cm.stacked_bar(frame, "y", "g", "x")
        actual = tuples(found)
        assert ("BroadcastHashJoin" in plan_of(found)) == (threshold == "10MB")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert actual == stacked(rows)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_stacked_at_scale(rows, frame, scale_out, monkeypatch, most):
    monkeypatch.setattr(running, "MAX_WINDOW_ROWS", most)
    assert tuples(cm.stacked_bar(frame, "y", "g", "x")) == stacked(rows)


def stacked(rows):
    cells = summed(rows)
    xs = sorted({x for x, _ in cells}, key=nulls_first)
    series = sorted({name for _, name in cells}, key=nulls_first)
    expected = []
    for x in xs:
        top = 0.0
        for name in series:
            y = cells.get((x, name), 0.0)
            expected.append((x, name, y, top, top + y))
            top += y
    return expected


@pytest.mark.parametrize("scale", [False, True])
def test_single_stack(request, rows, frame, scale):
    if scale:
        request.getfixturevalue("scale_out")
    totals = defaultdict(float)
    for _, name, y in rows:
        totals[name] += y or 0.0
    top, expected = 0.0, []
    for name in sorted(totals, key=nulls_first):
        expected.append((name, totals[name], top, top + totals[name]))
        top += totals[name]
    assert tuples(cm.stacked_bar(frame, "y", "g")) == expected


def test_shares(rows, frame):
    cells = summed(rows)
    totals = defaultdict(float)
    for (x, _), y in cells.items():
        totals[x] += y
    expected = {key: 100 * y / totals[key[0]] if totals[key[0]] else 0.0 for key, y in cells.items()}
    found = tuples(cm.bar_series(frame, "x", "y", "g", normalize=True))
    assert {row[:2]: row[3] for row in found} == pytest.approx(expected)


def test_heatmap(rows, frame):
    cells = {}
    for x, series, z in rows:
        if z is not None:
            cells[x, series] = cells.get((x, series), 0.0) + z
    low, high = min(cells.values()), max(0.0, *cells.values())
    shades = {key: (z - low) / (high - low) for key, z in cells.items()}
    found = tuples(cm.heatmap(frame, "x", "g", "y", bins=7))
    assert {row[:2]: row[3] for row in found} == pytest.approx(shades)
    assert {row[:2]: row[4] for row in found} == {key: min(7, int(shade * 7) + 1) for key, shade in shades.items()}


def test_retention(spark, rows):
    cells = {}
    for period, cohort, users in rows:
        if period is not None:
            cells[cohort, period] = cells.get((cohort, period), 0.0) + (users or 0.0)
    data = [row for row in rows if row[0] is not None]
    expected = {}
    for cohort in {c for c, _ in cells}:
        size = cells[cohort, min(p for c, p in cells if c == cohort)]
        for period in {p for _, p in cells}:
            users = cells.get((cohort, period), 0.0)
            expected[cohort, period] = (users, size, 100 * users / size if size > 0 else 0.0)
    frame = spark.createDataFrame(data, "period int, cohort string, users double")
    found = {row[:2]: row[2:] for row in tuples(cm.retention(frame, "cohort", "period", "users"))}
    assert found.keys() == expected.keys()
    for key, values in found.items():
        assert values == pytest.approx(expected[key])


def test_cohorts(spark):
    rng = random.Random(8)
    visits = [(7 if i % 3 == 0 else rng.randint(1, 40), rng.randint(0, 400)) for i in range(900)]
    events = spark.createDataFrame(visits, "who int, day int").selectExpr(
        "who", "TIMESTAMP_NTZ'2023-01-01 12:00:00' + make_dt_interval(day) AS at"
    )
    months = defaultdict(set)
    for who, at in tuples(events):
        months[who].add(at.year * 12 + at.month)
    expected = defaultdict(int)
    for active in months.values():
        for month in active:
            expected[min(active), month - min(active)] += 1
    found = {
        (cohort.year * 12 + cohort.month, period): users
        for cohort, period, users in tuples(cm.cohorts(events, "who", "at", "month"))
    }
    assert found == expected


def test_funnel(rows, frame):
    steps = ["c", "a", "never", "b"]
    totals = {step: sum(y or 0.0 for _, g, y in rows if g == step) for step in steps}
    ordered = sorted(steps, key=lambda step: -totals[step])
    expected = [(pos, step, totals[step]) for pos, step in enumerate(ordered)]
    assert tuples(cm.funnel(frame, steps, "g", "y")) == expected
