"""Sketches, bitmaps, sessions and ordered funnels against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from conftest import optimized, plan_of, tuples
from pyspark.sql import functions as F

import chartmill as cm
from chartmill.operators.sketches import quantile_error, value_bucket

START = dt.datetime(2024, 3, 30, 22)


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(2)
    kinds = {
        "wide": lambda: rng.choice((-1, 1)) * math.exp(rng.uniform(-40, 40)),
        "powers": lambda: rng.choice((-1.0, 1.0)) * 2.0 ** rng.randint(-1074, 1023),
        "money": lambda: round(rng.expovariate(0.05), 2),
        "odd": lambda: rng.choice((0.0, -0.0, None, float("nan"), float("inf"), float("-inf"), 5e-324, 1.7e308, 7.0)),
    }
    rows = [(kind, day, make()) for kind, make in kinds.items() for day in range(9) for _ in range(rng.randint(1, 60))]
    return rows, spark.createDataFrame(rows, "kind string, day int, `my value` double").repartition(4)


def test_quantiles_of_merged_sketches_are_within_the_stated_error(values):
    rows, df = values
    days = cm.quantile_sketch(df, ["kind", "day"], "my value")
    weeks = cm.merge_sketches(days.withColumn("week", F.expr("day div 7")), ["kind", "week"])
    percents = [0, 1, 25, 50, 75, 90, 99.9, 100]
    got = {(r.kind, r.week, r.percent): r.value for r in cm.quantiles(weeks, percents).collect()}
    for kind in ("wide", "powers", "money", "odd"):
        for week in (0, 1):
            own = sorted(v for k, d, v in rows if k == kind and d // 7 == week and v is not None and math.isfinite(v))
            for p in percents:
                exact = own[max(math.ceil(len(own) * float(p) / 100), 1) - 1]
                assert abs(got[kind, week, p] - exact) <= quantile_error() * abs(exact) * (1 + 1e-12) or abs(exact) < 1e-300


def test_merging_gives_the_sketch_of_all_rows(values):
    _, df = values
    direct = cm.quantile_sketch(df, ["kind"], "my value")
    merged = cm.merge_sketches(cm.quantile_sketch(df, ["kind", "day"], "my value"), ["kind"])
    assert sorted(tuples(direct)) == sorted(tuples(merged))


def test_buckets_are_ordered_as_the_values(spark):
    numbers = sorted(s * f * 2.0**e for s in (-1, 1) for e in (-1000, -3, 0, 5, 900) for f in (1, 1 + 2**-52, 1.5, 2 - 2**-52)) + [0.0]
    df = spark.createDataFrame([(x,) for x in sorted(numbers)], "x double").coalesce(1)
    buckets = [r[0] for r in df.select(value_bucket(F.col("x"))).collect()]
    assert buckets == sorted(buckets)


def test_sketches_refuse_text_and_bad_percentiles(values, spark):
    with pytest.raises(ValueError, match="numeric"):
        cm.quantile_sketch(values[1], ["day"], "kind")
    with pytest.raises(ValueError, match="percentile"):
        cm.sketch_quantile(101)
    empty = spark.createDataFrame([], "day int, v double")
    assert tuples(cm.quantiles(cm.quantile_sketch(empty, ["day"], "v"), [50])) == []


# --- distinct ids ------------------------------------------------------------


@pytest.fixture(scope="module")
def visits(spark):
    rng = random.Random(8)
    ids = [None, 0, 1, -1, -32768, 32767, 32768, 32769, 65536, 2**40, *range(100, 160)]
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(40)), rng.choice("ab"), rng.choice(ids)) for _ in range(700)]
    return rows, spark.createDataFrame(rows, "day date, kind string, `who is` long").repartition(3)


def test_distinct_ids_of_any_union(visits):
    rows, df = visits
    daily = cm.id_bitmaps(df, ["day", "kind"], "who is")
    months = cm.distinct_ids(daily.withColumn("month", F.month("day")), ["month"])
    assert dict(tuples(months)) == {m: len({w for d, _, w in rows if d.month == m and w is not None}) for m in (1, 2)}
    by_kind = cm.distinct_ids(cm.merge_bitmaps(daily, ["kind"]), ["kind"])
    assert dict(tuples(by_kind)) == {k: len({w for _, kind, w in rows if kind == k and w is not None}) for k in "ab"}


def test_rolling_distinct_ids(visits):
    rows, df = visits
    daily = cm.id_bitmaps(df, ["day", "kind"], "who is")
    got = {(r.day, r.kind): r.users for r in cm.rolling_distinct(daily, "day", 3, ["kind"]).collect()}
    days = {d for d, _, w in rows if w is not None}
    for day in days:
        for kind in "ab":
            want = {w for d, k, w in rows if k == kind and 0 <= (day - d).days < 3 and w is not None}
            assert got.get((day, kind), 0) == len(want)
    assert {d for d, _ in got} <= days


def test_dense_ids_have_no_gaps(spark):
    df = spark.createDataFrame([(c * n,) for c in "abcxyz" for n in range(1, 30)] * 2 + [(None,)], "name string").repartition(5)
    numbers = cm.dense_ids(df, "name")
    assert sorted(r.number for r in numbers.collect()) == list(range(1, 6 * 29 + 1))
    assert numbers.select("id").distinct().count() == 6 * 29
    with pytest.raises(ValueError, match="dense_ids"):
        cm.id_bitmaps(df, [], "name")


# --- sessions ----------------------------------------------------------------


@pytest.fixture(scope="module", params=["timestamp_ntz", "timestamp"])
def events(spark, request):
    rng = random.Random(6)
    rows = [(None, START, "a", 1.0), (1, None, "a", 1.0)]
    for user in range(8):
        at = START
        for _ in range(rng.choice((1, 5, 80))):
            at += dt.timedelta(seconds=rng.choice((0, 1, 60, 599, 600, 601, 3000, 90000)), microseconds=rng.choice((0, 0, 1)))
            rows.append((user, at, rng.choice("abcx"), rng.choice((None, 2.5))))
    df = spark.createDataFrame(rows, "u long, `at time` timestamp_ntz, step string, v double")
    return rows, df.withColumn("at time", F.col("at time").cast(request.param)).repartition(4)


def test_sessions_match_a_scan(events):
    rows, df = events
    want = []
    for user in range(8):
        own = sorted((t, v or 0.0) for u, t, _, v in rows if u == user and t is not None)
        runs = [[own[0]]]
        for one in own[1:]:
            if one[0] - runs[-1][-1][0] > dt.timedelta(minutes=10):
                runs.append([])
            runs[-1].append(one)
        want += [(user, i + 1, r[0][0], r[-1][0], len(r), sum(v for _, v in r)) for i, r in enumerate(runs)]
    assert sorted(tuples(cm.sessions(df, "u", "at time", 10, "v"))) == want


def test_session_hours_count_all_sessions(events):
    found = cm.sessions(events[1], "u", "at time", 10)
    hours = cm.session_hours(found).collect()
    assert sum(r.sessions for r in hours) == found.count()
    assert sum(r.events for r in hours) == len(events[0]) - 2


def test_events_are_reduced_before_they_are_sorted(events):
    plan = plan_of(cm.sessions(events[1], "u", "at time", 10))
    assert plan.count("partial_min") >= 1 and "session_window" not in plan
    assert optimized(cm.sessions(events[1], "u", "at time", 10)).count("Window") == 2


# --- ordered funnels ---------------------------------------------------------


def reached_by_hand(rows, user, steps, width):
    own = [(t, s) for u, t, s, _ in rows if u == user and t is not None]
    best = 0
    for start, first in own:
        if first != steps[0]:
            continue
        at, depth = start, 1
        for name in steps[1:]:
            later = [t for t, s in own if s == name and at < t <= start + width]
            if not later:
                break
            at, depth = min(later), depth + 1
        best = max(best, depth)
    return best


@pytest.mark.parametrize("steps, hours", [("abc", 1), ("abc", 30), ("aab", 2), ("ca", 0.01), ("abcx", 24 * 365)])
def test_ordered_funnel_matches_a_scan(events, steps, hours):
    rows, df = events
    want = [reached_by_hand(rows, user, steps, dt.timedelta(hours=hours)) for user in range(8)]
    got = tuples(cm.ordered_funnel(df, "u", "at time", "step", list(steps), hours))
    assert got == [(i, name, sum(depth > i for depth in want)) for i, name in enumerate(steps)]


def test_ordered_funnel_has_no_join(events):
    plan = plan_of(cm.ordered_funnel(events[1], "u", "at time", "step", ["a", "b", "c"], 1))
    assert "Join" not in plan


def test_windows_and_gaps_must_be_positive(events):
    with pytest.raises(ValueError):
        cm.sessions(events[1], "u", "at time", 0)
    with pytest.raises(ValueError):
        cm.ordered_funnel(events[1], "u", "at time", "step", ["a"], 0)
    with pytest.raises(ValueError):
        cm.ordered_funnel(events[1], "u", "at time", "step", [], 1)
    with pytest.raises(ValueError):
        cm.rolling_distinct(events[1], "u", 0)
