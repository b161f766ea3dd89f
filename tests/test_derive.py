from __future__ import annotations

import datetime as dt
import math

import pytest
from conftest import plan_of

from chartmill import derive, period_series
from chartmill.functions.grains import period_start, periods_between
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql(
        "SELECT DATE'2023-12-31' AS d, TIMESTAMP_NTZ'2024-02-29 23:59:59' AS ts, 'google' AS source, "
        "'cpc' AS medium, 2.5 AS amount, -4D AS debt, 9D AS square, 0 AS nothing"
    )


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("to_week(d)", dt.date(2023, 12, 25)),
        ("to_week(ts)", dt.date(2024, 2, 26)),
        ("to_month(d)", dt.date(2023, 12, 1)),
        ("to_quarter(d)", dt.date(2023, 10, 1)),
        ("to_year(d)", 2023),
        ("to_hour(ts)", 23),
        ("to_date(ts)", dt.date(2024, 2, 29)),
        ("weekday(d)", 6),
        ("weekday(to_week(d))", 0),
        ("weekday_name(d)", "Sunday"),
        ("source_medium(source, medium)", "google / cpc"),
        ("source_medium(source, CAST(NULL AS STRING))", None),
        ("concat_sep(source, medium, '-')", "google-cpc"),
        ("upper(source)", "GOOGLE"),
        ("lower('ABC')", "abc"),
        ("round(2.345D, 2)", 2.35),
        ("round(-2.5D, 0)", -3.0),
        ("abs(debt)", 4.0),
        ("log(square)", math.log(9)),
        ("log(debt)", None),
        ("sqrt(square)", 3.0),
        ("round(square / 7 * 100, 2)", 128.57),
        ("try_divide(square, nothing)", None),
    ],
)
def test_functions(row, text, value):
    result = derive(row, {"out": text}).select("out").first()[0]
    if isinstance(value, float):
        assert float(result) == pytest.approx(value)
    else:
        assert result == value


def test_order_is_kept(row):
    derived = derive(row, {"a": "square + 1", "b": "a * 2", "a2": "b - a"}).select("a", "b", "a2").first()
    assert tuple(derived) == (10.0, 20.0, 10.0)


def test_functions_are_inlined(load):
    plan = plan_of(derive(load("events"), {"w": "to_week(ts)", "h": "to_hour(ts)"}).select("w", "h"))
    assert "Python" not in plan
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan


@pytest.mark.parametrize(
    ("grain", "start", "distance"),
    [
        ("day", dt.date(2024, 5, 15), 500),
        ("week", dt.date(2024, 5, 13), 72),
        ("month", dt.date(2024, 5, 1), 16),
        ("quarter", dt.date(2024, 4, 1), 5),
        ("year", dt.date(2024, 1, 1), 1),
    ],
)
def test_grains(spark, grain, start, distance):
    days = spark.sql("SELECT DATE'2023-01-01' AS a, DATE'2024-05-15' AS b")
    a, b = period_start(F.col("a"), grain), period_start(F.col("b"), grain)
    assert tuple(days.select(b, periods_between(a, b, grain)).first()) == (start, distance)


def test_unknown_grain(load):
    with pytest.raises(ValueError, match="fortnight"):
        period_series(load("events"), "ts", "value", "fortnight")
