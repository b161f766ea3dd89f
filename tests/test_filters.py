from __future__ import annotations

import pytest
from conftest import plan_of, tuples
from pyspark.errors import AnalysisException

from chartmill import apply_filters


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "search", 10), (2, "direct", 20), (3, None, 30), (4, "social", None), (5, "direct", 7)],
        "id int, channel string, users int",
    )


def ids(df):
    return sorted(row[0] for row in tuples(df))


@pytest.mark.parametrize(
    ("filters", "kept"),
    [
        ({"include": {"channel": "direct"}}, [2, 5]),
        ({"include": {"channel": ["direct", "search"]}}, [1, 2, 5]),
        ({"exclude": {"channel": "direct"}}, [1, 4]),
        ({"exclude": {"channel": ["direct", "search"]}}, [4]),
        ({"include": {"channel": ["direct"], "users": "20"}}, [2]),
        ({"include": {"channel": ["direct", "search"]}, "exclude": {"users": ["7"]}}, [1, 2]),
        ({"expression": "users > 10"}, [2, 3]),
        ({"expression": "users >= 10 AND NOT (channel = 'direct' OR channel IS NULL)"}, [1]),
        ({"expression": "channel LIKE 's%'"}, [1, 4]),
        ({"expression": "channel NOT IN ('direct')"}, [1, 4]),
        ({"expression": 'channel IN ("direct", "social")'}, [2, 4, 5]),
        ({"expression": "users BETWEEN 7 AND 10"}, [1, 5]),
        ({"expression": "users IS NULL"}, [4]),
    ],
)
def test_kept_rows(rows, filters, kept):
    assert ids(apply_filters(rows, **filters)) == kept


def test_values_are_cast_to_the_column_type(rows):
    assert ids(apply_filters(rows, include={"users": ["7", "abc"]})) == [5]
    assert ids(apply_filters(rows, include={"users": "abc"})) == []
    assert ids(apply_filters(rows, exclude={"users": ["7", "abc"]})) == [1, 2, 3]
    assert ids(apply_filters(rows, exclude={"users": "abc"})) == [1, 2, 3, 5]


def test_values_may_be_numbers(rows):
    assert ids(apply_filters(rows, include={"users": 7})) == [5]
    assert ids(apply_filters(rows, exclude={"users": [7, 20]})) == [1, 3]


def test_date_column(spark):
    days = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-01'), (2, DATE'2024-02-01') AS t(id, day)")
    assert ids(apply_filters(days, include={"day": "2024-01-01"})) == [1]
    assert ids(apply_filters(days, expression="day >= '2024-01-15' AND day < '2025-01-01'")) == [2]


@pytest.mark.parametrize(
    "filters",
    [
        {"include": {"": "a"}},
        {"include": {"channel": ""}},
        {"exclude": {"channel": []}},
        {"exclude": {"channel": [None]}},
        {"expression": "  "},
    ],
)
def test_empty_parts_are_rejected(rows, filters):
    with pytest.raises(ValueError):
        apply_filters(rows, **filters)


def test_missing_column_is_reported_with_a_suggestion(rows):
    with pytest.raises(AnalysisException, match="channel"):
        apply_filters(rows, include={"chanel": "direct"})


def test_filters_and_columns_reach_the_scan(load):
    filtered = apply_filters(load("part"), include={"p_size": ["7", "abc"]}, exclude={"p_brand": "Brand#1"})
    plan = plan_of(filtered.select("p_partkey"))
    assert "In(p_size, [7" in plan
    assert "Not(EqualTo(p_brand,Brand#1))" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_size:int>" in plan
