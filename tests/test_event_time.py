"""Streams by event time: late files, restarts and crashes give the batch result."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import tuples

import chartmill as cm
from chartmill.streaming import event_time
from chartmill.streaming.event_time import (
    cohort_changes, day_changes, read_cohorts, read_days, write_cohorts, write_days,
)
from chartmill.streaming.period_stream import open_stream, read_latest

START = dt.datetime(2024, 1, 3, 7)
SCHEMA = "user string, ts timestamp_ntz, kind string, value double"


def rows_of(seed, days, n=60):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        moment = START + dt.timedelta(days=rng.choice(days), minutes=rng.randrange(1440))
        made.append((f"u{rng.randrange(12)}", moment, rng.choice(["a", "b", None]), rng.choice([None, 1.5, -2.0, 7.0])))
    return made + [("busy", made[0][1], "a", 1.0)] * 40 + [(None, START, "a", 1.0), ("u1", None, "a", 1.0)]


def put(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("grain", ["day", "week", "month"])
def test_cohorts_with_a_late_file_and_a_restart(spark, tmp_path, grain):
    source, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    put(spark, rows_of(1, range(40, 60)), source)
    put(spark, rows_of(2, range(50, 90)), source)
    stream = open_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    changes = cohort_changes(stream, "user", "ts", grain)
    write_cohorts(changes, out, progress)
    for late in (None, rows_of(3, range(0, 20)), rows_of(4, range(30, 100))):
        if late:
            put(spark, late, source)
            write_cohorts(cohort_changes(stream, "user", "ts", grain), out, progress)
        expected = cm.cohorts(spark.read.parquet(source), "user", "ts", grain)
        assert sorted(tuples(read_cohorts(spark, out, grain))) == sorted(tuples(expected))


def test_a_batch_that_fails_and_runs_again_counts_once(spark, tmp_path, monkeypatch):
    source, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    put(spark, rows_of(1, range(40, 60)), source)
    stream = open_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    write_cohorts(cohort_changes(stream, "user", "ts"), out, progress)
    before = sorted(tuples(read_cohorts(spark, out)))
    put(spark, rows_of(2, range(0, 90)), source)
    write = event_time.write_dataset

    def broken(df, path, fmt):
        write(df, path, fmt)
        raise OSError("lost after the folder was written")

    monkeypatch.setattr(event_time, "write_dataset", broken)
    with pytest.raises(Exception, match="lost after"):
        write_cohorts(cohort_changes(stream, "user", "ts"), out, progress)
    monkeypatch.undo()
    write_cohorts(cohort_changes(stream, "user", "ts"), out, progress)
    after = sorted(tuples(read_cohorts(spark, out)))
    assert after == sorted(tuples(cm.cohorts(spark.read.parquet(source), "user", "ts"))) != before


@pytest.mark.parametrize("group", [None, "kind"])
def test_days_with_a_late_file_and_a_restart(spark, tmp_path, group):
    source, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    put(spark, rows_of(1, range(40, 60)), source)
    stream = open_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    changes = day_changes(stream, "ts", "value", "60 days", group)
    write_days(changes, out, progress)
    put(spark, rows_of(2, range(20, 45)), source)
    put(spark, rows_of(3, range(50, 70)), source)
    write_days(day_changes(stream, "ts", "value", "60 days", group), out, progress)
    days = read_latest(spark, out, changes.schema)
    events = spark.read.parquet(source).filter("ts IS NOT NULL")
    for agg in event_time.DAY_AGGREGATES:
        expected = tuples(cm.period_series(events, "ts", "value", "week", group, agg))
        assert sorted(tuples(read_days(days, "week", agg)), key=repr) == sorted(expected, key=repr)
    with pytest.raises(ValueError, match="median"):
        read_days(days, "week", "median")


def test_days_beyond_the_watermark_are_closed(spark, tmp_path):
    source, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    put(spark, [("u", START, "a", 1.0)], source)
    stream = open_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)

    def run(rows):
        put(spark, rows, source)
        write_days(day_changes(stream, "ts", "value", "2 days"), out, progress)
        return sorted(tuples(read_days(read_latest(spark, out, event_time._day_schema(day_changes(stream, "ts", "value", "2 days"))), "day")))

    later = START + dt.timedelta(days=30)
    first = run([("u", later, "a", 2.0)])
    assert first == [(START.date(), 1.0), (later.date(), 2.0)]
    assert run([("u", START, "a", 10.0), ("u", later, "a", 4.0)]) == [(START.date(), 1.0), (later.date(), 6.0)]
