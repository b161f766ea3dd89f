from __future__ import annotations

import pytest
from conftest import tuples

from chartmill import period_series
from chartmill.streaming.period_stream import open_stream, read_latest, stream_period_series, write_available


def test_stream_in_batches_equals_the_batch_series(spark, load, tmp_path):
    events = load("events")
    source = str(tmp_path / "events")
    events.repartition(6).write.parquet(source)
    stream = open_stream(spark, source, events.schema, files_per_batch=2)
    out = str(tmp_path / "out")
    result = stream_period_series(stream, "ts", "value", "day", "event_type")
    write_available(result, out, str(tmp_path / "progress"))
    expected = {row[:2]: row[2] for row in tuples(period_series(events, "ts", "value", "day", "event_type"))}
    assert {row[:2]: row[2] for row in tuples(read_latest(spark, out, result.schema))} == pytest.approx(expected)

    # New files are added to what is known; old ones are not read again.
    events.limit(10).coalesce(1).write.mode("append").parquet(source)
    write_available(result, out, str(tmp_path / "progress"))
    counted = read_latest(spark, out, result.schema).agg({"y": "sum"}).first()[0]
    added = events.limit(10).agg({"value": "sum"}).first()[0]
    assert counted == pytest.approx(sum(expected.values()) + added)


def test_text_stream(spark, load, tmp_path):
    events = load("events").select("ts", "event_type", "value")
    source = str(tmp_path / "csv")
    events.repartition(3).write.option("header", True).csv(source)
    stream = open_stream(spark, source, events.schema, fmt="csv", files_per_batch=1)
    out = str(tmp_path / "out")
    result = stream_period_series(stream, "ts", "value", "month", agg="count")
    write_available(result, out, str(tmp_path / "p"))
    assert sum(row[1] for row in tuples(read_latest(spark, out, result.schema))) == events.count()


def test_no_running_median(spark, load):
    with pytest.raises(ValueError, match="median"):
        stream_period_series(load("events"), "ts", "value", agg="median")


def test_an_unfinished_result_is_not_read(spark, load, tmp_path):
    events = load("events")
    source, out = str(tmp_path / "events"), tmp_path / "out"
    events.repartition(4).write.parquet(source)
    result = stream_period_series(open_stream(spark, source, events.schema, files_per_batch=1), "ts", "value", "day")
    with pytest.raises(FileNotFoundError):
        read_latest(spark, str(out), result.schema)
    write_available(result, str(out), str(tmp_path / "progress"))
    assert sorted(path.name for path in out.iterdir()) == ["batch-000000000002", "batch-000000000003"]
    whole = sorted(tuples(read_latest(spark, str(out), result.schema)))
    (out / "batch-000000000004").mkdir()
    assert sorted(tuples(read_latest(spark, str(out), result.schema))) == whole
