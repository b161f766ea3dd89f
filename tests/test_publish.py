"""Runs of a batch published as a whole."""

from __future__ import annotations

import pytest
from conftest import tuples

import chartmill as cm
from chartmill.plans import publish
from chartmill.sources.sinks import folder_names


def charts_of(spark, factor, *more):
    rows = spark.createDataFrame([("a", 1.0 * factor), ('b "quoted", too', 2.0 * factor)], "x string, y double")
    bar = {"type": "bar", "x": "x", "y": "y", "agg": "sum"}
    spec = {"data": {"default": "t"}, "charts": [{**bar, "title": "one"}, {**bar, "title": "two"}, *more]}
    return cm.chart_batch(spark, spec, tables={"t": rows})


def published(spark, out):
    return {name: sorted(tuples(df)) for name, df in cm.read_published(spark, out).items()}


def whole(factor):
    return {name: [("a", 1.0 * factor), ('b "quoted", too', 2.0 * factor)] for name in ("one-bar", "two-bar")}


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_runs_replace_each_other_and_the_one_before_stays(spark, tmp_path, fmt):
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        cm.read_published(spark, out)
    runs, readers = [], []
    for factor in (1, 2, 3):
        assert all(outcome.ok for outcome in cm.publish_batch(charts_of(spark, factor), out, fmt))
        runs.append(publish.manifest(spark, out)["run"])
        readers.append(cm.read_published(spark, out))
        assert published(spark, out) == whole(factor)
    assert sorted(name for name in folder_names(spark, out) if name.startswith("run-")) == sorted(runs[1:])
    assert sorted(tuples(readers[1]["one-bar"])) == whole(2)["one-bar"]  # begun before the third run
    assert not [name for name in folder_names(spark, out) if "draft" in name]


@pytest.mark.parametrize("step", ["write_batch", "replace_file"])
def test_a_run_killed_half_way_leaves_the_old_results(spark, tmp_path, monkeypatch, step):
    out = str(tmp_path / "out")
    cm.publish_batch(charts_of(spark, 1), out)
    real = publish.write_batch

    def killed(*args):
        if step == "write_batch":
            real(*args)
        raise KeyboardInterrupt

    monkeypatch.setattr(publish, step, killed)
    with pytest.raises(KeyboardInterrupt):
        cm.publish_batch(charts_of(spark, 2), out)
    monkeypatch.undo()
    assert published(spark, out) == whole(1)
    cm.publish_batch(charts_of(spark, 3), out)
    assert published(spark, out) == whole(3)


def test_failed_charts_are_named_and_can_hold_back_a_run(spark, tmp_path):
    out = str(tmp_path / "out")
    bad = {"type": "bar", "title": "bad", "x": "nope", "y": "y"}
    outcomes = cm.publish_batch(charts_of(spark, 1, bad), out)
    assert [outcome.ok for outcome in outcomes] == [True, True, False]
    assert set(publish.manifest(spark, out)["failed"]) == {"bad-bar"}
    assert published(spark, out) == whole(1)
    outcomes = cm.publish_batch(charts_of(spark, 2, bad), out, allow_failed=False)
    assert not any(outcome.ok for outcome in outcomes)
    assert published(spark, out) == whole(1)
    assert len([name for name in folder_names(spark, out) if name.startswith("run-")]) == 1
