from __future__ import annotations

import json
import os

import pytest
from conftest import DATA, tuples

import chartmill as cm
from chartmill.plans import batch as batches
from chartmill.sources.resolve import Sources


def spec(*charts, **data):
    return {"data": data or {"default": f"{DATA}/events.parquet"}, "charts": list(charts)}


LINE = {"type": "line", "title": "Daily Value", "x": "day", "y": "value", "derive": {"day": "to_date(ts)"}}
BAR = {"type": "bar", "x": "event_type", "y": "value", "agg": "count"}
BROKEN = {"type": "bar", "title": "broken", "x": "no_such_column", "y": "value"}


@pytest.mark.parametrize(
    ("chart", "message"),
    [
        ({"type": "pie", "x": "a", "y": "b"}, "pie"),
        ({"type": "line", "x": "a"}, "'y'"),
        ({"type": "area", "y": "a"}, "'x'"),
        ({"type": "bar-stacked", "x": "a", "y": "b"}, "'group_by'"),
        ({"type": "heatmap", "x": "a", "y": "b"}, "'z'"),
        ({"type": "funnel", "values": "a"}, "'steps'"),
        ({"type": "funnel", "steps": ["a"]}, "'values'"),
        ({"type": "funnel", "steps": ["a", "b"], "values": "v", "step_order": [0, 2]}, "step order"),
        ({"type": "retention", "cohort_date": "a", "period_number": "b"}, "'users'"),
        ({"type": "line", "x": "a", "y": "b", "agg": "average"}, "average"),
        ({"type": "heatmap", "x": "a", "y": "b", "z": "c", "bins": 1}, "bins"),
        ({"type": "line", "x": "a", "y": "b", "filter": {}}, "filter"),
        ({"type": "line", "x": "a", "y": "b", "filter": {"include": {"a": []}}}, "'a'"),
        ({"type": "line", "x": "a", "y": "b", "filter": {"expression": " "}}, "expression"),
    ],
)
def test_rules(chart, message):
    if chart.get("filter") == {}:
        chart = {**chart, "filter": {"include": {}}}
    with pytest.raises(ValueError, match=message):
        cm.check_chart(chart)


def test_a_spec_needs_charts_and_names_the_broken_one():
    with pytest.raises(ValueError, match="at least one"):
        cm.check_spec({"charts": []})
    with pytest.raises(ValueError, match="chart 2"):
        cm.check_spec(spec(BAR, {"type": "line", "x": "a"}))


def test_specs_from_files(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(spec(BAR)))
    (tmp_path / "a.yaml").write_text("charts:\n  - type: bar\n    x: event_type\n    y: value\n    agg: count\n")
    assert cm.load_spec(str(tmp_path / "a.json"))["charts"] == [BAR]
    assert cm.load_spec(str(tmp_path / "a.yaml"))["charts"] == [BAR]


def test_every_chart_type(spark):
    every = [
        LINE,
        {**LINE, "type": "area", "group_by": "event_type"},
        {**LINE, "type": "area", "group_by": "event_type", "stacked": False, "normalize": True},
        BAR,
        {**BAR, "group_by": "user_id", "stacked": True},
        {**BAR, "type": "bar-stacked", "group_by": "user_id"},
        {"type": "heatmap", "x": "h", "y": "w", "z": "value", "derive": {"h": "to_hour(ts)", "w": "weekday(ts)"}},
        {"type": "scatter", "x": "user_id", "y": "value", "group_by": "event_type"},
        {"type": "scatter", "x": "user_id", "y": "value", "agg": "mean"},
        {"type": "funnel", "steps": ["view", "click"], "values": "value", "step_col": "event_type"},
        {"type": "funnel", "steps": ["view"], "values": "value", "x": "event_type", "conversion_rates": True},
        {"type": "retention", "cohort_date": "d", "period_number": "w", "users": "value",
         "derive": {"d": "to_week(ts)", "w": "weekday(ts)"}},
    ]
    batch = cm.chart_batch(spark, spec(*every))
    assert batch.errors == {}
    columns = [df.columns for df in batch.datasets.values()]
    assert columns == [
        ["x", "y"],
        ["x", "series", "y", "y_start", "y_end"],
        ["x", "series", "y", "share_pct"],
        ["x", "y"],
        ["x", "series", "y", "y_start", "y_end"],
        ["x", "series", "y", "y_start", "y_end"],
        ["x", "y", "z", "intensity", "bin"],
        ["x", "y", "series"],
        ["x", "y"],
        ["pos", "step", "value"],
        ["pos", "step", "value", "step_rate", "overall_rate", "width_ratio", "dropped", "drop_rate"],
        ["cohort", "period", "users", "cohort_size", "retention_pct"],
    ]
    assert all(count > 0 for _, count in tuples(cm.row_counts(batch)))


def test_the_only_text_column_holds_the_steps(spark, tmp_path):
    (tmp_path / "f.csv").write_text("step,value\nVisited,100\nBought,25\n")
    chart = {"type": "funnel", "steps": ["Visited", "Bought"], "values": "value"}
    batch = cm.chart_batch(spark, spec(chart, default=str(tmp_path / "f.csv")))
    assert tuples(batch.datasets["chart-1-funnel"]) == [(0, "Visited", 100.0), (1, "Bought", 25.0)]


def test_sort_and_limit_use_source_names(spark):
    chart = {**BAR, "agg": "sum", "sort": [{"column": "value", "ascending": False}], "limit": 2}
    rows = tuples(cm.build_chart(spark.read.parquet(f"{DATA}/events.parquet"), chart))
    assert len(rows) == 2 and rows[0][1] >= rows[1][1]


def test_failures_are_isolated(spark):
    batch = cm.chart_batch(spark, spec(LINE, BROKEN, {**BAR, "data": "/no/such/table.parquet"}, BAR))
    assert list(batch.datasets) == ["daily-value-line", "chart-4-bar"]
    assert set(batch.errors) == {"broken-bar", "chart-3-bar"}
    status = {row[0]: row[1:] for row in tuples(cm.batch_status(batch))}
    assert status["broken-bar"] == ("failed", None)
    assert status["chart-4-bar"] == ("ok", 5)


def test_missing_source_is_reported_per_chart(spark):
    batch = cm.chart_batch(spark, {"charts": [BAR, {**BAR, "data": f"{DATA}/events.parquet"}]})
    assert "no data source" in batch.errors["chart-1-bar"]
    assert list(batch.datasets) == ["chart-2-bar"]


def test_equal_titles_get_different_names(spark):
    batch = cm.chart_batch(spark, spec({**BAR, "title": "Same"}, {**BAR, "title": "same!"}))
    assert list(batch.datasets) == ["same-bar", "same-bar-2"]


def test_source_precedence(spark):
    frame = spark.range(3)
    sources = Sources(spark, "d", {"n": "named.parquet"}, None, {"t": frame})
    assert (sources.pick("n"), sources.pick(None)) == ("n", "d")
    assert Sources(spark, "d", None, "o").pick(None) == "o"
    assert Sources(spark, "d", None, "o").pick("c") == "c"
    assert sources.open("t") is frame
    with pytest.raises(ValueError, match="no data source"):
        Sources(spark).pick(None)


def test_a_shared_csv_is_read_once_and_released(spark, tmp_path):
    (tmp_path / "u.csv").write_text("channel,users\na,1\nb,2\n")
    chart = {"type": "bar", "x": "channel", "y": "users"}
    with cm.chart_batch(spark, spec(chart, chart, default=str(tmp_path / "u.csv"))) as batch:
        assert [row[1] for row in tuples(cm.row_counts(batch))] == [2, 2] and batch.cached == []
    other = {**chart, "filter": {"expression": "users > 0"}}
    with cm.chart_batch(spark, spec(chart, other, default=str(tmp_path / "u.csv"))) as batch:
        assert batch.cached == []
        assert [row[1] for row in tuples(cm.row_counts(batch))] == [2, 2]
        assert len(batch.cached) == 1
        source = batch.cached[0]
        assert source.storageLevel.useMemory
    assert not source.storageLevel.useMemory
    assert cm.chart_batch(spark, spec(BAR, BAR)).cached == []


def test_a_large_shared_csv_is_copied_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "CACHE_BYTES", 0)
    (tmp_path / "u.csv").write_text("channel,users,created\na,1,12/01/2023\nb,2,12/02/2023\n")
    day = {"type": "line", "x": "created_parsed", "y": "users", "filter": {"expression": "users > 0"}}
    bar = {"type": "bar", "x": "channel", "y": "users"}
    with cm.chart_batch(spark, spec(day, bar, default=str(tmp_path / "u.csv"))) as batch:
        assert batch.cached == [] and batch.staged == []
        built = [batch.build(name) for name in batch.datasets]
        assert batch.cached == [] and len(batch.staged) == 1
        path = batch.staged[0]
        assert all(path in df.inputFiles()[0] for df in built)
        assert [row[1] for row in tuples(cm.row_counts(batch))] == [2, 2]
    assert not os.path.exists(path)


def test_a_broken_source_is_tried_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "CACHE_BYTES", 0)
    (tmp_path / "bad.csv").write_text("x,y\na,1\nb,2,3\n")
    bar = {"type": "bar", "x": "x", "y": "y", "agg": "median"}
    good = {**BAR, "data": f"{DATA}/events.parquet"}
    batch = cm.chart_batch(spark, spec(bar, bar, good, default=str(tmp_path / "bad.csv")))
    outcomes = cm.write_batch(batch, str(tmp_path / "out"))
    assert [outcome.name for outcome in outcomes if outcome.ok] == ["chart-3-bar"]
    assert all("MALFORMED" in outcome.error or "malformed" in outcome.error.lower() for outcome in outcomes if not outcome.ok)
    assert len(batch.staged) == 1
    batch.close()


@pytest.mark.parametrize("uses", [1, 2])
def test_cells_of_unused_columns_do_not_matter(spark, tmp_path, uses):
    (tmp_path / "bad.csv").write_text("x,y,unused\na,1,5\nb,2,x\n")
    source = {"path": str(tmp_path / "bad.csv"), "schema": "x STRING, y BIGINT, unused BIGINT"}
    bar = {"type": "bar", "x": "x", "y": "y", "data": "s"}
    with cm.chart_batch(spark, spec(*[bar] * uses, sources={"s": source})) as batch:
        outcomes = cm.write_batch(batch, str(tmp_path / "out"))
    assert [outcome.rows for outcome in outcomes] == [2] * uses


def test_planning_a_batch_runs_no_job(spark, scale_out):
    stack = {"type": "bar-stacked", "x": "event_type", "y": "value", "group_by": "user_id"}
    median = {"type": "bar", "title": "Median", "x": "event_type", "y": "value", "agg": "median"}
    tables = {"events": spark.read.parquet(f"{DATA}/events.parquet")}  # Spark reads the schema in a job
    spark.sparkContext.setJobGroup("planning", "")
    batch = cm.chart_batch(spark, spec(stack, median, default="events"), tables=tables)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    assert len(batch.datasets) == 2 and list(jobs) == []
    assert [row[1] for row in tuples(cm.batch_status(batch))] == ["ok", "ok"]


def test_failures_while_rows_are_read_leave_the_status_of_others(spark):
    late = {**BAR, "title": "late", "filter": {"expression": "value > 0 AND raise_error('boom') IS NULL"}}
    batch = cm.chart_batch(spark, spec(late, BAR, BROKEN))
    status = {row[0]: row[1:] for row in tuples(cm.batch_status(batch))}
    assert status == {"late-bar": ("failed", None), "chart-2-bar": ("ok", 5), "broken-bar": ("failed", None)}
    outcome = next(o for o in cm.write_batch(batch, "/tmp/chartmill-none") if o.name == "late-bar")
    assert "boom" in outcome.error and "o4" not in outcome.error


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("concat(event_type, props, ' - ')", "join"),
        ("CONCAT(upper(event_type), 'b', '/')", "join"),
        ("concat(event_type, props)", "spark"),
        ("concat(event_type, props, '-', 'x')", "spark"),
        ("upper(concat(event_type, props, ' - '))", "refused"),
        ("concat(event_type, props, event_type)", "refused"),
    ],
)
def test_concat_in_a_spec(spark, text, label):
    chart = {"type": "bar", "x": "label", "y": "value", "agg": "count", "derive": {"label": text}}
    batch = cm.chart_batch(spark, spec(chart))
    if label == "refused":
        assert "concat_sep" in batch.errors["chart-1-bar"]
        return
    expected = text if label == "spark" else {"concat(event_type, props, ' - ')": "event_type || ' - ' || props"}.get(text, "upper(event_type) || '/b'")
    rows = spark.read.parquet(f"{DATA}/events.parquet").selectExpr(f"{expected} AS label").distinct().count()
    assert batch.build("chart-1-bar").count() == rows
    assert {row.x for row in batch.build("chart-1-bar").collect()} == {
        row.label for row in spark.read.parquet(f"{DATA}/events.parquet").selectExpr(f"{expected} AS label").collect()
    }


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_written_batch(spark, tmp_path, fmt):
    late = {**BAR, "title": "late", "filter": {"expression": "raise_error('boom') IS NULL"}}
    batch = cm.chart_batch(spark, spec(LINE, BROKEN, late, BAR))
    outcomes = {outcome.name: outcome for outcome in cm.write_batch(batch, str(tmp_path), fmt, parallel=3)}
    assert [name for name, outcome in outcomes.items() if outcome.ok] == ["daily-value-line", "chart-4-bar"]
    assert outcomes["daily-value-line"].rows == 30
    assert outcomes["chart-4-bar"].rows == 5
    assert outcomes["late-bar"].error and outcomes["broken-bar"].error
    path = outcomes["chart-4-bar"].path
    assert spark.read.option("header", True).format(fmt).load(path).count() == 5


def test_long_form(spark):
    batch = cm.chart_batch(spark, spec(LINE, {**BAR, "group_by": "user_id"}))
    long = cm.long_form(batch)
    assert long.columns == ["chart", "x", "series", "y"]
    assert {row[0] for row in tuples(long.select("chart").distinct())} == {"daily-value-line", "chart-2-bar"}


def test_spec_file_as_a_job(spark, tmp_path, capsys):
    from chartmill.__main__ import main as run_job

    (tmp_path / "good.json").write_text(json.dumps(spec(LINE, BAR)))
    assert run_job(["--spec", str(tmp_path / "good.json"), "--out", str(tmp_path / "out"), "--format", "json"]) == 0
    assert "2 written, 0 failed" in capsys.readouterr().out
    (tmp_path / "bad.json").write_text(json.dumps(spec(BAR, BROKEN)))
    assert run_job(["--spec", str(tmp_path / "bad.json"), "--out", str(tmp_path / "out2")]) == 1
    assert "broken-bar" in capsys.readouterr().out


@pytest.mark.parametrize(
    ("chart", "labels"),
    [
        (LINE, ["value"]),
        (
            {**LINE, "group_by": "event_type", "filter": {"include": {"event_type": ["click", "view"]}}},
            ["click", "view"],
        ),
        ({"type": "scatter", "x": "user_id", "y": "value"}, ["value vs user_id"]),
        ({"type": "heatmap", "x": "user_id", "y": "event_type", "z": "value"}, ["value"]),
        (
            {"type": "funnel", "steps": ["view", "click"], "values": "value", "x": "event_type", "step_order": [1, 0]},
            ["click", "view"],
        ),
        ({"type": "retention", "cohort_date": "ts", "period_number": "user_id", "users": "value"}, ["retention_pct"]),
    ],
)
def test_legend(load, chart, labels):
    found = [row[0] for row in tuples(cm.legend(load("events"), chart))]
    assert (found if chart["type"] == "funnel" else sorted(found)) == labels


def test_a_source_with_a_schema(spark, tmp_path):
    (tmp_path / "export").mkdir()
    (tmp_path / "export" / "part-0").write_text("a,1\nb,2\n")
    source = {"path": str(tmp_path / "export"), "fmt": "csv", "header": False, "schema": "kind STRING, n BIGINT"}
    chart = {"type": "bar", "data": "export", "x": "kind", "y": "n"}
    with cm.chart_batch(spark, spec(chart, {**chart, "agg": "median"}, sources={"export": source})) as batch:
        assert tuples(batch.build("chart-1-bar")) == [("a", 1.0), ("b", 2.0)]
        assert len(batch.cached) == 1


def test_unknown_table_format(spark):
    with pytest.raises(ValueError, match="orc"):
        cm.read_table(spark, "/tmp/none", fmt="orc")


def test_plain_charts_over_the_same_rows_share_one_scan(spark, tmp_path):
    charts = [
        {"type": "bar", "x": "event_type", "y": "value"},
        {"type": "bar", "x": "event_type", "y": "value", "agg": "mean", "sort": [{"column": "value", "ascending": False}], "limit": 2},
        {"type": "line", "x": "user_id", "y": "value", "group_by": "event_type", "agg": "count", "max_points": 7},
        {"type": "bar", "x": "event_type", "y": "value", "group_by": "event_type", "agg": "max"},
        {"type": "bar", "x": "event_type", "y": "value", "filter": {"include": {"event_type": "view"}}},
    ]
    batch = cm.chart_batch(spark, spec(*charts))
    source = spark.read.parquet(f"{DATA}/events.parquet")
    for name, chart in zip(batch.datasets, charts):
        built = batch.build(name)
        assert tuples(built) == tuples(cm.build_chart(source, chart))
        shared = chart.get("filter") is None
        assert ("FileScan" not in built._jdf.queryExecution().executedPlan().toString()) == shared


def test_null_keys_and_values_in_a_shared_scan(spark):
    rows = spark.createDataFrame([("a", None, 1), (None, "p", None), (None, None, 4), ("a", "p", 2)], "x STRING, g STRING, y INT")
    charts = [{"type": "bar", "x": "x", "y": "y"}, {"type": "line", "x": "x", "y": "y", "group_by": "g"}, {"type": "bar", "x": "g", "y": "y", "agg": "count"}]
    batch = cm.chart_batch(spark, spec(*charts, default="t"), tables={"t": rows})
    for name, chart in zip(batch.datasets, charts):
        assert tuples(batch.build(name)) == tuples(cm.build_chart(rows, chart))


def test_one_failing_chart_of_a_shared_scan_fails_alone(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2**62), ("a", 2**62), ("b", 1)], "x STRING, y BIGINT")
    charts = [{"type": "bar", "x": "x", "y": "y"}, {"type": "bar", "x": "x", "y": "y", "agg": "max"}]
    batch = cm.chart_batch(spark, spec(*charts, default="t"), tables={"t": rows})
    outcomes = cm.write_batch(batch, str(tmp_path))
    assert [outcome.ok for outcome in outcomes] == [False, True]
