"""Batches of charts and the streamed series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import chartmill as cm
from chartmill.streaming.period_stream import open_stream, read_latest, stream_period_series, write_available
from workload.registry import query, rounded, scratch, steady, steady_sql, table


def _spec(sf_dir: str) -> dict:
    """Five charts over three tables; the last one names a column that does not exist."""
    return {
        "data": {
            "default": f"{sf_dir}/events.parquet",
            "sources": {"sales": f"{sf_dir}/orders.parquet", "goods": f"{sf_dir}/part.parquet"},
        },
        "charts": [
            {
                "type": "line",
                "title": "Weekly value by type",
                "x": "week_start",
                "y": "value",
                "group_by": "event_type",
                "agg": "sum",
                "derive": {"week_start": "to_week(ts)"},
                "filter": {"exclude": {"event_type": ["error"]}},
            },
            {
                "type": "bar",
                "title": "Sales by priority",
                "data": "sales",
                "x": "o_orderpriority",
                "y": "o_totalprice",
                "agg": "sum",
                "filter": {"expression": "o_totalprice > 1000"},
                "sort": [{"column": "o_totalprice", "ascending": False}],
            },
            {
                "type": "bar-stacked",
                "title": "Status per year",
                "data": "sales",
                "x": "order_year",
                "y": "o_orderkey",
                "group_by": "o_orderstatus",
                "agg": "count",
                "derive": {"order_year": "to_year(o_orderdate)"},
            },
            {
                "type": "bar",
                "title": "Mean price by brand",
                "data": "goods",
                "x": "p_brand",
                "y": "p_retailprice",
                "agg": "mean",
            },
            {"type": "bar", "title": "Broken", "data": "goods", "x": "p_brnd", "y": "p_retailprice"},
        ],
    }


_CHARTS_SQL = """
    weekly AS (SELECT 'weekly-value-by-type-line' AS chart,
                      CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS x, event_type AS series,
                      sum(value) AS y
               FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3),
    priorities AS (SELECT 'sales-by-priority-bar' AS chart, o_orderpriority AS x, CAST(NULL AS VARCHAR) AS series,
                          sum(o_totalprice) AS y
                   FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2, 3),
    found AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS x, o_orderstatus AS series,
                     CAST(count(o_orderkey) AS DOUBLE) AS y FROM orders GROUP BY 1, 2),
    years AS (SELECT 'status-per-year-bar-stacked' AS chart, a.x, b.series, coalesce(f.y, 0) AS y
              FROM (SELECT DISTINCT x FROM found) a CROSS JOIN (SELECT DISTINCT series FROM found) b
              LEFT JOIN found f ON f.x = a.x AND f.series = b.series),
    brands AS (SELECT 'mean-price-by-brand-bar' AS chart, p_brand AS x, CAST(NULL AS VARCHAR) AS series,
                      avg(p_retailprice) AS y
               FROM part GROUP BY 1, 2, 3),
    charts AS (SELECT * FROM weekly UNION ALL SELECT * FROM priorities
               UNION ALL SELECT * FROM years UNION ALL SELECT * FROM brands)"""


@query("batch_run", f"WITH {_CHARTS_SQL} SELECT chart, count(*) AS n_rows FROM charts GROUP BY 1")
def batch_run(spark, sf_dir):
    with cm.chart_batch(spark, _spec(sf_dir)) as batch:
        return cm.row_counts(batch)


@query(
    "batch_status",
    f"""
    WITH {_CHARTS_SQL}
    SELECT chart, 'ok' AS status, count(*) AS n_rows FROM charts GROUP BY 1
    UNION ALL SELECT 'broken-bar', 'failed', NULL
    UNION ALL SELECT 'late-bar', 'failed', NULL
    """,
)
def batch_status(spark, sf_dir):
    """One chart names a column that does not exist, another one fails when its rows are read."""
    with cm.chart_batch(spark, _with_late_failure(_spec(sf_dir))) as batch:
        return cm.batch_status(batch)


def _with_late_failure(spec: dict) -> dict:
    late = {
        "type": "bar",
        "title": "Late",
        "data": "goods",
        "x": "p_brand",
        "y": "p_retailprice",
        "filter": {"expression": "p_size > 0 AND raise_error('late') IS NULL"},
    }
    return {**spec, "charts": [*spec["charts"], late]}


@query(
    "batch_written",
    f"""
    WITH {_CHARTS_SQL}
    SELECT chart, count(*) AS n_rows, count(*) AS n_read, {steady_sql("sum(y)", 2)} AS total FROM charts GROUP BY 1
    """,
)
def batch_written(spark, sf_dir):
    """Charts written by several threads, and read back; the failing ones leave no table."""
    with cm.chart_batch(spark, _with_late_failure(_spec(sf_dir))) as batch:
        outcomes = cm.write_batch(batch, scratch(spark, "charts"), parallel=3)
    parts = [
        spark.read.parquet(outcome.path)
        .agg(F.count(F.lit(1)).alias("n_read"), steady(F.sum("y"), 2).alias("total"))
        .select(F.lit(outcome.name).alias("chart"), F.lit(outcome.rows).cast("long").alias("n_rows"), "n_read", "total")
        for outcome in outcomes
        if outcome.ok
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "batch_one_scan",
    """
    SELECT 'by-status-bar' AS chart, o_orderstatus AS x, CAST(NULL AS VARCHAR) AS series, round(sum(o_totalprice), 2) AS y
    FROM orders WHERE o_totalprice > 500 GROUP BY 2
    UNION ALL
    SELECT 'by-year-line', CAST(year(o_orderdate) AS VARCHAR), o_orderstatus, CAST(count(o_orderkey) AS DOUBLE)
    FROM orders WHERE o_totalprice > 500 GROUP BY 2, 3
    UNION ALL
    SELECT 'top-bar', o_orderstatus, NULL, max(o_totalprice) FROM orders WHERE o_totalprice > 500 GROUP BY 2
    UNION ALL
    SELECT 'areas-area', o_orderpriority, o_orderstatus, min(o_totalprice) FROM orders WHERE o_totalprice > 500 GROUP BY 2, 3
    """,
)
def batch_one_scan(spark, sf_dir):
    """Four charts over the same rows, aggregated in one scan."""
    same = {"derive": {"order_year": "to_year(o_orderdate)"}, "filter": {"expression": "o_totalprice > 500"}}
    charts = [
        {"type": "bar", "title": "By status", "x": "o_orderstatus", "y": "o_totalprice"},
        {"type": "line", "title": "By year", "x": "order_year", "y": "o_orderkey", "group_by": "o_orderstatus", "agg": "count"},
        {"type": "bar", "title": "Top", "x": "o_orderstatus", "y": "o_totalprice", "agg": "max"},
        {"type": "area", "title": "Areas", "x": "o_orderpriority", "y": "o_totalprice", "group_by": "o_orderstatus", "agg": "min", "stacked": False},
    ]
    spec = {"data": {"default": f"{sf_dir}/orders.parquet"}, "charts": [{**chart, **same} for chart in charts]}
    with cm.chart_batch(spark, spec) as batch:
        return cm.long_form(batch).withColumn("y", rounded("y", 2))


@query(
    "spec_concat",
    """
    SELECT o_orderstatus || ' - ' || o_orderpriority AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1
    """,
)
def spec_concat(spark, sf_dir):
    """The documented spelling of a join with a separator, in a spec."""
    chart = {
        "type": "bar",
        "title": "Labels",
        "x": "label",
        "y": "o_totalprice",
        "derive": {"label": "concat(o_orderstatus, o_orderpriority, ' - ')"},
    }
    with cm.chart_batch(spark, {"data": {"default": f"{sf_dir}/orders.parquet"}, "charts": [chart]}) as batch:
        return batch.build("labels-bar").withColumn("y", rounded("y", 2))


@query("batch_long", f"WITH {_CHARTS_SQL} SELECT chart, x, series, {steady_sql('y', 2)} AS y FROM charts")
def batch_long(spark, sf_dir):
    with cm.chart_batch(spark, _spec(sf_dir)) as batch:
        return cm.long_form(batch).withColumn("y", steady("y", 2))


@query(
    "batch_sources",
    """
    SELECT 'default-bar' AS chart, c_mktsegment AS x, round(sum(c_acctbal), 2) AS y FROM customer GROUP BY 1, 2
    UNION ALL SELECT 'named-bar', o_orderstatus, round(sum(o_totalprice), 2) FROM orders GROUP BY 1, 2
    UNION ALL SELECT 'path-bar', p_brand, round(sum(p_retailprice), 2) FROM part GROUP BY 1, 2
    UNION ALL SELECT 'frame-bar', event_type, round(sum(value), 2) FROM events GROUP BY 1, 2
    """,
)
def batch_sources(spark, sf_dir):
    """The chart's own source (a name, a path, a DataFrame), else the override of the default."""
    spec = {
        "data": {"default": f"{sf_dir}/nation.parquet", "sources": {"sales": f"{sf_dir}/orders.parquet"}},
        "charts": [
            {"type": "bar", "title": "default", "x": "c_mktsegment", "y": "c_acctbal"},
            {"type": "bar", "title": "named", "data": "sales", "x": "o_orderstatus", "y": "o_totalprice"},
            {
                "type": "bar",
                "title": "path",
                "data": f"{sf_dir}/part.parquet",
                "x": "p_brand",
                "y": "p_retailprice",
            },
            {"type": "bar", "title": "frame", "data": "clicks", "x": "event_type", "y": "value"},
        ],
    }
    tables = {"clicks": table(spark, sf_dir, "events")}
    with cm.chart_batch(spark, spec, data=f"{sf_dir}/customer.parquet", tables=tables) as batch:
        return cm.long_form(batch).select("chart", "x", "y").withColumn("y", rounded("y", 2))


@query(
    "stream_weekly_series",
    """
    SELECT CAST(date_trunc('week', ts) AS DATE) AS x, event_type AS series, round(sum(value), 4) AS y
    FROM events GROUP BY 1, 2
    """,
)
def stream_weekly_series(spark, sf_dir):
    """The weekly series from a file stream, worked off in batches."""
    rows = table(spark, sf_dir, "events")
    arriving = scratch(spark, "arriving")
    rows.repartition(4, "event_id").write.parquet(arriving)
    events = open_stream(spark, arriving, rows.schema, files_per_batch=1)
    out = scratch(spark, "weekly")
    write_available(
        stream_period_series(events, "ts", "value", "week", "event_type"), out, scratch(spark, "progress")
    )
    line = read_latest(spark, out, "x DATE, series STRING, y DOUBLE")
    return line.withColumn("y", rounded("y"))


@query(
    "batch_published",
    """
    SELECT 'sales-by-priority-bar' AS chart, o_orderpriority AS x, round(sum(o_totalprice), 2) AS y
    FROM orders WHERE o_totalprice > 1000 GROUP BY ALL
    UNION ALL
    SELECT 'sales-by-status-bar', o_orderstatus, round(sum(o_totalprice), 2) FROM orders GROUP BY ALL
    """,
)
def batch_published(spark, sf_dir):
    """Two runs of one spec into the same place; what is read is the second run, as a whole."""
    sales = f"{sf_dir}/orders.parquet"
    bar = {"type": "bar", "y": "o_totalprice", "agg": "sum"}
    charts = [
        {**bar, "title": "Sales by priority", "x": "o_orderpriority", "filter": {"expression": "o_totalprice > 1000"}},
        {**bar, "title": "Sales by status", "x": "o_orderstatus"},
    ]
    out = scratch(spark, "published")
    for chosen in (charts[:1], charts):
        with cm.chart_batch(spark, {"data": {"default": sales}, "charts": chosen}) as batch:
            cm.publish_batch(batch, out)
    parts = [
        df.select(F.lit(name).alias("chart"), "x", rounded("y", 2).alias("y"))
        for name, df in cm.read_published(spark, out).items()
    ]
    return reduce(DataFrame.unionByName, parts)
