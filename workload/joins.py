"""Joins of sources, with heavy keys and in specs."""

from __future__ import annotations

from pyspark.sql import functions as F

import chartmill as cm
from workload.registry import query, rounded, table


@query(
    "join_fact_tables",
    """
    SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
    """,
)
def join_fact_tables(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = cm.join_sources(lines, orders, {"l_orderkey": "o_orderkey"}, large=True)
    grouped = joined.groupBy("o_orderpriority", "l_returnflag")
    return grouped.agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_extendedprice"), 2).alias("price"))


@query(
    "join_heavy_keys",
    """
    WITH highest AS (SELECT event_type, max(value) AS top FROM events GROUP BY event_type)
    SELECT CAST(date_trunc('month', ts) AS DATE) AS month, e.event_type, count(*) AS n,
           count(*) FILTER (WHERE value * 2 > top) AS n_high
    FROM events e JOIN highest h ON e.event_type = h.event_type GROUP BY ALL
    """,
)
def join_heavy_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    highest = events.groupBy("event_type").agg(F.max("value").alias("top"))
    joined = cm.join_sources(events, highest, "event_type", "inner", large=True)
    return (
        cm.derive(joined, {"month": "to_date(to_month(ts))"})
        .groupBy("month", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") * 2 > F.col("top")).alias("n_high"))
    )


@query(
    "join_without_partner",
    """
    SELECT c_mktsegment, count(*) AS n FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY ALL
    """,
)
def join_without_partner(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    idle = cm.join_sources(table(spark, sf_dir, "customer"), pending, {"c_custkey": "o_custkey"}, "anti", large=True)
    return idle.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "spec_join",
    """
    SELECT r_name AS x, year(o_orderdate)::VARCHAR AS series, round(sum(o_totalprice), 2) AS y
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
    """,
)
def spec_join(spark, sf_dir):
    places = {"left": f"{sf_dir}/nation.parquet", "right": f"{sf_dir}/region.parquet", "on": {"n_regionkey": "r_regionkey"}}
    buyers = {"left": f"{sf_dir}/customer.parquet", "right": "places", "on": {"c_nationkey": "n_nationkey"}}
    sales = {"left": f"{sf_dir}/orders.parquet", "right": "buyers", "on": {"o_custkey": "c_custkey"}, "how": "inner"}
    chart = {
        "type": "bar",
        "title": "Sales by region",
        "x": "r_name",
        "y": "o_totalprice",
        "group_by": "year",
        "agg": "sum",
        "derive": {"year": "CAST(year(o_orderdate) AS STRING)"},
    }
    spec = {"data": {"default": sales, "sources": {"places": places, "buyers": buyers}}, "charts": [chart]}
    batch = cm.chart_batch(spark, spec)
    if batch.errors:
        raise ValueError(str(batch.errors))
    (name,) = batch.datasets
    return batch.build(name).withColumn("y", rounded("y", 2))
