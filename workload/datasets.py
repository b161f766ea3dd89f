"""Chart datasets: series, stacks, shares, heatmaps, scatter, funnels, retention, feeders."""

from __future__ import annotations

import chartmill as cm
from workload.registry import query, rounded, steady, steady_sql, table

STEPS = ["view", "click", "signup", "purchase"]


def _round_all(df, *names, digits=4):
    return df.withColumns({name: rounded(name, digits) for name in names})


def _daily_events(spark, sf_dir):
    return cm.derive(table(spark, sf_dir, "events"), {"day": "to_date(ts)"})


def _monthly_orders(spark, sf_dir):
    return cm.derive(table(spark, sf_dir, "orders"), {"month_start": "to_month(o_orderdate)"})


# --- line, area, bar ---------------------------------------------------------


@query("line_simple", "SELECT CAST(ts AS DATE) AS x, round(sum(value), 4) AS y FROM events GROUP BY 1")
def line_simple(spark, sf_dir):
    return _round_all(cm.line_series(_daily_events(spark, sf_dir), "day", "value"), "y")


@query(
    "line_grouped",
    "SELECT CAST(ts AS DATE) AS x, event_type AS series, round(sum(value), 4) AS y FROM events GROUP BY 1, 2",
)
def line_grouped(spark, sf_dir):
    return _round_all(cm.line_series(_daily_events(spark, sf_dir), "day", "value", "event_type"), "y")


@query(
    "area_simple",
    """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS x, round(sum(o_totalprice), 2) AS y
    FROM orders GROUP BY 1
    """,
)
def area_simple(spark, sf_dir):
    return _round_all(
        cm.area_series(_monthly_orders(spark, sf_dir), "month_start", "o_totalprice"), "y", digits=2
    )


@query(
    "area_grouped",
    f"""
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS x, o_orderstatus AS series,
           {steady_sql("avg(o_totalprice)")} AS y
    FROM orders GROUP BY 1, 2
    """,
)
def area_grouped(spark, sf_dir):
    area = cm.area_series(
        _monthly_orders(spark, sf_dir), "month_start", "o_totalprice", "o_orderstatus", agg="mean"
    )
    return area.withColumn("y", steady("y"))


_STACK_SQL = """
    WITH cells AS ({cells}),
    grid AS (
        SELECT a.x, b.series, coalesce(c.y, 0) AS y
        FROM (SELECT DISTINCT x FROM cells) a
        CROSS JOIN (SELECT DISTINCT series FROM cells) b
        LEFT JOIN cells c ON c.x = a.x AND c.series = b.series)
    SELECT x, series, round(y, 2) AS y,
           round(coalesce(sum(y) OVER (PARTITION BY x ORDER BY series
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS y_start,
           round(sum(y) OVER (PARTITION BY x ORDER BY series ROWS UNBOUNDED PRECEDING), 2) AS y_end
    FROM grid
    """


@query(
    "area_stacked",
    _STACK_SQL.format(
        cells="""SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS x,
                        o_orderpriority || '/' || o_orderstatus AS series, sum(o_totalprice) AS y
                 FROM orders GROUP BY 1, 2"""
    ),
)
def area_stacked(spark, sf_dir):
    columns = {"week_start": "to_week(o_orderdate)", "kind": "concat_sep(o_orderpriority, o_orderstatus, '/')"}
    rows = cm.derive(table(spark, sf_dir, "orders"), columns)
    stack = cm.area_series(rows, "week_start", "o_totalprice", "kind", stacked=True)
    return _round_all(stack, "y", "y_start", "y_end", digits=2)


@query(
    "area_stacked_many_series",
    _STACK_SQL.format(
        cells="SELECT l_returnflag AS x, l_partkey AS series, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2"
    ),
)
def area_stacked_many_series(spark, sf_dir):
    """Few x, each with a stack of many series."""
    stack = cm.area_series(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_partkey", stacked=True)
    return _round_all(stack, "y", "y_start", "y_end", digits=2)


@query(
    "area_stacked_ranged",
    _STACK_SQL.format(
        cells="SELECT l_linestatus AS x, l_suppkey AS series, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2"
    ),
)
def area_stacked_ranged(spark, sf_dir):
    """The plan for large tables: stacks summed over sorted ranges, no stack in one task."""
    stack = cm.area_series(
        table(spark, sf_dir, "lineitem"), "l_linestatus", "l_quantity", "l_suppkey", stacked=True, large=True
    )
    return _round_all(stack, "y", "y_start", "y_end", digits=2)


@query(
    "area_stacked_normalized",
    f"""
    WITH cells AS (SELECT CAST(ts AS DATE) AS x, event_type AS series, sum(value) AS y FROM events GROUP BY 1, 2),
    grid AS (
        SELECT a.x, b.series, coalesce(c.y, 0) AS y
        FROM (SELECT DISTINCT x FROM cells) a CROSS JOIN (SELECT DISTINCT series FROM cells) b
        LEFT JOIN cells c ON c.x = a.x AND c.series = b.series),
    shares AS (SELECT *, CASE WHEN sum(y) OVER (PARTITION BY x) <> 0
                              THEN 100 * y / sum(y) OVER (PARTITION BY x) ELSE 0 END AS share FROM grid)
    SELECT x, series, round(y, 4) AS y, {steady_sql("share")} AS share_pct,
           {steady_sql("coalesce(sum(share) OVER (PARTITION BY x ORDER BY series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")}
           AS y_start,
           {steady_sql("sum(share) OVER (PARTITION BY x ORDER BY series ROWS UNBOUNDED PRECEDING)")} AS y_end
    FROM shares
    """,
)
def area_stacked_normalized(spark, sf_dir):
    stack = cm.area_series(
        _daily_events(spark, sf_dir), "day", "value", "event_type", stacked=True, normalize=True
    )
    return _round_all(stack, "y").withColumns({name: steady(name) for name in ("share_pct", "y_start", "y_end")})


@query(
    "area_normalized",
    f"""
    WITH cells AS (SELECT CAST(ts AS DATE) AS x, event_type AS series, sum(value) AS y FROM events GROUP BY 1, 2)
    SELECT x, series, round(y, 4) AS y,
           {steady_sql("100 * y / sum(y) OVER (PARTITION BY x)")} AS share_pct
    FROM cells
    """,
)
def area_normalized(spark, sf_dir):
    area = cm.area_series(_daily_events(spark, sf_dir), "day", "value", "event_type", normalize=True)
    return _round_all(area, "y").withColumn("share_pct", steady("share_pct"))


@query("bar_simple", "SELECT p_brand AS x, round(sum(p_retailprice), 2) AS y FROM part GROUP BY 1")
def bar_simple(spark, sf_dir):
    return _round_all(cm.bar_series(table(spark, sf_dir, "part"), "p_brand", "p_retailprice"), "y", digits=2)


@query(
    "bar_grouped",
    "SELECT p_type AS x, p_brand AS series, CAST(count(p_size) AS DOUBLE) AS y FROM part GROUP BY 1, 2",
)
def bar_grouped(spark, sf_dir):
    return cm.bar_series(table(spark, sf_dir, "part"), "p_type", "p_size", "p_brand", agg="count")


@query(
    "bar_stacked",
    _STACK_SQL.format(
        cells="""SELECT l_suppkey AS x, l_returnflag AS series, sum(l_quantity) AS y
                 FROM lineitem GROUP BY 1, 2"""
    ),
)
def bar_stacked(spark, sf_dir):
    stack = cm.stacked_bar(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", "l_suppkey")
    return _round_all(stack, "y", "y_start", "y_end", digits=2)


@query(
    "bar_stacked_total",
    """
    WITH cells AS (SELECT o_orderpriority AS series, sum(o_totalprice) AS y FROM orders GROUP BY 1)
    SELECT series, round(y, 2) AS y,
           round(coalesce(sum(y) OVER (ORDER BY series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2)
           AS y_start,
           round(sum(y) OVER (ORDER BY series ROWS UNBOUNDED PRECEDING), 2) AS y_end
    FROM cells
    """,
)
def bar_stacked_total(spark, sf_dir):
    stack = cm.stacked_bar(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return _round_all(stack, "y", "y_start", "y_end", digits=2)


@query(
    "bar_stacked_total_ranged",
    """
    WITH cells AS (SELECT l_partkey AS series, sum(l_quantity) AS y FROM lineitem GROUP BY 1)
    SELECT series, round(y, 2) AS y,
           round(coalesce(sum(y) OVER (ORDER BY series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2)
           AS y_start,
           round(sum(y) OVER (ORDER BY series ROWS UNBOUNDED PRECEDING), 2) AS y_end
    FROM cells
    """,
)
def bar_stacked_total_ranged(spark, sf_dir):
    """The plan for large tables: one stack of many series, summed over sorted ranges."""
    stack = cm.stacked_bar(table(spark, sf_dir, "lineitem"), "l_quantity", "l_partkey", large=True)
    return _round_all(stack, "y", "y_start", "y_end", digits=2)


@query(
    "extent_zero_based",
    """
    WITH cells AS (SELECT CAST(ts AS DATE) AS x, sum(value) AS y FROM events GROUP BY 1)
    SELECT CAST(0 AS DOUBLE) AS y_lo, round(greatest(max(y), 0) * 1.1, 4) AS y_hi FROM cells
    """,
)
def extent_zero_based(spark, sf_dir):
    line = cm.line_series(_daily_events(spark, sf_dir), "day", "value")
    return _round_all(cm.value_extent(line), "y_hi")


@query("series_keys", "SELECT DISTINCT event_type AS series FROM events")
def series_keys(spark, sf_dir):
    return cm.series_keys(table(spark, sf_dir, "events"), "event_type")


@query(
    "capped_bars",
    """
    SELECT l_suppkey AS x, round(sum(l_quantity), 2) AS y FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 20
    """,
)
def capped_bars(spark, sf_dir):
    """The cap cuts the chart, not the input: each bar is the sum of all its rows."""
    bars = cm.bar_series(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", max_points=20)
    return _round_all(bars, "y", digits=2)


# --- heatmap -----------------------------------------------------------------


@query(
    "heatmap_cells",
    """
    SELECT l_shipdate AS x, l_returnflag AS y, round(sum(l_quantity), 2) AS z FROM lineitem GROUP BY 1, 2
    """,
)
def heatmap_cells(spark, sf_dir):
    cells = cm.heatmap_cells(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_returnflag", "l_quantity")
    return _round_all(cells, "z", digits=2)


@query(
    "heatmap_intensity",
    f"""
    WITH cells AS (SELECT CAST(ts AS DATE) AS x, event_type AS y, sum(value) AS z FROM events GROUP BY 1, 2),
    ends AS (SELECT min(z) AS lo, greatest(max(z), 0) AS hi FROM cells)
    SELECT x, y, round(z, 4) AS z,
           {steady_sql("CASE WHEN hi > lo THEN (z - lo) / (hi - lo) ELSE 0.5 END", 6)} AS intensity
    FROM cells, ends
    """,
)
def heatmap_intensity(spark, sf_dir):
    cells = cm.heatmap_cells(_daily_events(spark, sf_dir), "day", "event_type", "value")
    return _round_all(cm.with_intensity(cells), "z").withColumn("intensity", steady("intensity", 6))


_HOUR_WEEKDAY_SQL = """SELECT CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
                              count(*) AS events FROM events GROUP BY 1, 2"""


@query("heatmap_hour_weekday", _HOUR_WEEKDAY_SQL)
def heatmap_hour_weekday(spark, sf_dir):
    return cm.hour_weekday(table(spark, sf_dir, "events"), "ts")


@query(
    "heatmap_bins",
    f"""
    WITH cells AS ({_HOUR_WEEKDAY_SQL}),
    scaled AS (SELECT hour AS x, weekday AS y, CAST(events AS DOUBLE) AS z,
                      (SELECT CAST(min(events) AS DOUBLE) FROM cells) AS lo,
                      (SELECT CAST(max(events) AS DOUBLE) FROM cells) AS hi FROM cells),
    shaded AS (SELECT x, y, z, CASE WHEN hi > lo THEN (z - lo) / (hi - lo) ELSE 0.5 END AS intensity FROM scaled)
    SELECT x, y, z, {steady_sql("intensity", 6)} AS intensity,
           CAST(least(10, floor(intensity * 10) + 1) AS INTEGER) AS bin
    FROM shaded
    """,
)
def heatmap_bins(spark, sf_dir):
    counts = cm.hour_weekday(table(spark, sf_dir, "events"), "ts")
    map_ = cm.heatmap(counts, "hour", "weekday", "events", bins=10)
    return map_.withColumn("intensity", steady("intensity", 6))


# --- scatter -----------------------------------------------------------------


@query(
    "scatter_points",
    "SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, p_brand AS series FROM part",
)
def scatter_points(spark, sf_dir):
    return cm.scatter_points(table(spark, sf_dir, "part"), "p_size", "p_retailprice", "p_brand")


@query(
    "scatter_extent",
    """
    SELECT round(min(l_quantity) - (max(l_quantity) - min(l_quantity)) * 0.1, 4) AS x_lo,
           round(max(l_quantity) + (max(l_quantity) - min(l_quantity)) * 0.1, 4) AS x_hi,
           round(min(l_extendedprice) - (max(l_extendedprice) - min(l_extendedprice)) * 0.1, 4) AS y_lo,
           round(max(l_extendedprice) + (max(l_extendedprice) - min(l_extendedprice)) * 0.1, 4) AS y_hi
    FROM lineitem
    """,
)
def scatter_extent(spark, sf_dir):
    points = cm.scatter_points(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return _round_all(cm.scatter_extent(points), "x_lo", "x_hi", "y_lo", "y_hi")


# --- funnel ------------------------------------------------------------------

_STEP_SQL = """
    steps(given, step) AS (VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'purchase')),
    v AS (SELECT s.given, s.step, coalesce(sum(e.value), 0) AS value
          FROM steps s LEFT JOIN events e ON e.event_type = s.step GROUP BY 1, 2)"""


def _funnel(spark, sf_dir, step_order):
    funnel = cm.funnel(table(spark, sf_dir, "events"), STEPS, "event_type", "value", step_order)
    return _round_all(funnel, "value")


@query("funnel_steps", f"WITH {_STEP_SQL} SELECT given AS pos, step, round(value, 4) AS value FROM v")
def funnel_steps(spark, sf_dir):
    return _funnel(spark, sf_dir, "given")


@query(
    "funnel_ordered",
    f"""
    WITH {_STEP_SQL}
    SELECT CASE step WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS pos,
           step, round(value, 4) AS value
    FROM v
    """,
)
def funnel_ordered(spark, sf_dir):
    return _funnel(spark, sf_dir, [2, 0, 3, 1])


@query(
    "funnel_by_value",
    f"""
    WITH {_STEP_SQL}
    SELECT CAST(row_number() OVER (ORDER BY value DESC, given) - 1 AS INTEGER) AS pos, step,
           round(value, 4) AS value
    FROM v
    """,
)
def funnel_by_value(spark, sf_dir):
    return _funnel(spark, sf_dir, None)


@query(
    "funnel_conversion",
    f"""
    WITH {_STEP_SQL}
    SELECT given AS pos, step, round(value, 4) AS value,
           {steady_sql("100 * value / nullif(lag(value) OVER w, 0)")} AS step_rate,
           {steady_sql("100 * value / nullif(first_value(value) OVER w, 0)")} AS overall_rate,
           {steady_sql("value / (SELECT max(value) FROM v)", 6)} AS width_ratio
    FROM v WHERE (SELECT max(value) FROM v) > 0
    WINDOW w AS (ORDER BY given)
    """,
)
def funnel_conversion(spark, sf_dir):
    rates = cm.funnel_conversion(table(spark, sf_dir, "events"), STEPS, "event_type", "value", "given")
    return rates.select(
        "pos",
        "step",
        rounded("value").alias("value"),
        steady("step_rate").alias("step_rate"),
        steady("overall_rate").alias("overall_rate"),
        steady("width_ratio", 6).alias("width_ratio"),
    )


@query(
    "funnel_dropoff",
    f"""
    WITH {_STEP_SQL},
    placed AS (SELECT *, row_number() OVER (ORDER BY value DESC, given) - 1 AS pos FROM v)
    SELECT CAST(pos AS INTEGER) AS pos, step, round(value - lead(value) OVER w, 4) AS dropped,
           {steady_sql("100 * (value - lead(value) OVER w) / nullif(value, 0)")} AS drop_rate
    FROM placed WINDOW w AS (ORDER BY pos)
    """,
)
def funnel_dropoff(spark, sf_dir):
    rates = cm.funnel_conversion(table(spark, sf_dir, "events"), STEPS, "event_type", "value")
    return rates.select(
        "pos", "step", rounded("dropped").alias("dropped"), steady("drop_rate").alias("drop_rate")
    )


@query(
    "legend_funnel",
    """
    SELECT event_type AS series FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1
    """,
)
def legend_funnel(spark, sf_dir):
    """The steps of a funnel as its legend names them."""
    chart = {"type": "funnel", "steps": STEPS, "step_col": "event_type", "values": "value"}
    return cm.legend(table(spark, sf_dir, "events"), chart)


@query(
    "funnel_from_events",
    """
    WITH steps(given, step) AS (VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'purchase'))
    SELECT s.given AS pos, s.step, count(DISTINCT e.user_id) AS value
    FROM steps s LEFT JOIN events e ON e.event_type = s.step GROUP BY 1, 2
    """,
)
def funnel_from_events(spark, sf_dir):
    return cm.funnel_counts(table(spark, sf_dir, "events"), STEPS, "event_type", "user_id")


# --- retention ---------------------------------------------------------------


def _cohort_sql(grain: str) -> str:
    """cohort, period, users from orders."""
    return f"""
    active AS (SELECT DISTINCT o_custkey AS who, CAST(date_trunc('{grain}', o_orderdate) AS DATE) AS p FROM orders),
    firsts AS (SELECT who, min(p) AS cohort FROM active GROUP BY 1),
    cells AS (SELECT cohort, CAST(date_diff('{grain}', cohort, p) AS INTEGER) AS period, count(*) AS users
              FROM active JOIN firsts USING (who) GROUP BY 1, 2)"""


_GRID_SQL = """,
    grid AS (SELECT a.cohort, b.period, CAST(coalesce(c.users, 0) AS DOUBLE) AS users
             FROM (SELECT DISTINCT cohort FROM cells) a CROSS JOIN (SELECT DISTINCT period FROM cells) b
             LEFT JOIN cells c ON c.cohort = a.cohort AND c.period = b.period),
    base AS (SELECT cohort, CAST(arg_min(users, period) AS DOUBLE) AS cohort_size FROM cells GROUP BY 1),
    pct AS (SELECT cohort, period, users, cohort_size,
                   CASE WHEN cohort_size > 0 THEN 100 * users / cohort_size ELSE 0 END AS retention_pct
            FROM grid JOIN base USING (cohort))"""


def _matrix(spark, sf_dir, grain, percentage=True, intensity=False):
    cells = cm.cohorts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", grain)
    return cm.retention(cells, "cohort", "period_number", "users", percentage, intensity)


@query(
    "retention_from_events",
    f"WITH {_cohort_sql('month')} SELECT cohort, period AS period_number, users FROM cells",
)
def retention_from_events(spark, sf_dir):
    return cm.cohorts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "month")


@query(
    "retention_matrix",
    f"""
    WITH {_cohort_sql("quarter")} {_GRID_SQL}
    SELECT cohort, period, users, cohort_size, {steady_sql("retention_pct")} AS retention_pct FROM pct
    """,
)
def retention_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir, "quarter").withColumn("retention_pct", steady("retention_pct"))


@query("retention_absolute", f"WITH {_cohort_sql('month')} {_GRID_SQL} SELECT cohort, period, users FROM grid")
def retention_absolute(spark, sf_dir):
    return _matrix(spark, sf_dir, "month", percentage=False)


@query(
    "retention_intensity",
    f"""
    WITH {_cohort_sql("year")} {_GRID_SQL}
    SELECT cohort, period, {steady_sql("retention_pct")} AS retention_pct,
           {steady_sql("retention_pct / (SELECT max(retention_pct) FROM pct)", 6)} AS intensity
    FROM pct WHERE (SELECT max(retention_pct) FROM pct) > 0
    """,
)
def retention_intensity(spark, sf_dir):
    shaded = _matrix(spark, sf_dir, "year", intensity=True)
    return shaded.select(
        "cohort",
        "period",
        steady("retention_pct").alias("retention_pct"),
        steady("intensity", 6).alias("intensity"),
    )


_PERIODS = range(7)


@query(
    "retention_pivot",
    f"WITH {_cohort_sql('year')} {_GRID_SQL} SELECT cohort, "
    + ", ".join(
        steady_sql(f"max(CASE WHEN period = {p} THEN retention_pct END)") + f" AS period_{p}" for p in _PERIODS
    )
    + " FROM pct GROUP BY cohort",
)
def retention_pivot(spark, sf_dir):
    """The periods are those of the data; a year more or less than the SQL lists would show."""
    wide = cm.retention_table(_matrix(spark, sf_dir, "year"))
    return wide.withColumns({name: steady(name) for name in wide.columns if name != "cohort"})


# --- feeders -----------------------------------------------------------------


@query(
    "weekly_series",
    """
    SELECT CAST(date_trunc('week', ts) AS DATE) AS x, event_type AS series, round(sum(value), 4) AS y
    FROM events GROUP BY 1, 2
    """,
)
def weekly_series(spark, sf_dir):
    line = cm.period_series(table(spark, sf_dir, "events"), "ts", "value", "week", "event_type")
    return _round_all(line, "y")
