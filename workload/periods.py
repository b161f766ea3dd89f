"""Quantile sketches, distinct users of merged periods, sessions, ordered funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

import chartmill as cm
from workload.registry import query, rounded, steady, steady_sql, table

PERCENTS = [5, 50, 90, 99.5]
STEPS = ["view", "click", "purchase"]

# Buckets of a double: a power of two in 64 parts; the value of a bucket is its middle.
_BUCKETS = """
    powers AS (SELECT *, CAST(floor(log2(abs(value))) AS BIGINT) AS guess FROM events WHERE value IS NOT NULL AND value <> 0),
    exact AS (SELECT *, guess + (abs(value) >= pow(2.0, guess + 1))::BIGINT - (abs(value) < pow(2.0, guess))::BIGINT AS power FROM powers),
    numbered AS (
      SELECT ts, event_type, sign(value)::BIGINT * ((power + 1075) * 64 + CAST(floor((abs(value) / pow(2.0, power) - 1) * 64) AS BIGINT) + 1) AS bucket
      FROM exact
      UNION ALL SELECT ts, event_type, 0 FROM events WHERE value = 0)"""


def _quantile_sql(period: str, keys: str) -> str:
    return f"""
    {_BUCKETS},
    counts AS (SELECT {period} AS period, {keys} bucket, count(*) AS n FROM numbered GROUP BY ALL),
    running AS (SELECT *, sum(n) OVER (PARTITION BY period{", " + keys.rstrip(", ") if keys else ""} ORDER BY bucket) AS seen,
                       sum(n) OVER (PARTITION BY period{", " + keys.rstrip(", ") if keys else ""}) AS total FROM counts),
    read AS (
      SELECT period, {keys} percent, min(bucket) AS bucket
      FROM running, (SELECT unnest([5.0, 50.0, 90.0, 99.5])::DOUBLE AS percent)
      WHERE seen >= greatest(ceil(total::DOUBLE * percent / 100), 1) GROUP BY ALL),
    valued AS (
      SELECT *, CASE WHEN bucket = 0 THEN 0.0 ELSE sign(bucket) * pow(2.0, (abs(bucket) - 1) // 64 - 1075)
        * (1 + ((abs(bucket) - 1) % 64 + 0.5) / 64) END::DOUBLE AS value FROM read)"""


@query(
    "quantile_rollup",
    f"""
    WITH {_quantile_sql("CAST(date_trunc('month', ts) AS DATE)", "event_type, ")}
    SELECT period AS month, event_type, percent, round(value, 4) AS value FROM valued
    """,
)
def quantile_rollup(spark, sf_dir):
    events = cm.derive(table(spark, sf_dir, "events"), {"day": "to_date(ts)"})
    days = cm.quantile_sketch(events, ["day", "event_type"], "value")
    months = cm.merge_sketches(cm.derive(days, {"month": "to_month(day)"}), ["month", "event_type"])
    return cm.quantiles(months, PERCENTS).withColumn("value", rounded("value"))


@query(
    "quantile_bands",
    f"""
    WITH {_quantile_sql("CAST(date_trunc('week', ts) AS DATE)", "")}
    SELECT period AS x, 'p' || regexp_replace(percent::VARCHAR, '\\.0$', '') AS series, round(value, 4) AS y FROM valued
    """,
)
def quantile_bands(spark, sf_dir):
    return cm.quantile_series(table(spark, sf_dir, "events"), "ts", "value", PERCENTS, "week").withColumn("y", rounded("y"))


def _daily_users(spark, sf_dir):
    events = cm.derive(table(spark, sf_dir, "events"), {"day": "to_date(ts)"})
    return cm.id_bitmaps(events, ["day", "event_type"], "user_id")


@query(
    "distinct_weekly",
    "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
)
def distinct_weekly(spark, sf_dir):
    daily = cm.derive(_daily_users(spark, sf_dir), {"week": "to_week(day)"})
    return cm.distinct_ids(daily, ["week", "event_type"])


@query(
    "distinct_monthly",
    "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def distinct_monthly(spark, sf_dir):
    return cm.distinct_ids(cm.derive(_daily_users(spark, sf_dir), {"month": "to_month(day)"}), ["month"])


@query(
    "distinct_rolling",
    """
    WITH seen AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE user_id IS NOT NULL),
    days AS (SELECT DISTINCT day FROM seen)
    SELECT d.day, count(DISTINCT s.user_id) AS users FROM days d JOIN seen s ON s.day BETWEEN d.day - 6 AND d.day GROUP BY 1
    """,
)
def distinct_rolling(spark, sf_dir):
    return cm.rolling_distinct(_daily_users(spark, sf_dir), "day", 7)


@query(
    "distinct_text_ids",
    "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(DISTINCT props) AS kinds FROM events GROUP BY 1",
)
def distinct_text_ids(spark, sf_dir):
    events = cm.derive(table(spark, sf_dir, "events"), {"day": "to_date(ts)"}).select("day", "props")
    numbers = cm.dense_ids(events, "props").withColumnRenamed("id", "props")
    daily = cm.id_bitmaps(events.join(numbers, "props"), ["day"], "number")
    return cm.distinct_ids(cm.derive(daily, {"month": "to_month(day)"}), ["month"], "kinds")


_SESSIONS = """
    flagged AS (
      SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, true)::INT AS begins
      FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM flagged),
    sessions AS (
      SELECT user_id AS "user", session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS events,
        coalesce(sum(value), 0) AS value FROM numbered GROUP BY ALL)"""


@query("sessions_table", f"WITH {_SESSIONS} SELECT * REPLACE (round(value, 4) AS value) FROM sessions")
def sessions_table(spark, sf_dir):
    found = cm.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 360, "value")
    return found.withColumn("value", rounded("value"))


@query(
    "sessions_hour_weekday",
    f"""
    WITH {_SESSIONS}
    SELECT CAST(hour(started) AS INTEGER) AS hour, CAST(isodow(started) - 1 AS INTEGER) AS weekday, count(*) AS sessions,
      sum(events)::BIGINT AS events
    FROM sessions GROUP BY 1, 2
    """,
)
def sessions_hour_weekday(spark, sf_dir):
    return cm.session_hours(cm.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 360))


# Chains by self-joins: for each start, the earliest following step, and again.
_CHAINS = """
    first AS (SELECT DISTINCT user_id, ts AS start, ts AS at FROM events WHERE event_type = 'view' AND user_id IS NOT NULL),
    second AS (
      SELECT f.user_id, f.start, min(e.ts) AS at FROM first f JOIN events e ON e.user_id = f.user_id AND e.event_type = 'click'
        AND e.ts > f.at AND e.ts <= f.start + INTERVAL 48 HOUR GROUP BY 1, 2),
    third AS (
      SELECT s.user_id, s.start, min(e.ts) AS at FROM second s JOIN events e ON e.user_id = s.user_id AND e.event_type = 'purchase'
        AND e.ts > s.at AND e.ts <= s.start + INTERVAL 48 HOUR GROUP BY 1, 2),
    counts AS (
      SELECT 0 AS pos, 'view' AS step, count(DISTINCT user_id) AS value FROM first UNION ALL
      SELECT 1, 'click', count(DISTINCT user_id) FROM second UNION ALL
      SELECT 2, 'purchase', count(DISTINCT user_id) FROM third)"""


@query("ordered_funnel", f"WITH {_CHAINS} SELECT * FROM counts")
def ordered_funnel(spark, sf_dir):
    return cm.ordered_funnel(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", STEPS, 48)


@query(
    "ordered_funnel_rates",
    f"""
    WITH {_CHAINS}
    SELECT pos, step, value::DOUBLE AS value,
      {steady_sql("100.0 * value / lag(value) OVER (ORDER BY pos)")} AS step_rate
    FROM counts
    """,
)
def ordered_funnel_rates(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rates = cm.ordered_funnel_conversion(events, "user_id", "ts", "event_type", STEPS, 48)
    return rates.select("pos", "step", "value", steady(F.col("step_rate")).alias("step_rate"))
