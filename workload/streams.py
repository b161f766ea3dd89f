"""Streams by event time over the events table, cut into files that arrive out of order."""

from __future__ import annotations

from chartmill.streaming.event_time import cohort_changes, day_changes, read_cohorts, read_days, write_cohorts, write_days
from chartmill.streaming.period_stream import open_stream, read_latest
from workload.registry import query, rounded, scratch, table

FILES = 4


def _arriving(spark, sf_dir):
    """The events as files cut by id, read two at a time; any of them may be late."""
    rows = table(spark, sf_dir, "events")
    folder = scratch(spark, "arriving")
    rows.repartition(FILES, "event_id").write.parquet(folder)
    return open_stream(spark, folder, rows.schema, files_per_batch=FILES // 2)


@query(
    "stream_cohorts",
    """
    WITH active AS (SELECT DISTINCT user_id, CAST(date_trunc('month', ts) AS DATE) AS period FROM events),
    firsts AS (SELECT user_id, min(period) AS cohort FROM active GROUP BY user_id)
    SELECT cohort, CAST(datediff('month', cohort, period) AS INT) AS period_number, count(*) AS users
    FROM active JOIN firsts USING (user_id) GROUP BY ALL
    """,
)
def stream_cohorts(spark, sf_dir):
    out = scratch(spark, "cohorts")
    write_cohorts(cohort_changes(_arriving(spark, sf_dir), "user_id", "ts", "month"), out, scratch(spark, "progress"))
    return read_cohorts(spark, out, "month")


@query(
    "stream_days_by_watermark",
    """
    SELECT CAST(date_trunc('month', ts) AS DATE) AS x, event_type AS series, round(avg(value), 4) AS y
    FROM events GROUP BY 1, 2
    """,
)
def stream_days_by_watermark(spark, sf_dir):
    out = scratch(spark, "days")
    changes = day_changes(_arriving(spark, sf_dir), "ts", "value", "3650 days", "event_type")
    write_days(changes, out, scratch(spark, "progress"))
    return read_days(read_latest(spark, out, changes.schema), "month", "mean").withColumn("y", rounded("y"))
