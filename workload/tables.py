"""Sources, projections, filters, aggregates, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

import chartmill as cm
from chartmill.columns import chart_value
from workload.registry import query, rounded, scratch, steady, steady_sql, table

# --- sources -----------------------------------------------------------------


@query(
    "csv_scan",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total,
           min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day,
           CAST(sum(l_linenumber) AS BIGINT) AS line_sum
    FROM lineitem WHERE l_quantity >= 5 GROUP BY 1, 2
    """,
)
def csv_scan(spark, sf_dir):
    """The table as CSV, its types inferred, then filter, group and aggregate."""
    path = scratch(spark, "lineitem.csv")
    cm.write_dataset(table(spark, sf_dir, "lineitem"), path, "csv")
    day = F.col("l_shipdate").cast("date")
    return (
        cm.apply_filters(cm.read_table(spark, path), expression="l_quantity >= 5")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count(F.lit(1)).alias("n"),
            rounded(F.sum("l_extendedprice"), 2).alias("total"),
            F.min(day).alias("first_day"),
            F.max(day).alias("last_day"),
            F.sum("l_linenumber").alias("line_sum"),
        )
    )


@query(
    "csv_scan_noheader",
    """
    SELECT c_mktsegment AS _c4, count(*) AS n, round(sum(c_acctbal), 2) AS balance
    FROM customer GROUP BY c_mktsegment
    """,
)
def csv_scan_noheader(spark, sf_dir):
    path = scratch(spark, "customer.csv")
    table(spark, sf_dir, "customer").write.csv(path)
    rows = cm.read_table(spark, path, header=False)
    return rows.groupBy("_c4").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("_c3"), 2).alias("balance"))


@query(
    "csv_quotes",
    """
    SELECT doc_id, md5('say "' || text || '", ' || chr(10) || ' ok ') AS noted, CAST(length(text) AS BIGINT) AS n
    FROM documents
    """,
)
def csv_quotes(spark, sf_dir):
    """Texts with quotes, commas and line breaks through a CSV file."""
    path = scratch(spark, "quotes.csv")
    noted = F.concat(F.lit('say "'), "text", F.lit('", \n ok '))
    docs = table(spark, sf_dir, "documents")
    cm.write_dataset(docs.select("doc_id", noted.alias("noted"), F.length("text").alias("n")), path, "csv")
    schema = "doc_id BIGINT, noted STRING, n BIGINT"
    rows = cm.read_csv(spark, path, schema=schema, multi_line=True)
    return rows.withColumn("noted", F.md5(F.col("noted").cast("binary")))


@query(
    "csv_schema_header",
    """
    SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids, CAST(sum(c_nationkey) AS BIGINT) AS nations
    FROM customer GROUP BY 1
    """,
)
def csv_schema_header(spark, sf_dir):
    """A schema that names some of a file's columns, in another order."""
    path = scratch(spark, "named.csv")
    cm.write_dataset(table(spark, sf_dir, "customer"), path, "csv")
    rows = cm.read_csv(spark, path, schema="c_nationkey BIGINT, c_mktsegment STRING, c_custkey BIGINT")
    return rows.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("ids"), F.sum("c_nationkey").alias("nations")
    )


@query(
    "csv_late_types",
    """
    SELECT o_orderstatus, count(*) AS n, min(lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS first_code,
           CAST(sum(2 * o_orderkey + CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 1 ELSE 0 END) AS DOUBLE) AS twice
    FROM orders GROUP BY 1
    """,
)
def csv_late_types(spark, sf_dir):
    """Whole numbers but for the last row's, and numbers that begin with zeros."""
    path = scratch(spark, "late.csv")
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey")).scalar()
    spelt = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") == last, ".5").otherwise(""))
    code = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    cm.write_dataset(orders.orderBy("o_orderkey").select("o_orderstatus", spelt.alias("n"), code.alias("code")), path, "csv")
    return cm.read_csv(spark, path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.min("code").alias("first_code"), F.sum(2 * F.col("n")).alias("twice")
    )


@query(
    "parse_dates",
    """
    SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS event_date_parsed,
           count(*) AS n
    FROM orders GROUP BY 1
    """,
)
def parse_dates(spark, sf_dir):
    """Four known date spellings in one text column; the fifth is unknown."""
    spelling = {
        "1-URGENT": "yyyy-MM-dd",
        "2-HIGH": "yyyy-MM-dd HH:mm:ss",
        "3-MEDIUM": "yyyyMMdd",
        "4-NOT SPECIFIED": "MM/dd/yyyy",
        "5-LOW": "yyyy/MM/dd",
    }
    text = F.coalesce(
        *[
            F.when(F.col("o_orderpriority") == priority, F.date_format("o_orderdate", pattern))
            for priority, pattern in spelling.items()
        ]
    )
    path = scratch(spark, "mixed.csv")
    cm.write_dataset(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("event_date")), path, "csv")
    rows = cm.read_table(spark, path, schema="o_orderkey BIGINT, event_date STRING")
    return rows.groupBy("event_date_parsed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_yyyymmdd",
    "SELECT CAST(o_orderdate AS DATE) AS event_date_parsed, count(*) AS n FROM orders GROUP BY 1",
)
def parse_yyyymmdd(spark, sf_dir):
    """Dates as whole numbers: the inferred type is long."""
    path = scratch(spark, "numbers.csv")
    number = F.date_format("o_orderdate", "yyyyMMdd").alias("event_date")
    cm.write_dataset(table(spark, sf_dir, "orders").select("o_orderkey", number), path, "csv")
    rows = cm.read_table(spark, path)
    return rows.groupBy("event_date_parsed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_epoch_micros",
    "SELECT event_id, date_trunc('millisecond', ts) AS event_timestamp_parsed FROM events",
)
def parse_epoch_micros(spark, sf_dir):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    raw = table(spark, sf_dir, "events").select("event_id", micros.alias("event_timestamp"))
    return cm.parse_epoch_micros(raw).select("event_id", "event_timestamp_parsed")


@query(
    "sink_roundtrip",
    """
    WITH d AS (SELECT o_orderpriority AS x, o_orderstatus AS series, round(sum(o_totalprice), 2) AS y
               FROM orders GROUP BY 1, 2)
    SELECT f.fmt, d.x, d.series, d.y
    FROM d CROSS JOIN (VALUES ('parquet'), ('csv'), ('json')) AS f(fmt)
    """,
)
def sink_roundtrip(spark, sf_dir):
    bars = cm.bar_series(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus")
    back = None
    for fmt in ("parquet", "csv", "json"):
        path = scratch(spark, f"bars.{fmt}")
        cm.write_dataset(bars, path, fmt)
        reader = spark.read.schema(bars.schema)
        if fmt == "csv":
            reader = reader.option("header", True)
        rows = reader.format(fmt).load(path)
        part = rows.select(F.lit(fmt).alias("fmt"), "x", "series", rounded("y", 2).alias("y"))
        back = part if back is None else back.unionByName(part)
    return back


# --- projections -------------------------------------------------------------


@query("select_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def select_columns(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")


@query(
    "numeric_coercion",
    f"""
    SELECT o_orderstatus,
           {steady_sql("avg(coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END, 0))")} AS mean_y,
           count(*) AS n
    FROM orders GROUP BY 1
    """,
)
def numeric_coercion(spark, sf_dir):
    price = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", chart_value(price).alias("y"))
    return rows.groupBy("o_orderstatus").agg(
        steady(F.avg("y")).alias("mean_y"), F.count(F.lit(1)).alias("n")
    )


# --- filters -----------------------------------------------------------------


def _counted(df, key):
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_include_single",
    "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1",
)
def filter_include_single(spark, sf_dir):
    rows = cm.apply_filters(table(spark, sf_dir, "events"), include={"event_type": "click"})
    return _counted(rows, "user_id")


@query(
    "filter_include_list",
    "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
)
def filter_include_list(spark, sf_dir):
    rows = cm.apply_filters(table(spark, sf_dir, "events"), include={"event_type": ["click", "view"]})
    return _counted(rows, "event_type")


@query(
    "filter_exclude_single",
    "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1",
)
def filter_exclude_single(spark, sf_dir):
    rows = cm.apply_filters(table(spark, sf_dir, "events"), exclude={"event_type": "error"})
    return _counted(rows, "event_type")


@query(
    "filter_exclude_list",
    "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY 1",
)
def filter_exclude_list(spark, sf_dir):
    rows = cm.apply_filters(table(spark, sf_dir, "events"), exclude={"event_type": ["error", "view"]})
    return _counted(rows, "event_type")


@query(
    "filter_combined",
    """
    SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' AND o_totalprice > 1000
    GROUP BY 1
    """,
)
def filter_combined(spark, sf_dir):
    rows = cm.apply_filters(
        table(spark, sf_dir, "orders"),
        include={"o_orderstatus": ["F", "O"]},
        exclude={"o_orderpriority": "5-LOW"},
        expression="o_totalprice > 1000",
    )
    return _counted(rows, "o_orderpriority")


def _by_expression(spark, sf_dir, name, expression, key):
    return _counted(cm.apply_filters(table(spark, sf_dir, name), expression=expression), key)


@query(
    "filter_expr_compare",
    """
    SELECT p_brand, count(*) AS n FROM part
    WHERE p_size >= 10 AND p_size < 40 AND p_retailprice > 905 AND p_size <> 25 GROUP BY 1
    """,
)
def filter_expr_compare(spark, sf_dir):
    text = "p_size >= 10 AND p_size < 40 AND p_retailprice > 905 AND p_size != 25"
    return _by_expression(spark, sf_dir, "part", text, "p_brand")


@query(
    "filter_expr_logic",
    """
    SELECT l_returnflag, count(*) AS n FROM lineitem
    WHERE (l_quantity > 40 OR l_discount > 0.08) AND NOT l_linestatus = 'F' GROUP BY 1
    """,
)
def filter_expr_logic(spark, sf_dir):
    text = "(l_quantity > 40 OR l_discount > 0.08) AND NOT l_linestatus = 'F'"
    return _by_expression(spark, sf_dir, "lineitem", text, "l_returnflag")


@query("filter_expr_like", "SELECT p_type, count(*) AS n FROM part WHERE p_type LIKE '%OMY%' GROUP BY 1")
def filter_expr_like(spark, sf_dir):
    return _by_expression(spark, sf_dir, "part", "p_type LIKE '%OMY%'", "p_type")


@query(
    "filter_expr_in",
    """
    SELECT p_brand, count(*) AS n FROM part
    WHERE p_type IN ('ECONOMY', 'SMALL') AND p_size NOT IN (1, 2, 3) GROUP BY 1
    """,
)
def filter_expr_in(spark, sf_dir):
    text = "p_type IN ('ECONOMY', 'SMALL') AND p_size NOT IN (1, 2, 3)"
    return _by_expression(spark, sf_dir, "part", text, "p_brand")


@query(
    "filter_expr_null",
    """
    WITH e AS (SELECT event_type, nullif(value, 0) AS value FROM events)
    SELECT event_type, count(*) AS n, 'present' AS kind FROM e WHERE value IS NOT NULL GROUP BY 1
    UNION ALL
    SELECT event_type, count(*) AS n, 'missing' AS kind FROM e WHERE value IS NULL GROUP BY 1
    """,
)
def filter_expr_null(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("value", F.nullif("value", F.lit(0.0)))
    present = _counted(cm.apply_filters(rows, expression="value IS NOT NULL"), "event_type")
    missing = _counted(cm.apply_filters(rows, expression="value IS NULL"), "event_type")
    return present.withColumn("kind", F.lit("present")).unionByName(missing.withColumn("kind", F.lit("missing")))


@query(
    "filter_expr_between",
    "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 GROUP BY 1",
)
def filter_expr_between(spark, sf_dir):
    return _by_expression(spark, sf_dir, "lineitem", "l_quantity BETWEEN 10 AND 20", "l_linestatus")


@query(
    "filter_expr_date",
    """
    SELECT o_orderstatus, count(*) AS n FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1
    """,
)
def filter_expr_date(spark, sf_dir):
    text = "o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'"
    return _by_expression(spark, sf_dir, "orders", text, "o_orderstatus")


@query(
    "filter_typed_literal",
    """
    SELECT p_brand, count(*) AS n FROM part
    WHERE p_size IN (7, 12, 30) AND p_partkey <> 100 AND p_retailprice <> 900.5 GROUP BY 1
    """,
)
def filter_typed_literal(spark, sf_dir):
    """Values are text; the ones that are no number match nothing and exclude nothing."""
    rows = cm.apply_filters(
        table(spark, sf_dir, "part"),
        include={"p_size": ["7", "12", "30", "abc"]},
        exclude={"p_partkey": ["100", "abc"], "p_retailprice": "900.5"},
    )
    return _counted(rows, "p_brand")


# --- aggregates --------------------------------------------------------------


def _aggregated(spark, sf_dir, agg):
    rows = cm.aggregate(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", agg)
    return rows if agg == "count" else rows.withColumn("l_quantity", steady("l_quantity"))


def _aggregate_sql(function: str) -> str:
    return f"SELECT l_returnflag, {function} AS l_quantity FROM lineitem GROUP BY 1"


@query("agg_sum", _aggregate_sql(steady_sql("sum(l_quantity)")))
def agg_sum(spark, sf_dir):
    return _aggregated(spark, sf_dir, "sum")


@query("agg_mean", _aggregate_sql(steady_sql("avg(l_quantity)")))
def agg_mean(spark, sf_dir):
    return _aggregated(spark, sf_dir, "mean")


@query("agg_count", _aggregate_sql("count(l_quantity)"))
def agg_count(spark, sf_dir):
    return _aggregated(spark, sf_dir, "count")


@query("agg_min", _aggregate_sql("min(l_quantity)"))
def agg_min(spark, sf_dir):
    return _aggregated(spark, sf_dir, "min")


@query("agg_max", _aggregate_sql("max(l_quantity)"))
def agg_max(spark, sf_dir):
    return _aggregated(spark, sf_dir, "max")


@query(
    "agg_median",
    f"""
    SELECT l_returnflag, l_linestatus, {steady_sql("median(l_extendedprice)")} AS l_extendedprice
    FROM lineitem GROUP BY 1, 2
    """,
)
def agg_median(spark, sf_dir):
    keys = ["l_returnflag", "l_linestatus"]
    medians = cm.aggregate(table(spark, sf_dir, "lineitem"), keys, "l_extendedprice", "median")
    return medians.withColumn("l_extendedprice", steady("l_extendedprice"))


@query(
    "agg_median_selected",
    f"""
    SELECT l_suppkey, l_linestatus, {steady_sql("median(l_extendedprice)")} AS l_extendedprice
    FROM lineitem GROUP BY 1, 2
    """,
)
def agg_median_selected(spark, sf_dir):
    """The plan for large tables: ranks selected from counts, no group in one task."""
    keys = ["l_suppkey", "l_linestatus"]
    medians = cm.aggregate(table(spark, sf_dir, "lineitem"), keys, "l_extendedprice", "median", large=True)
    return medians.withColumn("l_extendedprice", steady("l_extendedprice"))


def _orders_by(spark, sf_dir, **columns):
    rows = cm.transform(table(spark, sf_dir, "orders"), y="o_totalprice", agg="sum", **columns)
    return rows.withColumn("o_totalprice", rounded("o_totalprice", 2))


@query(
    "agg_by_x",
    "SELECT o_orderdate, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1",
)
def agg_by_x(spark, sf_dir):
    return _orders_by(spark, sf_dir, x="o_orderdate")


@query(
    "agg_by_group",
    "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1",
)
def agg_by_group(spark, sf_dir):
    return _orders_by(spark, sf_dir, x="o_orderdate", group_by="o_orderpriority")


@query(
    "agg_by_x_group",
    """
    SELECT o_orderdate, o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice
    FROM orders GROUP BY 1, 2
    """,
)
def agg_by_x_group(spark, sf_dir):
    return _orders_by(spark, sf_dir, group_by=["o_orderdate", "o_orderpriority"])


@query(
    "agg_all_columns",
    """
    SELECT l_linestatus, max(l_orderkey) AS l_orderkey, max(l_partkey) AS l_partkey,
           max(l_suppkey) AS l_suppkey, max(l_linenumber) AS l_linenumber, max(l_quantity) AS l_quantity,
           max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax,
           max(l_returnflag) AS l_returnflag, max(l_shipdate) AS l_shipdate
    FROM lineitem GROUP BY 1
    """,
)
def agg_all_columns(spark, sf_dir):
    return cm.aggregate_all(table(spark, sf_dir, "lineitem"), "l_linestatus", "max")


_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _all_numbers_sql(function: str) -> str:
    columns = ", ".join(f"{steady_sql(f'{function}({name})')} AS {name}" for name in _NUMBERS)
    return f"SELECT l_returnflag, {columns} FROM lineitem GROUP BY 1"


def _steady_numbers(df):
    return df.withColumns({name: steady(name) for name in _NUMBERS})


@query("agg_all_mean", _all_numbers_sql("avg"))
def agg_all_mean(spark, sf_dir):
    return _steady_numbers(cm.aggregate_all(table(spark, sf_dir, "lineitem"), "l_returnflag", "mean"))


@query("agg_all_median", _all_numbers_sql("median"))
def agg_all_median(spark, sf_dir):
    return _steady_numbers(cm.aggregate_all(table(spark, sf_dir, "lineitem"), "l_returnflag", "median", large=False))


@query("agg_all_median_selected", _all_numbers_sql("median"))
def agg_all_median_selected(spark, sf_dir):
    return _steady_numbers(cm.aggregate_all(table(spark, sf_dir, "lineitem"), "l_returnflag", "median", large=True))


@query(
    "agg_all_min",
    """
    SELECT o_orderstatus, min(o_orderkey) AS o_orderkey, min(o_custkey) AS o_custkey, min(o_totalprice) AS o_totalprice,
           min(o_orderdate) AS o_orderdate, min(o_orderpriority) AS o_orderpriority
    FROM orders GROUP BY 1
    """,
)
def agg_all_min(spark, sf_dir):
    return cm.aggregate_all(table(spark, sf_dir, "orders"), "o_orderstatus", "min")


@query(
    "agg_all_count",
    """
    SELECT n_regionkey, count(n_nationkey) AS n_nationkey, count(n_name) AS n_name FROM nation GROUP BY 1
    """,
)
def agg_all_count(spark, sf_dir):
    return cm.aggregate_all(table(spark, sf_dir, "nation"), "n_regionkey", "count")


@query(
    "pipeline_all_stages",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice
    FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority <> '5-LOW' AND o_totalprice > 1000
    GROUP BY 1, 2 ORDER BY 3 DESC LIMIT 10
    """,
)
def pipeline_all_stages(spark, sf_dir):
    """Filter, derive, aggregate, sort and limit in one call."""
    rows = cm.transform(
        table(spark, sf_dir, "orders"),
        filter={"include": {"o_orderstatus": ["O", "F"]}, "exclude": {"o_orderpriority": "5-LOW"}, "expression": "o_totalprice > 1000"},
        derive={"order_year": "to_year(o_orderdate)"},
        y="o_totalprice",
        group_by=["order_year", "o_orderpriority"],
        agg="sum",
        sort=[{"column": "o_totalprice", "ascending": False}],
        limit=10,
    )
    return rows.withColumn("o_totalprice", rounded("o_totalprice", 2))


@query("group_passthrough", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def group_passthrough(spark, sf_dir):
    rows = cm.transform(table(spark, sf_dir, "customer"), y="c_acctbal", group_by="c_nationkey")
    return rows.select("c_custkey", "c_nationkey", "c_acctbal")


# --- sort and limit ----------------------------------------------------------


@query(
    "sort_asc_topk",
    """
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
    ORDER BY o_totalprice ASC NULLS FIRST, o_orderkey, o_orderdate LIMIT 20
    """,
)
def sort_asc_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return cm.sort_limit(rows, [("o_totalprice", True)], 20)


@query(
    "sort_desc_topk",
    """
    SELECT l_suppkey, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem
    GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 15
    """,
)
def sort_desc_topk(spark, sf_dir):
    sums = cm.aggregate(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "sum")
    sums = sums.withColumn("l_extendedprice", rounded("l_extendedprice", 2))
    return cm.sort_limit(sums, [("l_extendedprice", False)], 15)


@query(
    "sort_multi_topk",
    """
    SELECT l_returnflag, l_quantity, l_orderkey, l_linenumber FROM lineitem
    ORDER BY l_returnflag ASC NULLS FIRST, l_quantity DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 50
    """,
)
def sort_multi_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_orderkey", "l_linenumber")
    return cm.sort_limit(rows, [("l_returnflag", True), ("l_quantity", False)], 50)


@query(
    "limit_rows",
    """
    SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders
    GROUP BY 1 ORDER BY 1, 2 LIMIT 30
    """,
)
def limit_rows(spark, sf_dir):
    rows = cm.transform(
        table(spark, sf_dir, "orders"), x="o_custkey", y="o_totalprice", agg="sum", limit=30
    )
    return rows.withColumn("o_totalprice", rounded("o_totalprice", 2))
