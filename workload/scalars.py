"""Derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

import chartmill as cm
from workload.registry import query, rounded, steady, steady_sql, table


def _derived_counts(spark, sf_dir, name, columns):
    rows = cm.derive(table(spark, sf_dir, name), columns)
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def _count_sql(name: str, **columns: str) -> str:
    picked = ", ".join(f"{text} AS {column}" for column, text in columns.items())
    places = ", ".join(str(i) for i in range(1, len(columns) + 1))
    return f"SELECT {picked}, count(*) AS n FROM {name} GROUP BY {places}"


@query("derive_to_week", _count_sql("orders", week_start="CAST(date_trunc('week', o_orderdate) AS DATE)"))
def derive_to_week(spark, sf_dir):
    return _derived_counts(spark, sf_dir, "orders", {"week_start": "to_week(o_orderdate)"})


@query("derive_to_month", _count_sql("orders", month_start="CAST(date_trunc('month', o_orderdate) AS DATE)"))
def derive_to_month(spark, sf_dir):
    return _derived_counts(spark, sf_dir, "orders", {"month_start": "to_month(o_orderdate)"})


@query("derive_to_hour", _count_sql("events", hour_of_day="CAST(hour(ts) AS INTEGER)"))
def derive_to_hour(spark, sf_dir):
    return _derived_counts(spark, sf_dir, "events", {"hour_of_day": "to_hour(ts)"})


@query("derive_weekday", _count_sql("orders", day_of_week="CAST(isodow(o_orderdate) - 1 AS INTEGER)"))
def derive_weekday(spark, sf_dir):
    return _derived_counts(spark, sf_dir, "orders", {"day_of_week": "weekday(o_orderdate)"})


@query("derive_source_medium", _count_sql("documents", traffic_source="source || ' / ' || lang"))
def derive_source_medium(spark, sf_dir):
    return _derived_counts(spark, sf_dir, "documents", {"traffic_source": "source_medium(source, lang)"})


@query("derive_to_date", _count_sql("events", day="CAST(ts AS DATE)"))
def derive_to_date(spark, sf_dir):
    return _derived_counts(spark, sf_dir, "events", {"day": "to_date(ts)"})


@query("derive_to_quarter", _count_sql("orders", quarter="CAST(date_trunc('quarter', o_orderdate) AS DATE)"))
def derive_to_quarter(spark, sf_dir):
    return _derived_counts(spark, sf_dir, "orders", {"quarter": "to_quarter(o_orderdate)"})


@query("derive_to_year", _count_sql("orders", order_year="CAST(year(o_orderdate) AS INTEGER)"))
def derive_to_year(spark, sf_dir):
    return _derived_counts(spark, sf_dir, "orders", {"order_year": "to_year(o_orderdate)"})


@query("derive_weekday_name", _count_sql("orders", day_name="dayname(o_orderdate)"))
def derive_weekday_name(spark, sf_dir):
    return _derived_counts(spark, sf_dir, "orders", {"day_name": "weekday_name(o_orderdate)"})


@query("derive_concat", _count_sql("orders", label="concat_ws('-', o_orderstatus, o_orderpriority)"))
def derive_concat(spark, sf_dir):
    return _derived_counts(
        spark, sf_dir, "orders", {"label": "concat_sep(o_orderstatus, o_orderpriority, '-')"}
    )


@query("derive_case", _count_sql("part", upper_name="upper(p_name)", lower_brand="lower(p_brand)"))
def derive_case(spark, sf_dir):
    columns = {"upper_name": "upper(p_name)", "lower_brand": "lower(p_brand)"}
    return _derived_counts(spark, sf_dir, "part", columns)


@query(
    "derive_round",
    """
    SELECT l_returnflag, CAST(sum(round(CAST(l_extendedprice AS DECIMAL(18, 2)), 1)) AS DOUBLE) AS total
    FROM lineitem GROUP BY 1
    """,
)
def derive_round(spark, sf_dir):
    rows = cm.derive(table(spark, sf_dir, "lineitem"), {"price": "round(l_extendedprice, 1)"})
    return rows.groupBy("l_returnflag").agg(rounded(F.sum("price"), 1).alias("total"))


@query(
    "derive_abs",
    "SELECT c_mktsegment, round(sum(abs(c_acctbal - 5000)), 2) AS distance FROM customer GROUP BY 1",
)
def derive_abs(spark, sf_dir):
    rows = cm.derive(table(spark, sf_dir, "customer"), {"distance": "abs(c_acctbal - 5000)"})
    return rows.groupBy("c_mktsegment").agg(rounded(F.sum("distance"), 2).alias("distance"))


@query(
    "derive_log",
    """
    SELECT c_mktsegment, round(sum(ln(CASE WHEN c_acctbal > 0 THEN c_acctbal END)), 4) AS log_sum,
           count(CASE WHEN c_acctbal > 0 THEN 1 END) AS n
    FROM customer GROUP BY 1
    """,
)
def derive_log(spark, sf_dir):
    """The natural logarithm; NULL where there is none."""
    rows = cm.derive(table(spark, sf_dir, "customer"), {"logged": "log(c_acctbal)"})
    return rows.groupBy("c_mktsegment").agg(
        rounded(F.sum("logged")).alias("log_sum"), F.count("logged").alias("n")
    )


@query(
    "derive_sqrt",
    f"SELECT o_orderstatus, {steady_sql('avg(sqrt(o_totalprice))')} AS root FROM orders GROUP BY 1",
)
def derive_sqrt(spark, sf_dir):
    rows = cm.derive(table(spark, sf_dir, "orders"), {"root": "sqrt(o_totalprice)"})
    return rows.groupBy("o_orderstatus").agg(steady(F.avg("root")).alias("root"))


@query(
    "derive_arith",
    f"""
    SELECT l_linestatus, {steady_sql("sum(round(l_extendedprice * (1 - l_discount), 4))", 2)} AS revenue,
           {steady_sql("avg(l_tax / nullif(l_discount, 0) * 100)")} AS tax_rate
    FROM lineitem GROUP BY 1
    """,
)
def derive_arith(spark, sf_dir):
    """Arithmetic inside functions; the second column builds on a guarded division."""
    columns = {
        "revenue": "round(l_extendedprice * (1 - l_discount), 4)",
        "tax_share": "try_divide(l_tax, l_discount)",
        "tax_rate": "tax_share * 100",
    }
    rows = cm.derive(table(spark, sf_dir, "lineitem"), columns)
    return rows.groupBy("l_linestatus").agg(
        steady(F.sum("revenue"), 2).alias("revenue"), steady(F.avg("tax_rate")).alias("tax_rate")
    )
