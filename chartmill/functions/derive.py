"""Derived columns: SQL expressions plus the engine's own SQL functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# name -> parameters, result type, body. Spark inlines these into the plan.
SQL_FUNCTIONS = {
    "to_week": ("d DATE", "DATE", "date_sub(d, weekday(d))"),
    "to_month": ("d DATE", "DATE", "trunc(d, 'MM')"),
    "to_quarter": ("d DATE", "DATE", "trunc(d, 'QUARTER')"),
    "to_year": ("d DATE", "INT", "year(d)"),
    "to_hour": ("ts TIMESTAMP_NTZ", "INT", "hour(ts)"),
    "weekday_name": ("d DATE", "STRING", "date_format(d, 'EEEE')"),
    "source_medium": ("source STRING, medium STRING", "STRING", "concat(source, ' / ', medium)"),
    "concat_sep": ("a STRING, b STRING, sep STRING", "STRING", "concat_ws(sep, a, b)"),
}

_REGISTERED = "_chartmill_functions"


def register_functions(spark: SparkSession) -> None:
    """Make ``SQL_FUNCTIONS`` callable in this session's SQL text (once per session)."""
    if getattr(spark, _REGISTERED, False):
        return
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    setattr(spark, _REGISTERED, True)


def documented_concat(spark: SparkSession, text: str) -> str:
    """An expression of a spec with its ``concat(a, b, 'sep')`` as what that means there: a and b joined by sep.

    Spark's own concat would put the separator last. The documented call stands alone, with a text as third
    argument; a three-argument concat that cannot be told from Spark's is an error.
    """
    if "concat" not in text.lower():
        return text
    parsed = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    if _is_join(parsed):
        parts = [parsed.arguments().apply(i).sql() for i in range(3)]
        if parsed.arguments().apply(2).getClass().getSimpleName() == "Literal":
            return f"concat_sep({', '.join(parts)})"
    if _holds_join(parsed):
        raise ValueError(f"in '{text}', write concat_sep(a, b, sep) to join with a separator, or a || b || c")
    return text


def _is_join(node) -> bool:
    if node.getClass().getSimpleName() != "UnresolvedFunction":
        return False
    name = node.nameParts()
    return name.apply(name.size() - 1).lower() == "concat" and node.arguments().size() == 3


def _holds_join(node) -> bool:
    children = node.children()
    return _is_join(node) or any(_holds_join(children.apply(i)) for i in range(children.size()))


def derive(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add columns from SQL expressions, in the order given.

    A later expression may use an earlier column. Besides the functions above,
    all Spark SQL functions work: ``weekday`` (0 is Monday), ``to_date``,
    ``upper``, ``lower``, ``round``, ``abs``, ``log`` (natural), ``sqrt``.
    Division by zero is an error; use ``try_divide`` where it can occur.
    """
    register_functions(df.sparkSession)
    for name, text in columns.items():
        df = df.withColumn(name, F.expr(text))
    return df
