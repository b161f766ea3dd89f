"""Calendar grains: period starts and distances between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")


def check_grain(grain: str) -> None:
    if grain not in GRAINS:
        raise ValueError(f"unknown grain '{grain}'; supported: {', '.join(GRAINS)}")


def period_start(moment: Column, grain: str) -> Column:
    """First day of the period; weeks start on Monday."""
    check_grain(grain)
    day = moment.cast("date")
    if grain == "day":
        return day
    return F.trunc(day, grain)


def periods_between(start: Column, later: Column, grain: str) -> Column:
    """Whole periods from one period start to another."""
    check_grain(grain)
    days = F.date_diff(later, start)
    months = (F.year(later) - F.year(start)) * 12 + F.month(later) - F.month(start)
    whole = {
        "day": days,
        "week": days / 7,
        "month": months,
        "quarter": months / 3,
        "year": months / 12,
    }
    return whole[grain].cast("int")
