"""Dates relative to an observation, and lenient timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_date(phrase: Column, observed: Column) -> Column:
    """The date a phrase means on the day of observation; null for other phrases.

    Weeks are meant by their Monday, months and years by their first day.
    """
    p = F.lower(F.trim(phrase))
    day = F.to_date(observed)
    start = lambda unit, d: F.to_date(F.date_trunc(unit, d))
    return (
        F.when(p == "today", day)
        .when(p == "yesterday", F.date_sub(day, 1))
        .when(p == "last week", start("week", F.date_sub(day, 7)))
        .when(p == "this month", start("month", day))
        .when(p == "last month", start("month", F.add_months(day, -1)))
        .when(p == "this year", start("year", day))
        .when(p == "last year", start("year", F.add_months(day, -12)))
    )


def parse_time(text: Column, fallback: Column) -> Column:
    """ISO time of text, or the fallback where it isn't one."""
    return F.coalesce(F.try_to_timestamp(text), fallback)


def percent(done: Column, total: Column) -> Column:
    """100 done / total within 0 and 100, to two places; null for no total."""
    share = F.try_divide(done * 100.0, total)
    return F.when(share.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)), 2))
