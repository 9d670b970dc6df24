"""Month arithmetic on dates. A month is numbered ``year * 12 + month``, so neighbours differ by one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_id(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date)).cast("int")


def month_start(month: Column) -> Column:
    return F.make_date(F.floor((month - 1) / 12).cast("int"), (F.pmod(month - 1, F.lit(12)) + 1).cast("int"), F.lit(1))


def month_end(date: Column) -> Column:
    return F.last_day(date)


def next_month_end(date: Column) -> Column:
    return F.last_day(F.add_months(date, 1))


def to_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy")) -> Column:
    """The date in the first format that fits; what fits none is null."""
    return F.coalesce(*[F.try_to_timestamp(text.cast("string"), F.lit(f)) for f in formats]).cast("date")


def available_from(period_end: Column, lag_months: int = 3) -> Column:
    """When a report on a period can be used: the same day lag_months later, or the last of that month if it has no such day."""
    return F.add_months(period_end, lag_months)
