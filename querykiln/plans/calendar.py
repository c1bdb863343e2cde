"""The date dimension with nationwide German public holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nationwide holidays, as (month, day) and as days after Easter Sunday.
FIXED_HOLIDAYS = [(1, 1), (5, 1), (10, 3), (12, 25), (12, 26)]
EASTER_OFFSETS = [-2, 1, 39, 50]


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter of a year, by the Meeus/Jones/Butcher rule in integer columns."""
    whole = lambda x, n: F.floor(x / F.lit(n))
    golden = year % 19
    century, rest = whole(year, 100), year % 100
    correction = whole(century - whole(century + 8, 25) + 1, 3)
    epact = (golden * 19 + century - whole(century, 4) - correction + 15) % 30
    weekday = ((century % 4) * 2 + whole(rest, 4) * 2 - epact - rest % 4 + 32) % 7
    shift = whole(golden + epact * 11 + weekday * 22, 451)
    days = epact + weekday - shift * 7 + 114
    return F.make_date(year, whole(days, 31).cast("int"), (days % 31 + 1).cast("int"))


def is_public_holiday(day: Column) -> Column:
    fixed = F.lit(False)
    for month, dom in FIXED_HOLIDAYS:
        fixed = fixed | ((F.month(day) == month) & (F.dayofmonth(day) == dom))
    return fixed | F.date_diff(day, easter_sunday(F.year(day))).isin(EASTER_OFFSETS)


def dim_date(span: DataFrame) -> DataFrame:
    """One row per day of a one-row `(first_day, last_day)` span."""
    day = F.col("date_key")
    big = lambda c: c.cast("bigint")
    return (
        span.select(F.explode(F.sequence("first_day", "last_day")).alias("date_key"))
        .select(
            "date_key", big(F.year(day)).alias("year"), big(F.quarter(day)).alias("quarter"),
            big(F.month(day)).alias("month"), big(F.dayofmonth(day)).alias("day_of_month"),
            big(F.weekday(day) + 1).alias("day_of_week"), big(F.weekofyear(day)).alias("iso_week"),
            (F.weekday(day) >= 5).alias("is_weekend"), is_public_holiday(day).alias("is_public_holiday"),
        )
    )


def order_span(orders: DataFrame, date_col: str = "order_date") -> DataFrame:
    return orders.agg(F.min(date_col).alias("first_day"), F.max(date_col).alias("last_day"))
