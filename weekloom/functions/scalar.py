"""Column functions that differ from Spark's own: half-even rounding, relative weeks, calendar approximations, names."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weeks in a month, as the calendar features count them.
MONTH_WEEKS = 4.33


def half_even(x: Column, places: int = 0) -> Column:
    """Round half to even, as float arithmetic does; F.round goes half up."""
    if places == 0:
        return F.rint(x)
    return F.rint(x * F.lit(float(10**places))) / F.lit(float(10**places))


def clip(x: Column, low, high) -> Column:
    """low first, then high: with low > high the result is high."""
    return F.least(F.greatest(x, low), high)


def relative_week(ts: Column, first: Column) -> Column:
    """1 for the seven times 24 hours from first on, then 2, and so on."""
    return (F.floor(F.timestamp_diff("DAY", first, ts) / F.lit(7)) + 1).cast("bigint")


def week_in_month(week: Column) -> Column:
    return (week - 1).cast("double") % F.lit(MONTH_WEEKS)


def month_of_week(week: Column, wrap: bool = False) -> Column:
    """1 to 12 from a week's number; wrap starts again after a year, else later weeks stay in 12."""
    month = F.floor((week - 1) / F.lit(MONTH_WEEKS))
    return (month % 12 + 1 if wrap else clip(month + 1, F.lit(1), F.lit(12))).cast("int")


def seasonality(week: Column, wrap: bool = False) -> dict[str, Column]:
    month = month_of_week(week, wrap)
    quarter = (F.floor((month - 1) / F.lit(3)) + 1).cast("int")
    week_of_month = F.floor(week_in_month(week)).cast("int") + 1
    turn = 2 * math.pi
    return {
        "month": month,
        "quarter": quarter,
        "week_of_month": week_of_month if wrap else clip(week_of_month, F.lit(1), F.lit(4)),
        "month_sin": F.sin(F.lit(turn) * month / 12),
        "month_cos": F.cos(F.lit(turn) * month / 12),
        "quarter_sin": F.sin(F.lit(turn) * quarter / 4),
        "quarter_cos": F.cos(F.lit(turn) * quarter / 4),
    }


def calendar_flags(week: Column, last_week: Column) -> dict[str, Column]:
    """0/1 flags; last_week: the last week there is, four weeks before which the holiday season starts."""
    in_month, in_quarter = week_in_month(week), (week - 1) % 13
    flags = {
        "is_end_of_month": in_month >= 3.5,
        "is_start_of_month": in_month <= 0.5,
        "is_end_of_quarter": in_quarter >= 11,
        "is_start_of_quarter": in_quarter <= 1,
        "is_holiday_season": week >= last_week - 4,
    }
    return {k: v.cast("int") for k, v in flags.items()}


def calendar_of_date(ts: Column) -> dict[str, Column]:
    """The same features of a date, for forecasts of dated weeks."""
    month = F.month(ts)
    return {
        "month": month,
        "quarter": F.quarter(ts),
        "week_of_month": F.least(F.floor((F.dayofmonth(ts) - 1) / F.lit(7)).cast("int") + 1, F.lit(5)),
        "is_end_of_month": (F.dayofmonth(F.last_day(ts)) + 1 - F.dayofmonth(ts) <= 7).cast("int"),
        "is_start_of_month": (F.dayofmonth(ts) <= 7).cast("int"),
        "is_end_of_quarter": month.isin(3, 6, 9, 12).cast("int"),
        "is_start_of_quarter": month.isin(1, 4, 7, 10).cast("int"),
        "is_holiday_season": month.isin(12, 1).cast("int"),
    }


def date_parts(ts: Column) -> dict[str, Column]:
    return {"semana_do_ano": F.weekofyear(ts), "dia_da_semana": F.date_format(ts, "EEEE"), "mes": F.month(ts), "dia_do_mes": F.dayofmonth(ts)}


def week_end(ts: Column) -> Column:
    """The Sunday that ends the calendar week of ts."""
    return F.next_day(F.date_sub(ts.cast("date"), 1), "SUN")


def stable_bucket(value: Column, buckets: int = 1_000_000) -> Column:
    """A pseudo-feature of a value, the same in every process."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def dummy_name(column: str, value: object) -> str:
    return f"{column}_{value}".replace(" ", "_").replace("-", "_")


def safe_names(names: list[str]) -> list[str]:
    """Names of letters, digits and single underscores, % as pct, made distinct by a number at the end."""
    out: list[str] = []
    taken: set[str] = set()
    for i, name in enumerate(names):
        base = re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z_]", "_", str(name).replace("%", "pct"))).strip("_") or f"feature_{i}"
        new, n = base, 0
        while new in taken:
            n += 1
            new = f"{base}_{n}"
        taken.add(new)
        out.append(new)
    return out
