"""Week arithmetic.

Weeks count backwards from an anchor date: week 1 ends 8 days before it, and a
larger number is further in the past. The reverse index turns that around, so
that it grows with time and the known history is 1..55.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data set.
ANCHOR = dt.date(2018, 5, 1)   # date from which weeks are counted back
REVERSE_BASE = 61              # week 60 has reverse index 1, week 6 has 55
HISTORY_WEEKS = 55             # weeks of known history
TARGET_BASE = 61               # horizon 1..5 is reverse week 62..66
DATE_PATTERN = "yyyyMMdd"

MODES = ("trunc", "floor")


def day_of(df: DataFrame, name: str) -> Column:
    """The day in `name`: text is read as yyyyMMdd (unreadable is NULL), dates pass through."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return F.col(name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(F.col(name))
    return F.try_to_date(F.col(name), DATE_PATTERN)


def week_number(day: Column, anchor: dt.date = ANCHOR, mode: str = "trunc") -> Column:
    """Number of whole weeks between `day` and the day before the anchor.

    `trunc` divides toward zero, which makes week 0 thirteen days long (from 7
    days before the anchor to 5 days after it); `floor` gives every week 7 days.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    days = F.datediff(F.lit(anchor), day) - F.lit(1)
    if mode == "floor":
        return F.floor(days / F.lit(7)).cast("int")
    return (days / F.lit(7)).cast("int")


def with_week(df: DataFrame, date_col: str = "data_date", anchor: dt.date = ANCHOR,
              mode: str = "trunc", out: str = "weekNum") -> DataFrame:
    return df.withColumn(out, week_number(day_of(df, date_col), anchor, mode))


def week_date_range(first: int, last: int, anchor: dt.date = ANCHOR,
                    mode: str = "trunc") -> tuple[dt.date, dt.date]:
    """First and last day whose week number lies in `first`..`last`."""
    if first > last:
        raise ValueError("first week is after last week")

    def bounds(week: int) -> tuple[int, int]:
        """Smallest and largest number of days before the anchor that give `week`."""
        if mode == "floor" or week > 0:
            return 7 * week + 1, 7 * week + 7
        if week == 0:
            return -5, 7
        return 7 * week - 5, 7 * week + 1

    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    nearest, _ = bounds(first)
    _, furthest = bounds(last)
    return anchor - dt.timedelta(days=furthest), anchor - dt.timedelta(days=nearest)


def week_runs(weeks: Iterable[int]) -> list[tuple[int, int]]:
    """The weeks as runs without gaps: 6, 7, 59, 60 gives (6, 7) and (59, 60)."""
    runs: list[tuple[int, int]] = []
    for week in sorted(set(weeks)):
        if runs and week == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], week)
        else:
            runs.append((week, week))
    return runs


def restrict_weeks(df: DataFrame, weeks: Iterable[int], date_col: str = "data_date",
                   anchor: dt.date = ANCHOR, mode: str = "trunc") -> DataFrame:
    """Keep the days of the given weeks by plain ranges on the date column.

    The optimizer cannot turn a predicate on the computed week into one on the
    date. Stated on the column itself it reaches the file scan, where it skips
    row groups and date partitions. yyyyMMdd text sorts like the dates it names.
    """
    dtype = df.schema[date_col].dataType
    col = F.col(date_col)

    def between(first: int, last: int) -> Column:
        start, end = week_date_range(first, last, anchor, mode)
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            kind = dtype.simpleString()
            return ((col >= F.lit(start).cast(kind))
                    & (col < F.lit(end + dt.timedelta(days=1)).cast(kind)))
        if isinstance(dtype, T.DateType):
            return col.between(F.lit(start), F.lit(end))
        return col.between(F.lit(start.strftime("%Y%m%d")), F.lit(end.strftime("%Y%m%d")))

    ranges = [between(first, last) for first, last in week_runs(weeks)]
    return df.where(reduce(lambda a, b: a | b, ranges, F.lit(False)))


def reverse_week(week: Column | str = "weekNum", base: int = REVERSE_BASE) -> Column:
    week = F.col(week) if isinstance(week, str) else week
    return (F.lit(base) - week).cast("int")


def with_reverse_week(df: DataFrame, out: str = "weekNum2", base: int = REVERSE_BASE,
                      drop: tuple[str, ...] = ("weekNum", "goods_id")) -> DataFrame:
    """Add the reverse index and drop the columns it replaces."""
    return df.withColumn(out, reverse_week("weekNum", base)).drop(*drop)


def target_week(df: DataFrame, horizon: int, first_week_col: str = "week1") -> Column:
    """Reverse week that forecast `horizon` (1 is the first) asks for.

    The template holds an offset in its first week column, normally 0; a missing or
    unreadable one counts as 0.
    """
    from .casts import as_int
    return (F.coalesce(as_int(df, first_week_col), F.lit(0)) + F.lit(TARGET_BASE + horizon)).cast("int")
