"""Lenient casts: a value that cannot be read becomes NULL, it does not fail the job.

The source tables come as text. ANSI mode stays on for the session, so leniency
is stated per column here and not through a global switch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.VarcharType, T.CharType))


def as_double(df: DataFrame, name: str) -> Column:
    """`name` as double; unreadable text gives NULL, a typed column is only widened."""
    if isinstance(df.schema[name].dataType, T.DoubleType):
        return F.col(name)
    return F.col(name).try_cast("double")


def as_int(df: DataFrame, name: str) -> Column:
    """`name` as int, fractions cut off: '3.7' is 3, 'abc' and out-of-range are NULL."""
    if isinstance(df.schema[name].dataType, T.IntegerType):
        return F.col(name)
    if not is_text(df, name):
        return F.col(name).try_cast("int")
    # Plain digits are the common case and parse without going through a double.
    return F.coalesce(F.col(name).try_cast("int"),
                      F.col(name).try_cast("double").try_cast("int"))
