"""Rounding, averages and the model score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up_trunc(value: Column | str) -> Column:
    """Add one half and cut off the fraction: 2.5 is 3, -0.7 is 0, -1.6 is -1.

    This is not `round`: the cut goes toward zero for negative values too.
    """
    value = F.col(value) if isinstance(value, str) else value
    return (value + F.lit(0.5)).try_cast("int")


def stable_mean(value: Column, places: int | None = None) -> Column:
    """Mean of a group, NULLs left out.

    A sum of doubles depends on the order in which shuffle blocks arrive, so a
    retried task may change its last digits. For values with a fixed number of
    decimals (money), give `places`: they are summed as whole units, which is
    exact in any order and stays in fixed-width aggregation buffers.
    """
    if places is None:
        return F.avg(value)
    unit = float(10 ** places)
    whole = F.rint(value * F.lit(unit)).cast("bigint")
    return F.sum(whole).cast("double") / F.lit(unit) / F.count(value)


def one_over_one_plus_rmse(label: Column | str, prediction: Column | str) -> Column:
    """Aggregate: 1 / (1 + root mean squared error), 1.0 for a perfect fit."""
    label = F.col(label) if isinstance(label, str) else label
    prediction = F.col(prediction) if isinstance(prediction, str) else prediction
    error = label - prediction
    return F.lit(1.0) / (F.lit(1.0) + F.sqrt(F.avg(error * error)))
