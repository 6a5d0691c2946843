"""Direct forecasts: one model per week ahead, all from one grouping and one Gram matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import HISTORY_WEEKS
from .gram import LinearFit, collect_gram, gram_blocks, ridge, single_rows
from .matrix import in_range
from .slots import slot_blocks, slot_values, slots_by_id

#: Weeks ahead of the last known week, and the sums that describe the weeks before.
AHEAD = (6, 7, 8, 9, 10)
LAGS = (0, 3, 12, 30)


def _by_week(df: DataFrame, cols: Sequence[str], id_col: str, time_col: str, weeks: int,
             duplicates: str) -> DataFrame:
    """`(id, seen array<int>, total array<array<double>>)`, one row per id.

    `total[w]` holds, per column, the sum over weeks 1..w; `seen` the weeks that have a row. At
    most one entry per week is collected.
    """
    slots = slot_values(df, id_col, in_range(F.col(time_col), 1, weeks), list(cols), duplicates)
    blocks = slot_blocks(F.sequence(F.lit(1), F.lit(weeks)), len(cols))
    zeros = F.array(*[F.lit(0.0)] * len(cols))

    def running(total: Column, block: Column) -> Column:
        last = F.element_at(total, -1)
        return F.concat(total, F.array(F.zip_with(last, block, lambda x, y: x + y)))

    # One pass over the weeks. The blocks are an argument of it, never part of its lambda, where
    # they would be made again for every week.
    return slots_by_id(slots).select("id", F.map_keys("by_slot").alias("seen"),
                                     F.aggregate(blocks, F.array(zeros), running).alias("total"))


def _between(after: Column, upto: Column, col: int) -> Column:
    """Sum of column `col` over the weeks after `after` up to `upto`."""
    return F.col("total")[upto][col] - F.col("total")[F.greatest(after, F.lit(0))][col]


def _lag_sums(target: Column, lags: Sequence[int], width: int) -> Column:
    return F.array(*[_between(target - k - 1, target, c) for k in lags for c in range(width)])


def direct_rows(df: DataFrame, cols: Sequence[str] = ("goods_num",), lags: Sequence[int] = LAGS,
                ahead: Sequence[int] = AHEAD, id_col: str = "sku_id",
                time_col: str = "weekNum2", weeks: int = HISTORY_WEEKS,
                duplicates: str = "last_goods") -> DataFrame:
    """`(id, target, features array<double>, ahead_<k>...)`: a row per id and week with a sale.

    `features` are the sums of each column over the weeks target - lag..target, `ahead_<k>` is the
    first column in week target + k, 0 where nothing was sold. Targets go as far as the last label
    week is still known. Lags and labels come out of one grouping by id: no second scan, no join.
    """
    table = _by_week(df, cols, id_col, time_col, weeks, duplicates)
    targets = F.filter("seen", lambda w: w <= weeks - max(ahead))
    rows = table.select("id", "total", F.explode(targets).alias("target"))
    t = F.col("target")
    return rows.select("id", "target", _lag_sums(t, lags, len(cols)).alias("features"),
                       *[_between(t + k - 1, t + k, 0).alias(f"ahead_{k}") for k in ahead])


def fit_direct(rows: DataFrame, ahead: Sequence[int] = AHEAD,
               reg: float = 0.1) -> dict[int, LinearFit]:
    """One linear model per week ahead: the inputs' matrix is the same, the labels are columns."""
    labels = [f"ahead_{k}" for k in ahead]
    gram = collect_gram(gram_blocks(single_rows(rows, "features", labels)))
    if not gram:
        raise ValueError("no rows to fit on")
    first = len(gram[()]) - len(labels)
    return {k: ridge(gram[()], range(1, first), first + i, reg) for i, k in enumerate(ahead)}


def forecast_direct(df: DataFrame, template: DataFrame, models: dict[int, LinearFit],
                    cols: Sequence[str] = ("goods_num",), lags: Sequence[int] = LAGS,
                    id_col: str = "sku_id", time_col: str = "weekNum2",
                    weeks: int = HISTORY_WEEKS, duplicates: str = "last_goods") -> DataFrame:
    """`(sku_id, week1..weekN, has_history)`: each model on the sums up to the last known week.

    One row per row of the template; a SKU without history is scored on zeros. The template is
    joined to narrow rows, of the numbers of the inputs.
    """
    known = _by_week(df, cols, id_col, time_col, weeks, duplicates).select(
        F.col("id").alias("sku_id"), _lag_sums(F.lit(weeks), lags, len(cols)).alias("features"))
    rows = template.select("sku_id").join(known, "sku_id", "left")
    zeros = F.array(*[F.lit(0.0)] * (len(lags) * len(cols)))
    rows = rows.select("sku_id", F.col("features").isNotNull().alias("has_history"),
                       F.coalesce("features", zeros).alias("features"))
    return rows.select("sku_id", *[models[k].prediction(F.col("features")).alias(f"week{i}")
                                   for i, k in enumerate(sorted(models), 1)], "has_history")
