"""Trailing sums: totals over the last 0, 1, 2, ... weeks up to a target week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matrix import in_range
from .slots import slot_blocks, slot_values, slots_by_id

LAST_LAG = 30


def _running(blocks: Column, width: int) -> Column:
    """Running sums over an array of blocks, flattened: first block, first + second, ...

    The sum is taken in the order of the lags, so the result does not depend on
    how rows were spread over tasks.
    """
    start = F.struct(F.array(*[F.lit(0.0)] * width).alias("total"),
                     F.array().cast("array<double>").alias("all"))

    def add(acc: Column, block: Column) -> Column:
        total = F.zip_with(acc["total"], block, lambda a, b: a + b)
        return F.struct(total.alias("total"), F.concat(acc["all"], total).alias("all"))

    return F.aggregate(blocks, start, add, lambda acc: acc["all"])


def trailing_sums(df: DataFrame, cols: list[str] | tuple[str, ...], time_col: str, id_col: str,
                  target: int, last_lag: int = LAST_LAG, duplicates: str = "last_goods",
                  out_id: str = "id", out: str = "features", nulls: str = "zero") -> DataFrame:
    """`(id string, features array<double>[(last_lag + 1) * len(cols)])`, lag by lag.

    For lag k the block holds, per column, the sum over times target - k..target.
    Ids without a row in that window get zeros.
    """
    cols = list(cols)
    slot = in_range(F.col(time_col), target - last_lag, target)
    collected = slots_by_id(slot_values(df, id_col, slot, cols, duplicates, nulls))
    return collected.select(F.col("id").alias(out_id),
                            _lags(target, last_lag, len(cols)).alias(out))


def _lags(target: int, last_lag: int, width: int) -> Column:
    """Running sums over the weeks of `by_slot`, from `target` backwards."""
    weeks = F.sequence(F.lit(target), F.lit(target - last_lag), F.lit(-1))
    return _running(slot_blocks(weeks, width), width)


def trailing_sums_with_label(df: DataFrame, cols: list[str] | tuple[str, ...], time_col: str,
                             id_col: str, target: int, label_time: int, label_col: str,
                             last_lag: int = LAST_LAG, duplicates: str = "last_goods",
                             out_id: str = "id", out: str = "features",
                             nulls: str = "zero") -> DataFrame:
    """`trailing_sums` with the total of `label_col` at `label_time`: one scan, one grouping by id.

    The label is summed over all goods of an id, 0 without a row; the features take one row per id
    and time, as `duplicates` says. `label_time` lies after `target`.
    """
    if label_time <= target:
        raise ValueError("the label lies after the features")
    cols, time = list(cols), F.col(time_col)
    slot = F.when(time.between(target - last_lag, target) | (time == label_time), time)
    slots = slot_values(df, id_col, slot, cols, duplicates, nulls, total_of=label_col)
    label = F.coalesce(F.sum(F.when(F.col("slot") == label_time, F.col("total"))), F.lit(0.0))
    collected = slots_by_id(slots, also=[label.alias(label_col)])
    return collected.select(F.col("id").alias(out_id),
                            _lags(target, last_lag, len(cols)).alias(out), label_col)


def trailing_sums_all_targets(df: DataFrame, cols: list[str] | tuple[str, ...], time_col: str,
                              id_col: str, last_lag: int = LAST_LAG,
                              duplicates: str = "last_goods", out_id: str = "id",
                              out: str = "features", nulls: str = "zero") -> DataFrame:
    """The same with every observed time of an id as a target: `(id, target, features)`.

    One window with a range frame per lag. Rows are unique per id and time before
    the window, so its groups hold at most one row per time. Newest first, a
    frame adds up in the order of the lags, as `trailing_sums` does.
    """
    cols = list(cols)
    slots = slot_values(df, id_col, F.col(time_col), cols, duplicates,
                        nulls).where("slot IS NOT NULL")
    newest_first = Window.partitionBy("id").orderBy(F.desc("slot"))
    sums = [F.sum(F.col("values")[i]).over(newest_first.rangeBetween(0, lag))
            for lag in range(last_lag + 1) for i in range(len(cols))]
    return slots.select(F.col("id").alias(out_id), F.col("slot").alias("target"),
                        F.array(*sums).alias(out))


def lag_columns(df: DataFrame, cols: list[str] | tuple[str, ...], last_lag: int = LAST_LAG,
                features: str = "features") -> list[Column]:
    """One named column per measure and lag, e.g. `goods_num_7`."""
    width = len(cols)
    return [F.col(features)[lag * width + i].alias(f"{c}_{lag}")
            for lag in range(last_lag + 1) for i, c in enumerate(cols)]
