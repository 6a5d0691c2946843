"""Dense week matrix: all weeks of a SKU side by side in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import HISTORY_WEEKS
from ..sources.schemas import FEATURE_COLUMNS
from .slots import slot_blocks, slot_values, slots_by_id

KEYED_BY = ("week", "value")


def in_range(col: Column, first: int, last: int) -> Column:
    """`col` when it lies in the range, NULL otherwise."""
    return F.when(col.between(first, last), col)


def week_matrix(df: DataFrame, cols: tuple[str, ...] | list[str] = ("weekNum2",) + FEATURE_COLUMNS,
                id_col: str = "sku_id", week_col: str = "weekNum2",
                weeks: int = HISTORY_WEEKS, duplicates: str = "last_goods",
                out: str = "features", nulls: str = "zero") -> DataFrame:
    """`(id, features array<double>[weeks * len(cols)])`, week by week, oldest first.

    A week without a row is a block of zeros. An id whose rows all lie outside
    weeks 1..`weeks` still gets its (all zero) row.
    """
    cols = list(cols)
    slots = slot_values(df, id_col, in_range(F.col(week_col), 1, weeks), cols, duplicates,
                        nulls)
    return _dense(slots_by_id(slots), len(cols), weeks, id_col, out)


def value_keyed_matrix(df: DataFrame, id_col: str = "sku_id", value_col: str = "goods_num",
                       week_col: str = "weekNum2", slots: int = HISTORY_WEEKS,
                       out: str = "features") -> DataFrame:
    """Slot i holds a sales value whose integer part is i, 0 where there is none.

    Among several candidates the one of the latest week wins, then the highest
    goods id, then the highest value.
    """
    value = F.col(value_col).cast("double")
    slot = in_range(value.try_cast("int"), 1, slots)
    order = [F.col(week_col), *([F.col("goods_id")] if "goods_id" in df.columns else []), value]
    picked = (df.select(F.col(id_col).cast("string").alias("id"), slot.alias("slot"),
                        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("key"))
              .groupBy("id", "slot")
              .agg(F.max(F.when(F.col("slot").isNotNull(), F.col("key"))).alias("best"))
              .select("id", "slot", F.array(f"best.o{len(order) - 1}").alias("values")))
    return _dense(slots_by_id(picked), 1, slots, id_col, out)


def sales_matrix(df: DataFrame, keyed_by: str = "week", **kwargs) -> DataFrame:
    """Units only, one slot per week, or the value-keyed form of the same width."""
    if keyed_by not in KEYED_BY:
        raise ValueError(f"keyed_by must be one of {KEYED_BY}")
    if keyed_by == "value":
        return value_keyed_matrix(df, **kwargs)
    return week_matrix(df, ["goods_num"], **kwargs)


def _dense(collected: DataFrame, width: int, weeks: int, id_col: str, out: str) -> DataFrame:
    blocks = slot_blocks(F.sequence(F.lit(1), F.lit(weeks)), width)
    return collected.select(F.col("id").alias(id_col), F.flatten(blocks).alias(out))


def matrix_cells(matrix: DataFrame, cols: list[str] | tuple[str, ...], id_col: str = "sku_id",
                 features: str = "features", slot_as: str = "week") -> DataFrame:
    """The matrix as a long table: one row per id and slot, one column per measure."""
    width = len(cols)
    weeks = (F.size(features) / width).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), weeks),
                         lambda w: F.slice(F.col(features), (w - 1) * width + 1, width))
    return (matrix.select(id_col, F.posexplode(blocks).alias("pos", "block"))
            .select(id_col, (F.col("pos") + 1).alias(slot_as),
                    *[F.col("block")[i].alias(f"v_{c}") for i, c in enumerate(cols)]))


def mask_block(features: Column, week: Column, width: int) -> Column:
    """Zero the block of `week`, so that a label does not sit among its own features."""
    start = (week - 1) * width
    masked = F.concat(F.slice(features, F.lit(1), start),
                      F.array_repeat(F.lit(0.0), width),
                      F.slice(features, start + width + 1, F.size(features)))
    return F.when((week >= 1) & (week * width <= F.size(features)), masked).otherwise(features)
