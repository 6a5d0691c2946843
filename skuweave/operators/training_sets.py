"""Training sets: features of a SKU next to the label it should predict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import HISTORY_WEEKS
from ..sources.schemas import FEATURE_COLUMNS
from .learn import with_array
from .lookup import spread_join
from .matrix import mask_block, week_matrix
from .trailing import LAST_LAG, trailing_sums_with_label

MATRIX_COLUMNS = ("weekNum2",) + FEATURE_COLUMNS


def horizon_training_set(df: DataFrame, target: int = 33, horizon: int = 7,
                         cols: list[str] | tuple[str, ...] = ("goods_num", "goods_price"),
                         label_col: str = "goods_num", time_col: str = "weekNum2",
                         id_col: str = "sku_id", last_lag: int = LAST_LAG,
                         duplicates: str = "last_goods") -> DataFrame:
    """Trailing sums up to `target`, with the units of week target + horizon as label.

    `(id, features array<double>, <label_col>)`; a SKU without sales in the label
    week has label 0. The label is summed per SKU, so that a SKU sold under several
    goods stays one row. Features and label come out of the same grouping.
    """
    return trailing_sums_with_label(df, cols, time_col, id_col, target, target + horizon,
                                    label_col, last_lag, duplicates)


def target_week_rows(df: DataFrame, matrix: DataFrame | None = None,
                     cols: list[str] | tuple[str, ...] = MATRIX_COLUMNS,
                     id_col: str = "sku_id", week_col: str = "weekNum2",
                     label_col: str = "goods_num", weeks: int = HISTORY_WEEKS,
                     duplicates: str = "last_goods", mask_target: bool = False,
                     spread: int = 1) -> DataFrame:
    """The matrix row of each SKU once per week it was sold in, with that week's units.

    `(sku_id, features, weekNum2, goods_num)`, features as in the matrix given, an
    array otherwise. Matrix and labels come
    from the same table, so every label has its matrix row and the other way
    round; a SKU that is NULL cannot be matched and is left out.

    The label rows of one SKU may be very many (a SKU sold under many goods), and
    an outer join could not be split on that side. The inner join can be. Give the
    stored `matrix` where there is one, it is then not computed again.

    The features contain the target week itself; `mask_target` zeroes that block.
    """
    cols = list(cols)
    if matrix is None:
        matrix = week_matrix(df, cols, id_col, week_col, weeks, duplicates)
    by = [c for c in (week_col, "goods_id") if c in df.columns]
    labels = df.select(F.col(id_col).cast("string").alias(id_col), label_col, *by)
    rows = spread_join(labels, matrix, [id_col], by=by, how="inner", spread=spread)
    if mask_target:
        rows = with_array(rows).withColumn(
            "features", mask_block(F.col("features"), F.col(week_col), len(cols)))
    return rows.select(id_col, "features", week_col, label_col)
