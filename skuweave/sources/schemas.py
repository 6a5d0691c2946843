"""Column names of the raw and weekly tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The columns of the daily input tables, as the files spell them.
RAW_COLUMNS = {
    "goodsale": ("data_date", "goods_id", "sku_id", "goods_num", "goods_price",
                 "orginal_shop_price"),
    "goodsdaily": ("data_date", "goods_id", "goods_click", "cart_click", "favorites_click",
                   "sales_uv", "onsale_days"),
    "goods_promote_price": ("data_date", "goods_id", "shop_price", "promote_price",
                            "promote_start_time", "promote_end_time"),
    "goods_sku_relation": ("goods_id", "sku_id"),
    "submit_example": ("sku_id", "week1", "week2", "week3", "week4", "week5"),
}

SALE_COLUMNS = ("goods_num", "goods_price", "orginal_shop_price")
PRICE_COLUMNS = ("shop_price", "promote_price")
TRAFFIC_COLUMNS = ("goods_click", "cart_click", "favorites_click", "sales_uv", "onsale_days")
FEATURE_COLUMNS = SALE_COLUMNS + PRICE_COLUMNS + TRAFFIC_COLUMNS
FEATURE_TABLE_COLUMNS = ("weekNum", "goods_id", "sku_id") + FEATURE_COLUMNS


def text_schema(columns: tuple[str, ...] | list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def check_feature_table(df: DataFrame) -> DataFrame:
    """Fail early, with names, when `df` cannot serve as a weekly feature table."""
    missing = [c for c in ("sku_id",) + FEATURE_COLUMNS if c not in df.columns]
    if "weekNum" not in df.columns and "weekNum2" not in df.columns:
        missing.append("weekNum or weekNum2")
    if missing:
        raise ValueError(f"not a weekly feature table, missing: {', '.join(missing)}")
    wrong = [c for c in FEATURE_COLUMNS
             if not isinstance(df.schema[c].dataType, T.NumericType)]
    if wrong:
        raise ValueError(f"feature columns must be numeric: {', '.join(wrong)}")
    return df
