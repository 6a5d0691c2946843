"""Daily rows to weekly facts, and the counts of the data analysis.

Every rollup is one grouping with built-in aggregates, so Spark combines rows
on the map side first: a product with a third of all rows sends one partial row
per group and task through the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ANCHOR, as_double, as_int, stable_mean, with_week
from ..sources.schemas import PRICE_COLUMNS, TRAFFIC_COLUMNS
from .project import typed_projection


def _ensure_week(df: DataFrame, anchor: dt.date) -> DataFrame:
    return df if "weekNum" in df.columns else with_week(df, anchor=anchor)


def weekly_sales(sales: DataFrame, anchor: dt.date = ANCHOR,
                 money_places: int | None = None) -> DataFrame:
    """Per goods, SKU and week: units summed, prices averaged."""
    sales = _ensure_week(sales, anchor)
    return sales.groupBy("goods_id", "sku_id", "weekNum").agg(
        F.sum(as_double(sales, "goods_num")).alias("goods_num"),
        *[stable_mean(as_double(sales, c), money_places).alias(c)
          for c in ("goods_price", "orginal_shop_price")])


def weekly_traffic(daily: DataFrame, anchor: dt.date = ANCHOR) -> DataFrame:
    """Per week and goods: mean of the daily counts (read as int)."""
    daily = _ensure_week(daily, anchor)
    return daily.groupBy("weekNum", "goods_id").agg(
        *[F.avg(as_int(daily, c)).alias(c) for c in TRAFFIC_COLUMNS])


def weekly_prices(promo: DataFrame, anchor: dt.date = ANCHOR,
                  money_places: int | None = None) -> DataFrame:
    """Per week and goods: mean shop price and promotion price."""
    promo = _ensure_week(promo, anchor)
    return promo.groupBy("weekNum", "goods_id").agg(
        *[stable_mean(as_double(promo, c), money_places).alias(c) for c in PRICE_COLUMNS])


def rows_per_week(df: DataFrame, anchor: dt.date = ANCHOR) -> DataFrame:
    """Number of rows per week, oldest number last."""
    return (_ensure_week(df, anchor).groupBy("weekNum")
            .agg(F.count("*").alias("count")).orderBy("weekNum"))


def preview(df: DataFrame, *order: str | Column, n: int = 100) -> DataFrame:
    """The first `n` rows in the given order (a top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)


def _per_listed_sku(per_sku: DataFrame, template: DataFrame, measure: str, out: str) -> DataFrame:
    """Sum `measure` per week over the SKUs of the template, latest week number first.

    `per_sku` has one row per SKU and week, so a hot SKU meets the template with
    at most one row per week. A SKU that the template lists m times counts m
    times, as in a plain inner join.
    """
    listed = template.groupBy("sku_id").agg(F.count("*").alias("times"))
    return (per_sku.join(listed, "sku_id").groupBy("weekNum")
            .agg(F.sum(F.col(measure) * F.col("times")).alias(out))
            .orderBy(F.desc("weekNum")))


def submitted_units_per_week(sales: DataFrame, template: DataFrame,
                             anchor: dt.date = ANCHOR) -> DataFrame:
    """`(weekNum, units)`: units sold per week of the SKUs in the template."""
    sales = _ensure_week(sales, anchor)
    per_sku = sales.groupBy("sku_id", "weekNum").agg(
        F.sum(as_double(sales, "goods_num")).alias("n"))
    return _per_listed_sku(per_sku, template, "n", "units")


def submitted_skus_per_week(sales: DataFrame, template: DataFrame,
                            anchor: dt.date = ANCHOR) -> DataFrame:
    """`(weekNum, count)`: goods and SKUs with sales per week, SKUs of the template only."""
    sold = _ensure_week(sales, anchor).select("goods_id", "sku_id", "weekNum").distinct()
    per_sku = sold.groupBy("sku_id", "weekNum").agg(F.count("*").alias("n"))
    return _per_listed_sku(per_sku, template, "n", "count")


def group_count(df: DataFrame, key: str) -> DataFrame:
    """Number of distinct keys as one row; NULL counts as a key."""
    return df.select(key).distinct().agg(F.count("*").alias("count"))


def fan_out(relation: DataFrame, key: str = "goods_id") -> DataFrame:
    """Rows per key, e.g. SKUs per goods."""
    return relation.groupBy(key).agg(F.count("*").alias("count"))


def row_count(df: DataFrame) -> DataFrame:
    """Row count as a one-row table, so that it can be part of a larger plan."""
    return df.agg(F.count("*").alias("count"))


def typed_traffic(daily: DataFrame) -> DataFrame:
    return typed_projection(daily, keep=("data_date", "goods_id"))


def typed_prices(promo: DataFrame) -> DataFrame:
    return typed_projection(
        promo, keep=("data_date", "goods_id", "promote_start_time", "promote_end_time"),
        doubles=PRICE_COLUMNS)
