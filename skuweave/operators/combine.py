"""The weekly feature table: sales with prices and traffic of the same goods and week."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ANCHOR, restrict_weeks
from ..sources.schemas import FEATURE_TABLE_COLUMNS, PRICE_COLUMNS, TRAFFIC_COLUMNS
from .lookup import spread_join
from .project import fill_missing, only_week
from .rollup import weekly_prices, weekly_sales, weekly_traffic

GOODS_WEEK = ["weekNum", "goods_id"]


def goods_week_lookup(prices: DataFrame, traffic: DataFrame) -> DataFrame:
    """Weekly prices and weekly traffic side by side, one row per week and goods.

    Both are unique per week and goods, so a union with one more grouping lines
    them up. A filter on the week passes through union and grouping down to both
    scans, which an outer join of the two would not allow.
    """
    def padded(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return df.select(*GOODS_WEEK, *[
            (F.col(c) if c in columns else F.lit(None)).cast("double").alias(c)
            for c in PRICE_COLUMNS + TRAFFIC_COLUMNS])

    both = padded(prices, PRICE_COLUMNS).unionByName(padded(traffic, TRAFFIC_COLUMNS))
    return both.groupBy(*GOODS_WEEK).agg(
        *[F.max(c).alias(c) for c in PRICE_COLUMNS + TRAFFIC_COLUMNS])


def attach_goods_week(sales: DataFrame, prices: DataFrame, traffic: DataFrame,
                      spread: int = 1) -> DataFrame:
    """Left join of weekly sales with weekly prices and weekly traffic.

    Sales are by far the largest side and are joined once. AQE makes this a
    broadcast join when the measured size of the lookup allows it, and otherwise
    splits the partition of a product that holds a large share of all rows;
    `spread` deals the rows of each product to that many parts beforehand.
    """
    return spread_join(sales, goods_week_lookup(prices, traffic), GOODS_WEEK,
                       by=["sku_id"], spread=spread)


def feature_table_from_weekly(sales: DataFrame, prices: DataFrame, traffic: DataFrame,
                              spread: int = 1) -> DataFrame:
    joined = fill_missing(attach_goods_week(sales, prices, traffic, spread))
    return joined.select(*FEATURE_TABLE_COLUMNS)


def build_feature_table(sales: DataFrame, promo: DataFrame, daily: DataFrame,
                        anchor: dt.date = ANCHOR, money_places: int | None = None,
                        weeks: Iterable[int] | None = None, spread: int = 1) -> DataFrame:
    """One row per goods, SKU and week, measures without NULLs.

    `weeks` limits the table. The weeks are also stated as ranges of days, so
    that the three scans skip the rest.
    """
    weekly = [weekly_sales(_days(sales, weeks, anchor), anchor, money_places),
              weekly_prices(_days(promo, weeks, anchor), anchor, money_places),
              weekly_traffic(_days(daily, weeks, anchor), anchor)]
    if weeks is not None:
        weekly = [w.where(F.col("weekNum").isin(sorted(set(weeks)))) for w in weekly]
    return feature_table_from_weekly(*weekly, spread=spread)


def _days(df: DataFrame, weeks: Iterable[int] | None, anchor: dt.date) -> DataFrame:
    if weeks is None:
        return df
    return restrict_weeks(df, sorted(set(weeks)), anchor=anchor)


def week_snapshot(sales: DataFrame, promo: DataFrame, daily: DataFrame, week: int,
                  anchor: dt.date = ANCHOR, money_places: int | None = None,
                  fill: bool = True) -> DataFrame:
    """The feature table of one week, from the daily tables.

    With `fill=False` missing prices and traffic stay NULL and the week is kept.
    """
    if fill:
        return build_feature_table(sales, promo, daily, anchor, money_places,
                                   weeks=[week]).drop("weekNum")
    weekly = (weekly_sales(_days(sales, [week], anchor), anchor, money_places),
              weekly_prices(_days(promo, [week], anchor), anchor, money_places),
              weekly_traffic(_days(daily, [week], anchor), anchor))
    return attach_goods_week(*[only_week(w, week) for w in weekly]).select(
        *FEATURE_TABLE_COLUMNS)


def year_over_year(features: DataFrame, label_weeks: Iterable[int] | None = None,
                   offset: int = 53, spread: int = 1,
                   labels: DataFrame | None = None) -> DataFrame:
    """Rows of week w + offset with the units their SKU sold in week w as `label`.

    One pass serves all `label_weeks`; without them, all weeks in which `labels` has any
    sales. `labels` has the columns sku_id, weekNum and goods_num (weekly sales will do,
    `features` is the default). The label is summed per SKU first, so a SKU listed under several
    goods does not multiply rows; a SKU without sales in week w gets 0.
    """
    labels = features if labels is None else labels
    past = features
    if label_weeks is not None:
        weeks = sorted({int(w) for w in label_weeks})
        past = past.where(F.col("weekNum").isin([w + offset for w in weeks]))
        labels = labels.where(F.col("weekNum").isin(weeks))
    else:
        sold = labels.select((F.col("weekNum") + offset).alias("weekNum")).distinct()
        past = past.join(sold, "weekNum", "left_semi")
    label = (labels.groupBy("sku_id", (F.col("weekNum") + offset).alias("weekNum"))
             .agg(F.sum("goods_num").alias("label")))
    paired = spread_join(past, label, ["sku_id", "weekNum"], by=["goods_id"], spread=spread)
    return fill_missing(paired, ["label"]).drop("weekNum")
