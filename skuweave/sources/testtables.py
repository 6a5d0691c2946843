"""The daily tables, derived from the retail test tables.

The test data has no sales, traffic and price files, so they are views over
`lineitem`, `part` and `events`. All rows take part: weeks outside the known
history of 55 weeks go through the same plans.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# They put the last year of shipments, and the month of events,
# where the weekly history has its weeks 6 to 60.
TEST_ANCHOR = dt.date(2001, 11, 5)
EVENT_SHIFT_DAYS = 8164
MONEY_PLACES = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return (lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
                 .withColumn("data_date", F.to_date("l_shipdate")))


def goodsale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sold line; the brand stands for the goods, the part for the SKU."""
    return _lines(spark, sf_dir).select(
        "data_date",
        F.col("p_brand").alias("goods_id"),
        F.col("l_partkey").cast("string").alias("sku_id"),
        F.col("l_quantity").alias("goods_num"),
        F.col("l_extendedprice").alias("goods_price"),
        F.col("p_retailprice").alias("orginal_shop_price"))


def goodsale_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines with the supplier as goods: a SKU then belongs to several goods."""
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return (lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.to_date("l_shipdate").alias("data_date"),
        F.col("l_suppkey").cast("string").alias("goods_id"),
        F.col("l_partkey").cast("string").alias("sku_id"),
        F.col("l_quantity").alias("goods_num"),
        F.col("l_extendedprice").alias("goods_price"),
        F.col("p_retailprice").alias("orginal_shop_price")))


def goods_promote_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per discounted line."""
    return _lines(spark, sf_dir).where(F.col("l_discount") > 0).select(
        "data_date",
        F.col("p_brand").alias("goods_id"),
        F.col("p_retailprice").alias("shop_price"),
        F.col("l_extendedprice").alias("promote_price"))


def goodsdaily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily clicks per goods, counted from events.

    Three plain aggregates in a row (per user and type, per type, per goods)
    give the distinct counts; each combines on the map side, and no row is
    expanded as several DISTINCT aggregates in one grouping would do.
    """
    by_user = (table(spark, sf_dir, "events")
               .select(F.date_sub(F.to_date("ts"), EVENT_SHIFT_DAYS).alias("data_date"),
                       "user_id", "event_type")
               .groupBy("data_date", "user_id", "event_type")
               .agg(F.count("*").alias("n")))
    goods = F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string"))
    by_type = (by_user.withColumn("goods_id", goods)
               .groupBy("data_date", "goods_id", "event_type")
               .agg(F.sum("n").alias("n"), F.count("*").alias("users")))

    def total(kind: str, measure: str, out: str):
        hit = F.when(F.col("event_type") == kind, F.col(measure)).otherwise(0)
        return F.sum(hit).cast("int").alias(out)

    return by_type.groupBy("data_date", "goods_id").agg(
        total("click", "n", "goods_click"),
        total("view", "n", "cart_click"),
        total("signup", "n", "favorites_click"),
        total("purchase", "users", "sales_uv"),
        F.count("event_type").cast("int").alias("onsale_days"))


def goods_sku_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("goods_id"), F.col("p_partkey").cast("string").alias("sku_id"))


def submit_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is to be forecast, also those never sold."""
    weeks = [F.lit("0").alias(f"week{k}") for k in range(1, 6)]
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("sku_id"), *weeks)


def as_text(df: DataFrame) -> DataFrame:
    """The same table as a CSV file would hold it: text only, days as yyyyMMdd."""
    out = []
    for name in df.columns:
        if name == "data_date":
            out.append(F.date_format("data_date", "yyyyMMdd").alias(name))
        else:
            out.append(F.col(name).cast("string").alias(name))
    return df.select(*out)
