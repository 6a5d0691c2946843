"""What the plans must look like to hold on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, plan_of
from skuweave import operators as op
from skuweave.functions import with_reverse_week
from skuweave.queries import QUERIES
from skuweave.sources import FEATURE_COLUMNS, PRICE_COLUMNS, TRAFFIC_COLUMNS, write_weeks
from skuweave.sources import testtables as tt

RELATIONAL = ("weekly_sales", "feature_table", "week_snapshot", "yoy_training_set",
              "dense_week_matrix", "value_keyed_vector", "trailing_sums",
              "trailing_sums_all_targets", "horizon_training_set", "submit_units_per_week")


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_python_cache_or_product(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "InMemoryTableScan",
                 "SinglePartition"):
        assert word not in plan, word


@pytest.mark.parametrize("name", RELATIONAL)
def test_scans_read_only_what_is_needed(spark, name):
    for schema in re.findall(r"FileScan parquet \[([^\]]*)\]", plan_of(QUERIES[name](spark, SMALL))):
        assert len(schema.split(",")) <= 6 and "l_tax" not in schema and "p_name" not in schema


def test_week_filter_reaches_all_three_scans(spark):
    plan = plan_of(QUERIES["week_snapshot"](spark, SMALL))
    assert len(re.findall(r"Filter .*l_shipdate#\d+ >= 2001-09-10", plan)) == 2
    assert plan.count("DataFilters: [isnotnull(l_shipdate") + plan.count(
        "DataFilters: [isnotnull(l_discount") == 2
    assert "date_sub(cast(ts" in plan.split("FileScan parquet [ts")[1].split("PartitionFilters")[0]


@pytest.mark.parametrize("name", ["weekly_sales", "weekly_prices", "weekly_traffic"])
def test_rollups_combine_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert plan.count("partial_sum") + plan.count("partial_avg") >= 2
    assert "SortAggregate" not in plan and "Expand" not in plan


def settings(spark, **conf):
    """Set session options, give back the old ones."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    return old


@pytest.fixture
def small_partitions(spark):
    """Thresholds scaled down to the test, and no broadcast joins."""
    old = settings(spark, **{
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"})
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_weekly_sales(spark):
    """100,000 weekly rows; one goods and week has a third of them."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, 100_000, 1, 8).select(
        F.when(hot, F.lit(7)).otherwise((F.col("id") % 50 + 6).cast("int")).alias("weekNum"),
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 97)).alias("goods_id"),
        F.concat(F.lit("s"), F.col("id")).alias("sku_id"),
        F.rand(1).alias("goods_num"), F.rand(2).alias("goods_price"),
        F.rand(3).alias("orginal_shop_price"))


def test_hot_product_is_split_in_the_feature_join(spark, small_partitions):
    sales = hot_weekly_sales(spark)
    keys = sales.select("weekNum", "goods_id").distinct()
    prices = keys.select("*", *[F.lit(1.5).alias(c) for c in PRICE_COLUMNS])
    traffic = keys.where("weekNum < 30").select("*", *[F.lit(2.5).alias(c)
                                                     for c in TRAFFIC_COLUMNS])
    table = op.feature_table_from_weekly(sales, prices, traffic)
    rows = table.collect()
    assert "skew=true" in plan_of(table)
    assert len(rows) == 100_000
    assert all(r.shop_price == 1.5 and r.goods_click == (2.5 if r.weekNum < 30 else 0) for r in rows)


def test_hot_sku_is_split_among_target_rows(spark, small_partitions):
    table = hot_weekly_sales(spark).select(
        F.when(F.col("goods_id") == "hot", F.lit("hot")).otherwise(
            F.concat(F.lit("s"), F.hash("sku_id") % 500)).alias("sku_id"),
        F.col("sku_id").alias("goods_id"), F.col("weekNum").alias("weekNum2"), "goods_num")
    rows = op.target_week_rows(table, cols=["goods_num"], weeks=20)
    keys = rows.select("sku_id", "weekNum2", "goods_num")
    got = keys.collect()
    assert "skew=true" in plan_of(keys)
    assert len(got) == 100_000 and sum(r.sku_id == "hot" for r in got) > 33_000


def test_a_large_week_is_written_in_several_files(spark, small_partitions, tmp_path):
    table = hot_weekly_sales(spark).where("weekNum IN (7, 8, 9)")
    write_weeks(table, str(tmp_path / "weeks"))
    files = {w: len(list((tmp_path / "weeks" / f"weekNum={w}").glob("*.parquet")))
             for w in (7, 8, 9)}
    assert files[7] > 3 and files[8] <= 2 and files[9] <= 2
    assert spark.read.parquet(str(tmp_path / "weeks")).count() == table.count()


def test_hot_sku_reaches_the_matrix_as_one_row_per_week(spark):
    """Rows of a SKU are reduced on the map side, before the first shuffle."""
    table = with_reverse_week(hot_weekly_sales(spark), drop=("weekNum",)).withColumn(
        "sku_id", F.lit("hot"))
    plan = plan_of(op.week_matrix(table, ["goods_num"]))
    below = plan.split("Exchange hashpartitioning(id")[-1]
    assert "partial_max" in below
    assert len(op.week_matrix(table, ["goods_num"]).first().features) == 55


def test_forecast_shuffles_features_once(spark):
    table = tt.submit_example(spark, SMALL)
    sales = op.weekly_sales(tt.goodsale(spark, SMALL), tt.TEST_ANCHOR)
    history = with_reverse_week(sales, drop=("weekNum",))
    rows = op.assemble(op.with_vector(op.target_week_rows(history, cols=["goods_num"]), 55),
                       ["features", "weekNum2"], "features2")
    model = op.linear(rounds=3).fit(rows)
    matrix = op.sales_matrix(history)
    plain = plan_of(matrix).count("Exchange")
    out = op.forecast_weeks(table, matrix, model, op.matrix_width(1))
    assert plan_of(out).count("Exchange") <= plain + 2
    assert plan_of(out).count("Join") <= plan_of(matrix).count("Join") + 1


def test_prices_and_traffic_meet_without_a_further_shuffle(spark):
    prices = op.weekly_prices(tt.goods_promote_price(spark, SMALL), tt.TEST_ANCHOR)
    traffic = op.weekly_traffic(tt.goodsdaily(spark, SMALL), tt.TEST_ANCHOR)
    both = op.combine.goods_week_lookup(prices, traffic)
    shuffles = plan_of(both).count("Exchange hash")
    assert shuffles == plan_of(prices).count("Exchange hash") + plan_of(traffic).count(
        "Exchange hash")
    assert set(both.columns) == {"weekNum", "goods_id", *FEATURE_COLUMNS[3:]}


def jobs_started(spark, build) -> int:
    """Number of jobs that building a DataFrame starts, before any action on it."""
    spark.sparkContext.setJobGroup("probe", "probe")
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("probe"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_operators_start_no_job(spark, tmp_path):
    sales = op.weekly_sales(tt.goodsale(spark, SMALL), tt.TEST_ANCHOR)
    history = with_reverse_week(sales, drop=("weekNum",))
    template = tt.submit_example(spark, SMALL)
    path = str(tmp_path / "matrix")
    op.with_vector(op.sales_matrix(history), 55).write.parquet(path)
    matrix = spark.read.parquet(path)
    rows = op.assemble(op.target_week_rows(history, matrix, ["goods_num"]),
                       ["features", "weekNum2"], "features2")
    model = op.linear(rounds=3).fit(rows)

    def build():
        op.week_matrix(history, ["goods_num"])
        op.horizon_training_set(history)
        op.trailing_sums_all_targets(history, ["goods_num"], "weekNum2", "sku_id")
        op.year_over_year(sales)
        op.assemble(op.target_week_rows(history, matrix, ["goods_num"]),
                    ["features", "weekNum2"], "features2")
        op.forecast_weeks(template, matrix, model, 55)
        op.WeekMatrix(cols=["goods_num"]).transform(history)

    assert jobs_started(spark, build) == 0
    assert jobs_started(spark, lambda: matrix.count()) > 0  # the probe sees jobs
