import datetime as dt
import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from skuweave import operators as op
from skuweave.functions import with_week

ANCHOR = dt.date(2018, 5, 1)
PRICES = replace(op.PRICES, places=2)


@pytest.fixture(scope="module")
def promo(spark):
    rng = random.Random(2)
    rows = [((ANCHOR - dt.timedelta(days=d)).strftime("%Y%m%d"), f"g{rng.randrange(4)}",
             rng.choice([str(rng.randrange(100, 999) / 100), None, "none"]),
             str(rng.randrange(100, 999) / 100)) for d in range(10, 60) for _ in range(rng.randrange(4))]
    return spark.createDataFrame(rows, "data_date string, goods_id string, shop_price string, "
                                       "promote_price string").cache()


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_deliveries_in_any_order(spark, promo, tmp_path):
    path, rng = str(tmp_path / "states"), random.Random(9)
    days = [r[0] for r in promo.select("data_date").distinct().collect()]
    rng.shuffle(days)
    for k in range(4):  # each delivery also repeats a day that is there already
        part = promo.where(F.col("data_date").isin(days[k::4] + days[:k]))
        op.continue_weeks(part, path, PRICES, anchor=ANCHOR)
    want = op.weekly_prices(promo, ANCHOR, 2)
    assert rows_of(op.finished(op.read_states(spark, path), PRICES)) == rows_of(want)
    assert {r.day.strftime("%Y%m%d") for r in op.covered_days(spark, path).collect()} == set(days)
    some = op.finished(op.read_states(spark, path, [3, 4]), PRICES)
    assert rows_of(some) == rows_of(want.where("weekNum IN (3, 4)"))


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path)
            for f in names if f.endswith(".parquet")}


def test_only_touched_weeks_are_written(spark, promo, tmp_path):
    path = str(tmp_path / "states")
    week = with_week(promo, anchor=ANCHOR)
    last = week.where("weekNum = 4").agg(F.max("data_date")).first()[0]
    op.continue_weeks(promo.where(F.col("data_date") != last), path, PRICES, anchor=ANCHOR)
    before = files(path)
    assert op.continue_weeks(promo.where(F.col("data_date") == last), path, PRICES,
                             anchor=ANCHOR) == [4]
    after = files(path)
    same = {f for f in before if before[f] == after.get(f)}
    assert same == {f for f in before if "weekNum=4" not in f}
    assert rows_of(op.finished(op.read_states(spark, path), PRICES)) == rows_of(
        op.weekly_prices(promo, ANCHOR, 2))
    # Run again: nothing is new, nothing is written.
    assert op.continue_weeks(promo, path, PRICES, anchor=ANCHOR) == []
    assert files(path) == after
    with pytest.raises(ValueError, match="covered already"):
        op.continue_weeks(promo, path, PRICES, anchor=ANCHOR, again="error")


def test_a_broken_off_job_is_run_again(spark, promo, tmp_path):
    """A week that got in counts once, though the job broke off before the others."""
    path = str(tmp_path / "states")
    week = with_week(promo, anchor=ANCHOR)
    half = week.where("weekNum <= 4").drop("weekNum")
    op.continue_weeks(half, path, PRICES, anchor=ANCHOR)
    op.continue_weeks(promo, path, PRICES, anchor=ANCHOR)
    assert rows_of(op.finished(op.read_states(spark, path), PRICES)) == rows_of(
        op.weekly_prices(promo, ANCHOR, 2))


def test_sales_traffic_and_edges(spark, tmp_path):
    sales = spark.createDataFrame(
        [("20180401", "g", "s", "2", "1.5", "3"), ("20180402", "g", "s", "3", None, "3"),
         ("20180401", None, "s", "1", "1", "1"), ("bad", "g", "s", "9", "9", "9"),
         (None, "g", "s", "9", "9", "9")],
        "data_date string, goods_id string, sku_id string, goods_num string, goods_price string, "
        "orginal_shop_price string")
    path = str(tmp_path / "sales")
    for day in ("20180402", "20180401"):
        op.continue_weeks(sales.where((F.col("data_date") == day) | ~F.col("data_date").like("2%")),
                          path, op.SALES, anchor=ANCHOR)
    got = op.finished(op.read_states(spark, path), op.SALES)
    assert rows_of(got) == rows_of(op.weekly_sales(sales.where("data_date LIKE '2%'"), ANCHOR))
    traffic = spark.createDataFrame([("20180401", "g", 1, 2, 3, 4, 5), ("20180403", "g", 2, 2, 3, 4, None)],
                                    "data_date string, goods_id string, goods_click int, "
                                    "cart_click int, favorites_click int, sales_uv int, "
                                    "onsale_days int")
    path = str(tmp_path / "traffic")
    op.continue_weeks(traffic, path, op.TRAFFIC, anchor=ANCHOR)
    assert rows_of(op.finished(op.read_states(spark, path), op.TRAFFIC)) == rows_of(
        op.weekly_traffic(traffic, ANCHOR))
    assert op.continue_weeks(traffic.where("false"), path, op.TRAFFIC) == []
    with pytest.raises(ValueError):
        op.read_states(spark, str(tmp_path / "nothing"))
