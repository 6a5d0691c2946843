import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import plan_of
from skuweave.functions import (ANCHOR, as_double, as_int, restrict_weeks, reverse_week,
                                round_half_up_trunc, stable_mean, target_week, week_date_range,
                                week_runs, with_reverse_week, with_week)


def column(df, name):
    return [r[name] for r in df.select(name).collect()]


def test_week_of_text_dates(spark):
    days = ["20180507", "20180506", "20180501", "20180424", "20180423", "20180319", "20180313",
            "20170306", "20170228", "20180230", None, "nonsense"]
    df = with_week(spark.createDataFrame([(d,) for d in days], "data_date string"))
    assert column(df, "weekNum") == [-1, 0, 0, 0, 1, 6, 6, 60, 60, None, None, None]


def test_week_zero_has_thirteen_days_unless_floored(spark):
    days = [(ANCHOR + dt.timedelta(days=i),) for i in range(-20, 20)]
    df = spark.createDataFrame(days, "data_date date")
    trunc = column(with_week(df), "weekNum")
    floor = column(with_week(df, mode="floor"), "weekNum")
    assert trunc.count(0) == 13 and floor.count(0) == 7
    assert {floor.count(w) for w in set(floor) - {min(floor), max(floor)}} == {7}


def brute_week(day, mode="trunc"):
    days = (ANCHOR - day).days - 1
    return days // 7 if mode == "floor" or days >= 0 else -(-days // 7)


@given(st.integers(-40, 70), st.integers(0, 10), st.sampled_from(["trunc", "floor"]))
def test_date_range_holds_exactly_the_days_of_its_weeks(first, more, mode):
    start, end = week_date_range(first, first + more, mode=mode)
    for day, inside in ((start, True), (end, True), (start - dt.timedelta(1), False),
                        (end + dt.timedelta(1), False)):
        assert (first <= brute_week(day, mode) <= first + more) is inside


def test_restrict_weeks_on_text_dates_and_timestamps_agree(spark):
    days = [ANCHOR - dt.timedelta(days=i) for i in range(-10, 120)]
    dates = spark.createDataFrame([(d,) for d in days], "data_date date")
    text = dates.select(F.date_format("data_date", "yyyyMMdd").alias("data_date"))
    stamps = dates.select(F.col("data_date").cast("timestamp_ntz").alias("data_date"))
    weeks = [0, 3, 4, 11]
    expected = sorted(brute_week(d) for d in days if brute_week(d) in weeks)
    for df in (dates, text, stamps):
        assert sorted(column(with_week(restrict_weeks(df, weeks)), "weekNum")) == expected


def test_week_restriction_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "days")
    spark.createDataFrame([("20180301", 1)], "data_date string, x int").write.parquet(path)
    plan = plan_of(restrict_weeks(spark.read.parquet(path), [7, 6]))
    assert "PushedFilters: [IsNotNull(data_date), GreaterThanOrEqual(data_date,20180306)" in plan


def test_week_runs():
    assert week_runs([60, 6, 7, 59, 7]) == [(6, 7), (59, 60)]


def test_reverse_index_and_targets(spark):
    df = spark.createDataFrame([(60, "g"), (6, "g")], "weekNum int, goods_id string")
    out = with_reverse_week(df)
    assert out.columns == ["weekNum2"] and column(out, "weekNum2") == [1, 55]
    assert df.select(reverse_week().alias("w")).schema["w"].dataType.simpleString() == "int"
    template = spark.createDataFrame([("s", "0"), ("t", "2")], "sku_id string, week1 string")
    assert column(template.select(target_week(template, 5).alias("w")), "w") == [66, 68]


def test_lenient_casts(spark):
    df = spark.createDataFrame([("3",), ("3.7",), ("-3.7",), ("abc",), (None,), ("99999999999",)],
                               "x string")
    assert column(df.select(as_int(df, "x").alias("x")), "x") == [3, 3, -3, None, None, None]
    assert column(df.select(as_double(df, "x").alias("x")), "x")[:4] == [3.0, 3.7, -3.7, None]


def test_typed_columns_are_not_cast_again(spark):
    df = spark.createDataFrame([(1, 2.5)], "i int, d double")
    assert "cast" not in plan_of(df.select(as_int(df, "i"), as_double(df, "d"))).lower()


@pytest.mark.parametrize("value,expected", [(-1.6, -1), (-0.7, 0), (1.2, 1), (2.5, 3), (0.49, 0)])
def test_rounding(spark, value, expected):
    df = spark.createDataFrame([(value,)], "p double")
    assert column(df.select(round_half_up_trunc("p").alias("p")), "p") == [expected]


def test_mean_of_money_does_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e9 + 0.07, None]
    results = set()
    for order in (values, values[::-1], values[2:] + values[:2]):
        df = spark.createDataFrame([(v,) for v in order], "x double").coalesce(1)
        results.add(df.agg(stable_mean(F.col("x"), 2)).first()[0])
    assert results == {(10 + 20 + 30 + 100000000007) / 100.0 / 4}
