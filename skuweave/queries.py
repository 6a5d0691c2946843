"""The registered queries: each operator over the whole test tables.

Every function takes (spark, sf_dir) and returns a DataFrame. `oracle.py` holds
the SQL that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .functions import (restrict_weeks, round_half_up_trunc, target_week, with_reverse_week,
                        with_week)
from .session import scratch_path, staged
from .sources import (FEATURE_COLUMNS, RAW_COLUMNS, from_rows, load_model, read_features,
                      read_raw, read_weeks, write_csv, write_model, write_table, write_weeks)
from .sources import testtables as tt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ANCHOR = tt.TEST_ANCHOR
PLACES = tt.MONEY_PLACES
SUMMED = ("goods_num", "goods_price")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def features(spark: SparkSession, sf_dir: str, weeks=None) -> DataFrame:
    return op.build_feature_table(
        tt.goodsale(spark, sf_dir), tt.goods_promote_price(spark, sf_dir),
        tt.goodsdaily(spark, sf_dir), ANCHOR, PLACES, weeks)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table with the reverse week index."""
    return with_reverse_week(features(spark, sf_dir), drop=("weekNum",))


def sales_history(spark: SparkSession, sf_dir: str, by_supplier: bool = False) -> DataFrame:
    """Weekly sales only, with the reverse week index."""
    daily = tt.goodsale_by_supplier if by_supplier else tt.goodsale
    return with_reverse_week(op.weekly_sales(daily(spark, sf_dir), ANCHOR, PLACES),
                             drop=("weekNum",))


# ---- weeks, casts, projections

@query
def week_bucket(spark, sf_dir):
    """Week numbers from yyyyMMdd text."""
    text = tt.as_text(tt.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("data_date")))
    return with_week(text, anchor=ANCHOR)


@query
def week_bucket_floor(spark, sf_dir):
    days = tt.table(spark, sf_dir, "orders").select("o_orderkey",
                                                    F.col("o_orderdate").alias("data_date"))
    return with_week(days, anchor=ANCHOR, mode="floor").select("o_orderkey", "weekNum")


@query
def typed_projection(spark, sf_dir):
    """Lenient casts of text columns, with values that cannot be read."""
    def spoilt(col: str):
        return F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).otherwise(
            F.col(col).cast("string"))

    text = tt.as_text(tt.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice",
        spoilt("l_extendedprice").alias("l_whole"), spoilt("l_discount").alias("l_share")))
    return op.typed_projection(text, keep=["l_orderkey", "l_linenumber"],
                               doubles=["l_extendedprice", "l_share"])


@query
def reverse_week(spark, sf_dir):
    return with_reverse_week(op.weekly_sales(tt.goodsale(spark, sf_dir), ANCHOR, PLACES)
                             ).select("sku_id", "weekNum2", "goods_num")


@query
def round_half_up(spark, sf_dir):
    value = (F.col("l_extendedprice") - 50000) / 1000
    return tt.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", round_half_up_trunc(value).alias("rounded"))


# ---- weekly rollups and counts

@query
def weekly_sales(spark, sf_dir):
    return op.weekly_sales(tt.goodsale(spark, sf_dir), ANCHOR, PLACES)


@query
def weekly_traffic(spark, sf_dir):
    return op.weekly_traffic(op.typed_traffic(tt.goodsdaily(spark, sf_dir)), ANCHOR)


@query
def weekly_prices(spark, sf_dir):
    return op.weekly_prices(op.typed_prices(tt.goods_promote_price(spark, sf_dir)), ANCHOR,
                            PLACES)


def _continued(spark, daily: DataFrame, rollup: op.Rollup) -> DataFrame:
    """The rollup from three deliveries: early days, late days of the same weeks, days once more."""
    path, late = scratch_path(spark, "states"), F.dayofmonth("data_date") > 20
    for part in (daily.where(~late), daily.where(late), daily.where(F.dayofmonth("data_date") == 25)):
        op.continue_weeks(part, path, rollup, anchor=ANCHOR)
    return op.finished(op.read_states(spark, path), rollup)


@query
def weekly_prices_continued(spark, sf_dir):
    prices = replace(op.PRICES, places=PLACES)
    return _continued(spark, tt.goods_promote_price(spark, sf_dir), prices)


@query
def weekly_sales_continued(spark, sf_dir):
    return _continued(spark, tt.goodsale(spark, sf_dir), replace(op.SALES, places=PLACES))


@query
def weekly_traffic_continued(spark, sf_dir):
    return _continued(spark, staged(tt.goodsdaily(spark, sf_dir), "daily"), op.TRAFFIC)


@query
def rows_per_week(spark, sf_dir):
    return op.rows_per_week(tt.goodsale(spark, sf_dir), ANCHOR)


@query
def newest_weeks_preview(spark, sf_dir):
    """The first 100 rows of the week counts, in order."""
    return op.preview(op.rows_per_week(tt.goodsale(spark, sf_dir), ANCHOR), "weekNum", n=100)


@query
def submit_units_per_week(spark, sf_dir):
    return op.submitted_units_per_week(tt.goodsale(spark, sf_dir),
                                       tt.submit_example(spark, sf_dir), ANCHOR)


@query
def submit_skus_per_week(spark, sf_dir):
    return op.submitted_skus_per_week(tt.goodsale_by_supplier(spark, sf_dir),
                                      tt.submit_example(spark, sf_dir), ANCHOR)


@query
def sku_count(spark, sf_dir):
    return op.group_count(tt.goods_sku_relation(spark, sf_dir), "sku_id")


@query
def goods_fanout(spark, sf_dir):
    return op.fan_out(tt.goods_sku_relation(spark, sf_dir), "goods_id")


# ---- feature tables

@query
def feature_table(spark, sf_dir):
    return features(spark, sf_dir)


@query
def feature_row_count(spark, sf_dir):
    return op.row_count(features(spark, sf_dir))


@query
def week_snapshot(spark, sf_dir):
    return op.week_snapshot(tt.goodsale(spark, sf_dir), tt.goods_promote_price(spark, sf_dir),
                            tt.goodsdaily(spark, sf_dir), 7, ANCHOR, PLACES)


@query
def week_snapshot_unfilled(spark, sf_dir):
    return op.week_snapshot(tt.goodsale(spark, sf_dir), tt.goods_promote_price(spark, sf_dir),
                            tt.goodsdaily(spark, sf_dir), 12, ANCHOR, PLACES, fill=False)


def _units(spark, sf_dir, weeks=None) -> DataFrame:
    """Weekly sales alone: labels need no prices and no traffic."""
    daily = tt.goodsale(spark, sf_dir)
    if weeks is not None:
        daily = restrict_weeks(daily, weeks, anchor=ANCHOR)
    return op.weekly_sales(daily, ANCHOR, PLACES)


@query
def yoy_training_set(spark, sf_dir):
    return op.year_over_year(features(spark, sf_dir, weeks=[59, 60]), [6, 7],
                             labels=_units(spark, sf_dir, [6, 7]))


@query
def yoy_training_set_all_weeks(spark, sf_dir):
    return op.year_over_year(features(spark, sf_dir), labels=_units(spark, sf_dir))


@query
def yoy_stacked(spark, sf_dir):
    """One set per label week, put on top of each other."""
    return op.stack_sets(*[
        op.year_over_year(features(spark, sf_dir, weeks=[week + 53]), [week],
                          labels=_units(spark, sf_dir, [week])) for week in (6, 7)])


@query
def yoy_several_goods(spark, sf_dir):
    """SKUs sold under several goods: the label is per SKU and does not multiply rows."""
    sales = op.weekly_sales(tt.goodsale_by_supplier(spark, sf_dir), ANCHOR, PLACES)
    return op.year_over_year(sales, spread=4)


# ---- matrices and trailing sums

@query
def dense_week_matrix(spark, sf_dir):
    table = history(spark, sf_dir)
    return op.matrix_cells(op.week_matrix(table), op.MATRIX_COLUMNS)


@query
def dense_week_matrix_several_goods(spark, sf_dir):
    cols = ["weekNum2", *SUMMED]
    return op.matrix_cells(op.week_matrix(sales_history(spark, sf_dir, True), cols), cols)


@query
def sales_week_matrix_summed(spark, sf_dir):
    matrix = op.sales_matrix(sales_history(spark, sf_dir, True), duplicates="sum")
    return op.matrix_cells(matrix, ["goods_num"])


@query
def week_matrix_stage(spark, sf_dir):
    """The week matrix as an ML stage, units and prices."""
    stage = op.WeekMatrix(cols=list(SUMMED))
    matrix = stage.transform(sales_history(spark, sf_dir))
    return op.matrix_cells(op.with_array(matrix), SUMMED)


@query
def value_keyed_vector(spark, sf_dir):
    matrix = op.sales_matrix(sales_history(spark, sf_dir), keyed_by="value")
    return op.matrix_cells(matrix, ["goods_num"], slot_as="slot")


@query
def trailing_sums(spark, sf_dir):
    sums = op.trailing_sums(sales_history(spark, sf_dir), SUMMED, "weekNum2", "sku_id", 33)
    return sums.select("id", *op.lag_columns(sums, SUMMED))


@query
def trailing_sums_stage(spark, sf_dir):
    """The same as an ML stage, with a vector as its result."""
    stage = op.TrailingSums(cols=list(SUMMED), timeCol="weekNum2", idCol="sku_id", targetTime=33,
                            statisticTime=30)
    sums = op.with_array(stage.transform(sales_history(spark, sf_dir)))
    return sums.select("id", *op.lag_columns(sums, SUMMED))


@query
def trailing_sums_checked(spark, sf_dir):
    """Rows known to be unique per SKU and week: counted, and refused if they are not."""
    cols = list(SUMMED)
    sums = op.trailing_sums(sales_history(spark, sf_dir), cols, "weekNum2", "sku_id", 33,
                            duplicates="error")
    return sums.select("id", *op.lag_columns(sums, cols))


@query
def bad_offsets(spark, sf_dir):
    """Target weeks of a template whose offsets are missing or no numbers for some SKUs."""
    number = F.col("sku_id").cast("int") % 3
    template = tt.submit_example(spark, sf_dir).withColumn("week1", F.when(
        number == 0, F.lit(None).cast("string")).when(number == 1, "x").otherwise("2"))
    grid = op.forecast_grid(template, _sold_in_history(spark, sf_dir))
    return grid.select("sku_id", "horizon", "weekNum")


@query
def holdout_split(spark, sf_dir):
    """Sold SKU-weeks on either side of the split by hash."""
    rows = sales_history(spark, sf_dir).select("sku_id", "weekNum2", "goods_num")
    train, test = op.hash_split(rows, ["sku_id", "weekNum2"])
    return train.withColumn("side", F.lit("train")).union(test.withColumn("side", F.lit("test")))


@query
def holdout_score(spark, sf_dir):
    """Score, on the held-out side alone, of the mean units of the training side."""
    rows = sales_history(spark, sf_dir).select("sku_id", "weekNum2", "goods_num")
    train, test = op.hash_split(rows, ["sku_id", "weekNum2"])
    mean = train.groupBy(F.lit(1).alias("one")).agg(F.avg("goods_num").alias("prediction"))
    scored = test.withColumn("one", F.lit(1)).join(F.broadcast(mean), "one")  # one row
    return op.score_table(scored).select(F.round("score", 9).alias("score"))


@query
def trailing_sums_several_goods(spark, sf_dir):
    sums = op.trailing_sums(sales_history(spark, sf_dir, True), SUMMED, "weekNum2", "sku_id", 50)
    return sums.select("id", *op.lag_columns(sums, SUMMED))


@query
def trailing_sums_all_targets(spark, sf_dir):
    sums = op.trailing_sums_all_targets(sales_history(spark, sf_dir), SUMMED, "weekNum2",
                                        "sku_id")
    return sums.select("id", "target", *op.lag_columns(sums, SUMMED))


# ---- training sets

@query
def extract_label(spark, sf_dir):
    return op.select_label(sales_history(spark, sf_dir), "sku_id", "goods_num",
                           "weekNum2 = 40", id_as="id")


@query
def horizon_training_set(spark, sf_dir):
    rows = op.horizon_training_set(sales_history(spark, sf_dir))
    return rows.select("id", *op.lag_columns(rows, SUMMED), "goods_num")


def _target_row_facts(rows: DataFrame, width: int) -> DataFrame:
    """What can be read off a target row: its own block, and totals over all blocks."""
    own = F.when(F.col("weekNum2").between(1, 55),
                 F.try_element_at("features", ((F.col("weekNum2") - 1) * width + 2)))
    places = F.lit([2 + w * width for w in range(55)])
    units = F.transform(places, lambda at: F.element_at("features", at))
    # The argument of a lambda, so that both totals come from one reading of the row.
    totals = F.get(F.transform(F.array(units), lambda u: F.struct(
        F.aggregate(u, F.lit(0.0), lambda a, x: a + x).alias("units"),
        F.size(F.array_remove(u, 0.0)).alias("weeks"))), F.lit(0))
    read = rows.select("sku_id", "weekNum2", "goods_num", own.alias("own_units"),
                       F.explode(F.array(totals)).alias("totals"),
                       F.size("features").alias("width"))
    return read.select("sku_id", "weekNum2", "goods_num", "own_units",
                       F.col("totals.units").alias("all_units"),
                       F.col("totals.weeks").alias("sold_weeks"), "width")


@query
def target_week_rows(spark, sf_dir):
    rows = op.target_week_rows(staged(history(spark, sf_dir), "features"))
    return _target_row_facts(rows, len(op.MATRIX_COLUMNS))


@query
def target_week_rows_masked(spark, sf_dir):
    """The same without the label among the features; several goods per SKU."""
    cols = ["weekNum2", *SUMMED]
    table = staged(sales_history(spark, sf_dir, True), "sales")
    rows = op.target_week_rows(table, cols=cols, mask_target=True, spread=4)
    return _target_row_facts(rows, len(cols))


@query
def assembled_features(spark, sf_dir):
    table = features(spark, sf_dir)
    names = op.feature_names(table, ("sku_id", "goods_id", "weekNum", "label"))
    rows = op.assemble(table, names)
    values = vector_to_array(F.col("features"))
    return rows.select("sku_id", "weekNum",
                       *[values[i].alias(f"f_{c}") for i, c in enumerate(names)])


@query
def poly_expand(spark, sf_dir):
    rows = op.assemble(sales_history(spark, sf_dir), ["goods_num", "weekNum2"], "features2")
    values = vector_to_array(F.col("polyfeatures"))
    return op.expand(rows).select("sku_id", "weekNum2",
                                  *[values[i].alias(f"p{i}") for i in range(5)])


@query
def poly_sparse(spark, sf_dir):
    """The same products from the inputs that are not zero, as sparse vectors."""
    rows = sales_history(spark, sf_dir).select("sku_id", "weekNum2", F.array(
        "goods_num", F.col("weekNum2").cast("double")).alias("features2"))
    values = vector_to_array(F.col("polyfeatures"))
    return op.expand_sparse(rows, 2, "features2").select(
        "sku_id", "weekNum2", *[values[i].alias(f"p{i}") for i in range(5)])


@query
def chi_select(spark, sf_dir):
    """The one of three yes/no features that says most about a good sales week."""
    table = features(spark, sf_dir)
    flags = [F.col("orginal_shop_price") >= 1000, F.col("goods_click") > 0,
             F.col("goods_price") >= 50000]
    rows = table.select((F.col("goods_num") >= 30).cast("double").alias("label"),
                        *[f.cast("double").alias(f"flag{i}") for i, f in enumerate(flags)])
    _, chosen = op.top_categorical(op.assemble(rows, ["flag0", "flag1", "flag2"]))
    value = vector_to_array(F.col("selectedFeatures"))[0]
    return (chosen.groupBy("label", value.alias("selected"))
            .agg(F.count("*").alias("count")))


# ---- models

def _one_feature(spark, sf_dir) -> DataFrame:
    """Units of week 40 against the sum over 31 weeks up to week 33."""
    table = staged(sales_history(spark, sf_dir).select("sku_id", "goods_id", "weekNum2",
                                                       "goods_num"), "sales")
    rows = op.horizon_training_set(table, cols=["goods_num"])
    rows = staged(rows.select("id", "goods_num", F.col("features")[30].alias("past")), "rows")
    return op.assemble(rows, ["past"])


def _fitted(rows: DataFrame, model) -> DataFrame:
    return op.predict(model, rows).select("id", "goods_num",
                                          F.round("prediction", 6).alias("prediction"))


@query
def linear_fit(spark, sf_dir):
    rows = _one_feature(spark, sf_dir)
    return _fitted(rows, op.linear("features", "goods_num", reg=0.1).fit(rows))


@query
def model_roundtrip(spark, sf_dir):
    """Save the model, load it and score with the loaded one."""
    rows = _one_feature(spark, sf_dir)
    path = scratch_path(spark, "model")
    write_model(LinearRegression(labelCol="goods_num", regParam=0.1).fit(rows), path)
    return _fitted(rows, load_model(path, "linear"))


@query
def cv_fit(spark, sf_dir):
    """Mean RMSE over four folds for each candidate, folds dealt by SKU number."""
    rows = _one_feature(spark, sf_dir).withColumn("fold", (F.col("id").cast("int") % 4))
    regs = [0.1, 0.01]
    search = op.tune_linear(rows, regs=regs, folds=4, fold_col="fold")
    return spark.createDataFrame(
        [(r, round(float(m), 6)) for r, m in zip(regs, search.avgMetrics)],
        "reg double, rmse double")


@query
def linear_fit_factorised(spark, sf_dir):
    """Coefficients of the fit on 55 weeks and the target week, from one row per SKU."""
    table = staged(sales_history(spark, sf_dir).select("sku_id", "goods_id", "weekNum2",
                                                       "goods_num"), "sales")
    fit = op.fit_factorised(table, op.sales_matrix(table), reg=0.1)
    names = [f"week_{w}" for w in range(1, 56)] + ["target_week"]
    found = [*zip(names, map(float, fit.coefficients)), ("intercept", fit.intercept)]
    return spark.createDataFrame([(n, round(v, 6)) for n, v in found],
                                 "name string, coefficient double")


@query
def cv_one_pass(spark, sf_dir):
    """The candidates of `cv_fit` from one Gram matrix per fold."""
    rows = _one_feature(spark, sf_dir).withColumn("fold", F.col("id").cast("int") % 4)
    scores, _ = op.cross_validate(rows, regs=[0.1, 0.01])
    return spark.createDataFrame([(r, round(m, 6)) for r, m in scores], "reg double, rmse double")


@query
def origin_scores(spark, sf_dir):
    """Validation by time: units seven weeks ahead from the sum over 31 weeks."""
    rows = op.direct_rows(sales_history(spark, sf_dir), lags=[30], ahead=[7])
    rows = rows.withColumn("label_week", F.col("target") + 7)
    scores = op.origin_scores(rows, regs=[1.0, 0.1, 0.01], first=20, label="ahead_7")
    return scores.withColumn("rmse", F.round("rmse", 6))


@query
def forecast_direct(spark, sf_dir):
    """Units six to ten weeks after the last known week: five labels, one Gram matrix."""
    table = staged(sales_history(spark, sf_dir).select("sku_id", "goods_id", "weekNum2",
                                                       "goods_num"), "sales")
    models = op.fit_direct(op.direct_rows(table))
    forecast = op.forecast_direct(table, tt.submit_example(spark, sf_dir), models)
    return forecast.select("sku_id", *[F.round(f"week{k}", 6).alias(f"week{k}")
                                       for k in range(1, 6)], "has_history")


@query
def score_metric(spark, sf_dir):
    """Score of the rule "as many units as the week number modulo 50"."""
    rows = sales_history(spark, sf_dir).withColumn(
        "prediction", F.abs(F.col("weekNum2") % 50).cast("double"))
    return op.score_table(rows).select(F.round("score", 9).alias("score"))


@query
def trailing_fit(spark, sf_dir):
    """Linear regression on all 62 trailing sums, tuned by four folds dealt by SKU number."""
    rows = op.with_vector(op.horizon_training_set(sales_history(spark, sf_dir)), 62)
    rows = staged(rows.withColumn("fold", F.col("id").cast("int") % 4), "rows")
    train, _ = op.hash_split(rows, ["id"])
    search = op.tune_linear(train, fold_col="fold")
    return _fitted(rows, search.bestModel)


def _boosted(spark, sf_dir):
    """Sales matrix, rows with their target week, and trees fitted on the training part."""
    table = staged(sales_history(spark, sf_dir), "sales")
    matrix = staged(op.with_vector(op.sales_matrix(table), op.matrix_width(1)), "matrix")
    rows = op.assemble(op.target_week_rows(table, matrix, ["goods_num"]),
                       ["features", "weekNum2"], "features2")
    rows = staged(rows.select("sku_id", "weekNum2", "goods_num", "features2"), "rows")
    train, _ = op.hash_split(rows, ["sku_id", "weekNum2"])
    return matrix, rows, op.boosted_trees(rounds=3, depth=4).fit(train)


@query
def gbt_fit(spark, sf_dir):
    _, rows, model = _boosted(spark, sf_dir)
    return op.predict(model, rows).select("sku_id", "weekNum2", "goods_num", "prediction")


def _stump_rows(spark, sf_dir) -> DataFrame:
    """Units against the season (thirteenths of a year) and the price class of the SKU."""
    rows = sales_history(spark, sf_dir).select(
        "sku_id", "weekNum2", "goods_num", F.pmod("weekNum2", F.lit(13)).alias("season"),
        F.floor(F.col("orginal_shop_price") / 100).cast("int").alias("price_class"))
    return staged(op.assemble(rows, ["season", "price_class"]), "stumps")


def _held_out(rows: DataFrame, keys) -> DataFrame:
    return op.mark_held(rows, keys)


STUMPS = op.RidgeBoosting(rounds=4, step=0.5, depth=1, leaf_reg=2.0)


@query
def gbt_ridge_leaves(spark, sf_dir):
    """Boosted stumps whose leaves are sums of residuals over rows + 2."""
    rows = _stump_rows(spark, sf_dir)
    scored = STUMPS.fit(rows, "features", "goods_num").transform(rows)
    return scored.select("sku_id", "weekNum2", F.round("prediction", 6).alias("prediction"))


@query
def gbt_stumps(spark, sf_dir):
    """Spark's boosted trees as stumps, fitted on the training side, for all rows."""
    rows = _stump_rows(spark, sf_dir)
    train, _ = op.hash_split(rows, ["sku_id", "weekNum2"])
    model = op.boosted_trees("features", rounds=4, step=0.2, depth=1, min_rows=1,
                             min_gain=0.0).fit(train)
    return op.predict(model, rows).select("sku_id", "weekNum2",
                                          F.round("prediction", 6).alias("prediction"))


@query
def gbt_missing(spark, sf_dir):
    """One stump on the clicks, 0 clicks being absent: the side of each bin, and what it adds."""
    table = features(spark, sf_dir).select("goods_num", "goods_click")
    bins = op.AbsentBins.fit(table, ["goods_click"], bins=6)
    rows = staged(bins.transform(table), "bins")
    model = op.RidgeBoosting(rounds=1, step=1.0, depth=1, base=0.0).fit(rows, "features",
                                                                        "goods_num")
    side = spark.createDataFrame(list(op.sides(model.trees[0].model)), "bin int, side string")
    scored = model.transform(rows).groupBy(
        vector_to_array("features")[0].cast("int").alias("bin")).agg(
        F.count("*").alias("rows"), F.round(F.max("prediction"), 6).alias("prediction"))
    return scored.join(side, "bin")


@query
def training_history(spark, sf_dir):
    """Error after each round, on the training part and on the part held out by hash."""
    rows = _held_out(_stump_rows(spark, sf_dir), ["sku_id", "weekNum2"])
    model = STUMPS.fit(rows, "features", "goods_num", F.col("held"))
    return model.history_table(spark).select(
        "round", *[F.round(c, 6).alias(c) for c in ("train_rmse", "valid_rmse")])


@query
def early_stop(spark, sf_dir):
    """Predictions of the held-out rows by the model cut at its best round."""
    rows = _held_out(_stump_rows(spark, sf_dir), ["sku_id", "weekNum2"])
    model = op.early_stop(rows, op.RidgeBoosting(rounds=5, step=1.4, depth=1), "features",
                          "goods_num", F.col("held"))
    scored = model.transform(rows.where("held"))
    return scored.select("sku_id", "weekNum2", F.round("prediction", 6).alias("prediction"),
                         F.lit(len(model.trees)).alias("trees"))


# ---- forecasts

def _sold_in_history(spark, sf_dir) -> DataFrame:
    """SKUs sold in the 55 weeks of known history."""
    weeks = range(6, 61)
    return (with_week(restrict_weeks(tt.goodsale(spark, sf_dir), weeks, anchor=ANCHOR),
                      anchor=ANCHOR).select("sku_id").distinct())


@query
def forecast_grid(spark, sf_dir):
    return op.forecast_grid(tt.submit_example(spark, sf_dir), _sold_in_history(spark, sf_dir))


@query
def target_weeks(spark, sf_dir):
    template = tt.submit_example(spark, sf_dir)
    return template.select("sku_id", *[target_week(template, k).alias(f"target{k}")
                                       for k in range(1, 6)])


def _yoy_forecast(spark, sf_dir) -> DataFrame:
    weeks = sorted({6, 7, 59, 60, *op.YEAR_BEFORE.values()})
    table = staged(features(spark, sf_dir, weeks=weeks), "weeks")
    rows = op.year_over_year(table)
    model = op.linear("features", "label").fit(op.assemble(rows, op.feature_names(rows)))
    return op.forecast_year_over_year(table, tt.submit_example(spark, sf_dir), model)


@query
def yoy_forecast(spark, sf_dir):
    """Forecast from all features of the weeks a year before."""
    forecast = _yoy_forecast(spark, sf_dir)
    return forecast.select("sku_id", *[F.round(f"week{k}", 6).alias(f"week{k}")
                                       for k in range(1, 6)])


@query
def yoy_forecast_units(spark, sf_dir):
    """The same with the units alone, learnt from every pair of weeks."""
    table = op.weekly_sales(tt.goodsale(spark, sf_dir), ANCHOR, PLACES).select(
        "weekNum", "goods_id", "sku_id", "goods_num")
    table = staged(table, "weeks")
    rows = op.year_over_year(table)
    model = op.linear("features", "label", reg=0.1).fit(op.assemble(rows, ["goods_num"]))
    forecast = op.forecast_year_over_year(table, tt.submit_example(spark, sf_dir), model)
    return forecast.select("sku_id", *[F.round(f"week{k}", 6).alias(f"week{k}")
                                       for k in range(1, 6)])


@query
def forecast_coverage(spark, sf_dir):
    """Submitted SKUs with a row a year before the first forecast week, and without one."""
    week = op.YEAR_BEFORE[1]
    known = _units(spark, sf_dir, [week]).where(F.col("weekNum") == week).select("sku_id").distinct()
    submitted = tt.submit_example(spark, sf_dir).select("sku_id")
    return op.forecast_coverage(submitted.join(
        known.withColumn("week1", F.lit(1.0)), "sku_id", "left"))


def _forecast_from_past(spark, sf_dir) -> DataFrame:
    """Five weeks from two inputs, the sum over 31 weeks up to week 33 and the target week."""
    table = staged(sales_history(spark, sf_dir), "sales")
    sums = op.trailing_sums(table, ["goods_num"], "weekNum2", "sku_id", 33, out_id="sku_id")
    past = staged(op.with_vector(sums.select(
        "sku_id", F.slice("features", 31, 1).alias("features")), 1), "past")
    rows = op.assemble(op.target_week_rows(table, past, ["goods_num"]),
                       ["features", "weekNum2"], "features2")
    model = op.linear(reg=0.1).fit(rows)
    known = past.join(_sold_in_history(spark, sf_dir), "sku_id", "left_semi")
    return op.forecast_weeks(tt.submit_example(spark, sf_dir), known, model, 1)


@query
def forecast_linear(spark, sf_dir):
    return _forecast_from_past(spark, sf_dir)


@query
def forecast_wide(spark, sf_dir):
    """Five weeks per submitted SKU from the boosted trees."""
    matrix, _, model = _boosted(spark, sf_dir)
    return op.forecast_weeks(tt.submit_example(spark, sf_dir), matrix, model,
                             op.matrix_width(1))


# ---- files

@query
def csv_roundtrip(spark, sf_dir):
    """Daily tables written as CSV, read back as text and rolled up."""
    root = scratch_path(spark, "daily")
    tables = {"goodsale": tt.goodsale, "goodsdaily": tt.goodsdaily,
              "goods_promote_price": tt.goods_promote_price}
    raw = {}
    for name, view in tables.items():
        written = tt.as_text(view(spark, sf_dir))
        write_csv(written, f"{root}/{name}.csv")
        raw[name] = read_raw(spark, f"{root}/{name}.csv", written.columns)
    return op.build_feature_table(raw["goodsale"],
                                  op.typed_prices(raw["goods_promote_price"]),
                                  op.typed_traffic(raw["goodsdaily"]), ANCHOR, PLACES)


@query
def week_folders_roundtrip(spark, sf_dir):
    """Whole history in one folder per week; five weeks read back."""
    path = scratch_path(spark, "weeks")
    write_weeks(features(spark, sf_dir), path)
    return read_weeks(spark, path, op.YEAR_BEFORE.values()).select("weekNum", "goods_id",
                                                                   "sku_id", *FEATURE_COLUMNS)


@query
def features_roundtrip(spark, sf_dir):
    """The feature table stored, and read with its columns and types checked."""
    path = scratch_path(spark, "features")
    write_table(features(spark, sf_dir), path)
    return read_features(spark, path).select("weekNum", "goods_id", "sku_id", *FEATURE_COLUMNS)


@query
def local_rows(spark, sf_dir):
    """Weekly sales next to a few rows stated in code."""
    named = from_rows(spark, [(6, "spring"), (7, "spring"), (59, "autumn")],
                      "weekNum int, kind string")
    sales = _units(spark, sf_dir, [6, 7, 59])
    return sales.join(named, "weekNum").groupBy("weekNum", "kind").agg(
        F.count("*").alias("sold"), F.sum("goods_num").alias("units"))


@query
def matrix_roundtrip(spark, sf_dir):
    """The week matrix stored as ML vectors and read back."""
    path = scratch_path(spark, "matrix")
    matrix = op.sales_matrix(sales_history(spark, sf_dir))
    write_table(op.with_vector(matrix, op.matrix_width(1)), path)
    stored = spark.read.parquet(path).withColumn("features", vector_to_array("features"))
    return op.matrix_cells(stored, ["goods_num"])


@query
def forecast_file(spark, sf_dir):
    """The forecast of every submitted SKU as the one CSV file that is handed in."""
    path = scratch_path(spark, "forecast")
    write_csv(_forecast_from_past(spark, sf_dir).drop("has_history"), path, single_file=True)
    return read_raw(spark, path, RAW_COLUMNS["submit_example"])


__all__ = ["QUERIES"]
