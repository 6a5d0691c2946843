"""Training jobs. Each fits on the training part only and scores the held-out part."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession

from ..functions import with_reverse_week
from ..operators import (MATRIX_COLUMNS, BoostedModel, RidgeBoosting, assemble, boosted_trees,
                         collect_gram, expand, factorised_rows, feature_names, gram_blocks,
                         hash_split, horizon_training_set, in_train, linear, matrix_width, predict,
                         ridge, rmse, sales_matrix, squared_error, target_week_rows,
                         training_history, tune_linear, week_matrix, with_fold, with_vector)
from ..operators.trailing import LAST_LAG
from ..session import ensure_checkpoint_dir, staged_for
from ..sources import check_feature_table, read_features, write_model, write_table


@dataclass
class Fit:
    """A fitted model with its held-out score, 1 / (1 + RMSE)."""

    model: Model | BoostedModel
    score: float
    history: list[float] = field(default_factory=list)
    params: str = ""


def fit_and_score(rows: DataFrame, estimator: Estimator, keys: Iterable[str],
                  train_share: float = 0.8, with_history: bool = False) -> Fit:
    """Fit on the hashed training part of `rows` and score the rest.

    The assembled rows are written once. Estimators keep their own form of the
    rows in memory, so caching them here would hold everything twice; and what a
    lost executor held is then read again, not joined again.
    """
    features = estimator.getOrDefault("featuresCol")
    label = estimator.getOrDefault("labelCol")
    keys = list(keys)
    with staged_for(rows.select(*dict.fromkeys([*keys, features, label]))) as stored:
        train, test = hash_split(stored, keys, train_share)
        model = estimator.fit(train)
        error = rmse(predict(model, test), label)
        history = training_history(model, train) if with_history else []
    return Fit(model, 1.0 / (1.0 + error), history)


def train_year_over_year(spark: SparkSession, path: str, model_path: str,
                         rounds: int = 7) -> Fit:
    """Boosted trees on the year-over-year rows: all columns but ids and label."""
    ensure_checkpoint_dir(spark)
    rows = spark.read.parquet(path)
    rows = assemble(rows, feature_names(rows), "features")
    fit = fit_and_score(rows, boosted_trees("features", "label", rounds, min_gain=0.1,
                                            column_share=0.8), ["sku_id", "goods_id"],
                        with_history=True)
    write_model(fit.model, model_path)
    return fit


def fit_factorised_and_score(table: DataFrame, matrix: DataFrame, reg: float = 0.1,
                             train_share: float = 0.8) -> Fit:
    """The linear fit on all target-week rows and its held-out score, without making the rows.

    Label rows are dealt to the two sides by the same hash as in `fit_and_score`; both sides'
    matrices come from one pass, and the error on the held-out side from its matrix.
    """
    side = {"in_train": in_train(["sku_id", "weekNum2"], train_share)}
    rows = factorised_rows(table, matrix, keys=side)
    sums = {key[0]: gram for key, gram in
            collect_gram(gram_blocks(rows, ["in_train"]), ["in_train"]).items()}
    if True not in sums:
        raise ValueError("no rows to fit on")
    label = len(sums[True]) - 1
    fit = ridge(sums[True], range(1, label), label, reg)
    held = sums.get(False)
    score = float("nan")
    if held is not None:
        error = squared_error(held, fit, range(1, label), label) / held[0, 0]
        score = 1.0 / (1.0 + error ** 0.5)
    return Fit(fit.model(table.sparkSession, "features2"), score)


def fit_boosted_and_score(rows: DataFrame, boosting: RidgeBoosting, keys: Iterable[str],
                          features: str = "features2", label: str = "goods_num",
                          train_share: float = 0.8) -> Fit:
    """Boosting with an L2 term; rounds are stopped by the held-out side if it has `patience`."""
    model = boosting.fit(rows, features, label, ~in_train(list(keys), train_share))
    valid = [v for _, _, v in model.history if v is not None]
    score = 1.0 / (1.0 + valid[-1]) if valid else float("nan")
    return Fit(model, score, [train for _, train, _ in model.history])


def train_all_weeks(spark: SparkSession, path: str, model_path: str, rounds: int,
                    matrix_path: str, kind: str = "gbt", step: float = 0.01,
                    depth: int = 7, min_gain: float = 0.1, column_share: float = 0.8,
                    mask_target: bool = False, spread: int = 1, factorised: bool = False,
                    leaf_reg: float | None = None, patience: int | None = None) -> Fit:
    """All features of all weeks, plus the target week, against that week's units.

    The matrix is stored at `matrix_path`, for this job and for the forecast: the
    join with the labels starts from the stored table. `factorised` fits the linear model from
    one row per SKU. With `leaf_reg` (or `patience`, rounds without a better held-out error) the
    trees get that L2 term on their leaves, and columns are drawn per tree, not per node.
    """
    if factorised and (kind != "linear" or mask_target):
        raise ValueError("only the linear fit without masking can be factorised")
    ensure_checkpoint_dir(spark)
    table = with_reverse_week(read_features(spark, path), drop=("weekNum",))
    width = matrix_width(len(MATRIX_COLUMNS))
    write_table(with_vector(week_matrix(table), width), matrix_path)
    if factorised:
        fit = fit_factorised_and_score(table, spark.read.parquet(matrix_path))
        write_model(fit.model, model_path)
        return fit
    rows = target_week_rows(table, spark.read.parquet(matrix_path), mask_target=mask_target,
                            spread=spread)
    rows = with_vector(rows, width)
    rows = assemble(rows, ["features", "weekNum2"], "features2")
    if kind == "gbt" and (leaf_reg is not None or patience is not None):
        boosting = RidgeBoosting(rounds, step, depth, leaf_reg or 0.0, min_gain=min_gain,
                                 column_share=column_share, patience=patience)
        fit = fit_boosted_and_score(rows, boosting, ["sku_id", "weekNum2"])
        fit.model.save(spark, model_path)
        return fit
    if kind == "linear":
        estimator = linear("features2", reg=0.1, rounds=rounds)
    elif kind == "gbt":
        estimator = boosted_trees("features2", rounds=rounds, step=step, depth=depth,
                                  min_gain=min_gain, column_share=column_share)
    else:
        raise ValueError("kind must be gbt or linear")
    fit = fit_and_score(rows, estimator, ["sku_id", "weekNum2"])
    write_model(fit.model, model_path)
    return fit


def train_sales_weeks(spark: SparkSession, path: str, model_path: str, matrix_path: str,
                      rounds: int = 20, keyed_by: str = "week", degree: int = 2,
                      depth: int = 7) -> Fit:
    """Units of all weeks plus the target week, expanded to products of two columns."""
    ensure_checkpoint_dir(spark)
    table = with_reverse_week(read_features(spark, path), drop=("weekNum",))
    write_table(with_vector(sales_matrix(table, keyed_by), matrix_width(1)), matrix_path)
    rows = target_week_rows(table, spark.read.parquet(matrix_path), ["goods_num"])
    rows = assemble(rows, ["features", "weekNum2"], "features2")
    rows = expand(rows, "features2", "polyfeatures", degree)
    fit = fit_and_score(rows, boosted_trees("polyfeatures", rounds=rounds, depth=depth),
                        ["sku_id", "weekNum2"], with_history=True)
    write_model(fit.model, model_path)
    return fit


def train_trailing_sums(spark: SparkSession, path: str, model_path: str | None = None,
                        target: int = 33, horizon: int = 7,
                        cols: Iterable[str] = ("goods_num", "goods_price"),
                        folds: int = 4, kind: str = "linear", rounds: int = 10,
                        depth: int = 5) -> Fit:
    """Trailing sums up to the target week: tuned linear regression, or boosted trees.

    Folds are dealt by a hash of the SKU, so they don't change with the partitions.
    """
    if kind not in ("linear", "gbt"):
        raise ValueError("kind must be gbt or linear")
    table = with_reverse_week(check_feature_table(spark.read.parquet(path)), drop=("weekNum",))
    cols = list(cols)
    rows = with_vector(horizon_training_set(table, target, horizon, cols),
                       (LAST_LAG + 1) * len(cols))
    with staged_for(rows) as stored:
        train, test = hash_split(stored, ["id"])
        if kind == "linear":
            dealt = with_fold(train, ["id"], folds)
            best = tune_linear(dealt, "features", "goods_num", folds=folds,
                               fold_col="fold").bestModel
        else:
            best = boosted_trees("features", rounds=rounds, depth=depth).fit(train)
        fit = Fit(best, 1.0 / (1.0 + rmse(predict(best, test))), params=best.explainParams())
    if model_path:
        write_model(best, model_path)
    return fit

