"""Assembly, feature expansion and selection, estimators, splits, tuning and scoring."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (PolynomialExpansion, UnivariateFeatureSelector,
                                UnivariateFeatureSelectorModel, VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import one_over_one_plus_rmse


# ---- vectors

def assemble(df: DataFrame, inputs: Sequence[str], out: str = "features") -> DataFrame:
    """Numbers and vectors of a row as one vector, stored sparse where that is smaller.

    The length of a vector input is taken from its column metadata (`sized`).
    Where that is missing, Spark runs the plan so far to look at a first row.
    """
    return VectorAssembler(inputCols=list(inputs), outputCol=out).transform(df)


def sized(vector: Column, name: str, size: int) -> Column:
    """Name a vector column and state its length in the column metadata.

    The metadata goes with the column through joins and Parquet files.
    """
    return vector.alias(name, metadata={"ml_attr": {"num_attrs": int(size)}})


def is_array(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.ArrayType)


def with_vector(df: DataFrame, size: int, col: str = "features") -> DataFrame:
    """Turn an array column into an ML vector of known length; a vector stays as it is."""
    vector = array_to_vector(F.col(col)) if is_array(df, col) else F.col(col)
    return df.select(*[sized(vector, c, size) if c == col else F.col(c) for c in df.columns])


def with_array(df: DataFrame, col: str = "features") -> DataFrame:
    """Turn an ML vector column into an array; an array stays as it is."""
    return df if is_array(df, col) else df.withColumn(col, vector_to_array(F.col(col)))


def expand(df: DataFrame, inputs: str = "features2", out: str = "polyfeatures",
           degree: int = 2) -> DataFrame:
    return PolynomialExpansion(inputCol=inputs, outputCol=out, degree=degree).transform(df)


def top_categorical(df: DataFrame, features: str = "features", label: str = "label",
                    top: int = 1, out: str = "selectedFeatures"
                    ) -> tuple[UnivariateFeatureSelectorModel, DataFrame]:
    """Keep the `top` categorical features by the chi-square test against the label."""
    selector = UnivariateFeatureSelector(featuresCol=features, labelCol=label, outputCol=out,
                                         selectionMode="numTopFeatures")
    selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(top)
    model = selector.fit(df)
    return model, model.transform(df)


# ---- estimators

def boosted_trees(features: str = "features2", label: str = "goods_num", rounds: int = 20,
                  step: float = 0.1, depth: int = 7, min_rows: int = 5, min_gain: float = 0.01,
                  subsample: float = 1.0, column_share: float = 1.0, seed: int = 42,
                  memory_mb: int = 512) -> GBTRegressor:
    """Gradient boosted trees on squared error.

    `column_share` is drawn per tree node. There is no L2 term on leaf values and
    zeros are ordinary values. `memory_mb` bounds the histograms gathered per pass
    over the data: with hundreds of features a larger value means fewer passes.
    """
    share = "all" if column_share >= 1.0 else str(column_share)
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=rounds, stepSize=step,
                        maxDepth=depth, minInstancesPerNode=min_rows, minInfoGain=min_gain,
                        subsamplingRate=subsample, featureSubsetStrategy=share,
                        lossType="squared", seed=seed, maxMemoryInMB=memory_mb)


def linear(features: str = "features2", label: str = "goods_num", reg: float = 0.1,
           rounds: int = 100, aggregation_depth: int = 8) -> LinearRegression:
    """Linear regression with an L2 term; `aggregation_depth` keeps the driver's merge small."""
    return LinearRegression(featuresCol=features, labelCol=label, regParam=reg, maxIter=rounds,
                            aggregationDepth=aggregation_depth)


# ---- splits and tuning

def hash_split(df: DataFrame, keys: Iterable[str],
               train_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of `keys`: a plain filter, the same rows whatever the partitioning.

    A random split sorts every partition first and changes when rows move; here a
    recomputed partition gives the same two sides again. The hash is the start of md5 of
    the keys as text, joined by '|', so that other engines can repeat the split.
    """
    side = in_train(keys, train_share)
    return df.where(side), df.where(~side)


def mark_held(df: DataFrame, keys: Iterable[str], train_share: float = 0.8,
              out: str = "held") -> DataFrame:
    """Both sides of `hash_split` in one table, read and hashed once; `out` says which is held out."""
    return df.withColumn(out, ~in_train(keys, train_share))


def in_train(keys: Iterable[str], train_share: float = 0.8) -> Column:
    """Whether a row is on the training side of `hash_split`."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return number % 1000 < int(round(train_share * 1000))


def with_fold(df: DataFrame, keys: Iterable[str], folds: int = 4,
              out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(*keys), F.lit(folds)).cast("int"))


def tune_linear(train: DataFrame, features: str = "features", label: str = "goods_num",
                regs: Sequence[float] = (0.1, 0.01), folds: int = 4, fold_col: str | None = None,
                seed: int = 42, parallelism: int = 2) -> CrossValidatorModel:
    """Choose the regularisation by k-fold cross-validation on RMSE."""
    estimator = LinearRegression(featuresCol=features, labelCol=label, regParam=0.01)
    grid = ParamGridBuilder().addGrid(estimator.regParam, list(regs)).build()
    search = CrossValidator(estimator=estimator, estimatorParamMaps=grid,
                            evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"),
                            numFolds=folds, seed=seed, parallelism=parallelism)
    if fold_col is not None:
        search = search.setFoldCol(fold_col)
    return search.fit(train)


# ---- scoring

def predict(model: Model, df: DataFrame, features: str | None = None,
            out: str = "prediction") -> DataFrame:
    """Score rows; the input and output columns may differ from those of the fit."""
    if not isinstance(model, Model):  # a BoostedModel, which is no Spark stage
        return model.transform(df, out, features)
    params = {model.getParam("predictionCol"): out}
    if features is not None:
        params[model.getParam("featuresCol")] = features
    return model.transform(df, params)


def rmse(scored: DataFrame, label: str = "goods_num", prediction: str = "prediction") -> float:
    return RegressionEvaluator(labelCol=label, predictionCol=prediction,
                               metricName="rmse").evaluate(scored)


def score_table(scored: DataFrame, label: str = "goods_num",
                prediction: str = "prediction") -> DataFrame:
    """1 / (1 + RMSE) as a one-row table."""
    return scored.agg(one_over_one_plus_rmse(label, prediction).alias("score"))


def training_history_table(model: Model, train: DataFrame,
                           held_out: DataFrame | None = None) -> DataFrame:
    """`(round, train_rmse, valid_rmse)` of Spark's boosted trees, one row per round."""
    errors = [list(model.evaluateEachIteration(part, "squared")) if part is not None else None
              for part in (train, held_out)]
    rows = [(k, float(e) ** 0.5, float(errors[1][k - 1]) ** 0.5 if errors[1] else None)
            for k, e in enumerate(errors[0], 1)]
    return train.sparkSession.createDataFrame(
        rows, "round int, train_rmse double, valid_rmse double")


def training_history(model: Model, df: DataFrame) -> list[float]:
    """The objective after each round, one number per round."""
    if hasattr(model, "evaluateEachIteration"):
        return list(model.evaluateEachIteration(df, "squared"))
    return list(model.summary.objectiveHistory) if model.hasSummary else []
