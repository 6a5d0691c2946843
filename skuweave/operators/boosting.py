"""Boosted trees with an L2 term on leaves, absent values, and rounds stopped by held-out error.

The trees are Spark's; what a leaf adds is not its mean but the sum of its residuals divided by
its rows plus `leaf_reg`. That, and the error after the round on both sides of the split, come
from one grouping by leaf.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, ensure_checkpoint_dir
from .learn import assemble

LEAF, PART = "_leaf", "_part_of_inputs"


# ---- the model

@dataclass(frozen=True)
class Tree:
    """One round: a tree, the inputs that it was given (all where None), and its leaves' values."""

    model: DecisionTreeRegressionModel
    inputs: tuple[int, ...] | None
    values: tuple[float, ...]

    def add_leaf(self, df: DataFrame, features: str) -> DataFrame:
        """`df` with the number of the leaf that each row falls into."""
        if self.inputs is not None:
            df = VectorSlicer(inputCol=features, outputCol=PART, indices=list(self.inputs)
                              ).transform(df)
            features = PART
        model = self.model.copy()
        model.setFeaturesCol(features).setPredictionCol("").setLeafCol(LEAF)
        return model.transform(df).drop(PART)

    def value(self) -> Column:
        """The value of the leaf, looked up in the tree's leaf table."""
        return F.element_at(F.lit([float(v) for v in self.values]), F.col(LEAF).cast("int") + 1)


@dataclass(frozen=True)
class BoostedModel:
    base: float
    step: float
    features: str
    trees: tuple[Tree, ...]
    #: (round, error on the training part, error on the validation part or None), both as RMSE.
    history: tuple[tuple[int, float, float | None], ...] = field(default=())

    def transform(self, df: DataFrame, out: str = "prediction",
                  features: str | None = None) -> DataFrame:
        """Score rows: the base plus what each tree's leaf adds."""
        df = df.withColumn(out, F.lit(float(self.base)))
        for tree in self.trees:
            df = tree.add_leaf(df, features or self.features)
            df = df.withColumn(out, F.col(out) + F.lit(self.step) * tree.value()).drop(LEAF)
        return df

    def cut(self, rounds: int) -> BoostedModel:
        """The same model with its first trees only."""
        return BoostedModel(self.base, self.step, self.features, self.trees[:rounds],
                            self.history[:rounds])

    @property
    def best_round(self) -> int:
        """The round with the smallest validation error (training error where none was held out)."""
        scored = [(valid if valid is not None else train, k) for k, train, valid in self.history]
        return min(scored)[1] if scored else 0

    def history_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.history),
                                     "round int, train_rmse double, valid_rmse double")

    def leaf_table(self, spark: SparkSession) -> DataFrame:
        """`(tree, leaf, value)`, trees counted from 1."""
        rows = [(k, leaf, float(v)) for k, tree in enumerate(self.trees, 1)
                for leaf, v in enumerate(tree.values)]
        return spark.createDataFrame(rows, "tree int, leaf int, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        """One folder: Spark's trees, the leaf table, and the settings."""
        for k, tree in enumerate(self.trees, 1):
            tree.model.write().overwrite().save(f"{path}/trees/{k}")
        self.leaf_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/leaves")
        facts = json.dumps({"base": self.base, "step": self.step, "features": self.features,
                            "inputs": [t.inputs for t in self.trees], "history": self.history})
        spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode(
            "overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        values: dict[int, dict[int, float]] = {}
        for row in spark.read.parquet(f"{path}/leaves").collect():  # rounds times leaves
            values.setdefault(row.tree, {})[row.leaf] = row.value
        trees = tuple(
            Tree(DecisionTreeRegressionModel.load(f"{path}/trees/{k}"),
                 None if inputs is None else tuple(inputs),
                 tuple(v for _, v in sorted(values[k].items())))
            for k, inputs in enumerate(facts["inputs"], 1))
        return cls(facts["base"], facts["step"], facts["features"], trees,
                   tuple(tuple(h) for h in facts["history"]))


# ---- fitting

@dataclass(frozen=True)
class RidgeBoosting:
    """Gradient boosting on squared error with `leaf_reg` on the leaves.

    `base` is the first prediction (the mean of the training part where None). `column_share` is
    drawn per tree. With a validation part, `patience` rounds without a smaller error on it end
    the fit, and the model keeps the rounds up to the best one. Every `stage_every` rounds the
    rows and their predictions are written to the shared folder, so that neither a plan nor a
    recovery goes back through more trees than that; only the newest copy is kept, and none after
    the fit.
    """

    rounds: int = 20
    step: float = 0.1
    depth: int = 7
    leaf_reg: float = 2.0
    min_rows: int = 1
    min_gain: float = 0.0
    column_share: float = 1.0
    base: float | None = None
    max_bins: int = 32
    patience: int | None = None
    stage_every: int = 5
    seed: int = 42
    memory_mb: int = 512

    def fit(self, df: DataFrame, features: str = "features2", label: str = "goods_num",
            validation: Column | None = None) -> BoostedModel:
        """Fit on the rows where `validation` is not true. Rows without label are left out."""
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        held = F.coalesce(validation, F.lit(False)) if validation is not None else F.lit(False)
        rows = df.dropna(subset=[features, label]).select(
            features, F.col(label).cast("double").alias("_label"), held.alias("_held"))
        with Scratch(spark) as scratch:
            rows = scratch.stage(rows, "boosting")
            mean = rows.where("NOT _held").agg(F.avg("_label"), F.count("*")).first()
            if not mean[1]:
                raise ValueError("no rows to fit on")
            base = float(mean[0] if self.base is None else self.base)
            width = self._width(rows, features)
            rows = rows.withColumn("_made", F.lit(base))
            trees: list[Tree] = []
            history: list[tuple[int, float, float | None]] = []
            best = (math.inf, 0)
            for k in range(1, self.rounds + 1):
                rows = rows.withColumn("_rest", F.col("_label") - F.col("_made"))
                tree, error = self._round(rows, features, k, width)
                trees.append(tree)
                history.append((k, *error))
                best = min(best, (error[-1] if error[-1] is not None else error[0], k))
                if error[1] is not None and self.patience is not None and (
                        k - best[1] >= self.patience):
                    break
                if k == self.rounds:
                    break
                rows = tree.add_leaf(rows.drop("_rest"), features)
                rows = rows.withColumn("_made", F.col("_made") + F.lit(self.step) * tree.value()
                                       ).drop(LEAF)
                if k % self.stage_every == 0:
                    rows = scratch.stage(rows, "boosting")
                    scratch.keep_last()
        model = BoostedModel(base, self.step, features, tuple(trees), tuple(history))
        return model.cut(best[1]) if validation is not None and self.patience is not None else model

    def _width(self, rows: DataFrame, features: str) -> int:
        if self.column_share >= 1.0:
            return 0
        meta = rows.schema[features].metadata.get("ml_attr", {})
        return int(meta["num_attrs"]) if "num_attrs" in meta else rows.select(features).first()[0].size

    def _round(self, rows: DataFrame, features: str, k: int,
               width: int) -> tuple[Tree, tuple[float, float | None]]:
        """One tree on the residuals `_rest`; the errors are those after its leaves are added."""
        inputs = None
        train = rows.where("NOT _held")
        column = features
        if width:
            many = max(1, round(self.column_share * width))
            inputs = tuple(sorted(random.Random(f"{self.seed}/{k}").sample(range(width), many)))
            train = VectorSlicer(inputCol=features, outputCol=PART, indices=list(inputs)
                                 ).transform(train)
            column = PART
        model = DecisionTreeRegressor(
            featuresCol=column, labelCol="_rest", maxDepth=self.depth, maxBins=self.max_bins,
            minInstancesPerNode=self.min_rows, minInfoGain=self.min_gain, seed=self.seed,
            maxMemoryInMB=self.memory_mb).fit(train)
        leafed = Tree(model, inputs, ()).add_leaf(rows, features)
        rest = F.col("_rest")
        # At most two rows per leaf.
        sums = {(int(r[LEAF]), r["_held"]): (r.n, r.s, r.ss) for r in leafed.groupBy(
            LEAF, "_held").agg(F.count("*").alias("n"), F.sum(rest).alias("s"),
                               F.sum(rest * rest).alias("ss")).collect()}
        leaves = (model.numNodes + 1) // 2
        values = tuple(sums[leaf, False][1] / (sums[leaf, False][0] + self.leaf_reg)
                       if (leaf, False) in sums else 0.0 for leaf in range(leaves))

        def rmse(part: bool) -> float | None:
            found = [(n, s, ss, self.step * values[leaf]) for (leaf, held), (n, s, ss)
                     in sums.items() if held == part]
            if not found:
                return None
            rows_, error = sum(f[0] for f in found), sum(
                ss - 2 * v * s + n * v * v for n, s, ss, v in found)
            return math.sqrt(max(error, 0.0) / rows_)

        return Tree(model, inputs, values), (rmse(False), rmse(True))


def early_stop(df: DataFrame, boosting: RidgeBoosting, features: str, label: str,
               validation: Column) -> BoostedModel:
    """All rounds on the training part, then the model up to the round that held-out rows like best."""
    model = boosting.fit(df, features, label, validation)
    return model.cut(model.best_round)


# ---- absent values

@dataclass(frozen=True)
class AbsentBins:
    """Inputs as categories: quantile bins, and bin 0 for values that are absent.

    Absent is NULL, NaN, and the value `absent`. Given to a tree as categories, the bin of the
    absent values goes to whichever side of a split fits it better, split by split.
    """

    thresholds: Mapping[str, tuple[float, ...]]
    absent: float | None = 0.0

    @classmethod
    def fit(cls, df: DataFrame, inputs: Sequence[str], bins: int = 16,
            absent: float | None = 0.0, accuracy: int = 10_000) -> AbsentBins:
        """Bounds at the quantiles of the values that are there, all inputs in one pass.

        An approximate quantile: its state is bounded, its error is a rank of 1 / `accuracy`.
        """
        if bins < 1:
            raise ValueError("at least one bin")
        shares = [k / bins for k in range(1, bins)]
        found = {}
        if shares:
            there = cls(dict.fromkeys(inputs, ()), absent)
            row = df.agg(*[F.percentile_approx(F.when(~there._missing(c), F.col(c).cast("double")),
                                               shares, accuracy).alias(f"q{i}")
                           for i, c in enumerate(inputs)]).first()
            found = {c: tuple(sorted(set(row[f"q{i}"] or ()))) for i, c in enumerate(inputs)}
        return cls({c: found.get(c, ()) for c in inputs}, absent)

    def _missing(self, name: str) -> Column:
        value = F.col(name).cast("double")
        out = value.isNull() | F.isnan(value)
        return out if self.absent is None else out | (value == F.lit(float(self.absent)))

    def bin_of(self, name: str) -> Column:
        """0 where absent, otherwise 1 and up: bin k ends at the k-th bound, which belongs to it."""
        above = [(F.col(name) > F.lit(t)).cast("int") for t in self.thresholds[name]]
        return F.when(self._missing(name), F.lit(0)).otherwise(
            sum(above, F.lit(1))).cast("double")

    @property
    def most(self) -> int:
        """Number of categories of the input that has most; trees need as many bins."""
        return max(len(t) for t in self.thresholds.values()) + 2

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Assemble the bins of all inputs as one vector of categories."""
        names = {c: f"_bin_{i}" for i, c in enumerate(self.thresholds)}
        for c, bin_name in names.items():
            many = len(self.thresholds[c]) + 2
            nominal = {"ml_attr": {"type": "nominal", "name": bin_name,
                                   "vals": [str(v) for v in range(many)]}}
            df = df.withColumn(bin_name, self.bin_of(c)).withMetadata(bin_name, nominal)
        return assemble(df, list(names.values()), out).drop(*names.values())


def sides(model: DecisionTreeRegressionModel, input_index: int = 0) -> Iterator[tuple[int, str]]:
    """`(category, "left" or "right")` of the root split of a tree on categories."""
    root = model._call_java("rootNode")
    if root.subtreeDepth() == 0 or root.split().featureIndex() != input_index:
        return
    split = root.split()
    for side, found in (("left", split.leftCategories()), ("right", split.rightCategories())):
        for category in found:
            yield int(category), side
