"""Linear regression from Gram matrices: one pass over narrow rows, any number of fits.

A row carries a feature vector x and what is to be known about the rows that share it: their
number, and the sums and cross products of further columns ("tails": target week, labels). The
Gram matrix of (1, x, tails) over all of them is a sum over rows, so

- a wide x is read once, however many labels it has, and is never repeated;
- folds, origins, penalties and several labels all come from the same matrices;
- the error of a fit on a set of rows follows from the matrix of that set.

Tasks sum matrices of their rows and send them as blocks, which are summed by block. What reaches
the driver is the square of the number of columns per key, never anything that grows with rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .learn import with_array

BLOCK = 128
#: Matrices that a task holds before it sends what it has.
HELD_CELLS = 16_000_000


# ---- rows to sum over

def _tail_parts(tails: Sequence[str], add) -> list[Column]:
    """Number, sums and cross products of the tails; `add` is F.sum, or nothing for single rows."""
    t = [F.col(c).cast("double") for c in tails]
    return [add(F.lit(1.0)).alias("n"), F.array(*[add(a) for a in t]).alias("sums"),
            F.array(*[add(a * b) for a in t for b in t]).alias("products")]


def label_sums(labels: DataFrame, by: Sequence[str], tails: Sequence[str]) -> DataFrame:
    """`(by..., n, sums, products)`: the label rows of each key in one row of fixed width.

    Plain sums, combined on the map side. Rows with a NULL tail are left out.
    """
    known = labels.dropna(subset=list(tails))
    return known.groupBy(*by).agg(*_tail_parts(tails, F.sum))


def single_rows(rows: DataFrame, x: str, tails: Sequence[str],
                keys: Sequence[str] = ()) -> DataFrame:
    """`(keys..., x, n, sums, products)` of rows that carry their labels themselves."""
    known = with_array(rows, x).dropna(subset=[x, *tails])
    return known.select(*keys, F.col(x).alias("x"), *_tail_parts(tails, lambda c: c))


# ---- sums of matrices

def _part(x: np.ndarray, n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Gram matrix of (1, x, tails) over a batch of rows."""
    p, q = x.shape[1], sums.shape[1]
    out = np.empty((1 + p + q, 1 + p + q))
    out[0, 0] = n.sum()
    out[0, 1:1 + p] = out[1:1 + p, 0] = n @ x
    out[0, 1 + p:] = out[1 + p:, 0] = sums.sum(0)
    out[1:1 + p, 1:1 + p] = (x * n[:, None]).T @ x
    out[1:1 + p, 1 + p:] = x.T @ sums
    out[1 + p:, 1:1 + p] = out[1:1 + p, 1 + p:].T
    out[1 + p:, 1 + p:] = products.sum(0).reshape(q, q)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _blocks(key: tuple, matrix: np.ndarray, size: int) -> Iterator[tuple]:
    for i in range(0, len(matrix), size):
        for j in range(i, len(matrix), size):  # symmetric: the upper half is enough
            yield (*key, i, j, matrix[i:i + size, j:j + size].ravel())


def _sum_rows(keys: Sequence[str], size: int, most: int):
    """Matrices of a task's rows, as blocks, by key; `most` cells are held at a time."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        names, types = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [*keys, "i", "j", "cells"]
            types = [*[batch.schema.field(k).type for k in keys], pa.int32(), pa.int32(),
                     pa.list_(pa.float64())]
            x, n = _matrix(batch["x"]), batch["n"].to_numpy(zero_copy_only=False)
            sums, products = _matrix(batch["sums"]), _matrix(batch["products"])
            groups = {(): np.arange(batch.num_rows)}
            if keys:
                groups = {}
                for at, key in enumerate(zip(*[batch[k].to_pylist() for k in keys])):
                    groups.setdefault(key, []).append(at)
            for key, at in groups.items():
                part = _part(x[at], n[at], sums[at], products[at])
                held[key] = held[key] + part if key in held else part
                if sum(m.size for m in held.values()) > most:
                    yield from _as_batches(held, names, types, size)
                    held = {}
        if held:
            yield from _as_batches(held, names, types, size)
    return run


def _as_batches(held: Mapping[tuple, np.ndarray], names, types,
                size: int) -> Iterator[pa.RecordBatch]:
    for key, matrix in held.items():
        columns = list(zip(*_blocks(key, matrix, size)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _sum_blocks(keys: Sequence[str]):
    """Sum of sorted blocks: one block is held at a time."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            places = list(zip(*[batch[k].to_pylist() for k in (*keys, "i", "j")]))
            for at, place in enumerate(places):
                cells = batch["cells"][at].values.to_numpy()
                if place != now:
                    if now is not None:
                        yield done(now, total, batch.schema)
                    now, total = place, cells.copy()
                else:
                    total += cells
            schema = batch.schema
        if now is not None:
            yield done(now, total, schema)

    def done(place, total, schema):
        return pa.RecordBatch.from_arrays(
            [pa.array([v], schema.field(k).type) for k, v in zip((*keys, "i", "j"), place)]
            + [pa.array([total], pa.list_(pa.float64()))], names=[*keys, "i", "j", "cells"])
    return run


def gram_blocks(rows: DataFrame, keys: Sequence[str] = (), size: int = BLOCK,
                held_cells: int = HELD_CELLS) -> DataFrame:
    """`(keys..., i, j, cells)`: the Gram matrices of `(x, n, sums, products)` rows, in blocks.

    `i`, `j` are the block's first row and column, blocks below the diagonal are left out. Every
    task sends one row per key and block of `size` by `size` cells, or more where its keys'
    matrices have over `held_cells` cells in all; all vectors must have one length.
    """
    keys = list(keys)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}{', ' if keys else ''}i int, j int, cells array<double>"
    parts = rows.select(*keys, "x", "n", "sums", "products").mapInArrow(
        _sum_rows(keys, size, held_cells), schema)
    return parts.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j").mapInArrow(
        _sum_blocks(keys), schema)


def collect_gram(blocks: DataFrame, keys: Sequence[str] = ()) -> dict[tuple, np.ndarray]:
    """The summed matrices by key, on the driver: (columns squared) numbers each."""
    found: dict[tuple, list] = {}
    for row in blocks.toLocalIterator():
        found.setdefault(tuple(row[k] for k in keys), []).append(row)
    out = {}
    for key, parts in found.items():
        heights = {r.i: round(len(r.cells) ** 0.5) for r in parts if r.i == r.j}
        width = sum(heights.values())
        matrix = np.empty((width, width))
        for r in parts:
            cells = np.array(r.cells).reshape(heights[r.i], heights[r.j])
            matrix[r.i:r.i + heights[r.i], r.j:r.j + heights[r.j]] = cells
            matrix[r.j:r.j + heights[r.j], r.i:r.i + heights[r.i]] = cells.T
        out[key] = matrix
    return out


# ---- fits

@dataclass(frozen=True)
class LinearFit:
    """Coefficients of one label, in the order of the inputs."""

    coefficients: np.ndarray
    intercept: float
    rows: int

    def prediction(self, x: Column) -> Column:
        """The prediction for an array column, as a JVM expression."""
        return F.aggregate(F.zip_with(x, F.lit([float(c) for c in self.coefficients]),
                                      lambda a, b: a * b),
                           F.lit(float(self.intercept)), lambda s, v: s + v)

    def model(self, spark: SparkSession, features: str = "features") -> LinearRegressionModel:
        """The same as a Spark model: it can be saved, loaded and put in a pipeline."""
        java = spark._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
            "linReg_gram", _py2java(spark.sparkContext, Vectors.dense(self.coefficients)),
            float(self.intercept))
        model = LinearRegressionModel(java)
        model._resetUid("linReg_gram")
        return model._set(featuresCol=features) if hasattr(model, "_set") else model


def ridge(gram: np.ndarray, inputs: Sequence[int], label: int, reg: float = 0.0) -> LinearFit:
    """Least squares with an L2 term on standardised columns, as `linear` fits it.

    `inputs` and `label` are columns of the Gram matrix; column 0 is the constant. `reg` counts in
    units of the label's deviation. An input that never changes gets 0, as does every input where
    the label never changes. Without a penalty, dependent inputs give the smallest solution.
    """
    n = gram[0, 0]
    if n <= 0:
        raise ValueError("no rows to fit on")
    inputs = list(inputs)
    mean = gram[0] / n
    cov = gram / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    flat = scale <= 1e-9 * np.maximum(np.abs(mean), 1e-300)
    used = [i for i in inputs if not flat[i]]
    beta = np.zeros(len(inputs))
    if used and not flat[label]:
        corr = cov[np.ix_(used, used)] / np.outer(scale[used], scale[used])
        target = cov[used, label] / (scale[used] * scale[label])
        if reg > 0:
            solved = np.linalg.solve(corr + np.eye(len(used)) * reg / scale[label], target)
        else:
            solved = np.linalg.lstsq(corr, target, rcond=1e-12)[0]
        place = {c: k for k, c in enumerate(inputs)}
        beta[[place[i] for i in used]] = solved * scale[label] / scale[used]
    return LinearFit(beta, float(mean[label] - beta @ mean[inputs]), int(round(n)))


def squared_error(gram: np.ndarray, fit: LinearFit, inputs: Sequence[int], label: int) -> float:
    """Sum of squared errors of a fit on the rows behind `gram`, without reading them.

    Taken around the means of those rows, where the sums are small.
    """
    n = gram[0, 0]
    if n <= 0:
        return 0.0
    weights = np.zeros(len(gram))
    weights[list(inputs)] = -fit.coefficients
    weights[label] = 1.0
    mean = gram[0] / n
    bias = float(weights @ mean) - fit.intercept
    spread = float(weights @ (gram - n * np.outer(mean, mean)) @ weights)
    return max(spread, 0.0) + n * bias * bias


# ---- uses

def factorised_rows(table: DataFrame, matrix: DataFrame, id_col: str = "sku_id",
                    week_col: str = "weekNum2", label_col: str = "goods_num",
                    keys: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per SKU (and key): its matrix row, and the sums of its weeks and labels.

    What `target_week_rows` repeats once per label row stands here once. The label rows are
    summed before the join, so a SKU with a third of all rows is one row in it. `keys` split the
    label rows, e.g. into a training and a test side.
    """
    keys = dict(keys or {})
    labels = table.select(F.col(id_col).cast("string").alias(id_col), week_col, label_col,
                          *[c.alias(k) for k, c in keys.items()])
    summed = label_sums(labels, [id_col, *keys], [week_col, label_col])
    x = with_array(matrix).select(F.col(id_col), F.col("features").alias("x"))
    return summed.join(x, id_col).select(*keys, "x", "n", "sums", "products")


def fit_factorised(table: DataFrame, matrix: DataFrame, reg: float = 0.1, **columns) -> LinearFit:
    """The linear fit on all target-week rows, without making one of them.

    Inputs are the matrix row and the target week, as in `target_week_rows` without masking; the
    result is that of `linear(reg=reg)` on the assembled rows.
    """
    gram = collect_gram(gram_blocks(factorised_rows(table, matrix, **columns)))
    if not gram:
        raise ValueError("no rows to fit on")
    width = len(gram[()])
    return ridge(gram[()], range(1, width - 1), width - 1, reg)


def fold_scores(grams: Mapping[object, np.ndarray], regs: Sequence[float],
                label: int = -1) -> list[tuple[float, float]]:
    """`(penalty, mean RMSE over the folds)`: each fold is scored by a fit on all the others."""
    total = sum(grams.values())
    label = label % len(total)
    inputs = [i for i in range(1, len(total)) if i != label]
    out = []
    for reg in regs:
        errors = []
        for fold in grams.values():
            fit = ridge(total - fold, inputs, label, reg)
            errors.append(np.sqrt(squared_error(fold, fit, inputs, label) / fold[0, 0]))
        out.append((float(reg), float(np.mean(errors))))
    return out


def cross_validate(rows: DataFrame, regs: Sequence[float] = (0.1, 0.01), fold_col: str = "fold",
                   x: str = "features", label: str = "goods_num"
                   ) -> tuple[list[tuple[float, float]], LinearFit]:
    """k-fold cross-validation in one scan: all penalties, and the best one fitted on all rows.

    The training part of a fold is the total less the fold. Ties take the penalty named first.
    """
    blocks = gram_blocks(single_rows(rows, x, [label], [fold_col]), [fold_col])
    grams = {k[0]: g for k, g in collect_gram(blocks, [fold_col]).items()}
    if len(grams) < 2:
        raise ValueError("cross-validation needs rows in two folds at least")
    scores = fold_scores(grams, regs)
    total = sum(grams.values())
    best = min(scores, key=lambda s: s[1])[0]
    return scores, ridge(total, range(1, len(total) - 1), len(total) - 1, best)


def origin_scores(rows: DataFrame, regs: Sequence[float] = (0.1, 0.01), step: int = 4,
                  first: int | None = None, week: str = "label_week", x: str = "features",
                  label: str = "goods_num") -> DataFrame:
    """Validation by time: `(origin, reg, train_rows, test_rows, rmse)`.

    At each origin the fit sees the rows whose label week is the origin's or earlier, and is
    scored on the label weeks of the next `step` weeks; then the origin moves on by `step`. The
    features of a row end before its label week, so nothing of the future gets in. Origins begin
    at `first` (or the earliest label week) and end where no later label is left. One scan: a
    matrix per label week, and running totals of those.
    """
    spark = rows.sparkSession
    blocks = gram_blocks(single_rows(rows, x, [label], [week]).where(F.col(week).isNotNull()),
                         [week])
    weeks = {int(k[0]): g for k, g in collect_gram(blocks, [week]).items()}
    out = []
    if weeks:
        width = len(next(iter(weeks.values())))
        inputs, target = range(1, width - 1), width - 1
        zero = np.zeros((width, width))
        for origin in range(min(weeks) if first is None else first, max(weeks), step):
            past = sum((g for w, g in weeks.items() if w <= origin), zero)
            after = sum((g for w, g in weeks.items() if origin < w <= origin + step), zero)
            if past[0, 0] < 1 or after[0, 0] < 1:
                continue
            for reg in regs:
                fit = ridge(past, inputs, target, reg)
                error = squared_error(after, fit, inputs, target) / after[0, 0]
                out.append((origin, float(reg), fit.rows, int(round(after[0, 0])),
                            float(np.sqrt(error))))
    return spark.createDataFrame(
        out, "origin int, reg double, train_rows long, test_rows long, rmse double")
