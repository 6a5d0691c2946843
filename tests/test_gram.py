import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from skuweave import operators as op
from skuweave.operators import gram as gm
from skuweave.sources import load_model, write_model

HISTORY = "sku_id string, goods_id string, weekNum2 int, goods_num double"


@pytest.fixture(scope="module")
def history(spark):
    """A SKU with a third of all rows (many goods), weeks outside the range, and a constant one."""
    rng = random.Random(4)
    rows = [(f"s{s}", "g", w, float(rng.randrange(1, 40) + s)) for s in range(70)
            for w in range(-3, 60) if rng.random() < 0.5]
    rows += [("s1", f"g{k}", w, float(rng.randrange(9))) for k in range(25) for w in range(1, 56)]
    return spark.createDataFrame(rows, HISTORY).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(history):
    data = op.target_week_rows(history, cols=["goods_num"])
    return op.assemble(op.with_vector(data, 55), ["features", "weekNum2"], "features2").cache()


def test_factorised_equals_the_fit_on_all_rows(spark, history, rows, tmp_path):
    for reg in (0.1, 2.0):
        want = op.linear(reg=reg).fit(rows)
        got = op.fit_factorised(history, op.sales_matrix(history), reg=reg)
        assert got.rows == rows.count()
        assert np.allclose(got.coefficients, want.coefficients.toArray(), atol=1e-9)
        assert got.intercept == pytest.approx(want.intercept)
    model = got.model(spark, "features2")
    write_model(model, str(tmp_path / "m"))
    loaded = load_model(str(tmp_path / "m"), "linear")
    a = op.predict(loaded, rows, "features2").agg(F.sum("prediction")).first()[0]
    assert a == pytest.approx(want.transform(rows).agg(F.sum("prediction")).first()[0])


def test_factorised_never_makes_the_wide_rows(spark, history):
    matrix = op.sales_matrix(history)
    plan = plan_of(gm.gram_blocks(gm.factorised_rows(history, matrix)))
    join = plan[plan.index("Join"):]
    # The labels are summed before they meet the matrix, on the map side first.
    assert join.count("partial_sum") >= 1 and "MapInArrow" in plan
    summed = gm.factorised_rows(history, matrix)
    assert summed.count() == history.select("sku_id").distinct().count()


def test_wide_matrices_are_summed_in_blocks(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 290)), rng.normal(size=300)
    df = spark.createDataFrame([(x[i].tolist(), float(y[i]), i % 3) for i in range(300)],
                               "x array<double>, y double, k int").repartition(4)
    blocks = op.gram_blocks(op.single_rows(df, "x", ["y"], ["k"]), ["k"])
    assert blocks.count() == 3 * 6  # three by three blocks, upper half
    for (k,), got in op.collect_gram(blocks, ["k"]).items():
        z = np.c_[np.ones(300), x, y][np.arange(300) % 3 == k]
        assert np.allclose(got, z.T @ z)


def test_small_blocks_and_little_memory_change_nothing(history):
    rows = gm.factorised_rows(history, op.sales_matrix(history), keys={"k": F.col("weekNum2") % 5})
    want = op.collect_gram(op.gram_blocks(rows, ["k"]), ["k"])
    got = op.collect_gram(op.gram_blocks(rows, ["k"], size=7, held_cells=1), ["k"])
    assert want.keys() == got.keys() and len(want) > 5
    assert all(np.allclose(want[k], got[k]) for k in want)


def test_edges_of_a_fit(spark):
    df = spark.createDataFrame([([1.0, 5.0, 2.0], 3.0), ([2.0, 5.0, 4.0], 5.0), ([4.0, 5.0, 8.0], 9.0),
                                (None, 1.0), ([0.0, 0.0, 0.0], None)], "x array<double>, y double")
    (g,) = op.collect_gram(op.gram_blocks(op.single_rows(df, "x", ["y"]))).values()
    fit = op.ridge(g, [1, 2, 3], 4)  # a constant input, and two that depend on each other
    assert fit.rows == 3 and fit.coefficients[1] == 0
    got = df.dropna().select(fit.prediction(F.col("x")).alias("p"), "y").collect()
    assert all(r.p == pytest.approx(r.y) for r in got)
    assert op.squared_error(g, fit, [1, 2, 3], 4) == pytest.approx(0, abs=1e-9)
    flat = df.dropna().withColumn("y", F.lit(7.0))
    (g,) = op.collect_gram(op.gram_blocks(op.single_rows(flat, "x", ["y"]))).values()
    fit = op.ridge(g, [1, 2, 3], 4, reg=0.1)
    assert fit.intercept == 7 and not fit.coefficients.any()
    empty = spark.createDataFrame([], "x array<double>, y double")
    assert op.collect_gram(op.gram_blocks(op.single_rows(empty, "x", ["y"]))) == {}


def test_cross_validation_in_one_scan(spark, rows):
    data = rows.select(F.col("features2").alias("features"), "goods_num",
                       F.pmod(F.hash("sku_id"), F.lit(4)).alias("fold")).cache()
    regs = [5.0, 0.1]
    want = op.tune_linear(data, regs=regs, folds=4, fold_col="fold")
    scores, best = op.cross_validate(data, regs)
    assert np.allclose([m for _, m in scores], want.avgMetrics)
    assert np.allclose(best.coefficients, want.bestModel.coefficients.toArray(), atol=1e-8)
    with pytest.raises(ValueError):
        op.cross_validate(data.where("fold = 0"), regs)


def test_origins_see_no_later_label(spark):
    rng = np.random.default_rng(3)
    rows = [([float(a), float(b)], float(2 * a - b + rng.normal()), int(w))
            for a, b, w in zip(rng.normal(size=400), rng.normal(size=400), rng.integers(1, 30, 400))]
    df = spark.createDataFrame(rows, "features array<double>, goods_num double, label_week int")
    got = {(r.origin, r.reg): r for r in op.origin_scores(df, [0.5], step=5, first=10).collect()}
    assert sorted(o for o, _ in got) == [10, 15, 20, 25]
    for (origin, reg), r in got.items():
        train = [x for x in rows if x[2] <= origin]
        test = [x for x in rows if origin < x[2] <= origin + 5]
        fitted = op.linear("f", "goods_num", reg).fit(op.assemble(spark.createDataFrame(
            [(*x, y) for x, y, _ in train], "a double, b double, goods_num double"), ["a", "b"], "f"))
        errors = [y - fitted.intercept - np.dot(fitted.coefficients, x) for x, y, _ in test]
        assert (r.train_rows, r.test_rows) == (len(train), len(test))
        assert r.rmse == pytest.approx(np.sqrt(np.mean(np.square(errors))))
    assert op.origin_scores(df.where("false")).collect() == []


def test_direct_rows_and_forecast(spark, history):
    cols = ["goods_num"]
    rows = op.direct_rows(history, lags=[0, 30], ahead=[6, 10]).collect()
    best = {}
    for r in history.collect():
        if 1 <= r.weekNum2 <= 55:
            key = r.sku_id, r.weekNum2
            best[key] = max(best.get(key, ("", 0.0)), (r.goods_id, r.goods_num))
    units = {k: v for k, (_, v) in best.items()}
    assert {(r.id, r.target) for r in rows} == {k for k in units if k[1] <= 45}
    for r in rows:
        past = [units.get((r.id, w), 0.0) for w in range(r.target - 30, r.target + 1)]
        assert r.features == [past[-1], sum(past)]
        assert (r.ahead_6, r.ahead_10) == tuple(units.get((r.id, r.target + k), 0.0)
                                                for k in (6, 10))
    data = op.direct_rows(history)
    models = op.fit_direct(data)
    for k, fit in models.items():  # five labels from one matrix, as five separate fits
        want = op.linear("v", f"ahead_{k}").fit(op.with_vector(
            data.withColumnRenamed("features", "v"), 4, "v"))
        assert np.allclose(fit.coefficients, want.coefficients.toArray())
    template = spark.createDataFrame([("s3",), ("never",), ("s3",)], "sku_id string")
    out = op.forecast_direct(history, template, models).collect()
    assert sorted((r.sku_id, r.has_history) for r in out) == [
        ("never", False), ("s3", True), ("s3", True)]
    x = [sum(units.get(("s3", w), 0.0) for w in range(55 - k, 56)) for k in op.LAGS]
    for r in out:
        for i, k in enumerate(sorted(models), 1):
            base = np.dot(models[k].coefficients, x) if r.has_history else 0.0
            assert r[f"week{i}"] == pytest.approx(models[k].intercept + base)
    plan = plan_of(op.direct_rows(history, cols))
    assert "Join" not in plan


def test_totals_by_week_take_one_pass(spark):
    """No week starts again at the first one, and no block is made inside the running sum."""
    df = spark.createDataFrame([("a", "g", w, float(w)) for w in range(1, 11)],
                               "sku_id string, goods_id string, weekNum2 int, goods_num double")
    found = op.direct_rows(df, lags=[0, 3], ahead=[2], weeks=10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan
    assert "element_at(map_from_entries" not in plan
    rows = {r.target: (list(r.features), r.ahead_2) for r in found.collect()}
    assert rows == {w: ([w, sum(range(max(1, w - 3), w + 1))], w + 2) for w in range(1, 9)}
