import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuweave import operators as op
from skuweave.sources import from_rows, load_model, write_model

HISTORY = "sku_id string, goods_id string, weekNum2 int, goods_num double"


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(3)
    rows = [(f"s{s}", "g", w, float(rng.randrange(1, 40) + s)) for s in range(40)
            for w in range(1, 56) if rng.random() < 0.5]
    return spark.createDataFrame(rows, HISTORY).repartition(4, "sku_id").cache()


@pytest.fixture(scope="module")
def rows(history):
    data = op.target_week_rows(history, cols=["goods_num"])
    return op.assemble(op.with_vector(data, 55), ["features", "weekNum2"], "features2").cache()


def test_assembled_width_and_expansion(rows):
    first = op.expand(rows.limit(1)).first()
    assert (first.features2.size, first.polyfeatures.size) == (56, 1652)


def test_sparse_products(spark, rows):
    """The same cells as the dense expansion, and no more than those of the inputs that are not 0."""
    got = op.expand_sparse(rows.select("sku_id", "weekNum2", "goods_num", "features2"), 56, "features2")
    want = {(r.sku_id, r.weekNum2): r.polyfeatures for r in op.expand(rows).collect()}
    seen = 0
    for r in got.collect():
        dense = want[r.sku_id, r.weekNum2]
        given = r.features2.numNonzeros()
        assert r.polyfeatures.size == dense.size == 1652
        assert len(r.polyfeatures.indices) == given * (given + 3) // 2
        assert np.array_equal(r.polyfeatures.toArray(), dense.toArray())
        seen += 1
    assert seen == len(want)
    model = op.linear("polyfeatures", rounds=3).fit(got)  # an ML vector like any other
    assert model.numFeatures == 1652
    wide = spark.createDataFrame([([0.0] * 600 + [2.0] + [0.0] * 5, ), ([0.0] * 606,)],
                                 "features array<double>")
    first, empty = op.expand_sparse(wide, 606).select("polyfeatures").collect()
    if not len(first.polyfeatures.indices):
        first, empty = empty, first
    at = 600 * 603 // 2
    assert first.polyfeatures.size == 184_527 and list(first.polyfeatures.indices) == [at, at + 601]
    assert list(first.polyfeatures.values) == [2.0, 4.0] and not len(empty.polyfeatures.indices)
    null = spark.createDataFrame([([1.0, None],)], "features array<double>")
    with pytest.raises(Exception, match="an input is NULL"):
        op.expand_sparse(null, 2)


def test_history_of_sparks_trees(rows):
    train, test = op.hash_split(rows, ["sku_id", "weekNum2"])
    model = op.boosted_trees(rounds=3, depth=3).fit(train)
    table = op.training_history_table(model, train, test).orderBy("round").collect()
    assert [r.round for r in table] == [1, 2, 3]
    assert table[-1].valid_rmse == pytest.approx(op.rmse(model.transform(test)))
    assert table[0].train_rmse > table[-1].train_rmse


def test_missing_input_is_an_error(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception, match="null"):
        op.assemble(df, ["a", "b"]).collect()


def test_chi_square_example(spark):
    # fixed values: the three rows of a well-known example, third feature is the answer
    df = from_rows(spark, [(7, Vectors.dense(0.0, 0.0, 18.0, 1.0), 1.0),
                           (8, Vectors.dense(0.0, 1.0, 12.0, 0.0), 0.0),
                           (9, Vectors.dense(1.0, 0.0, 15.0, 0.1), 0.0)],
                   T.StructType([T.StructField("id", T.IntegerType()),
                                 T.StructField("features", VectorUDT()),
                                 T.StructField("clicked", T.DoubleType())]))
    model, out = op.top_categorical(df, label="clicked")
    assert list(model.selectedFeatures) == [2]
    assert [r.selectedFeatures[0] for r in out.orderBy("id").collect()] == [18.0, 12.0, 15.0]


def test_linear_against_normal_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)],
                               "a double, b double, c double, label double")
    model = op.linear("features", "label", reg=0.0).fit(op.assemble(df, ["a", "b", "c"]))
    want = np.linalg.lstsq(np.c_[x, np.ones(200)], y, rcond=None)[0]
    assert np.allclose([*model.coefficients, model.intercept], want)


def test_hash_split_is_complete_and_stable(rows):
    train, test = op.hash_split(rows, ["sku_id", "weekNum2"])
    again, _ = op.hash_split(rows.repartition(7), ["sku_id", "weekNum2"])
    keys = [(r.sku_id, r.weekNum2) for r in train.collect()]
    assert sorted(keys) == sorted((r.sku_id, r.weekNum2) for r in again.collect())
    assert len(keys) + test.count() == rows.count()
    assert 0.7 < len(keys) / rows.count() < 0.9


def test_split_shares_follow_the_request(rows):
    train, test = op.hash_split(rows.select("sku_id", "weekNum2"), ["sku_id", "weekNum2"], 0.3)
    assert 0 < train.count() < test.count()
    assert train.join(test, ["sku_id", "weekNum2"]).count() == 0


def test_folds(rows):
    folds = {r.fold for r in op.with_fold(rows, ["sku_id"]).select("fold").distinct().collect()}
    assert folds == {0, 1, 2, 3}


def test_boosted_trees_same_seed_same_score(rows, tmp_path):
    trees = op.boosted_trees(rounds=3, depth=3)
    a, b = trees.fit(rows), trees.fit(rows)
    assert op.rmse(a.transform(rows)) == op.rmse(b.transform(rows))
    write_model(a, str(tmp_path / "m"))
    loaded = load_model(str(tmp_path / "m"), "gbt")
    assert sorted(map(str, loaded.transform(rows).select("sku_id", "prediction").collect())) \
        == sorted(map(str, a.transform(rows).select("sku_id", "prediction").collect()))
    history = op.training_history(a, rows)
    assert len(history) == 3 and history[-1] < history[0]


def test_score(rows):
    scored = rows.withColumn("prediction", F.col("goods_num") + 3)
    assert op.score_table(scored).first().score == pytest.approx(0.25)
    assert 1 / (1 + op.rmse(scored)) == pytest.approx(0.25)


def test_cross_validation_picks_the_better_candidate(history):
    data = op.with_vector(op.horizon_training_set(history, cols=["goods_num"]), 31)
    search = op.tune_linear(data, regs=(50.0, 0.01), folds=4)
    assert len(search.avgMetrics) == 2
    best = min(zip(search.avgMetrics, (50.0, 0.01)))[1]
    assert search.bestModel.getOrDefault("regParam") == best
    assert op.training_history(search.bestModel, data) is not None


def test_predict_under_other_names(rows):
    model = op.linear(rounds=5).fit(rows)
    out = op.predict(model, rows.withColumnRenamed("features2", "f"), "f", "p")
    assert "p" in out.columns and "prediction" not in out.columns


# ---- stages

def test_stage_defaults_and_names(history):
    out = op.TrailingSums(cols=["goods_num"], timeCol="weekNum2", idCol="sku_id",
                          targetTime=33).transform(history)
    assert out.columns == ["id", "features"] and out.first().features.size == 31
    short = (op.TrailingSums().setCols(["goods_num"]).setTimeCol("weekNum2").setIdCol("sku_id")
             .setTargetTime(33).setStatisticTime(4).setOutputIdCol("sku"))
    assert short.transform(history).first().features.size == 5


def test_stages_agree_with_the_operators(history):
    stage = op.WeekMatrix(cols=["goods_num"]).transform(history)
    got = {r.sku_id: list(r.features) for r in stage.collect()}
    assert got == {r.sku_id: r.features for r in op.sales_matrix(history).collect()}
    keyed = op.WeekMatrix(cols=["goods_num"], keyedBy="value").transform(history)
    got = {r.sku_id: list(r.features) for r in keyed.collect()}
    assert got == {r.sku_id: r.features for r in op.value_keyed_matrix(history).collect()}


def test_stages_can_be_saved_and_stand_in_a_pipeline(history, tmp_path):
    stage = op.TrailingSums(cols=["goods_num"], timeCol="weekNum2", idCol="sku_id", targetTime=30,
                            statisticTime=5)
    stage.write().overwrite().save(str(tmp_path / "stage"))
    loaded = op.TrailingSums.load(str(tmp_path / "stage"))
    assert sorted(map(str, loaded.transform(history).collect())) == sorted(
        map(str, stage.transform(history).collect()))
    copied = stage.copy({stage.targetTime: 20})
    assert copied.getOrDefault("targetTime") == 20 and stage.getOrDefault("targetTime") == 30
    model = Pipeline(stages=[stage]).fit(history)
    model.write().overwrite().save(str(tmp_path / "fitted"))
    assert PipelineModel.load(str(tmp_path / "fitted")).transform(history).count() == 40


# ---- forecasts

def test_forecast_against_scoring_row_by_row(spark, history, rows):
    model = op.linear(rounds=10).fit(rows)
    matrix = op.sales_matrix(history)
    template = spark.createDataFrame([("s1", "0"), ("s2", "0"), ("never", "0"), ("s1", "0")],
                                     "sku_id string, week1 string")
    out = op.forecast_weeks(template, matrix, model, op.matrix_width(1))
    assert out.columns == ["sku_id"] + [f"week{k}" for k in range(1, 6)] + ["has_history"]
    known = {r.sku_id: r.features for r in matrix.collect()}
    got = out.collect()
    assert sorted(r.sku_id for r in got) == ["never", "s1", "s1", "s2"]
    for r in got:
        assert r.has_history == (r.sku_id in known)
        for k in range(1, 6):
            x = Vectors.dense([*known.get(r.sku_id, [0.0] * 55), 61.0 + k])
            assert r[f"week{k}"] == int(model.predict(x) + 0.5)
    assert len({r.week1 - r.week5 for r in got}) >= 1


def test_forecast_weeks_differ_by_horizon(spark, history, rows):
    model = op.linear(reg=0.0).fit(rows)
    model_shift = model.coefficients[55] * 4
    template = spark.createDataFrame([("s1", "0"), ("s1", "2")], "sku_id string, week1 string")
    a, b = sorted(op.forecast_weeks(template, op.sales_matrix(history), model, 55).collect(),
                  key=lambda r: r.week1 * (1 if model_shift > 0 else -1))
    assert abs((a.week5 - a.week1) - model_shift) <= 1
    # an offset of two weeks in the template moves all targets by two weeks
    assert [b.week1, b.week2, b.week3] == [a.week3, a.week4, a.week5]


def test_year_over_year_forecast_and_coverage(spark):
    weeks = spark.createDataFrame([
        (52, "g1", "a", 1.0), (51, "g1", "a", 2.0), (48, "g1", "a", 3.0), (52, "g1", "b", 4.0),
        (52, "g2", "b", 6.0), (7, "g1", "c", 9.0)],
        "weekNum int, goods_id string, sku_id string, goods_num double")
    train = op.assemble(spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)],
                                              "goods_num double, label double"), ["goods_num"])
    model = op.linear("features", "label", reg=0.0).fit(train)
    template = spark.createDataFrame([("a",), ("b",), ("c",)], "sku_id string")
    out = op.forecast_year_over_year(weeks, template, model)
    got = {r.sku_id: [None if v is None else round(v, 6) for v in r[1:]] for r in out.collect()}
    assert got == {"a": [10.0, 20.0, None, None, 30.0], "b": [50.0] + [None] * 4, "c": [None] * 5}
    assert op.forecast_coverage(out).first().asDict() == {"missing": 1, "matched": 2}


def test_forecast_grid(spark):
    template = spark.createDataFrame([("a", "0"), ("b", "0")], "sku_id string, week1 string")
    known = spark.createDataFrame([("a",)], "sku_id string")
    got = op.forecast_grid(template, known).orderBy("sku_id", "horizon").collect()
    assert [(r.horizon, r.weekNum) for r in got[:5]] == [(k, 61 + k) for k in range(1, 6)]
    assert [r.has_history for r in got] == [True] * 5 + [False] * 5


def test_vectors_survive_parquet(spark, history, tmp_path):
    path = str(tmp_path / "matrix")
    op.with_vector(op.sales_matrix(history), 55).write.parquet(path)
    back = spark.read.parquet(path).select("sku_id", vector_to_array("features").alias("f"))
    assert {r.sku_id: r.f for r in back.collect()} == {
        r.sku_id: r.features for r in op.sales_matrix(history).collect()}
