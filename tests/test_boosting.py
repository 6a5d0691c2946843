import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import plan_of
from skuweave import operators as op
from skuweave.session import checkpoint_root


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(600):
        a, b = rng.randrange(12), rng.randrange(9)
        data.append((i, float(a), float(b), 3.0 * (a > 5) + b * b / 9 + rng.random()))
    df = spark.createDataFrame(data, "id int, a double, b double, y double").repartition(4)
    return op.assemble(df, ["a", "b"]).cache()


def stumps(data, rounds, step, leaf_reg, base, held=lambda r: False):
    """Every split of every input, tried one by one."""
    made = {r[0]: base for r in data}
    train = [r for r in data if not held(r)]
    errors = []
    for _ in range(rounds):
        best = None
        for f in (1, 2):
            for v in sorted({r[f] for r in train})[:-1]:
                left = [r[3] - made[r[0]] for r in train if r[f] <= v]
                right = [r[3] - made[r[0]] for r in train if r[f] > v]
                gain = sum(left) ** 2 / len(left) + sum(right) ** 2 / len(right)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, v, sum(left) / (len(left) + leaf_reg),
                            sum(right) / (len(right) + leaf_reg))
        _, f, v, low, high = best
        for r in data:
            made[r[0]] += step * (low if r[f] <= v else high)
        errors.append([(sum((r[3] - made[r[0]]) ** 2 for r in part) / len(part)) ** 0.5
                       if part else None for part in (train, [r for r in data if held(r)])])
    return made, errors


@pytest.mark.parametrize("leaf_reg", [0.0, 25.0])
def test_ridge_leaves_against_every_split(spark, rows, leaf_reg):
    data = [(r.id, r.a, r.b, r.y) for r in rows.collect()]
    boosting = op.RidgeBoosting(rounds=4, step=0.5, depth=1, leaf_reg=leaf_reg, base=0.5,
                                stage_every=2)
    model = boosting.fit(rows, "features", "y")
    want, errors = stumps(data, 4, 0.5, leaf_reg, 0.5)
    got = {r.id: r.prediction for r in model.transform(rows).collect()}
    assert got == pytest.approx(want)
    assert [h[1] for h in model.history] == pytest.approx([e[0] for e in errors])
    assert model.leaf_table(spark).count() == 8


def test_stopped_by_held_out_error(spark, rows):
    data = [(r.id, r.a, r.b, r.y) for r in rows.collect()]
    held = F.col("id") % 3 == 0
    boosting = op.RidgeBoosting(rounds=8, step=1.9, depth=1, leaf_reg=0.0)
    base = sum(r[3] for r in data if r[0] % 3) / sum(1 for r in data if r[0] % 3)
    _, errors = stumps(data, 8, 1.9, 0.0, base, lambda r: r[0] % 3 == 0)
    full = boosting.fit(rows, "features", "y", held)
    table = full.history_table(spark).orderBy("round").collect()
    assert [(r.train_rmse, r.valid_rmse) for r in table] == [pytest.approx(tuple(e)) for e in errors]
    best = min(range(8), key=lambda k: errors[k][1])
    model = op.early_stop(rows, boosting, "features", "y", held)
    assert len(model.trees) == best + 1 == full.best_round
    # What is held out is never learnt from.
    spoilt = rows.withColumn("y", F.when(held, 1e6).otherwise(F.col("y")))
    again = boosting.fit(spoilt, "features", "y", held)
    assert [t.values for t in again.trees] == [pytest.approx(t.values) for t in full.trees]
    patient = op.RidgeBoosting(rounds=8, step=1.9, depth=1, leaf_reg=0.0, patience=1)
    assert len(patient.fit(rows, "features", "y", held).trees) <= best + 1


def test_columns_drawn_per_tree_and_save(spark, rows, tmp_path):
    before = set(op_files(spark))
    model = op.RidgeBoosting(rounds=6, depth=2, column_share=0.5).fit(rows, "features", "y")
    assert set(op_files(spark)) == before  # nothing is left of the staged rows
    assert {t.inputs for t in model.trees} == {(0,), (1,)}
    model.save(spark, str(tmp_path / "m"))
    loaded = op.BoostedModel.load(spark, str(tmp_path / "m"))
    assert loaded.history == model.history
    pairs = zip(*[sorted((r.id, r.prediction) for r in m.transform(rows).collect())
                  for m in (model, loaded)])
    assert all(a == b for a, b in pairs)


def op_files(spark):
    from pathlib import Path
    return [p.name for p in Path(checkpoint_root(spark)).glob("boosting-*")]


def test_no_leaf_and_no_rows(spark, rows):
    flat = rows.withColumn("y", F.lit(2.0))
    model = op.RidgeBoosting(rounds=2, depth=3).fit(flat, "features", "y")
    assert {r.prediction for r in model.transform(rows).collect()} == {2.0}
    with pytest.raises(ValueError, match="no rows"):
        op.RidgeBoosting().fit(rows.where("false"), "features", "y")


def test_one_grouping_per_round(spark, rows):
    tree = op.RidgeBoosting(rounds=1, depth=2).fit(rows, "features", "y").trees[0]
    plan = plan_of(tree.add_leaf(rows, "features").groupBy("_leaf").agg(F.sum("y")))
    above = plan[:plan.index("InMemoryTableScan")]
    assert above.count("Exchange") == 1 and "partial_sum" in above


# ---- absent values

def test_bins_by_hand(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 9)] + [(0.0,), (None,), (float("nan"),)],
                               "x double")
    bins = op.AbsentBins.fit(df, ["x"], bins=4)
    assert bins.thresholds["x"] == (2.0, 4.0, 6.0)
    got = bins.transform(df).select("x", vector_to_array("features")[0].alias("b")).collect()
    assert {r.x: r.b for r in got if r.x} == {**{float(v): float((v + 1) // 2) for v in range(1, 9)},
                                              **{r.x: 0.0 for r in got if r.x != r.x}}
    assert all(r.b == 0 for r in got if not r.x)
    kept = op.AbsentBins.fit(df, ["x"], bins=2, absent=None)
    assert kept.bin_of("x") is not None and kept.thresholds["x"] == (4.0,)
    assert op.AbsentBins.fit(df.where("x IS NULL"), ["x"]).thresholds["x"] == ()


@pytest.mark.parametrize("level, side", [(100.0, "right"), (-100.0, "left"), (8.0, "right"),
                                         (0.5, "left")])
def test_absent_values_take_the_side_that_fits(spark, level, side):
    """Small x are low, large x are high; the rows without x go with whom they resemble."""
    rng = random.Random(1)
    data = [(float(x), float(x)) for x in range(1, 10) for _ in range(20)]
    data += [(0.0, level + rng.random() / 10) for _ in range(40)]
    df = spark.createDataFrame(data, "x double, y double")
    bins = op.AbsentBins.fit(df, ["x"], bins=9)
    rows = bins.transform(df)
    model = op.RidgeBoosting(rounds=1, step=1.0, depth=1, leaf_reg=0.0).fit(rows, "features", "y")
    assert dict(op.sides(model.trees[0].model))[0] == side
    low = {k for k, s in op.sides(model.trees[0].model) if s == "left"}
    if abs(level) < 50:  # the known bins are still cut in the order of their values
        known = sorted(low - {0})
        assert known == list(range(1, len(known) + 1)) and known
