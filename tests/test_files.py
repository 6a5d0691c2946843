import csv
import datetime as dt
import random
from pathlib import Path

import pytest

from skuweave.functions import ANCHOR
from skuweave.plans.cli import main
from skuweave.session import (Scratch, checkpoint_root, ensure_checkpoint_dir,
                              initial_shuffle_partitions, scratch_path, staged)
from skuweave.sources import (RAW_COLUMNS, load_model, read_raw, read_template, read_weeks, write_csv,
                              write_weeks)


def write_rows(path: Path, header, rows):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


@pytest.fixture(scope="module")
def folder(tmp_path_factory) -> Path:
    """Daily CSV files for 55 weeks."""
    root, rng = tmp_path_factory.mktemp("daily"), random.Random(11)
    skus = [(f"g{i % 6}", f"s{i}") for i in range(30)]
    days = [(ANCHOR - dt.timedelta(days=d)).strftime("%Y%m%d") for d in range(43, 428)]
    write_rows(root / "goodsale.csv", RAW_COLUMNS["goodsale"], [
        (rng.choice(days), *rng.choice(skus), rng.randrange(1, 9), rng.randrange(100, 900) / 10,
         99.5) for _ in range(4000)])
    write_rows(root / "goodsdaily.csv", RAW_COLUMNS["goodsdaily"], [
        (d, f"g{g}", *[rng.randrange(20) for _ in range(5)]) for d in days for g in range(5)])
    write_rows(root / "goods_promote_price.csv", RAW_COLUMNS["goods_promote_price"], [
        (d, f"g{g}", 88.5, rng.randrange(500, 880) / 10, d, d) for d in days[::3]
        for g in range(4)])
    write_rows(root / "goods_sku_relation.csv", RAW_COLUMNS["goods_sku_relation"], skus)
    write_rows(root / "submit_example.csv", RAW_COLUMNS["submit_example"],
               [(f"s{i}", 0, 0, 0, 0, 0) for i in range(0, 40, 2)])
    return root


def test_csv_is_read_as_text(spark, folder):
    df = read_raw(spark, f"{folder}/goodsale.csv")
    assert df.columns == list(RAW_COLUMNS["goodsale"])
    assert {t for _, t in df.dtypes} == {"string"}
    named = read_raw(spark, f"{folder}/goodsale.csv", RAW_COLUMNS["goodsale"])
    assert sorted(named.collect()) == sorted(df.collect())
    assert read_template(spark, f"{folder}/submit_example.csv").count() == 20


def test_wrong_column_names_are_noticed(spark, folder):
    df = read_raw(spark, f"{folder}/goodsale.csv", ["a", "b", "c", "d", "e", "f"])
    with pytest.raises(Exception):
        df.collect()


def test_single_file_is_opt_in(spark, tmp_path):
    df = spark.range(100).repartition(4)
    write_csv(df, str(tmp_path / "parts"))
    assert len(list((tmp_path / "parts").glob("*.csv"))) == 4
    write_csv(df, str(tmp_path / "one"), single_file=True)
    files = list((tmp_path / "one").glob("*.csv"))
    assert len(files) == 1 and len(files[0].read_text().splitlines()) == 101
    write_csv(spark.range(100_000).repartition(8), str(tmp_path / "big"), single_file=True)
    (big,) = (tmp_path / "big").glob("*.csv")
    assert len(big.read_text().splitlines()) == 100_001


def test_weeks_are_replaced_one_by_one_and_pruned(spark, tmp_path):
    path = str(tmp_path / "weeks")
    first = spark.createDataFrame([(6, "a"), (7, "b")], "weekNum int, x string")
    write_weeks(first, path)
    write_weeks(spark.createDataFrame([(7, "new"), (8, "c")], "weekNum int, x string"), path)
    got = {(r.weekNum, r.x) for r in read_weeks(spark, path, [6, 7, 8]).collect()}
    assert got == {(6, "a"), (7, "new"), (8, "c")}
    opened = read_weeks(spark, path, [7]).inputFiles()
    assert opened and all("/weekNum=7/" in name for name in opened)


def test_scratch_is_below_the_named_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_root(spark) == shared
    assert scratch_path(spark, "x").startswith(f"{shared}/x-")
    assert f"{shared}/t-" in staged(spark.range(3), "t").inputFiles()[0]
    assert ensure_checkpoint_dir(spark) == shared
    assert shared in spark.sparkContext.getCheckpointDir()


def test_a_cluster_must_name_a_shared_folder():
    """A local warehouse is no place that the executors of a cluster can be relied on to see."""
    def session(master, **conf):
        class Session:
            class conf_:
                get = staticmethod(lambda key, default=None: conf.get(key, default))

            class sparkContext:
                pass

        Session.conf, Session.sparkContext.master = Session.conf_, master
        return Session

    local = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(session("yarn", **local))
    assert checkpoint_root(session("local[4]", **local)) == "file:/tmp/warehouse/scratch"
    shared = {"spark.sql.warehouse.dir": "hdfs://store/warehouse"}
    assert checkpoint_root(session("yarn", **shared)) == "hdfs://store/warehouse/scratch"
    named = {**local, "spark.checkpoint.dir": "hdfs://store/tmp/"}
    assert checkpoint_root(session("yarn", **named)) == "hdfs://store/tmp"


def test_scratch_tables_go_when_the_job_ends(spark):
    with Scratch(spark) as scratch:
        one, two = (scratch.stage(spark.range(3), n) for n in ("a", "b"))
        paths = [Path(p) for p in scratch.paths]
        assert one.count() == two.count() == 3 and all(p.exists() for p in paths)
        scratch.keep_last()
        assert [p.exists() for p in paths] == [False, True]
    assert not any(p.exists() for p in paths)


def test_initial_partitions():
    assert initial_shuffle_partitions(10 << 40) == 81920
    assert initial_shuffle_partitions(1, total_cores=16) == 16


# ---- jobs

@pytest.fixture(scope="module")
def jobs(spark, folder, tmp_path_factory) -> Path:
    """Feature table, week folders and year-over-year rows, made by the command line."""
    out = tmp_path_factory.mktemp("out")
    assert main(["features", str(folder), f"{out}/features"]) == 0
    assert main(["snapshots", str(folder), f"{out}/weeks", "--weeks", "48", "49", "50", "51",
                 "52", "7"]) == 0
    assert main(["yoy-set", str(folder), f"{out}/yoy"]) == 0
    return out


def test_feature_job(spark, jobs):
    table = spark.read.parquet(f"{jobs}/features")
    assert table.agg({"weekNum": "min"}).first()[0] == 6
    assert table.agg({"weekNum": "max"}).first()[0] == 60
    assert table.agg({"goods_num": "sum"}).first()[0] > 0
    weeks = read_weeks(spark, f"{jobs}/weeks", [48, 7])
    same = table.where("weekNum IN (48, 7)").select(*weeks.columns)
    assert sorted(map(str, weeks.collect())) == sorted(map(str, same.collect()))


def test_continued_features(spark, folder, jobs, tmp_path, capsys):
    """Days delivered in two folders, with some days in both, give the features of one run."""
    for name in ("goodsale", "goodsdaily", "goods_promote_price"):
        with open(folder / f"{name}.csv") as f:
            header, *rows = csv.reader(f)
        days = sorted({r[0] for r in rows})
        middle = days[len(days) // 2 + 2]
        for part, keep in (("old", [r for r in rows if r[0] < middle]),
                           ("new", [r for r in rows if r[0] >= days[len(days) // 2]])):
            (tmp_path / part).mkdir(exist_ok=True)
            write_rows(tmp_path / part / f"{name}.csv", header, keep)
    out = f"{tmp_path}/out"
    assert main(["continue", f"{tmp_path}/old", out]) == 0
    assert main(["continue", f"{tmp_path}/new", out]) == 0
    assert main(["continue", f"{tmp_path}/new", out]) == 0
    assert capsys.readouterr().out.splitlines()[-1] == ""  # nothing new in the third run
    got, want = spark.read.parquet(f"{out}/features"), spark.read.parquet(f"{jobs}/features")
    keys = ["weekNum", "goods_id", "sku_id"]
    pairs = got.join(want.select(*keys, *[want[c].alias(f"w_{c}") for c in want.columns
                                          if c not in keys]), keys).collect()
    assert len(pairs) == got.count() == want.count()
    for r in pairs:
        assert all(r[c] == pytest.approx(r[f"w_{c}"]) for c in want.columns if c not in keys)


def test_analysis_job(folder, capsys):
    assert main(["analyse", str(folder)]) == 0
    printed = capsys.readouterr().out
    assert "rows per week" in printed and "number of SKUs" in printed and "30" in printed


def test_training_needs_three_arguments(capsys):
    assert main(["train", "only", "two"]) == -1
    assert "<filePath> <modelSavePath> <numRound>" in capsys.readouterr().err


def test_train_with_masked_target(spark, jobs):
    before = set(Path(checkpoint_root(spark)).glob("rows-*"))
    assert main(["train", f"{jobs}/features", f"{jobs}/model-masked", "2", "--kind", "linear",
                 "--mask-target"]) == 0
    assert set(Path(checkpoint_root(spark)).glob("rows-*")) == before


def test_factorised_job_equals_the_plain_one(spark, jobs, capsys):
    scores, models = [], []
    for name, extra in (("plain", []), ("factorised", ["--factorised"])):
        model = f"{jobs}/model-{name}"
        assert main(["train", f"{jobs}/features", model, "200", "--kind", "linear", *extra]) == 0
        scores.append(float(capsys.readouterr().out.strip().splitlines()[-1]))
        models.append(load_model(model, "linear"))
    assert scores[0] == pytest.approx(scores[1], rel=1e-4)
    assert models[0].intercept == pytest.approx(models[1].intercept, rel=1e-2)
    with pytest.raises(ValueError):
        main(["train", f"{jobs}/features", f"{jobs}/m", "2", "--kind", "gbt", "--factorised"])


def test_boosted_job_with_leaf_term(folder, jobs, capsys):
    model = f"{jobs}/model-boosted"
    assert main(["train", f"{jobs}/features", model, "3", "--leaf-reg", "2", "--patience", "2",
                 "--step", "0.3", "--depth", "3"]) == 0
    assert 0 < float(capsys.readouterr().out.strip().splitlines()[-1]) <= 1
    assert main(["forecast", f"{model}-matrix", f"{folder}/submit_example.csv", model,
                 f"{jobs}/result-boosted", "--kind", "boosted"]) == 0


def test_train_trailing_with_trees(jobs, capsys):
    assert main(["train-trailing", f"{jobs}/features", f"{jobs}/model-trailing-gbt", "--kind", "gbt",
                 "--rounds", "2", "--depth", "2"]) == 0
    out = capsys.readouterr().out
    assert "maxIter" in out and 0 < float(out.strip().splitlines()[-1]) <= 1
    assert load_model(f"{jobs}/model-trailing-gbt", "gbt").getNumTrees == 2


@pytest.mark.parametrize("kind", ["linear", "gbt"])
def test_train_and_forecast(spark, folder, jobs, kind, capsys):
    model = f"{jobs}/model-{kind}"
    assert main(["train", f"{jobs}/features", model, "3", "--kind", kind]) == 0
    assert 0 < float(capsys.readouterr().out.strip().splitlines()[-1]) <= 1
    assert main(["forecast", f"{model}-matrix", f"{folder}/submit_example.csv", model,
                 f"{jobs}/result-{kind}", "--kind", kind, "--single-file"]) == 0
    files = list(Path(f"{jobs}/result-{kind}").glob("*.csv"))
    assert len(files) == 1
    with open(files[0]) as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == list(RAW_COLUMNS["submit_example"])
    assert sorted(r["sku_id"] for r in rows) == sorted(f"s{i}" for i in range(0, 40, 2))
    assert all(int(r[f"week{k}"]) == float(r[f"week{k}"]) for r in rows for k in range(1, 6))


def test_train_trailing_and_sales(folder, jobs, capsys):
    assert main(["train-trailing", f"{jobs}/features", f"{jobs}/model-trailing"]) == 0
    assert "regParam" in capsys.readouterr().out
    model = f"{jobs}/model-sales"
    assert main(["train-sales", f"{jobs}/features", model, "--rounds", "1"]) == 0
    assert main(["forecast", f"{model}-matrix", f"{folder}/submit_example.csv", model,
                 f"{jobs}/result-sales", "--sales-only"]) == 0


def test_year_over_year_jobs(spark, folder, jobs, capsys):
    assert main(["train-yoy", f"{jobs}/yoy", f"{jobs}/model-yoy", "--rounds", "2"]) == 0
    assert main(["forecast-yoy", f"{jobs}/weeks", f"{folder}/submit_example.csv",
                 f"{jobs}/model-yoy", f"{jobs}/result-yoy"]) == 0
    assert "matched" in capsys.readouterr().out
    written = read_raw(spark, f"{jobs}/result-yoy").collect()
    assert sorted(r.sku_id for r in written) == sorted(f"s{i}" for i in range(0, 40, 2))
    sold = {r.sku_id for r in read_weeks(spark, f"{jobs}/weeks", [52]).collect()}
    assert {r.sku_id for r in written if r.week1 is not None} == {
        s for s in sold if int(s[1:]) % 2 == 0}
