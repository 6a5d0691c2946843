import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from skuweave import operators as op
from skuweave.functions import with_reverse_week
from skuweave.sources import FEATURE_COLUMNS, FEATURE_TABLE_COLUMNS, check_feature_table

SALES = "data_date string, goods_id string, sku_id string, goods_num string, goods_price string, " \
        "orginal_shop_price string"
PROMO = "data_date string, goods_id string, shop_price string, promote_price string, " \
        "promote_start_time string, promote_end_time string"
DAILY = "data_date string, goods_id string, goods_click string, cart_click string, " \
        "favorites_click string, sales_uv string, onsale_days string"
HISTORY = "sku_id string, goods_id string, weekNum2 int, goods_num double"


@pytest.fixture(scope="module")
def daily_tables(spark):
    sales = spark.createDataFrame([
        ("20180319", "g1", "s1", "2", "10.0", "12"), ("20180318", "g1", "s1", "3", "20.0", "12"),
        ("20180311", "g1", "s1", "1", "10.0", "12"), ("20180319", "g2", "s2", "x", "7.5", "8"),
        ("20180230", "g1", "s1", "9", "1.0", "1")], SALES)
    promo = spark.createDataFrame([
        ("20180319", "g1", "11.5", "9.5", "a", "b"), ("20180318", "g1", "12.5", "bad", "a", "b")],
        PROMO)
    daily = spark.createDataFrame([
        ("20180319", "g1", "10", "1", "0", "2", "3"), ("20180318", "g1", "5.9", "2", "0", "2", "4"),
        ("20180319", "g2", "7", "1", "1", "1", "1")], DAILY)
    return sales, op.typed_prices(promo), op.typed_traffic(daily)


def rows_by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_typed_projection_defaults_to_int(spark):
    df = spark.createDataFrame([("a", "1.5", "2.5")], "k string, d string, i string")
    out = op.typed_projection(df, keep=["k"], doubles=["d"])
    assert out.dtypes == [("k", "string"), ("d", "double"), ("i", "int")]
    assert out.first() == ("a", 1.5, 2)


def test_feature_table_by_hand(daily_tables):
    table = op.build_feature_table(*daily_tables)
    assert table.columns == list(FEATURE_TABLE_COLUMNS)
    rows = rows_by(table, "weekNum", "goods_id", "sku_id")
    assert len(rows) == 4
    full = rows[6, "g1", "s1"]
    assert (full.goods_num, full.goods_price, full.orginal_shop_price) == (5.0, 15.0, 12.0)
    assert (full.shop_price, full.promote_price) == (12.0, 9.5)
    # the daily counts are whole numbers: 5.9 is read as 5
    assert (full.goods_click, full.cart_click, full.onsale_days) == (7.5, 1.5, 3.5)
    bare = rows[7, "g1", "s1"]
    assert [bare[c] for c in FEATURE_COLUMNS] == [1.0, 10.0, 12.0] + [0.0] * 7
    assert rows[6, "g2", "s2"].goods_num == 0.0 and rows[6, "g2", "s2"].goods_click == 7.0
    # an unreadable date has no week; it must not become week 0
    assert (None, "g1", "s1") in rows


def test_feature_table_of_some_weeks_is_the_filtered_table(daily_tables):
    whole = op.build_feature_table(*daily_tables).where("weekNum IN (6, 7)")
    some = op.build_feature_table(*daily_tables, weeks=[7, 6])
    assert sorted(whole.collect()) == sorted(some.collect())
    assert len(some.collect()) == 3


def test_snapshot_forms(daily_tables):
    filled = op.week_snapshot(*daily_tables, week=7)
    assert "weekNum" not in filled.columns and filled.first().shop_price == 0.0
    raw = op.week_snapshot(*daily_tables, week=7, fill=False)
    assert raw.first().weekNum == 7 and raw.first().shop_price is None


@pytest.mark.parametrize("spread", [1, 5])
def test_spread_does_not_change_the_join(daily_tables, spread):
    plain = op.build_feature_table(*daily_tables)
    assert sorted(map(str, op.build_feature_table(*daily_tables, spread=spread).collect())) \
        == sorted(map(str, plain.collect()))


def test_feature_table_check(spark):
    with pytest.raises(ValueError, match="missing: sku_id"):
        check_feature_table(spark.range(1))


def test_submitted_weeks_counts_listed_skus_as_often_as_listed(spark, daily_tables):
    template = spark.createDataFrame([("s1",), ("s1",), ("s9",)], "sku_id string")
    sales = daily_tables[0].where("data_date <> '20180230'")
    units = op.submitted_units_per_week(sales, template).collect()
    assert [tuple(r) for r in units] == [(7, 2.0), (6, 10.0)]
    skus = op.submitted_skus_per_week(sales, template).collect()
    assert [tuple(r) for r in skus] == [(7, 2), (6, 2)]


def test_counts(spark):
    df = spark.createDataFrame([("g1", "s1"), ("g1", None), ("g2", "s1")],
                               "goods_id string, sku_id string")
    assert op.group_count(df, "sku_id").first() == (2,)
    assert dict(op.fan_out(df).collect()) == {"g1": 2, "g2": 1}
    assert op.row_count(df).first() == (3,)


def test_preview_is_a_top_n(spark):
    df = spark.range(1000).withColumn("x", -F.col("id"))
    assert [r.id for r in op.preview(df, "x", n=3).collect()] == [999, 998, 997]


def test_stack_sets_keeps_duplicates_and_matches_names(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(2, 1)], "y int, x int")
    assert [tuple(r) for r in op.stack_sets(a, b).collect()] == [(1, 2), (1, 2)]


def test_year_over_year_label_is_per_sku(spark):
    table = spark.createDataFrame([
        (60, "g1", "s1", 1.0), (60, "g2", "s1", 2.0), (59, "g1", "s1", 3.0), (60, "g1", "s2", 4.0),
        (7, "g1", "s1", 10.0), (7, "g3", "s1", 5.0), (6, "g1", "s2", 8.0)],
        "weekNum int, goods_id string, sku_id string, goods_num double")
    got = {(r.sku_id, r.goods_id, r.goods_num): r.label
           for r in op.year_over_year(table).collect()}
    assert got == {("s1", "g1", 1.0): 15.0, ("s1", "g2", 2.0): 15.0, ("s1", "g1", 3.0): 0.0,
                   ("s2", "g1", 4.0): 0.0}


# ---- matrices

def test_matrix_layout(spark):
    row = {c: float(i) for i, c in enumerate(FEATURE_COLUMNS, start=1)}
    df = spark.createDataFrame([("s1", 2, *row.values())], "sku_id string, weekNum2 int, " + ", ".join(
        f"{c} double" for c in FEATURE_COLUMNS))
    features = op.week_matrix(df).first().features
    assert len(features) == 605
    assert features[11:22] == [2.0] + [float(i) for i in range(1, 11)]
    assert set(features[:11] + features[22:]) == {0.0}


@pytest.mark.parametrize("duplicates,expected", [("last_goods", 7.0), ("sum", 9.0)])
def test_duplicate_weeks(spark, duplicates, expected):
    df = spark.createDataFrame([("s1", "g1", 5, 2.0), ("s1", "g2", 5, 7.0)], HISTORY)
    assert op.sales_matrix(df, duplicates=duplicates).first().features[4] == expected


def test_duplicates_can_be_refused(spark):
    unique = spark.createDataFrame([("s1", "g1", 5, 2.0), ("s1", "g2", 6, 7.0)], HISTORY)
    assert op.sales_matrix(unique, duplicates="error").first().features[4:6] == [2.0, 7.0]
    twice = spark.createDataFrame([("s1", "g1", 5, 2.0), ("s1", "g2", 5, 7.0)], HISTORY)
    sums = ["goods_num"], "weekNum2", "sku_id"
    for refused in (op.sales_matrix(twice, duplicates="error"),
                    op.trailing_sums(twice, *sums, 5, duplicates="error"),
                    op.trailing_sums_all_targets(twice, *sums, duplicates="error")):
        with pytest.raises(Exception, match="duplicate row of s1 in slot 5"):
            refused.collect()


def test_null_and_text_measures(spark):
    df = spark.createDataFrame([("1", "s1", "3", "2.5"), ("2", "s1", "4", None)],
                               "goods_id string, sku_id string, weekNum2 string, goods_num string")
    sums = op.trailing_sums(df, ["goods_num"], "weekNum2", "sku_id", 4, last_lag=2)
    assert sums.first().features == [0.0, 2.5, 2.5]
    for refused in (op.trailing_sums(df, ["goods_num"], "weekNum2", "sku_id", 4, nulls="error"),
                    op.sales_matrix(df, nulls="error")):
        with pytest.raises(Exception, match="goods_num is NULL"):
            refused.collect()
    bad = df.withColumn("goods_num", F.lit("many"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        op.sales_matrix(bad).collect()


def test_value_keyed(spark):
    df = spark.createDataFrame([("s1", "g", 1, 3.0), ("s1", "g", 2, 3.5), ("s1", "g", 3, 60.0),
                                ("s2", "g", 1, 0.2)], HISTORY)
    got = {r.sku_id: r.features for r in op.sales_matrix(df, keyed_by="value").collect()}
    assert got["s1"] == [0.0, 0.0, 3.5] + [0.0] * 52
    assert got["s2"] == [0.0] * 55


def test_mask_block(spark):
    df = spark.createDataFrame([(1,), (3,), (4,), (0,)], "w int").withColumn(
        "f", F.array(*[F.lit(float(i)) for i in range(1, 7)]))
    got = {r.w: r.m for r in df.select("w", op.mask_block(F.col("f"), F.col("w"), 2).alias("m"))
           .collect()}
    assert got == {1: [0, 0, 3, 4, 5, 6], 3: [1, 2, 3, 4, 0, 0], 4: [1, 2, 3, 4, 5, 6],
                   0: [1, 2, 3, 4, 5, 6]}


def test_trailing_sums_by_hand(spark):
    df = spark.createDataFrame([("s1", "g", 5, 2.0), ("s1", "g", 4, 3.0), ("s1", "g", 2, 10.0),
                                ("s2", "g", 9, 1.0)], HISTORY)
    out = {r.id: r.features for r in op.trailing_sums(df, ["goods_num"], "weekNum2", "sku_id", 5,
                                                      last_lag=3).collect()}
    assert out == {"s1": [2.0, 5.0, 5.0, 15.0], "s2": [0.0] * 4}


# ---- against plain Python, on random rows with many goods per SKU

@pytest.fixture(scope="module")
def random_history(spark):
    rng = random.Random(7)
    rows = {}
    for _ in range(3000):
        sku = "hot" if rng.random() < 0.4 else f"s{rng.randrange(60)}"
        rows[sku, f"g{rng.randrange(40):02d}", rng.randrange(-5, 70)] = (
            float(rng.randrange(0, 80)), rng.randrange(1, 9999) / 100)
    rows = [(*k, *v) for k, v in rows.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, HISTORY + ", goods_price double").repartition(6)
    return rows, df.cache()


def last_goods(rows):
    best = {}
    for sku, goods, week, units, price in sorted(rows, key=lambda r: r[1]):
        best[sku, week] = (units, price)
    return best


def test_matrix_against_brute_force(random_history):
    rows, df = random_history
    best, skus = last_goods(rows), {r[0] for r in rows}
    got = {r.sku_id: r.features for r in op.week_matrix(df, ["goods_num", "goods_price"]).collect()}
    assert got == {s: [x for w in range(1, 56) for x in best.get((s, w), (0.0, 0.0))]
                   for s in skus}


def brute_trailing(best, sku, target, last_lag=30):
    units = price = 0.0
    out = []
    for lag in range(last_lag + 1):
        u, p = best.get((sku, target - lag), (0.0, 0.0))
        units, price = units + u, price + p
        out += [units, price]
    return out


@pytest.mark.parametrize("target", [33, 68, 0])
def test_trailing_sums_against_brute_force(random_history, target):
    rows, df = random_history
    best = last_goods(rows)
    got = {r.id: r.features for r in op.trailing_sums(
        df, ["goods_num", "goods_price"], "weekNum2", "sku_id", target).collect()}
    assert got == {s: brute_trailing(best, s, target) for s in {r[0] for r in rows}}


def test_all_targets_against_brute_force(random_history):
    rows, df = random_history
    best = last_goods(rows)
    got = {(r.id, r.target): r.features for r in op.trailing_sums_all_targets(
        df, ["goods_num", "goods_price"], "weekNum2", "sku_id").collect()}
    assert got == {k: brute_trailing(best, *k) for k in best}


def test_trailing_sums_never_fall_and_start_at_the_target_week(random_history):
    rows, df = random_history
    best = last_goods(rows)
    for r in op.trailing_sums(df, ["goods_num"], "weekNum2", "sku_id", 40).collect():
        assert r.features[0] == best.get((r.id, 40), (0.0,))[0]
        assert r.features == sorted(r.features)


def test_matrix_keeps_weekly_totals(random_history):
    rows, df = random_history
    cells = op.matrix_cells(op.sales_matrix(df, duplicates="sum"), ["goods_num"])
    got = dict(cells.groupBy("week").agg(F.sum("v_goods_num")).collect())
    want = defaultdict(float)
    for _, _, week, units, _ in rows:
        want[week] += units
    assert got == {w: want[w] for w in range(1, 56)}


def test_value_keyed_against_brute_force(random_history):
    rows, df = random_history
    best = defaultdict(lambda: [0.0] * 55)
    for sku, goods, week, units, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        slots = best[sku]
        if 1 <= int(units) <= 55:
            slots[int(units) - 1] = units
    got = {r.sku_id: r.features for r in op.value_keyed_matrix(df).collect()}
    assert got == dict(best)


@pytest.mark.parametrize("spread", [1, 4])
def test_target_rows_keep_every_label(random_history, spread):
    rows, df = random_history
    best = last_goods(rows)
    got = op.target_week_rows(df, cols=["goods_num"], spread=spread).collect()
    assert sorted((r.sku_id, r.weekNum2, r.goods_num) for r in got) == sorted(
        (s, w, u) for s, _, w, u, _ in rows)
    for r in got:
        assert r.features == [best.get((r.sku_id, w), (0.0,))[0] for w in range(1, 56)]


def test_masked_target_rows_hide_the_label(random_history):
    _, df = random_history
    for r in op.target_week_rows(df, cols=["goods_num"], mask_target=True).collect():
        if 1 <= r.weekNum2 <= 55:
            assert r.features[r.weekNum2 - 1] == 0.0


def test_horizon_set(random_history):
    rows, df = random_history
    units = defaultdict(float)
    for sku, _, week, n, _ in rows:
        if week == 40:
            units[sku] += n
    got = op.horizon_training_set(df).collect()
    assert {r.id: r.goods_num for r in got} == {s: units[s] for s in {r[0] for r in rows}}
    assert len(got[0].features) == 62


def test_reverse_week_drops_what_it_replaces(daily_tables):
    out = with_reverse_week(op.build_feature_table(*daily_tables))
    assert "weekNum" not in out.columns and "goods_id" not in out.columns


@pytest.mark.parametrize("duplicates", ["last_goods", "sum"])
def test_label_and_lags_from_one_grouping(spark, duplicates):
    rows = [("s1", "g1", 33, 2.0), ("s1", "g2", 33, 3.0), ("s1", "g1", 30, 5.0), ("s1", "g1", 40, 7.0),
            ("s1", "g2", 40, 8.0), ("s2", "g1", 36, 4.0), ("s3", "g1", 40, None), ("s4", "g1", 2, 9.0)]
    df = spark.createDataFrame(rows, HISTORY)
    got = {r.id: r for r in op.horizon_training_set(df, cols=["goods_num"],
                                                    duplicates=duplicates).collect()}
    assert {k: r.goods_num for k, r in got.items()} == {"s1": 15.0, "s2": 0.0, "s3": 0.0, "s4": 0.0}
    week = 5.0 if duplicates == "sum" else 3.0
    assert got["s1"].features[:4] == [week, week, week, week + 5.0]
    assert all(sum(got[k].features) == 0 for k in ("s2", "s3", "s4"))
    plan = plan_of(op.horizon_training_set(df, cols=["goods_num"]))
    assert "Join" not in plan and plan.count("Scan") == 1
    with pytest.raises(ValueError, match="after the features"):
        op.horizon_training_set(df, cols=["goods_num"], horizon=0)


def test_the_slots_of_an_id_become_a_map_once(spark):
    """Not once per week, inside the lambda over the weeks."""
    df = spark.createDataFrame([("a", "g", 3, 2.0), ("a", "g", 5, 1.0)], HISTORY)
    for table, features in ((op.sales_matrix(df, weeks=5), [0, 0, 2, 0, 1]),
                            (op.trailing_sums(df, ["goods_num"], "weekNum2", "sku_id", 5, 3),
                             [1, 1, 3, 3])):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "element_at(map_from_entries" not in plan
        assert [list(r.features) for r in table.collect()] == [features]
