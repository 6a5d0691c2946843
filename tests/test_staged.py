from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from skuweave import operators as op
from skuweave import session as sess
from skuweave.operators.learn import sized


def wide(spark, rows, width):
    vector = array_to_vector(F.array_repeat(F.lit(1.0), width))
    return spark.range(rows, numPartitions=1).select(
        F.col("id").cast("string").alias("sku_id"), sized(vector, "features", width))


def rows_of_tasks(df):
    return [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_rows_of_a_staged_table_are_dealt_by_their_size_in_memory(spark, monkeypatch):
    """Equal vectors take no room on disk; they all came to one task."""
    monkeypatch.setattr(sess, "FILE_BYTES", 1 << 20)
    df = wide(spark, 20_000, 56)
    stored = sess.staged(df, "wide")
    assert len(stored.inputFiles()) > 8
    assert stored.count() == 20_000
    assert max(rows_of_tasks(stored)) <= 20_000 // 4
    with sess.Scratch(spark) as scratch:
        assert len(scratch.stage(df, "wide").inputFiles()) > 8


def test_wider_rows_make_shorter_files(spark):
    narrow, broad = (sess.rows_per_file(wide(spark, 1, width).schema) for width in (2, 605))
    assert 100 * broad < 16 * narrow
    assert broad * 605 * 8 < sess.FILE_BYTES


def test_held_rows_are_marked_in_one_reading(spark):
    df = spark.range(500).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("k"), "id")
    train, test = op.hash_split(df, ["k", "id"])
    marked = op.mark_held(df, ["k", "id"])
    assert "Union" not in marked._jdf.queryExecution().optimizedPlan().toString()
    for held, side in ((False, train), (True, test)):
        assert sorted(r.id for r in marked.where(F.col("held") == held).collect()) == sorted(
            r.id for r in side.collect())
    assert marked.where("held IS NULL").isEmpty()
