"""Helpers that several text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A word: a maximal run of bytes other than space, tab, line feed, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def whole(text: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits that stand for a row: its id and its whole text.

    Rows that repeat both are one document to the operators that use the key, and
    each of the repeated rows gets that document's result.
    """
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")),
                                  F.lit(":"), whole(text_col))))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows kept for measuring: crc32 of the id as text, modulo the folds, is 0 (NULL id: held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all nodes share (`skuweave.session.checkpoint_root`)."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths staged in the blocks of `transient` that are open, innermost last.
_OPEN: list[list[str]] = []


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here.

    Inside a block of `transient` the table goes when the block ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def transient(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged in the block are removed when it ends, but for those that are kept.

    Yields `keep`, for a DataFrame that `stage` has returned. Whatever leaves the block may only
    read kept tables.
    """
    paths: list[str] = []
    _OPEN.append(paths)

    def keep(df: DataFrame) -> DataFrame:
        paths.remove(df.staged_at)
        if len(_OPEN) > 1:
            _OPEN[-2].append(df.staged_at)
        return df

    try:
        yield keep
    finally:
        _OPEN.pop()
        for path in paths:
            remove(spark, path)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name like `name` that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node reached.

    Alternates two star steps: every node joins its neighbours that are greater
    (large star), then those that are smaller (small star), to the smallest node it
    knows. Links are grouped by node with a minimum that is combined before the
    shuffle, and joined, so that a hub is split like any hot join key. Every round
    is written to the shared folder, and goes when the next one is there; the rounds grow
    with the logarithm of the longest chain. Only nodes with a link are returned.
    """
    spark = links.sparkSession
    edges = stage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(),
                  name)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.k).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        first = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = down.join(first, down.u == first.k).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, stage(small.select("e.u", "e.v").where("u <> v").distinct(), name)
        remove(spark, last.staged_at)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
