"""Mixing sources to target weights by thresholds on a hash of the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stage, whole, word_count

#: The hash has 60 bits; every level of the histogram looks at ten more of them.
HASH_BITS, LEVEL_BITS = 60, 10


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1),
                   share_percent: int = 150, cap: int = 2) -> DataFrame:
    """Target size of every source, from (source, source_size).

    Sources in order of code points, NULL last, take the weights in turn and share
    `share_percent` of all sizes. No target exceeds `cap` times its source's size;
    what is cut off goes to the others by weight. That sharing ends at the level
    where the sources below their cap have one ratio of target to weight, so the
    sources are sorted once by cap to weight and the first level that the next
    source's cap does not cut is taken.

    The table has one row per source, a summary of the documents: only these rows,
    never documents, meet in one task.
    """
    total = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "place")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (sizes.withColumn("place", F.row_number().over(by_name) - 1)
              .withColumn("weight", weight.cast("long"))
              .withColumn("most", F.lit(cap) * F.col("source_size"))
              .withColumn("ratio", F.col("most") / F.col("weight"))
              .withColumn("pot", F.sum("source_size").over(total) * F.lit(share_percent / 100)))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.col("pot") - F.coalesce(F.sum("most").over(before), F.lit(0)))
             / F.sum("weight").over(onward))
    ranked = ranked.withColumn("level", level)
    # The first row whose own cap is not reached sets the level for itself and all later ones.
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    ranked = ranked.withColumn("final", F.first(fits, ignorenulls=True).over(total_by(by_cap)))
    target = F.least(F.col("most").cast("double"),
                     F.coalesce(F.col("final") * F.col("weight"), F.col("most").cast("double")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def total_by(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def hash_of_id(id_col: str):
    """60 bits of md5 of the id as text; any engine computes the same number."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, h) of every document."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(whole(text_col)).alias("size"), hash_of_id(id_col).alias("h"))


def plan_of(rows: DataFrame, weights: tuple[int, ...], share_percent: int, cap: int) -> DataFrame:
    """One row per source: s, source_size, target, base copies, threshold of the hash.

    The threshold is found without sorting documents: words are summed by source and the
    first ten bits of the hash, the bucket where the running sum passes the budget is cut
    by the next ten bits, and so on to the last bit. Each level groups only the documents
    in the bucket that the level before has left, and a histogram has at most 1,024 rows
    per source. Of the two sums around the budget the nearer is taken.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, share_percent, cap).withColumn(
        "base", F.when(F.col("source_size") > 0, F.least(
            F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    ).withColumn("budget", F.greatest(F.col("target") - F.col("base") * F.col("source_size"),
                                      F.lit(0.0))), "mix-targets")

    # Per source: the hash bits decided so far, the words below them, the budget.
    open_ = targets.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("head"),
                           F.lit(0).cast("long").alias("below"), "budget")
    same = F.col("source").eqNullSafe(F.col("s"))
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        here = F.shiftright("h", shift + LEVEL_BITS) == F.col("head")
        inside = rows.join(open_.select("s", "head"), same & here, "left_semi") if level else rows
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("bits")).agg(
            F.sum("size").alias("words")).join(open_.select("s", "below", "budget"), same).select(
            "s", F.col("bits").alias("head"), "words", "below", "budget")
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("head"))
        hist = hist.withColumn("upto", F.col("below") + upto)
        # The bucket in which the running sum reaches the budget.
        edge = hist.where((F.col("upto") >= F.col("budget"))
                          & (F.col("upto") - F.col("words") < F.col("budget")))
        open_ = stage(edge.select("s", "head", (F.col("upto") - F.col("words")).alias("below"),
                                  "budget", "upto"), f"mix-level{level}")
    nearer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("below")
    threshold = open_.select("s", F.when(nearer, F.col("head")).otherwise(
        F.col("head") - 1).alias("threshold"))
    return targets.join(threshold, same, "left").select(
        F.col("source").alias("s"), "source_size", "target", "base",
        F.coalesce("threshold", F.lit(-1)).alias("threshold"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1),
            share_percent: int = 150, cap: int = 2) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies, taken.

    size counts words. A source whose target is r times its size takes every document
    floor(r) times and, of the rest, the documents whose hash lies at or below the
    source's threshold, so the words taken differ from the target by at most half of one
    document (or of the documents that share its hash).

    The choice depends on ids alone: reruns agree, and a smaller target takes a subset.
    NULL texts have size 0, NULL sources are a source, NULL ids share one hash; rows
    with equal ids are taken or left together. Only the three named columns are read.
    """
    rows = stage(sized(docs, id_col, text_col, source_col), "mix-sizes")
    plan = stage(plan_of(rows, weights, share_percent, cap), "mix-plan")
    copies = F.col("base") + (F.col("h") <= F.col("threshold")).cast("long")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").alias(id_col), "size", "source", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1),
        share_percent: int = 150, cap: int = 2) -> DataFrame:
    """The documents that the mixture takes, all columns and `copies`, how often each is taken.

    Texts are not moved: whether a document is taken follows from its own id and its
    source's row of the plan. A column `copies` that the documents have already is replaced.
    """
    source, base, limit = (free_name(docs, f"_mix_{n}") for n in ("source", "base", "threshold"))
    rows = stage(sized(docs, id_col, text_col, source_col), "mix-sizes")
    plan = stage(plan_of(rows, weights, share_percent, cap), "mix-plan").select(
        F.col("s").alias(source), F.col("base").alias(base), F.col("threshold").alias(limit))
    copies = F.col(base) + (hash_of_id(id_col) <= F.col(limit)).cast("long")
    return docs.join(plan, docs[source_col].eqNullSafe(plan[source])).select(
        *[docs[f"`{c}`"] for c in docs.columns if c != "copies"], copies.alias("copies")).where(
        "copies > 0")
