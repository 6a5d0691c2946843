"""Exact deduplication by content hash, with a comparison of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, lower_ascii, whole


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     keep: str = "smallest", fold_case: bool = True) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by a 128-bit hash and, inside it, by their bytes, so texts that
    only share the hash stay apart. The row with the smallest (or largest) id stays.

    The grouping combines equal texts before its shuffle: a text that a third of all
    rows hold sends one row per task. The way back is a join of narrow rows on two
    hashes, which AQE splits at a hot key; no text moves twice and no list of a
    group's rows is built.

    A NULL text counts as empty, and all empty texts are one group. NULL ids never
    stay while the group has another id; in a group of NULL ids only, all stay. Rows
    that repeat id and text are one document and get the same flags, and each counts
    in group_size. Only the two named columns are read.
    """
    text = whole(text_col)
    rows = docs.select(F.col(id_col).alias("id"),
                       (lower_ascii(text) if fold_case else text).alias("body"))
    best = {"smallest": F.min, "largest": F.max}[keep]
    groups = (rows.groupBy(F.unhex(F.md5("body")).alias("h"), "body")
              .agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
              .select("h", F.sha2("body", 256).alias("sha"), "keep_id", "group_size"))
    narrow = rows.select("id", F.unhex(F.md5("body")).alias("h"), F.sha2("body", 256).alias("sha"))
    return narrow.join(groups, ["h", "sha"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          keep: str = "smallest", fold_case: bool = True) -> DataFrame:
    """The documents that stay, all their columns."""
    stays, digest = free_name(docs, "_stay"), free_name(docs, "_sha")
    kept = exact_duplicates(docs, id_col, text_col, keep, fold_case).where("kept").select(
        F.col(id_col).alias(stays), F.col("text_sha256").alias(f"{digest}_kept")).distinct()
    text = whole(text_col)
    rows = docs.withColumn(digest, F.sha2(lower_ascii(text) if fold_case else text, 256))
    return rows.join(kept, rows[id_col].eqNullSafe(kept[stays])
                     & (rows[digest] == kept[f"{digest}_kept"]), "left_semi").drop(digest)
