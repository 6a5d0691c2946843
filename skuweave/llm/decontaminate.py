"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_key, free_name, whole

#: A token for matching: letters and digits, in lower case; punctuation doesn't count.
TOKEN = r"[\p{L}\p{N}]+"

#: Positions that a mask looks at. Every stretch of 13 tokens with at most two
#: substitutions leaves one of the two masks whole at one offset (a test tries all).
MASKS = ((0, 1, 3, 6, 7, 8), (0, 1, 2, 5, 6, 8))
WINDOW, LEAST_EQUAL = 13, 11

#: Seeds and items are broadcast up to this many bytes; beyond, they are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0),
                       lambda w: F.xxhash64(w))


def with_seeds(rows: DataFrame) -> DataFrame:
    """Rows with `tokens` become one row per offset and mask: columns `pos` and `seed`.

    Offsets are generated first and seeds are computed from the array they index, so
    that both are part of generated code and the array is not copied. The outer form of
    the generator keeps the optimizer from filtering on the array, which would make it a
    second time.
    """
    span = max(max(mask) for mask in MASKS) + 1
    seeds = F.array(*[
        F.xxhash64(F.lit(k), *[F.get("tokens", F.col("pos") + p) for p in mask])
        for k, mask in enumerate(MASKS)])
    return (rows.select("*", F.posexplode_outer("tokens").alias("pos", "token")).drop("token")
            .where(F.col("pos") <= F.size("tokens") - span)
            .select("*", F.explode(seeds).alias("seed")))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Overlaps of documents with benchmark items: (key, id, item, doc_from, doc_to, n_equal).

    A document leaks an item when 13 tokens in a row of both, laid side by side, are
    equal in at least 11 places. Tokens at masked positions are hashed at every offset of
    every document and item; where two hashes are equal, the two texts are laid side by
    side as the hit says and compared along the whole item. doc_from and doc_to bound the
    tokens of the windows that are equal enough, n_equal counts equal tokens along the item.

    The benchmark's side is broadcast after its size was counted, or joined by shuffle if
    it exceeds BROADCAST_BYTES. Documents then stay where they are: hashing, probing and
    comparing happen in the task that reads them, and only overlaps are shuffled, to
    drop repetitions.

    NULL and empty texts, and items or documents of fewer than 13 tokens, leak nothing.
    Rows that repeat id and text yield their overlaps once; NULL ids stay. Only the named
    columns are read.
    """
    items = benchmark.select(F.col(item_col).alias("item"),
                             token_hashes(whole(item_text_col)).alias("item_tokens")).where(
        F.size("item_tokens") >= WINDOW).distinct()
    seeds = with_seeds(items.withColumnRenamed("item_tokens", "tokens")).select(
        "seed", F.col("pos").alias("item_pos"), F.col("tokens").alias("item_tokens"), "item")
    length = items.agg(F.sum(F.size("item_tokens") * (F.size("item_tokens") * 8 + 64) * len(MASKS))
                       ).first()[0]
    if (length or 0) <= BROADCAST_BYTES:
        seeds = F.broadcast(seeds)

    rows = docs.select(doc_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"),
                       token_hashes(whole(text_col)).alias("tokens"))
    hits = with_seeds(rows).join(seeds, "seed").select(
        "key", "id", "item", "tokens", "item_tokens",
        (F.col("pos") - F.col("item_pos")).alias("shift"))
    equal = F.transform("item_tokens", lambda t, j: F.when(
        (F.col("shift") + j >= 0) & F.get("tokens", F.col("shift") + j).eqNullSafe(t), 1).otherwise(0))

    def windows(equal: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size("item_tokens") - WINDOW),
                        lambda s: F.aggregate(F.slice(equal, s + 1, WINDOW), F.lit(0),
                                              lambda total, e: total + e) >= LEAST_EQUAL)

    # As a generator the comparison stays above the join and sees its hits only.
    compared = F.transform(F.array(equal), lambda e: F.struct(
        windows(e).alias("windows"),
        F.aggregate(e, F.lit(0), lambda total, x: total + x).alias("n_equal")))
    return (hits.select("key", "id", "item", "shift", F.inline_outer(compared))
            .where(F.size("windows") > 0)
            .select("key", "id", "item",
                    (F.array_min("windows") + F.col("shift")).alias("doc_from"),
                    (F.array_max("windows") + F.col("shift") + WINDOW).alias("doc_to"), "n_equal")
            .distinct())


def leaking_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """One row per document and item it leaks: id, item, overlaps, doc_from, doc_to, n_equal."""
    return (leaks(docs, benchmark, id_col, text_col, item_col, item_text_col)
            .groupBy("key", F.col("id").alias(id_col), F.col("item").alias(item_col))
            .agg(F.count("*").alias("overlaps"), F.min("doc_from").alias("doc_from"),
                 F.max("doc_to").alias("doc_to"), F.max("n_equal").alias("n_equal"))
            .drop("key"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """The documents that leak no item, all their columns."""
    key = free_name(docs, "_leak")
    found = leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).select(
        F.col("key").alias(key)).distinct()
    return docs.join(found, doc_key(id_col, text_col) == found[key], "left_anti")
