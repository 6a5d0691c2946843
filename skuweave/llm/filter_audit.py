"""What each filter of a chain removes, for every order in which the chain can run.

A document is reduced once to a mask, one bit per filter that it fails, and documents are
counted per part and mask: at most two to the number of filters cells per part. A recursive
CTE then extends prefixes of the chain by each filter that they don't hold yet, joins the cells
of the part, carries the bits applied so far, and emits the figures of that step. The documents
themselves take no part in the recursion.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, stage, whole, words_of

#: The filter that fails where a smaller id has the same text.
REPEATED = "repeated"
STEP_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def standard_filters(text: str = "text") -> dict[str, Column | str]:
    """Five filters by letter; each condition is true for a document that fails."""
    body, words = whole(text), words_of(whole(text))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(body, F.lit("[A-Z]")) > 10 * F.length(body),
        "D": body.rlike("[#$%&*|]"),
        "E": REPEATED,
    }


def failure_masks(docs: DataFrame, filters: Mapping[str, Column | str], part: str = "lang",
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, part, mask)`, one row per document; bit i of `mask` is set where filter i fails.

    A NULL part is the empty string; a condition that is NULL does not fail. For `REPEATED`,
    texts are compared by SHA-256 over the whole table, and a row fails where its id is greater
    than the smallest id with its text: rows that repeat both id and text all pass or all fail,
    a NULL id never fails and is never the smaller one. Only ids, masks and digests are
    shuffled; the digests that occur twice are written before the join, so that a text held by a
    third of all rows is split like any hot join key.
    """
    plain = [F.when(F.coalesce(condition, F.lit(False)), F.lit(1 << i)).otherwise(0)
             for i, condition in enumerate(filters.values()) if not isinstance(condition, str)]
    same = [1 << i for i, c in enumerate(filters.values()) if isinstance(c, str) and c == REPEATED]
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        reduce(lambda a, b: a.bitwiseOR(b), plain, F.lit(0)).alias("mask"),
        *([F.unhex(F.sha2(whole(text_col), 256)).alias("digest")] if same else []))
    if not same:
        return rows
    rows = stage(rows, "audit-rows")
    first = stage(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
                  .where("n > 1").select("digest", "first"), "audit-firsts")
    bit = F.when(F.col("id") > F.col("first"), F.lit(sum(same))).otherwise(0)
    return rows.join(first, "digest", "left").select(
        "id", "part", F.col("mask").bitwiseOR(bit).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`(part, cells array<struct<mask, docs, good, toxic>>)`, sorted by mask.

    A document is good where any of its label rows has quality 1, toxic where any has toxic 1.
    There are at most two to the number of filters cells in a part, so the array is bounded.
    """
    marked = stage(labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
        .where("id IS NOT NULL AND (good OR toxic)"), "audit-labels")
    counted = masks.join(marked, "id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("docs"), F.count_if(F.col("good")).alias("good"),
        F.count_if(F.col("toxic")).alias("toxic"))
    cell = F.struct("mask", "docs", "good", "toxic")
    return counted.groupBy("part").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def _recursion(letters: str) -> str:
    """The recursive CTE over `{cells}`: one row per part and prefix of any order."""
    def total(measure: str, where: str) -> str:
        return f"aggregate(c.cells, 0L, (n, x) -> n + if({where}, x.{measure}, 0L))"

    bit = "shiftleft(1, l.i)"
    here = f"x.mask & s.applied = 0 AND x.mask & {bit} <> 0"
    counts = [total("docs", f"x.mask & (s.applied | {bit}) = 0"), total("docs", here),
              total("docs", f"x.mask & s.applied <> 0 AND x.mask & {bit} <> 0"),
              total("docs", f"x.mask = {bit}"), total("good", here), total("toxic", here)]
    return f"""
WITH RECURSIVE steps(part, prefix, applied, step, {", ".join(STEP_COUNTS)}) AS (
  SELECT part, '', 0, 0, {", ".join(["0L"] * len(counts))} FROM {{cells}}
  UNION ALL
  SELECT s.part, concat(s.prefix, substr('{letters}', l.i + 1, 1)), s.applied | {bit}, s.step + 1,
         {", ".join(counts)}
  FROM steps s JOIN {{cells}} c ON c.part = s.part
  LATERAL VIEW explode(filter(sequence(0, {len(letters) - 1}),
                              i -> s.applied & shiftleft(1, i) = 0)) l AS i
  WHERE s.step < {len(letters)})
SELECT part, prefix, step, {", ".join(STEP_COUNTS)} FROM steps WHERE step > 0"""


def prefix_steps(cells: DataFrame, letters: str) -> DataFrame:
    """The figures of every prefix of every order: `(part, prefix, step, kept, removed, ...)`.

    A part has sum(n! / (n - k)!) prefixes, 325 for five filters. Spark bounds the rows of one
    recursion (`spark.sql.cteRecursionRowLimit`) and fails beyond; the parts are dealt to as
    many recursions as that bound asks for.
    """
    if not 0 < len(set(letters)) == len(letters):
        raise ValueError("each filter needs a letter of its own")
    spark: SparkSession = cells.sparkSession
    cells = stage(cells, "audit-cells")
    per_part = sum(math.perm(len(letters), k) for k in range(len(letters) + 1))
    limit = int(spark.conf.get("spark.sql.cteRecursionRowLimit"))
    blocks = 1 if limit <= 0 else -(-cells.count() * per_part * 2 // limit) or 1
    dealt = [cells] if blocks == 1 else [
        cells.where(F.pmod(F.xxhash64("part"), F.lit(blocks)) == k) for k in range(blocks)]
    return stage(reduce(DataFrame.union, [spark.sql(_recursion(letters), cells=c) for c in dealt]),
                 "audit-steps")


def filter_audit(docs: DataFrame, labels: DataFrame,
                 filters: Mapping[str, Column | str] | None = None, part: str = "lang",
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, order of the filters and step, with the counts of that step.

    `filters` maps one letter to the condition that a failing document meets (or `REPEATED`).
    `kept`: documents left after the step. `removed`: those that go here. `redundant`: those that
    fail this filter and went before. `unique_fails`: those that fail this filter only.
    `good_lost`, `toxic_lost`: those that go here with quality 1, with toxic 1. `shapley`: what
    this filter removes, summed over all orders.

    Rows are counted, so repeated rows count each. NULL text is empty, NULL part is the empty
    string, NULL conditions don't fail. An empty table has no parts and gives no rows. Other
    columns of the input are not touched, whatever their names.
    """
    filters = filters or standard_filters(text_col)
    letters, n = "".join(filters), len(filters)
    if any(len(f) != 1 for f in filters):
        raise ValueError("a filter is named by one letter")
    steps = prefix_steps(mask_cells(failure_masks(docs, filters, part, id_col, text_col), labels,
                                    id_col), letters)
    orders_with = F.factorial(F.lit(n) - F.col("step"))
    shapley = steps.groupBy("part", F.substring("prefix", -1, 1).alias("letter")).agg(
        F.sum(F.col("removed") * orders_with).alias("shapley"))
    orders = steps.where(F.col("step") == n).select(
        "part", F.col("prefix").alias("filter_order"),
        F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    orders = orders.withColumn("prefix", F.expr("substr(filter_order, 1, step)")).withColumn(
        "letter", F.expr("substr(filter_order, step, 1)"))
    return orders.join(steps, ["part", "prefix", "step"]).join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", *STEP_COUNTS, "shapley")


__all__ = ["REPEATED", "STEP_COUNTS", "WORD", "failure_masks", "filter_audit", "mask_cells",
           "prefix_steps", "standard_filters"]
