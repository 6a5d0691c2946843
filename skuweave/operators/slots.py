"""One row per id and time slot: the common first step of the matrix operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUPLICATES = ("last_goods", "sum", "error")
NULLS = ("zero", "error")


def measure(col: str, nulls: str = "zero") -> Column:
    """A measure as double. Text that is no number is an error; NULL is 0 or an error."""
    if nulls not in NULLS:
        raise ValueError(f"nulls must be one of {NULLS}")
    if nulls == "error":
        missing = F.raise_error(F.lit(f"{col} is NULL")).cast("double")
    else:
        missing = F.lit(0.0)
    return F.coalesce(F.col(col).cast("double"), missing)


def slot_values(df: DataFrame, id_col: str, slot: Column, cols: list[str],
                duplicates: str = "last_goods", nulls: str = "zero",
                goods_col: str = "goods_id", total_of: str | None = None) -> DataFrame:
    """`(id, slot int, values array<double>)`, unique on id and slot.

    `slot` is NULL for rows outside the wanted range. Their values are dropped
    but the id is kept, and they all fall into one NULL slot: the map side sends
    at most one row per id and slot, also for an id with a third of all rows.

    Several goods may sell the same SKU in a week. `last_goods` takes the row of
    the highest goods id (ties: highest values), `sum` adds them up, `error`
    counts the rows and fails where an id has a second one in a slot. NULL values
    count as 0, or fail with `nulls="error"`. With `total_of`, a column `total` holds the sum of
    that column over all rows of the id and slot, whichever row was taken.
    """
    if duplicates not in DUPLICATES:
        raise ValueError(f"duplicates must be one of {DUPLICATES}")
    measures = [measure(c, nulls) for c in cols]
    rows = df.select(F.col(id_col).cast("string").alias("id"), slot.cast("int").alias("slot"),
                     *([F.col(goods_col).alias("goods")] if goods_col in df.columns else []),
                     F.array(*measures).alias("values"),
                     *([F.col(total_of).cast("double").alias("part")] if total_of else []))
    total = [F.sum("part").alias("total")] if total_of else []
    named = ["total"] if total_of else []
    if duplicates == "error":
        # Of fixed width and combined on the map side, like a sum.
        only = [F.max(F.when(F.col("slot").isNotNull(), F.col("values")[i])) for i in range(len(cols))]
        found = rows.groupBy("id", "slot").agg(F.array(*only).alias("values"),
                                               F.count("slot").alias("found"), *total)
        twice = F.raise_error(F.concat(F.lit("duplicate row of "), F.col("id"), F.lit(" in slot "),
                                       F.col("slot").cast("string"))).cast("array<double>")
        return found.select("id", "slot", F.when(F.col("found") > 1, twice).when(
            F.col("slot").isNotNull(), F.col("values")).alias("values"), *named)
    keys = rows.groupBy("id", "slot")
    if duplicates == "sum":
        sums = [F.coalesce(F.sum(F.col("values")[i]), F.lit(0.0)) for i in range(len(cols))]
        return keys.agg(F.array(*sums).alias("values"), *total)
    order = ["goods", "values"] if "goods" in rows.columns else ["values"]
    # A NULL slot needs the id only; a constant keeps its partial rows small.
    ranked = F.when(F.col("slot").isNotNull(), F.struct(*order))
    return keys.agg(F.max(ranked).alias("best"), *total).select(
        "id", "slot", F.col("best.values").alias("values"), *named)


def slots_by_id(slots: DataFrame, *keys: str, also: Sequence[Column] = ()) -> DataFrame:
    """Collect the slots of each id as `by_slot`, a map from slot to values.

    There is at most one entry per slot of the range, so the collected state is
    bounded. A duplicate slot makes the map fail, it is never picked silently. `also` are further
    aggregates over the slots of an id.
    """
    entry = F.when(F.col("slot").isNotNull(), F.struct("slot", "values"))
    return (slots.groupBy("id", *keys)
            .agg(F.map_from_entries(F.collect_list(entry)).alias("by_slot"), *also))


def slot_or_zeros(by_slot: Column, slot: Column, width: int) -> Column:
    zeros = F.array(*[F.lit(0.0)] * width)
    return F.coalesce(F.try_element_at(by_slot, slot), zeros)


def slot_blocks(slots: Column, width: int, by_slot: str = "by_slot") -> Column:
    """The block of each of `slots` (an array), in their order; zeros where there is none.

    The map is the argument of a lambda of its own. Named inside the lambda over the slots, the
    optimizer puts its making there, and it is made again for every slot.
    """
    blocks = F.transform(F.array(F.col(by_slot)), lambda found: F.transform(
        slots, lambda slot: slot_or_zeros(found, slot, width)))
    return F.get(blocks, F.lit(0))
