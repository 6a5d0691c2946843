"""Join of many rows to a lookup table with at most one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, lookup: DataFrame, on: list[str], by: list[str],
                how: str = "left", spread: int = 1) -> DataFrame:
    """Join `rows` to `lookup` so that one hot key does not end up in one task.

    The rows of a key are dealt to `spread` parts by the hash of the columns `by`,
    and the lookup row is repeated once per part. An aggregated lookup is already
    partitioned by `on`, and a join that reuses this cannot be split at run time.
    The part number is a join key of its own, so both sides are read straight
    from a shuffle, where AQE splits a large partition further; this holds for
    `spread=1` too, which repeats nothing.
    """
    if spread < 1:
        raise ValueError("spread must be at least 1")
    part = "_part"
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*by), F.lit(spread)).cast("int"))
    repeated = lookup.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return dealt.join(repeated, [*on, part], how).drop(part)
