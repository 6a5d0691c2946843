"""Weekly rollups that can be continued: partial states on disk, and the days they cover.

A stored week holds sums and counts, not means, and a marker row for each day that went into
it. New days are rolled up alone, merged with the stored states of the weeks they touch, and only
those weeks are written. State and markers of a week are in one folder and are replaced together,
so a job that broke off can simply be run again: the days that got in are known and are passed
over.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ANCHOR, as_double, as_int, day_of, week_number
from ..session import Scratch
from ..sources.schemas import PRICE_COLUMNS, TRAFFIC_COLUMNS
from ..sources.writers import write_weeks

WEEK = "weekNum"


@dataclass(frozen=True)
class Rollup:
    """Keys of a weekly table, and its summed and averaged measures.

    With `places`, averaged measures are summed as whole units of that many decimals: exact in any
    order, so a continued table equals one computed at once, to the last digit.
    """

    keys: tuple[str, ...]
    sums: tuple[str, ...] = ()
    means: tuple[str, ...] = ()
    whole: bool = False
    places: int | None = None

    @property
    def states(self) -> list[str]:
        return [*[f"{c}_sum" for c in (*self.sums, *self.means)], *[f"{c}_n" for c in self.means]]


SALES = Rollup(("goods_id", "sku_id"), sums=("goods_num",),
               means=("goods_price", "orginal_shop_price"))
PRICES = Rollup(("goods_id",), means=PRICE_COLUMNS)
TRAFFIC = Rollup(("goods_id",), means=TRAFFIC_COLUMNS, whole=True)


def partial_states(daily: DataFrame, rollup: Rollup) -> DataFrame:
    """`(weekNum, keys..., <measure>_sum, <measure>_n)` of daily rows that know their week."""
    def value(name: str) -> Column:
        return as_int(daily, name) if rollup.whole else as_double(daily, name)

    def unit(name: str) -> Column:
        if rollup.places is None:
            return value(name)
        return F.rint(value(name) * F.lit(float(10 ** rollup.places))).cast("bigint")

    return daily.groupBy(WEEK, *rollup.keys).agg(
        *[F.sum(value(c)).alias(f"{c}_sum") for c in rollup.sums],
        *[F.sum(unit(c)).alias(f"{c}_sum") for c in rollup.means],
        *[F.count(value(c)).alias(f"{c}_n") for c in rollup.means])


def merge_states(states: DataFrame, rollup: Rollup) -> DataFrame:
    """States of the same week and keys added up; a sum over no value at all stays NULL."""
    return states.groupBy(WEEK, *rollup.keys).agg(*[F.sum(c).alias(c) for c in rollup.states])


def finished(states: DataFrame, rollup: Rollup) -> DataFrame:
    """The weekly table: sums as they are, means as sum over count (NULL where there was no value)."""
    def mean(name: str) -> Column:
        total = F.col(f"{name}_sum").cast("double")
        if rollup.places is not None:
            total = total / F.lit(float(10 ** rollup.places))
        return (total / F.when(F.col(f"{name}_n") > 0, F.col(f"{name}_n"))).alias(name)

    return states.select(WEEK, *rollup.keys, *[F.col(f"{c}_sum").alias(c) for c in rollup.sums],
                         *[mean(c) for c in rollup.means])


def _stored(spark: SparkSession, path: str, weeks: Iterable[int] | None = None) -> DataFrame | None:
    """What lies at `path`; with `weeks`, only those folders are opened. NULL where nothing does."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if weeks is None:
        found = [path] if files.exists(root) and files.listStatus(root) else []
    else:
        found = [f"{path}/{WEEK}={w}" for w in sorted(set(weeks)) if files.exists(
            spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{WEEK}={w}"))]
    return spark.read.option("basePath", path).parquet(*found) if found else None


def read_states(spark: SparkSession, path: str, weeks: Iterable[int] | None = None,
                empty: Rollup | None = None) -> DataFrame:
    """The stored states, of all weeks or of some.

    Where there are none, that is an error, or a table without rows for the rollup `empty`.
    """
    found = _stored(spark, path, weeks)
    if found is not None:
        return found.where("day IS NULL").drop("day")
    if empty is None:
        raise ValueError(f"no states of these weeks at {path}")
    columns = [f"{WEEK} int", *[f"{c} string" for c in empty.keys],
               *[f"{c} double" for c in empty.states]]
    return spark.createDataFrame([], ", ".join(columns))


def covered_days(spark: SparkSession, path: str) -> DataFrame:
    """`(weekNum, day)`: the days that the stored states hold."""
    found = _stored(spark, path)
    if found is None:
        return spark.createDataFrame([], f"{WEEK} int, day date")
    return found.where("day IS NOT NULL").select(WEEK, "day")


def continue_weeks(daily: DataFrame, path: str, rollup: Rollup, date_col: str = "data_date",
                   anchor: dt.date = ANCHOR, again: str = "skip") -> list[int]:
    """Add days to the states at `path` (made if there are none); returns the weeks written.

    A day comes whole, in one go. One that is covered already is passed over, or is an error with
    `again="error"`. Rows without a readable day belong to no day and are left out. The new rows
    are read once for their days, a narrow scan, and once for their sums; of the stored weeks only
    those that a new day falls into are read. The list of days is one entry per calendar day.
    """
    if again not in ("skip", "error"):
        raise ValueError('again must be "skip" or "error"')
    spark, day = daily.sparkSession, day_of(daily, date_col)
    dated = daily.withColumn("_day", day).where("_day IS NOT NULL")
    here = {r[0] for r in dated.select("_day").distinct().collect()}
    stored = _stored(spark, path)
    known = set()
    if stored is not None:
        known = {r[0] for r in stored.where(F.col("day").isNotNull()).select("day").collect()}
    if again == "error" and here & known:
        raise ValueError(f"days that are covered already: {sorted(here & known)[:5]}")
    new = sorted(here - known)
    if not new:
        return []
    rows = dated.withColumn(WEEK, week_number(F.col("_day"), anchor))
    if here & known:
        rows = rows.where(F.col("_day").isin(new))
    with Scratch(spark) as scratch:
        marks = spark.createDataFrame([(d,) for d in new], "day date").select(
            week_number(F.col("day"), anchor).alias(WEEK), "day")
        states = partial_states(rows, rollup)
        weeks = sorted(r[0] for r in marks.select(WEEK).distinct().collect())
        old = _stored(spark, path, weeks)
        if old is not None:
            columns = [WEEK, *rollup.keys, *rollup.states]
            states = merge_states(states.select(*columns).unionByName(
                old.where("day IS NULL").select(*columns)), rollup)
            marks = marks.unionByName(old.where("day IS NOT NULL").select(WEEK, "day"))
        # The new folders replace the ones just read, so they are computed to the end first.
        merged = scratch.stage(states.unionByName(marks, allowMissingColumns=True), "weeks")
        write_weeks(merged, path, WEEK)
    return weeks
