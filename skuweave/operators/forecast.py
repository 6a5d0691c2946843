"""Forecast tables: submitted SKUs with one column per forecast week."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import HISTORY_WEEKS, as_int, round_half_up_trunc, target_week
from .learn import assemble, expand, predict, sized, with_vector
from .project import feature_names

HORIZONS = 5
# The week that lies one year, 53 weeks, before each forecast week.
YEAR_BEFORE = {k: 53 - k for k in range(1, HORIZONS + 1)}


def forecast_grid(template: DataFrame, known: DataFrame, horizons: int = HORIZONS) -> DataFrame:
    """`(sku_id, horizon, weekNum, has_history)`: what is asked for, and what is known.

    `known` has one row per SKU with history.
    """
    marked = template.join(known.select("sku_id", F.lit(True).alias("seen")), "sku_id", "left")
    weeks = F.array(*[target_week(template, k) for k in range(1, horizons + 1)])
    return (marked.select("sku_id", F.col("seen").isNotNull().alias("has_history"),
                          F.posexplode(weeks).alias("pos", "weekNum"))
            .select("sku_id", (F.col("pos") + 1).alias("horizon"), "weekNum", "has_history"))


def forecast_weeks(template: DataFrame, matrix: DataFrame, model: Model,
                   width: int, horizons: int = HORIZONS, degree: int = 1) -> DataFrame:
    """`(sku_id, week1..weekN, has_history)`, one row per row of the template.

    The template meets the matrix in one join. All horizons are then scored on
    the same row, one after the other: the wide features are neither repeated per
    horizon nor shuffled again, and no pivot is needed. SKUs without history are
    scored on a row of zeros. `width` is the length of the feature vector.
    """
    offset = F.coalesce(as_int(template, "week1"), F.lit(0))
    zeros = array_to_vector(F.array_repeat(F.lit(0.0), width))
    rows = (template.select("sku_id", offset.alias("week1"))
            .join(with_vector(matrix, width).select("sku_id", "features"), "sku_id", "left")
            .select("sku_id", "week1", F.col("features").isNotNull().alias("has_history"),
                    sized(F.coalesce("features", zeros), "features", width)))
    keep = ["sku_id", "has_history", "features", "offset"]
    rows = rows.withColumnRenamed("week1", "offset")
    for k in range(1, horizons + 1):
        rows = rows.withColumn("target", target_week(rows, k, "offset"))
        rows = assemble(rows, ["features", "target"], "row")
        if degree > 1:
            rows = expand(rows, "row", "expanded", degree)
        rows = predict(model, rows, "expanded" if degree > 1 else "row", "sale")
        done = f"week{k}"
        rows = rows.select(*keep, round_half_up_trunc("sale").alias(done))
        keep.append(done)
    return rows.select("sku_id", *[f"week{k}" for k in range(1, horizons + 1)], "has_history")


def forecast_year_over_year(features: DataFrame, template: DataFrame, model: Model,
                            weeks: Mapping[int, int] | None = None) -> DataFrame:
    """Score the weeks one year before each horizon and line them up per submitted SKU.

    `(sku_id, week1..weekN)`; a SKU without a row in such a week has NULL there. A
    SKU listed under several goods gets the mean of their predictions. The weeks
    are scored in one pass over one table.
    """
    weeks = dict(weeks or YEAR_BEFORE)
    horizon_of = F.create_map(*[F.lit(int(x)) for h, w in weeks.items() for x in (w, h)])
    rows = (features.where(F.col("weekNum").isin(sorted(weeks.values())))
            .withColumn("horizon", horizon_of[F.col("weekNum")]))
    inputs = feature_names(rows, ("sku_id", "goods_id", "label", "weekNum", "horizon"))
    scored = predict(model, assemble(rows, inputs, "row"), "row")
    wide = (scored.groupBy("sku_id").pivot("horizon", sorted(weeks))
            .agg(F.avg("prediction")))
    wide = wide.select("sku_id", *[F.col(str(h)).alias(f"week{h}") for h in sorted(weeks)])
    return template.select("sku_id").join(wide, "sku_id", "left")


def forecast_coverage(forecast: DataFrame, week: str = "week1") -> DataFrame:
    """How many submitted SKUs have a forecast for `week`, and how many do not."""
    return forecast.agg(
        F.count(F.when(F.col(week).isNull(), 1)).alias("missing"),
        F.count(F.when(F.col(week).isNotNull(), 1)).alias("matched"))


def matrix_width(columns: int, weeks: int = HISTORY_WEEKS) -> int:
    return columns * weeks
