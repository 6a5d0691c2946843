"""Forecast jobs: stored matrix or weeks, template and model to a forecast file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import (MATRIX_COLUMNS, YEAR_BEFORE, BoostedModel, forecast_coverage,
                         forecast_weeks, forecast_year_over_year, matrix_width)
from ..sources import load_model, read_template, read_weeks, write_csv


def run_forecast(spark: SparkSession, matrix_path: str, template_path: str, model_path: str,
                 out: str, kind: str = "gbt", columns: int = len(MATRIX_COLUMNS),
                 degree: int = 1, single_file: bool = False) -> None:
    """Five weeks for every submitted SKU, as CSV `sku_id, week1..week5`."""
    model = (BoostedModel.load(spark, model_path) if kind == "boosted"
             else load_model(model_path, kind))
    forecast = forecast_weeks(read_template(spark, template_path),
                              spark.read.parquet(matrix_path), model,
                              matrix_width(columns), degree=degree)
    write_csv(forecast.drop("has_history"), out, single_file)


def run_year_over_year(spark: SparkSession, weeks_path: str, template_path: str,
                       model_path: str, out: str, kind: str = "gbt",
                       single_file: bool = False) -> DataFrame:
    """Forecast from the weeks a year before, written as CSV; returns its coverage counts."""
    features = read_weeks(spark, weeks_path, YEAR_BEFORE.values())
    forecast = forecast_year_over_year(features, read_template(spark, template_path),
                                       load_model(model_path, kind))
    write_csv(forecast, out, single_file)
    return forecast_coverage(read_template(spark, out))
