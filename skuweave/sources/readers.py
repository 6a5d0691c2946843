"""Table readers. Each returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .schemas import RAW_COLUMNS, check_feature_table, text_schema


def read_raw(spark: SparkSession, path: str, columns: Iterable[str] | None = None,
             sep: str = ",") -> DataFrame:
    """CSV with a header line, every column as text.

    With `columns` no file is opened before the job runs; they must then be in
    file order. Without, Spark reads the header line of one file for the names.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    if columns is not None:
        # enforceSchema=False checks the names against each file's header line.
        reader = reader.schema(text_schema(list(columns))).option("enforceSchema", False)
    return reader.csv(path)


def read_raw_tables(spark: SparkSession, folder: str,
                    names: Iterable[str] = ("goodsale", "goodsdaily", "goods_promote_price"),
                    ) -> dict[str, DataFrame]:
    """The named `<folder>/<name>.csv` tables; only the ones a plan uses need be named."""
    return {name: read_raw(spark, f"{folder.rstrip('/')}/{name}.csv") for name in names}


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """The list of SKUs to forecast: `sku_id, week1..week5`, as text."""
    return read_raw(spark, path, RAW_COLUMNS["submit_example"])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return check_feature_table(spark.read.parquet(path))


def read_weeks(spark: SparkSession, path: str, weeks: Iterable[int]) -> DataFrame:
    """Weeks of a table written by `write_weeks`; the folders of other weeks are not listed.

    At least one of the weeks must be there.
    """
    names = ",".join(str(w) for w in sorted({int(w) for w in weeks}))
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/weekNum={{{names}}}")


_MODELS = {"gbt": GBTRegressionModel, "linear": LinearRegressionModel, "stages": PipelineModel}


def load_model(path: str, kind: str):
    """Load a saved model; `kind` is "gbt", "linear" or "stages" (a fitted `Pipeline`)."""
    return _MODELS[kind].load(path)


def from_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(rows, schema)
