"""Table and model writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str) -> None:
    """Replace the Parquet table at `path`."""
    df.write.mode("overwrite").parquet(path)


def write_weeks(df: DataFrame, path: str, week_col: str = "weekNum") -> None:
    """Write one folder per week, replacing only the weeks that `df` holds.

    There are few weeks and each may be huge, so the rows are not simply hashed
    by week. `rebalance` lets AQE cut a large week into several files of the
    advisory size and put small weeks together in one task.
    """
    (df.hint("rebalance", week_col)
       .write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(week_col)
       .parquet(path))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header line, comma separated.

    Parts are written in parallel. `single_file` is for the file that is handed in:
    all rows then pass, in a stream, through one task. The repartition comes after
    the scoring, which keeps its own parallelism.
    """
    out = df.repartition(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("sep", ",").csv(path)


def write_model(model, path: str) -> None:
    model.write().overwrite().save(path)
