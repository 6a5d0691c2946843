"""Daily files to weekly feature tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions import ANCHOR
from ..operators import (PRICES, SALES, TRAFFIC, build_feature_table, continue_weeks, fan_out,
                         feature_table_from_weekly, finished, group_count, preview, read_states, rows_per_week,
                         submitted_skus_per_week, submitted_units_per_week, year_over_year)
from ..sources import read_raw, read_raw_tables, read_template, write_table, write_weeks


ROLLUPS = {"sales": SALES, "prices": PRICES, "traffic": TRAFFIC}


def daily_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sales, promotion prices and traffic; the other files of the folder are not needed."""
    raw = read_raw_tables(spark, folder)
    return raw["goodsale"], raw["goods_promote_price"], raw["goodsdaily"]


def create_feature_table(spark: SparkSession, folder: str, out: str,
                         anchor: dt.date = ANCHOR) -> None:
    """Whole history as one Parquet table."""
    write_table(build_feature_table(*daily_tables(spark, folder), anchor=anchor), out)


def create_week_snapshots(spark: SparkSession, folder: str, out: str, weeks: Iterable[int],
                          anchor: dt.date = ANCHOR) -> None:
    """Some weeks as folders of one table; weeks written before stay as they are."""
    table = build_feature_table(*daily_tables(spark, folder), anchor=anchor, weeks=list(weeks))
    write_weeks(table, out)


def continue_feature_table(spark: SparkSession, folder: str, out: str,
                           anchor: dt.date = ANCHOR, again: str = "skip") -> list[int]:
    """Add the days in `folder` to `<out>/states` and write the touched weeks of `<out>/features`.

    The history is not read: only the new days, and the stored states and features of the weeks
    that they fall into. Returns those weeks. Features are made from states alone, so a job that
    broke off after the states is put right by `rebuild_weeks`.
    """
    tables = dict(zip(("sales", "prices", "traffic"), daily_tables(spark, folder)))
    weeks: set[int] = set()
    for name, rollup in ROLLUPS.items():
        weeks |= set(continue_weeks(tables[name], f"{out}/states/{name}", rollup, anchor=anchor,
                                    again=again))
    if weeks:
        rebuild_weeks(spark, out, weeks)
    return sorted(weeks)


def rebuild_weeks(spark: SparkSession, out: str, weeks: Iterable[int]) -> None:
    """Write some weeks of `<out>/features` from the stored states."""
    weekly = [finished(read_states(spark, f"{out}/states/{name}", weeks, empty=rollup), rollup)
              for name, rollup in ROLLUPS.items()]
    write_weeks(feature_table_from_weekly(*weekly), f"{out}/features")


def create_year_over_year_set(spark: SparkSession, folder: str, out: str,
                              label_weeks: Iterable[int] = (7, 6), offset: int = 53,
                              anchor: dt.date = ANCHOR) -> None:
    """Training rows that pair a week with the one a year later."""
    label_weeks = list(label_weeks)
    weeks = label_weeks + [w + offset for w in label_weeks]
    table = build_feature_table(*daily_tables(spark, folder), anchor=anchor, weeks=weeks)
    write_table(year_over_year(table, label_weeks, offset), out)


def analyse(spark: SparkSession, folder: str, template: str | None = None,
            anchor: dt.date = ANCHOR) -> dict[str, DataFrame]:
    """The tables of the data analysis, by name; nothing runs until they are shown."""
    folder = folder.rstrip("/")
    sales = read_raw(spark, f"{folder}/goodsale.csv")
    listed = read_template(spark, template or f"{folder}/submit_example.csv")
    relation = read_raw(spark, f"{folder}/goods_sku_relation.csv")
    return {
        "rows per week": preview(rows_per_week(sales, anchor), "weekNum"),
        "submitted units per week": submitted_units_per_week(sales, listed, anchor),
        "submitted SKUs per week": submitted_skus_per_week(sales, listed, anchor),
        "number of SKUs": group_count(relation, "sku_id"),
        "SKUs per goods": fan_out(relation, "goods_id"),
    }
