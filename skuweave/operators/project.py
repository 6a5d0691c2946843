"""Typed projection, renames, label selection, filters and null filling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_double, as_int
from ..sources.schemas import FEATURE_COLUMNS

#: Columns that are never model inputs.
NOT_FEATURES = ("sku_id", "goods_id", "label")


def typed_projection(df: DataFrame, keep: Iterable[str] = (),
                     doubles: Iterable[str] = ()) -> DataFrame:
    """Cast every column: `keep` stays as it is, `doubles` to double, all others to int."""
    keep, doubles = set(keep), set(doubles)
    out = []
    for name in df.columns:
        if name in keep:
            out.append(F.col(name))
        elif name in doubles:
            out.append(as_double(df, name).alias(name))
        else:
            out.append(as_int(df, name).alias(name))
    return df.select(*out)


def feature_names(df: DataFrame, exclude: Iterable[str] = NOT_FEATURES) -> list[str]:
    """The input columns of a model: all but the ids and the label, in table order."""
    exclude = set(exclude)
    return [c for c in df.columns if c not in exclude]


def only_week(df: DataFrame, week: int, week_col: str = "weekNum") -> DataFrame:
    return df.where(F.col(week_col) == F.lit(int(week)))


def select_label(df: DataFrame, id_col: str, label_col: str, condition: str | Column,
                 id_as: str | None = None, label_as: str | None = None) -> DataFrame:
    """`(id, label)` of the rows that meet `condition` (SQL text or a column)."""
    return df.where(condition).select(F.col(id_col).alias(id_as or id_col),
                                      F.col(label_col).alias(label_as or label_col))


def fill_missing(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Zero for NULL in numeric columns; text columns keep their NULLs.

    By default only measures are filled. A NULL week marks an unreadable date and
    must not turn into week 0.
    """
    columns = [c for c in (columns or FEATURE_COLUMNS) if c in df.columns]
    return df.na.fill(0, subset=columns)


def stack_sets(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all tables, duplicates kept; columns are matched by name."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out
