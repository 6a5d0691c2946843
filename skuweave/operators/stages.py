"""The matrix operators as Spark ML stages, with parameters that can be saved.

Both read a table with several rows per id and give one row per id, with an ML
vector, so they stand at the head of an ML `Pipeline`.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from ..functions import HISTORY_WEEKS
from ..sources.schemas import FEATURE_COLUMNS
from .learn import with_vector
from .matrix import value_keyed_matrix, week_matrix
from .trailing import LAST_LAG, trailing_sums


class _SlotParams(Params):
    cols = Param(Params._dummy(), "cols", "measure columns", TypeConverters.toListString)
    idCol = Param(Params._dummy(), "idCol", "id column", TypeConverters.toString)
    timeCol = Param(Params._dummy(), "timeCol", "integer time column", TypeConverters.toString)
    outputIdCol = Param(Params._dummy(), "outputIdCol", "name of the id in the result",
                        TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "name of the vector",
                      TypeConverters.toString)
    duplicates = Param(Params._dummy(), "duplicates",
                       "rows that share id and time: last_goods, sum or error",
                       TypeConverters.toString)

    def setCols(self, value):
        return self._set(cols=value)

    def setIdCol(self, value):
        return self._set(idCol=value)

    def setTimeCol(self, value):
        return self._set(timeCol=value)

    def setOutputIdCol(self, value):
        return self._set(outputIdCol=value)

    def setOutputCol(self, value):
        return self._set(outputCol=value)

    def setDuplicates(self, value):
        return self._set(duplicates=value)

    def _value(self, name):
        return self.getOrDefault(self.getParam(name))


class TrailingSums(Transformer, _SlotParams, DefaultParamsReadable, DefaultParamsWritable):
    """Sums over the last 0..statisticTime time units up to targetTime."""

    targetTime = Param(Params._dummy(), "targetTime", "time the sums end at",
                       TypeConverters.toInt)
    statisticTime = Param(Params._dummy(), "statisticTime", "longest lag", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, cols=None, timeCol=None, idCol=None, targetTime=None,
                 statisticTime=LAST_LAG, outputIdCol="id", outputCol="features",
                 duplicates="last_goods"):
        super().__init__()
        self._setDefault(statisticTime=LAST_LAG, outputIdCol="id", outputCol="features",
                         duplicates="last_goods")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setTargetTime(self, value):
        return self._set(targetTime=value)

    def setStatisticTime(self, value):
        return self._set(statisticTime=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols, last_lag, out = (self._value(p) for p in ("cols", "statisticTime", "outputCol"))
        sums = trailing_sums(dataset, cols, self._value("timeCol"), self._value("idCol"),
                             self._value("targetTime"), last_lag, self._value("duplicates"),
                             self._value("outputIdCol"), out)
        return with_vector(sums, (last_lag + 1) * len(cols), out)


class WeekMatrix(Transformer, _SlotParams, DefaultParamsReadable, DefaultParamsWritable):
    """All weeks of an id side by side, or the value-keyed vector of the same width."""

    weeks = Param(Params._dummy(), "weeks", "number of slots", TypeConverters.toInt)
    keyedBy = Param(Params._dummy(), "keyedBy", "week or value", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, cols=None, timeCol="weekNum2", idCol="sku_id", weeks=HISTORY_WEEKS,
                 keyedBy="week", outputIdCol="sku_id", outputCol="features",
                 duplicates="last_goods"):
        super().__init__()
        self._setDefault(cols=["weekNum2", *FEATURE_COLUMNS], timeCol="weekNum2",
                         idCol="sku_id", weeks=HISTORY_WEEKS, keyedBy="week",
                         outputIdCol="sku_id", outputCol="features", duplicates="last_goods")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setWeeks(self, value):
        return self._set(weeks=value)

    def setKeyedBy(self, value):
        return self._set(keyedBy=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols, weeks, out, id_col, time_col = (
            self._value(p) for p in ("cols", "weeks", "outputCol", "idCol", "timeCol"))
        if self._value("keyedBy") == "value":
            cols = cols[:1]
            matrix = value_keyed_matrix(dataset, id_col, cols[0], time_col, weeks, out)
        else:
            matrix = week_matrix(dataset, cols, id_col, time_col, weeks,
                                 self._value("duplicates"), out)
        return with_vector(matrix, weeks * len(cols), out).withColumnRenamed(
            id_col, self._value("outputIdCol"))
