"""Products of two inputs as sparse vectors, made from the inputs that are not zero."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .learn import with_array

#: The form in which Spark stores a sparse vector.
SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def expanded_size(inputs: int) -> int:
    """Inputs, and the products of any two of them: 605 + 1 inputs give 184,527."""
    return inputs * (inputs + 3) // 2


def _not_zero(features: Column) -> Column:
    """`(i, x)` of the inputs that are not zero, in order. NULL inputs are an error."""
    known = F.transform(features, lambda x, i: F.struct(i.alias("i"), F.coalesce(
        x, F.raise_error(F.lit("an input is NULL")).cast("double")).alias("x")))
    return F.filter(known, lambda c: c["x"] != 0)


def _products(given: Column, size: int) -> Column:
    """The expansion of degree two, from the inputs that are not zero, in Spark's form of a vector.

    In the order of `expand`: the block of input i begins at i (i + 3) / 2 with the input itself,
    and goes on with its products with inputs 0..i. So a row with k inputs that are not zero costs
    k (k + 3) / 2 cells, however many inputs there are.
    """
    def block(c: Column, rank: Column) -> Column:
        start = F.floor(c["i"] * (c["i"] + 3) / 2).cast("int")
        own = F.struct(start.alias("at"), c["x"].alias("v"))
        return F.concat(F.array(own), F.transform(
            F.slice(given, F.lit(1), rank + 1),
            lambda d: F.struct((start + 1 + d["i"]).cast("int").alias("at"),
                               (c["x"] * d["x"]).alias("v"))))

    cells = F.flatten(F.transform(given, block))
    return F.struct(F.lit(0).cast("tinyint").alias("type"),
                    F.lit(expanded_size(size)).alias("size"),
                    F.transform(cells, lambda c: c["at"]).alias("indices"),
                    F.transform(cells, lambda c: c["v"]).alias("values")).cast(SPARSE)


def expand_sparse(df: DataFrame, size: int, inputs: str = "features",
                  out: str = "polyfeatures") -> DataFrame:
    """`df` with the products of its inputs as an ML vector; `inputs` is an array or a vector.

    Equals `expand` with degree 2, but no row is ever as wide as the expansion. The result is
    written to the shared folder: read with the vector type, the stored cells are ML vectors,
    without a function that is called per row.
    """
    spark = df.sparkSession
    rows = with_array(df.withColumn("_given", F.col(inputs)), "_given")
    rows = rows.withColumn("_given", _not_zero(F.col("_given")))
    made = rows.withColumn(out, _products(F.col("_given"), size)).drop("_given")
    path = scratch_path(spark, "products")
    made.write.parquet(path)
    fields = [T.StructField(f.name, VectorUDT(), True, {"ml_attr": {"num_attrs": expanded_size(size)}})
              if f.name == out else f for f in made.schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)
