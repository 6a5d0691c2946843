"""Weekly demand features and forecasts on PySpark.

Everything is a function from DataFrames to a DataFrame, or a Spark ML stage.
Nothing in the library runs a job on import, and operators stay lazy: jobs start
in `skuweave.plans` (training, forecasting, writing) or in the caller.
"""

__version__ = "0.1.0"
