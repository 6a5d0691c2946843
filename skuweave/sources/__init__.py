"""Reading and writing: CSV with text columns, Parquet, models, the forecast file."""

from .readers import (from_rows, load_model, read_features, read_raw, read_raw_tables,
                      read_template, read_weeks)
from .schemas import (FEATURE_COLUMNS, FEATURE_TABLE_COLUMNS, PRICE_COLUMNS, RAW_COLUMNS,
                      SALE_COLUMNS, TRAFFIC_COLUMNS, check_feature_table, text_schema)
from .writers import write_csv, write_model, write_table, write_weeks

__all__ = [
    "FEATURE_COLUMNS", "FEATURE_TABLE_COLUMNS", "PRICE_COLUMNS", "RAW_COLUMNS",
    "SALE_COLUMNS", "TRAFFIC_COLUMNS", "check_feature_table", "from_rows", "load_model",
    "read_features", "read_raw", "read_raw_tables", "read_template", "read_weeks",
    "text_schema", "write_csv", "write_model", "write_table", "write_weeks",
]
