"""Time the headline queries: one JSON line on stdout.

Settings come from the environment: BENCH_SF_DIR, BENCH_CPUS and, for a part of
the queries, BENCH_QUERIES (comma separated). Each query runs twice, to the end, and
the second run counts: in the first, code is still being compiled. Its rows go to a sink
that drops them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from skuweave.queries import QUERIES
from skuweave.session import build_session

HEADLINE = (
    "weekly_sales", "weekly_traffic", "weekly_prices", "rows_per_week",
    "submit_units_per_week", "submit_skus_per_week", "feature_table", "week_snapshot",
    "yoy_training_set", "yoy_training_set_all_weeks", "dense_week_matrix",
    "dense_week_matrix_several_goods", "value_keyed_vector", "trailing_sums",
    "trailing_sums_all_targets", "horizon_training_set", "target_week_rows",
    "assembled_features", "poly_expand", "linear_fit", "cv_fit", "trailing_fit", "gbt_fit",
    "yoy_forecast", "forecast_wide", "csv_roundtrip", "week_folders_roundtrip",
    "linear_fit_factorised", "cv_one_pass", "origin_scores", "forecast_direct",
    "gbt_ridge_leaves", "gbt_missing", "early_stop", "weekly_prices_continued", "poly_sparse",
)


def run(fn, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in wanted:
        run(QUERIES[name], spark, sf_dir)
        times[name] = run(QUERIES[name], spark, sf_dir)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "seconds for all headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))[2:]}))
    spark.stop()


if __name__ == "__main__":
    main()
