"""DataFrame operators: typed projection, weekly rollups, joins, matrices, training sets."""

from .boosting import AbsentBins, BoostedModel, RidgeBoosting, Tree, early_stop, sides
from .combine import (attach_goods_week, build_feature_table, feature_table_from_weekly,
                      goods_week_lookup, week_snapshot, year_over_year)
from .continued import (PRICES, SALES, TRAFFIC, Rollup, continue_weeks, covered_days, finished,
                        merge_states, partial_states, read_states)
from .direct import AHEAD, LAGS, direct_rows, fit_direct, forecast_direct
from .forecast import (HORIZONS, YEAR_BEFORE, forecast_coverage, forecast_grid,
                       forecast_weeks, forecast_year_over_year, matrix_width)
from .gram import (LinearFit, collect_gram, cross_validate, factorised_rows, fit_factorised,
                   fold_scores, gram_blocks, label_sums, origin_scores, ridge, single_rows,
                   squared_error)
from .learn import (assemble, boosted_trees, expand, hash_split, in_train, linear, mark_held,
                    predict, rmse, score_table, sized, top_categorical, training_history,
                    training_history_table, tune_linear, with_array, with_fold, with_vector)
from .lookup import spread_join
from .matrix import (mask_block, matrix_cells, sales_matrix, value_keyed_matrix, week_matrix)
from .project import (feature_names, fill_missing, only_week, select_label, stack_sets,
                      typed_projection)
from .rollup import (fan_out, group_count, preview, row_count, rows_per_week,
                     submitted_skus_per_week, submitted_units_per_week, typed_prices,
                     typed_traffic, weekly_prices, weekly_sales, weekly_traffic)
from .sparse import expand_sparse, expanded_size
from .stages import TrailingSums, WeekMatrix
from .trailing import (lag_columns, trailing_sums, trailing_sums_all_targets,
                       trailing_sums_with_label)
from .training_sets import MATRIX_COLUMNS, horizon_training_set, target_week_rows

__all__ = [
    "AHEAD", "AbsentBins", "BoostedModel", "HORIZONS", "LAGS", "LinearFit", "MATRIX_COLUMNS",
    "PRICES", "RidgeBoosting", "Rollup", "SALES", "TRAFFIC", "TrailingSums", "Tree",
    "WeekMatrix", "YEAR_BEFORE", "assemble", "attach_goods_week", "boosted_trees",
    "build_feature_table", "collect_gram", "continue_weeks", "covered_days", "cross_validate",
    "direct_rows", "early_stop", "expand", "expand_sparse", "expanded_size", "factorised_rows",
    "fan_out", "feature_names", "feature_table_from_weekly", "fill_missing", "finished",
    "fit_direct", "fit_factorised", "fold_scores", "forecast_coverage", "forecast_direct",
    "forecast_grid", "forecast_weeks", "forecast_year_over_year", "goods_week_lookup",
    "gram_blocks", "group_count", "hash_split", "horizon_training_set", "in_train",
    "label_sums", "lag_columns", "linear", "mark_held", "mask_block", "matrix_cells",
    "matrix_width", "merge_states", "only_week", "origin_scores", "partial_states", "predict", "preview",
    "read_states", "ridge", "rmse", "row_count", "rows_per_week", "sales_matrix",
    "score_table", "select_label", "sides", "single_rows", "sized", "spread_join",
    "squared_error", "stack_sets", "submitted_skus_per_week", "submitted_units_per_week",
    "target_week_rows", "top_categorical", "trailing_sums", "trailing_sums_all_targets",
    "trailing_sums_with_label", "training_history", "training_history_table", "tune_linear",
    "typed_prices", "typed_projection", "typed_traffic", "value_keyed_matrix", "week_matrix",
    "week_snapshot", "weekly_prices", "weekly_sales", "weekly_traffic", "with_array",
    "with_fold", "with_vector", "year_over_year",
]
