"""Column expressions. All are built from JVM-side functions; there is no UDF."""

from .casts import as_double, as_int, is_text
from .numeric import one_over_one_plus_rmse, round_half_up_trunc, stable_mean
from .weeks import (ANCHOR, HISTORY_WEEKS, REVERSE_BASE, TARGET_BASE, day_of,
                    restrict_weeks, reverse_week, target_week, week_date_range, week_number,
                    week_runs, with_reverse_week, with_week)

__all__ = [
    "ANCHOR", "HISTORY_WEEKS", "REVERSE_BASE", "TARGET_BASE", "as_double", "as_int", "day_of",
    "is_text", "one_over_one_plus_rmse", "restrict_weeks", "reverse_week",
    "round_half_up_trunc", "stable_mean", "target_week", "week_date_range", "week_number",
    "week_runs", "with_reverse_week", "with_week",
]
