from riskmart.functions.nulls import (  # noqa: F401
    nan_to_null, nan_to_null_all, safe_div, clip_lower, row_mean, row_min, row_max,
    sum_or_zero, count_true, negative_days_to_years,
)
from riskmart.functions.text import round_even, fixed, py_float_text  # noqa: F401
