from vitalgrid.functions.scalar import (  # noqa: F401
    any_exceeds_expr, coerce_numeric_expr, nan_to_null, relabel_expr, risk_band_expr,
    row_sum_expr, safe_div, stable_uniform, stable_hash_key, minutes_between,
)
