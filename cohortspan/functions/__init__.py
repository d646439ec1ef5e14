from cohortspan.functions.finance import (
    discount_factor,
    discount_factor_sql,
    hazard,
    linear_ramp,
    linear_ramp_sql,
    paid_before_sql,
    payment_sql,
    ratio,
)
from cohortspan.functions.scalars import (
    arm_label,
    is_number_list,
    plus_zero,
    to_number,
    two_decimals,
)

__all__ = [
    "arm_label",
    "discount_factor",
    "discount_factor_sql",
    "hazard",
    "is_number_list",
    "linear_ramp",
    "linear_ramp_sql",
    "paid_before_sql",
    "payment_sql",
    "plus_zero",
    "ratio",
    "to_number",
    "two_decimals",
]
