"""Discounting, hazards, ramps and instalment schedules as column expressions.

Formulas used inside other expressions come as SQL text (``*_sql``): nested lambdas stay
readable and cost one parse instead of one call per operand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def discount_factor_sql(rate: str, period: str) -> str:
    return f"power(1D + {rate}, -CAST({period} - 1 AS DOUBLE))"


def discount_factor(rate: Column, period: Column) -> Column:
    """Present value in period 1 of one unit paid in ``period`` (1-based)."""
    return F.pow(F.lit(1.0) + rate, -(period - F.lit(1)).cast("double"))


def hazard(surviving: Column, periods: Column) -> Column:
    """Constant per-period hazard that leaves the share ``surviving`` after ``periods``.

    Nobody surviving means a hazard of 1; ``log(0)`` is null in Spark, so it is stated here.
    """
    return F.when(surviving == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.exp(F.log(surviving) / periods)
    )


def linear_ramp_sql(first: str, last: str, count: str) -> str:
    step = f"({last} - {first}) / greatest({count} - 1, 1)"
    return f"transform(sequence(0, greatest({count}, 1) - 1), i -> {first} + {step} * i)"


def linear_ramp(first: str, last: str, count: str) -> Column:
    """ARRAY of ``count`` evenly spaced values from ``first`` to ``last`` (SQL operands)."""
    return F.expr(linear_ramp_sql(first, last, count))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null, not an error, when the denominator is 0."""
    return F.try_divide(numerator, denominator)


def _plan_fields(plan: str, fields: dict[str, str] | None) -> dict[str, str]:
    names = ("tot_payment", "cont_payment", "cost_trend", "contract_length", "initial_payment")
    return {name: (fields or {}).get(name, plan + name) for name in names}


def geometric_sql(factor: str, first: str, count: str) -> str:
    """``factor`` to the powers ``first - 1``, ``first``, ..., ``count`` of them, summed up.

    In closed form; the difference quotient stays exact for factors near 1.
    """
    many = f"CAST({count} AS DOUBLE)"
    quotient = f"expm1({many} * log1p({factor} - 1D)) / ({factor} - 1D)"
    return f"""IF({count} <= 0, 0D, power({factor}, CAST({first} - 1 AS DOUBLE))
        * IF({factor} = 1D, {many}, {quotient}))"""


def payment_sql(
    period: str,
    plan: str = "",
    *,
    fields: dict[str, str] | None = None,
    discount: str = "discount",
    firm_discount: str = "firm_discount",
    start: str | None = None,
    firm_on_continuous: bool = False,
) -> str:
    """Amount a payment plan asks for in a 1-based ``period``.

    ``plan`` prefixes the field names (``"s."`` for a struct ``s``); ``fields`` gives other SQL
    for single fields: ``tot_payment, cont_payment, cost_trend, contract_length,
    initial_payment``.

    A plan with a total is paid in ``contract_length`` instalments from ``start`` on; an initial
    share moves that part to the first instalment and spreads the rest over the others, so with
    a single instalment the rest is never paid. A plan without a total pays ``cont_payment`` in
    each period, falling by ``cost_trend``. Totals grow with the firm's rate; continuous plans
    do so only when ``firm_on_continuous``.
    """
    named = _plan_fields(plan, fields)
    total, ongoing, trend, length, initial = named.values()
    position = period if start is None else f"({period} - {start} + 1)"
    elapsed = f"CAST({period} - 1 AS DOUBLE)"
    grown = f"power((1D + {firm_discount}) / (1D + {discount}), {elapsed})"
    shrunk = f"power(1D + {discount}, -{elapsed})"
    return f"""
        CASE WHEN {total} > 0 THEN
            CASE WHEN {position} >= 1 AND {position} <= {length} THEN
                CASE WHEN {initial} > 0 AND {position} = 1 THEN {total} * {initial}
                     WHEN {initial} > 0
                     THEN {total} * (1D - {initial}) / greatest({length} - 1D, 1D)
                     ELSE {total} / greatest({length}, 1D) END * {grown}
            ELSE 0D END
        ELSE {ongoing}
            * CASE WHEN {trend} = 0 THEN 1D ELSE power(1D + {trend}, -{elapsed}) END
            * {grown if firm_on_continuous else shrunk}
        END"""


def paid_before_sql(
    period: str,
    plan: str = "",
    *,
    fields: dict[str, str] | None = None,
    discount: str = "discount",
    firm_discount: str = "firm_discount",
    start: str | None = None,
    firm_on_continuous: bool = False,
) -> str:
    """What ``payment_sql`` asks for in all periods before a 1-based ``period``.

    Instalments and continuous payments are geometric series, so no period has to be looked at.
    """
    total, ongoing, trend, length, initial = _plan_fields(plan, fields).values()
    begin = start or "1"
    grown = f"((1D + {firm_discount}) / (1D + {discount}))"
    shrunk = grown if firm_on_continuous else f"(1D / (1D + {discount}))"
    falling = f"({shrunk} / IF({trend} = 0, 1D, 1D + {trend}))"
    paid = f"greatest(least({period} - {begin}, coalesce(CAST(floor({length}) AS INT), 0)), 0)"
    first = f"IF({paid} >= 1, {total} * {initial} * power({grown}, CAST({begin} - 1 AS DOUBLE)), 0D)"
    rest = f"{total} * (1D - {initial}) / greatest({length} - 1D, 1D)"
    return f"""
        CASE WHEN {total} > 0 THEN
            CASE WHEN {initial} > 0
                 THEN {first} + {rest} * {geometric_sql(grown, f"({begin} + 1)", f"({paid} - 1)")}
                 ELSE {total} / greatest({length}, 1D) * {geometric_sql(grown, begin, paid)} END
        ELSE {ongoing} * {geometric_sql(falling, "1", f"({period} - 1)")} END"""
