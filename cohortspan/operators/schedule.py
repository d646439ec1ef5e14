"""Payment schedules of contract tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.functions import payment_sql

PLAN_FIELDS = (
    "tot_payment",
    "cont_payment",
    "cost_trend",
    "contract_length",
    "initial_payment",
)


def payment_schedule(
    plans: DataFrame,
    horizon: str,
    *,
    columns: dict[str, str] | None = None,
    discount: str = "0D",
    firm_discount: str = "0D",
    start: str | None = None,
    only_due: bool = False,
    mode: str = "current",
    time: str = "time",
    payment: str = "payment",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """One row per contract and period with the amount due.

    Works on any table. ``horizon``, ``start``, the rates and the values of ``columns`` are SQL
    over ``plans``; ``columns`` names the plan fields that are not columns of ``plans`` (a field
    named nowhere counts as 0). ``only_due`` leaves out the periods after the last instalment of
    plans with a total. ``mode="legacy"`` applies the firm's rate to continuous plans too and
    starts in period 1.
    """
    given = columns or {}
    fields = {
        name: f"CAST({given.get(name, name if name in plans.columns else '0')} AS DOUBLE)"
        for name in PLAN_FIELDS
    }
    begin = None if mode == "legacy" else start
    last = f"CAST({horizon} AS INT)"
    if only_due:
        due = f"{begin or 1} + CAST({fields['contract_length']} AS INT) - 1"
        last = f"IF({fields['tot_payment']} > 0, least({last}, {due}), {last})"
    amount = payment_sql(
        time,
        fields=fields,
        discount=discount,
        firm_discount=firm_discount,
        start=begin,
        firm_on_continuous=mode == "legacy",
    )
    kept = [c for c in (plans.columns if keep is None else keep) if c != payment]
    # sequence() would count down for a last period below 1.
    return (
        plans.where(f"{last} >= 1")
        .selectExpr("*", f"explode(sequence(1, greatest({last}, 1))) AS {time}")
        .select(*kept, time, F.expr(amount).alias(payment))
    )
