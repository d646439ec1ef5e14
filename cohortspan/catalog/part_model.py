"""A model per part: a treated arm and an untreated one, priced by two plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspan.tables import ModelBundle

HORIZON, DISCOUNT, FIRM = 20, 0.03, 0.1

_GLOBALS = f"""stack(4, 'discount', {DISCOUNT}D, 'firm_discount', {FIRM}D,
    'time_horizon', {HORIZON}D, 'control_count', 1D) AS (name, value)"""


def _state(treatment: str, state: int, p_prog: str, qol: float, p_death: float, pay: str) -> str:
    return (
        f"named_struct('treatment', '{treatment}', 'state', {state}, 'p_prog', {p_prog}, "
        f"'QoL', {qol}D, 'p_death', {p_death}D, 'payment', {pay})"
    )


def _states() -> str:
    chance = "CAST((p_size % 10 + 1) / 20D AS DOUBLE)"
    rows = []
    for arm, first, plan in (("active", chance, "'fixed'"), ("control", "1D", "'cont'")):
        rows += [
            _state(arm, 1, first, 1.0, 0.01, plan),
            _state(arm, 2, "1D", 0.67, 0.02, "'cont'"),
            _state(arm, 3, "1D", 0.33, 0.02, "'cont'"),
            _state(arm, 4, "0D", 0.0, 0.0, "CAST(NULL AS STRING)"),
        ]
    return f"inline(array({', '.join(rows)}))"


def part_bundle(spark: SparkSession, sf_dir: str, **terms: float) -> ModelBundle:
    """``terms`` sets further fields of the plan with a total, such as ``refund``."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS scenario_id", "p_size", "p_retailprice"
    )
    fixed = {
        "tot_payment": "p_retailprice / 100D",
        "cont_payment": "0D",
        "contract_length": "CAST(1 + p_size % 10 AS DOUBLE)",
        **{name: f"{value}D" for name, value in terms.items()},
    }
    ongoing = {**{name: "0D" for name in fixed}, "cont_payment": "0.1D"}

    def row(name: str, fields: dict[str, str]) -> str:
        pairs = ", ".join(f"'{k}', {v}" for k, v in fields.items())
        return f"named_struct('payment', '{name}', {pairs})"

    plans = f"inline(array({row('fixed', fixed)}, {row('cont', ongoing)}))"
    return ModelBundle(
        states=part.selectExpr("scenario_id", _states()),
        payments=part.selectExpr("scenario_id", plans),
        globals=part.selectExpr("scenario_id", _GLOBALS),
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
