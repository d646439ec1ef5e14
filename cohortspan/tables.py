"""Schemas, fixed field descriptions and the model bundle."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STATE_COLUMNS = {
    "treatment": "string",
    "state": "int",
    "p_prog": "double",
    "QoL": "double",
    "p_death": "double",
    "payment": "string",
}

PAYMENT_COLUMNS = {
    "payment": "string",
    "tot_payment": "double",
    "cont_payment": "double",
    "cost_trend": "double",
    "contract_length": "double",
    "initial_payment": "double",
    "refund": "double",
    "aggregate_failure": "double",
}

GLOBAL_COLUMNS = {"name": "string", "value": "double"}

FIELD_COLUMNS = {
    "name": "string",
    "title": "string",
    "value": "double",
    "min": "double",
    "max": "double",
    "description": "string",
}

LEGACY_TREATMENT_COLUMNS = {
    "plan": "int",
    "name": "string",
    "p_HU": "double",
    "p_HD": "double",
    "p_UD": "double",
    "health_states": "int",
    "QoL_start": "double",
    "QoL_end": "double",
    "random_state": "int",
    "random_state2": "int",
    "p_HU2": "double",
}

LEGACY_CONTRACT_COLUMNS = {
    "plan": "int",
    "name": "string",
    "tot_payment": "double",
    "cont_payment": "double",
    "contract_length": "double",
    "initial_payment": "double",
    "refund": "double",
    "start": "int",
    "end": "int",
    "cost_trend": "double",
    "aggregate_failure": "double",
}

# Fixed values: (name, title, default, min, max, description) of every input field. Names,
# titles, defaults and limits are part of the data format.
STATE_FIELDS = [
    ("treatment", "Treatment", None, None, None, "Name of the treatment arm"),
    ("payment", "Payment", None, None, None, "Payment plan in force in the state"),
    ("state", "State", None, 1.0, None, "Number of the health state"),
    ("p_prog", "Pr.prog", 0.0, 0.0, 1.0, "Chance of moving to the next state"),
    ("p_death", "Pr.death", 0.0, 0.0, 1.0, "Chance of dying"),
    ("QoL", "QoL", None, 0.0, 1.0, "Quality of life weight"),
]
PAYMENT_FIELDS = [
    ("payment", "Payment", None, None, None, "Name of the payment plan"),
    ("tot_payment", "Tot. payment", 0.0, 0.0, None, "Total to be paid"),
    ("cont_payment", "Cont. payment", 0.0, 0.0, None, "Payment in each period in the state"),
    ("cost_trend", "Cost Trend", 0.0, -0.1, 0.1, "Yearly fall of a continuous payment"),
    ("contract_length", "Periods", 20.0, 0.0, 100.0, "Number of instalments"),
    ("initial_payment", "Initial", 0.0, 0.0, 1.0, "Share paid in the first instalment"),
    ("refund", "Refund", 0.0, 0.0, 1.0, "Share paid back on failure"),
    ("aggregate_failure", "Agg. Fail", 0.0, 0.0, 1.0, "Failing share that stops the plan"),
]
GLOBAL_FIELDS = [
    ("discount", "HA discount", 0.0, 0.0, 0.2, "Discount rate of the payer"),
    ("firm_discount", "Firm discount", 0.0, 0.0, 0.2, "Discount rate of the firm"),
    ("time_horizon", "Time horizon", 20.0, 1.0, 100.0, "Number of periods"),
    ("control_count", "Control count", 1.0, 1.0, None, "Number of control treatments"),
]

PAYMENT_DEFAULTS = {name: value for name, _, value, *_ in PAYMENT_FIELDS if value is not None}
GLOBAL_DEFAULTS = {name: value for name, _, value, *_ in GLOBAL_FIELDS}
# What an absent legacy column means.
LEGACY_TREATMENT_DEFAULTS = {
    "p_HU": 1.0,
    "p_HD": 0.0,
    "p_UD": 0.0,
    "QoL_start": 1.0,
    "QoL_end": 0.0,
    "random_state": 1,
    "random_state2": 0,
    "p_HU2": 0.0,
}
LEGACY_CONTRACT_DEFAULTS = {
    "tot_payment": 0.0,
    "cont_payment": 0.0,
    "contract_length": 0.0,
    "initial_payment": 0.0,
    "refund": 0.0,
    "start": 1,
    "end": 2,
    "cost_trend": 0.0,
    "aggregate_failure": 0.0,
}

SCENARIO = "scenario_id"
# Key of the copies of a scenario in a sweep.
VARIANT = "variant_id"


def struct_of(columns: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items()))


def fields_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, struct_of(FIELD_COLUMNS))


@dataclass(frozen=True)
class ModelBundle:
    """The tables of one or many models.

    ``keys`` names the scenario columns that every data table carries. Field tables describe
    columns, hold a row per column and carry no key. ``grid`` belongs to sweeps: the combinations of
    cell values (``plans.grid.Grid``) that the models are analysed for. ``base`` is the bundle that
    these tables are copies of, one for each combination.
    """

    states: DataFrame
    payments: DataFrame
    globals: DataFrame
    state_fields: DataFrame | None = None
    payment_fields: DataFrame | None = None
    global_fields: DataFrame | None = None
    keys: tuple[str, ...] = field(default=(SCENARIO,))
    grid: object | None = None
    base: ModelBundle | None = None

    @property
    def plain(self) -> ModelBundle:
        """The bundle whose scenarios have as many rows, at the least cost."""
        return self if self.base is None else self.base

    def with_tables(self, **tables) -> ModelBundle:
        return replace(self, **{"base": None, **tables})


@dataclass(frozen=True)
class LegacyBundle:
    """Plan-matched treatments and contracts of one or many models; ``base`` as in ``ModelBundle``."""

    treatments: DataFrame
    contracts: DataFrame
    globals: DataFrame
    keys: tuple[str, ...] = field(default=(SCENARIO,))
    base: LegacyBundle | None = None

    @property
    def plain(self) -> LegacyBundle:
        """The bundle whose scenarios have as many rows, at the least cost."""
        return self if self.base is None else self.base

    def with_tables(self, **tables) -> LegacyBundle:
        return replace(self, **{"base": None, **tables})
