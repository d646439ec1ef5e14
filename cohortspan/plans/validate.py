"""Checks of a whole model: limits, unmatched plans and rules the pipeline relies on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.operators.checks import range_violations, violation, violations
from cohortspan.operators.columns import fill_defaults
from cohortspan.session import meet
from cohortspan.tables import (
    GLOBAL_FIELDS,
    LEGACY_TREATMENT_DEFAULTS,
    PAYMENT_DEFAULTS,
    LegacyBundle,
    ModelBundle,
)


def _lost(keys: list[str], table: str, other: str) -> Column:
    """A violation where a plan is named that the other table lacks (``known`` is null)."""
    message = F.concat(F.lit("The payment plan: '"), F.col("payment"), F.lit(f"' cannot be found in: {other}"))
    given = F.col("payment").isNotNull() & F.col("known").isNull()
    for key in keys:
        given = given & F.col(key).isNotNull()
    return F.when(given, violation(table, F.lit("payment"), F.col("row_id"), message))


def _state_rows(bundle: ModelBundle) -> DataFrame:
    """States beside what is known of their plan: ``known``, and ``total``, whether it has one."""
    keys = list(bundle.keys)
    plans = fill_defaults(bundle.payments, PAYMENT_DEFAULTS).groupBy(*keys, "payment")
    facts = plans.agg(F.lit(True).alias("known"), F.max(F.col("tot_payment") > 0).alias("total"))
    return bundle.states.join(facts, [*keys, "payment"], "left")


def _state_errors(bundle: ModelBundle) -> Column:
    """Violations of a row of ``_state_rows``."""
    limits = range_violations(bundle.states, bundle.state_fields, "state", "row_id", keys=bundle.keys)
    return F.concat(limits, violations([_lost(list(bundle.keys), "state_table", "payment_table")]))


def _plan_errors(bundle: ModelBundle, limits: bool, rules: bool) -> DataFrame:
    """Violations of plans, all from one reading of them beside the plans that states use."""
    keys, found = list(bundle.keys), []
    rows = bundle.payments
    if limits:
        used = bundle.states.select(*keys, "payment").distinct().withColumn("known", F.lit(True))
        rows = rows.join(used, [*keys, "payment"], "left")
        found.append(range_violations(bundle.payments, bundle.payment_fields, "payment", "row_id", keys=keys))
        found.append(violations([_lost(keys, "payment_table", "state_table")]))
    if rules:
        # filled cells stay beside those given, which the limits are for
        own = fill_defaults(rows.withColumn("__row", F.struct(*[F.col(c) for c in rows.columns])), PAYMENT_DEFAULTS)
        rows = own.select("__row.*", F.struct(*PAYMENT_DEFAULTS).alias("__filled"))
        filled = {name: F.col(f"__filled.{name}") for name in PAYMENT_DEFAULTS}
        total = filled["tot_payment"] > 0
        no_length = F.concat(F.lit("No instalment to pay the total of: "), F.col("payment"))
        both = F.concat(F.lit("Both a total and a continuous payment: "), F.col("payment"))
        broken = {
            "contract_length": (filled["contract_length"] < 1, no_length),
            "cont_payment": (filled["cont_payment"] > 0, both),
        }
        found.append(
            violations(
                [
                    F.when(total & is_broken, violation("payment_table", F.lit(column), F.col("row_id"), message))
                    for column, (is_broken, message) in broken.items()
                ]
            )
        )
    return rows.select(*keys, F.concat(*found).alias("found"))


def _treatment_errors(bundle: ModelBundle, limits: bool) -> DataFrame:
    """Violations of treatments, and of their states with ``limits``, from one grouping of the states.

    A treatment's states fit one row, as they do in the analysis.
    """
    keys = list(bundle.keys)
    row = F.struct("state", "row_id", F.col("payment").isNull().alias("free"))
    facts = {
        "first": F.min("state"),
        "n": F.count("state"),
        "kinds": F.size(F.collect_set("state")),
        "row": F.min("row_id"),
        "totals": F.size(F.collect_set(F.when(F.col("total"), F.col("payment")))),
        "total_row": F.min(F.when(F.col("total"), F.col("row_id"))),
        "last": F.max(row),
        "free": F.count_if(F.col("payment").isNull()),
    }
    if limits:
        facts["rows"] = F.flatten(F.collect_list("found"))
    rows = _state_rows(bundle)
    if limits:
        rows = rows.withColumn("found", _state_errors(bundle))
    grouped = rows.groupBy(*keys, "treatment").agg(*[value.alias(name) for name, value in facts.items()])
    # An array of its states stands for a treatment, so no state may lie far out.
    longest = next(most for name, _, _, _, most, _ in GLOBAL_FIELDS if name == "time_horizon")
    name = F.col("treatment")
    broken = [
        (F.col("totals") > 1, "payment", "total_row", F.concat(name, F.lit(" uses several plans with a total"))),
        (
            (F.col("first") != 1) | (F.col("n") != F.col("kinds")),
            "state",
            "row",
            F.concat(F.lit("States must start at 1 and increase: "), name),
        ),
        (F.col("last.state") > longest, "state", "last.row_id", F.concat(F.lit("States beyond the longest horizon: "), name)),
        (
            F.col("free") > F.when(F.col("last.free"), 1).otherwise(0),
            "payment",
            "last.row_id",
            F.concat(F.lit("A state before the last has no plan: "), name),
        ),
    ]
    own = violations(
        [
            F.when(is_broken, violation("state_table", F.lit(column), F.col(at), message))
            for is_broken, column, at, message in broken
        ]
    )
    return grouped.select(*keys, F.concat(own, F.col("rows")).alias("found") if limits else own.alias("found"))


def _listed(bundle: ModelBundle, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).select(*bundle.keys, F.inline("found"))


def check_model(bundle: ModelBundle) -> DataFrame:
    """All violations of a model as ``(keys, table, column, row, message)``: values beyond their limits
    and plans that only one of the two tables has."""
    states = _state_rows(bundle).select(*bundle.keys, _state_errors(bundle).alias("found"))
    return _listed(bundle, [states, _plan_errors(bundle, limits=True, rules=False)])


def check_rules(bundle: ModelBundle) -> DataFrame:
    """Models that the analysis cannot price as they stand.

    A treatment may use one plan with a total only, such a plan needs an instalment and pays nothing
    continuously, the states of a treatment start at 1, rise, end by the longest horizon, and all but
    the last have a plan.
    """
    return _listed(bundle, [_treatment_errors(bundle, limits=False), _plan_errors(bundle, limits=False, rules=True)])


def check(bundle: ModelBundle) -> DataFrame:
    """``check_model`` and ``check_rules`` together, in one pass over each table (and one over the
    names of plans in the other)."""
    return _listed(bundle, [_treatment_errors(bundle, limits=True), _plan_errors(bundle, limits=True, rules=True)])


def check_contracts(bundle: LegacyBundle) -> DataFrame:
    """Contracts whose end lies beyond the treatment's states or not after their start."""
    keys = list(bundle.keys)
    start = F.coalesce(F.col("start"), F.lit(1)) if "start" in bundle.contracts.columns else F.lit(1)
    states = bundle.treatments.select(*keys, "plan", "health_states").distinct()
    message = F.when(
        F.col("end") > F.col("health_states"),
        F.lit("end is set greater than number of health states"),
    ).when(F.col("end") <= start, F.lit("end has to be later than start"))
    return (
        meet(bundle.contracts, states, [*keys, "plan"])
        .select(
            *keys,
            F.lit("contracts").alias("table"),
            F.lit("end, health_states").alias("column"),
            F.col("row_id").cast("long").alias("row"),
            message.alias("message"),
        )
        .where("message IS NOT NULL")
    )


def check_treatments(bundle: LegacyBundle) -> DataFrame:
    """Legacy treatments with too few states for their random state."""
    few = F.when(
        F.col("health_states") < 2,
        F.format_string(
            "health_states must be at least 2, now: %d", F.col("health_states").cast("long")
        ),
    ).when(
        F.col("health_states") <= F.coalesce(F.col("random_state"), F.lit(1)) + 1,
        F.lit("The random_state is too big compared with the number of health_states"),
    ).when(
        F.coalesce(F.col("p_HU"), F.lit(1.0)) + F.coalesce(F.col("p_HD"), F.lit(0.0)) > 1,
        F.lit("Probabilities add up to more than 1"),
    )
    treatments = fill_defaults(bundle.treatments, LEGACY_TREATMENT_DEFAULTS, blank=None)
    return treatments.select(
        *bundle.keys,
        F.lit("treatments").alias("table"),
        F.lit("health_states").alias("column"),
        F.col("row_id").cast("long").alias("row"),
        few.alias("message"),
    ).where("message IS NOT NULL")
