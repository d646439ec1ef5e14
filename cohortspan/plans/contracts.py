"""Plan-matched treatments and contracts: the older model form.

A treatment is one row of parameters, so its chain is built inside the row. Treatments are
shuffled once, by plan; contracts join them there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.functions import discount_factor, discount_factor_sql, linear_ramp_sql, paid_before_sql, payment_sql
from cohortspan.operators.chain import project_shares, transition_table
from cohortspan.operators.columns import fill_defaults, parameters, with_parameters
from cohortspan.operators.schedule import payment_schedule
from cohortspan.operators.scan import ordered_scan, position
from cohortspan.plans.cohort import compare_arms
from cohortspan.session import large_keys, meet, spread
from cohortspan.tables import LEGACY_CONTRACT_DEFAULTS, LEGACY_TREATMENT_DEFAULTS, LegacyBundle

LEGACY_GLOBALS = {"discount": 0.0, "firm_discount": 0.0, "time_horizon": 20.0}

_STATES = "sequence(1, health_states)"


def treatment_edges() -> str:
    """SQL for the edges of a treatment row.

    Every state steps on with ``1 - p_UD`` or dies with ``p_UD``; the one before death always
    dies. The random state stays, steps on with ``p_HU`` or dies with ``p_HD``; a second one,
    when set, steps on with ``p_HU2`` or dies with ``p_UD`` (which replaces the step on where
    the next state is death).
    """

    def edge(target: str, p: str) -> str:
        return f"named_struct('from_state', i, 'to_state', {target}, 'p', {p})"

    n = "health_states"
    second = f"""array_compact(array({edge("i", "1D - p_HU2 - p_UD")},
        IF(i + 1 < {n}, {edge("i + 1", "p_HU2")}, NULL), {edge(n, "p_UD")}))"""
    first = f"""array({edge("i", "1D - p_HU - p_HD")}, {edge("i + 1", "p_HU")},
        {edge(n, "p_HD")})"""
    return f"""flatten(transform({_STATES}, i -> CASE
        WHEN i = {n} THEN array({edge("i", "1D")})
        WHEN i = random_state2 THEN {second}
        WHEN i = random_state THEN {first}
        WHEN i = {n} - 1 THEN array({edge("i + 1", "1D")})
        ELSE array({edge("i + 1", "1D - p_UD")}, {edge(n, "p_UD")}) END))"""


def quality_ramp() -> str:
    """SQL for the QoL of each state: a line from start to end, then 0 when the end is above 0."""
    line = linear_ramp_sql("QoL_start", "QoL_end", "health_states")
    short = linear_ramp_sql("QoL_start", "QoL_end", "health_states - 1")
    return f"IF(QoL_end > 0, concat({short}, array(0D)), {line})"


def complete_treatments(treatments: DataFrame) -> DataFrame:
    """Optional columns filled: absent ones and blank cells both get their default."""
    return _complete(treatments, LEGACY_TREATMENT_DEFAULTS)


def complete_contracts(contracts: DataFrame) -> DataFrame:
    return _complete(contracts, LEGACY_CONTRACT_DEFAULTS)


def _complete(df: DataFrame, defaults: dict) -> DataFrame:
    filled = fill_defaults(df, defaults, blank=None)
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def quality_table(bundle: LegacyBundle) -> DataFrame:
    """``name, state, QoL`` of each treatment."""
    return complete_treatments(bundle.treatments).select(
        *bundle.keys, "plan", "name", F.expr(f"posexplode({quality_ramp()}) AS (at, QoL)")
    ).selectExpr(*bundle.keys, "plan", "name", "at + 1 AS state", "QoL")


def treatment_transitions(bundle: LegacyBundle) -> DataFrame:
    """Long transition matrix of each treatment."""
    return complete_treatments(bundle.treatments).select(
        *bundle.keys, "plan", F.col("name").alias("treatment"),
        F.expr(f"inline({treatment_edges()})"),
    )


def treatment_table(bundle: LegacyBundle, count: int, partitions: int | None = None) -> DataFrame:
    """Transition matrix of each treatment of ``count`` states, a row per state.

    Treatments are spread before they become many edges, so that no task sums up more than its part.
    """
    spread_out = bundle.with_tables(treatments=spread(bundle.treatments, [*bundle.keys, "name"], partitions))
    return transition_table(treatment_transitions(spread_out), bundle.keys, count, legacy=True)


def contract_payments(contracts: DataFrame) -> DataFrame:
    """Undiscounted instalments of each contract, over its length."""
    return payment_schedule(
        complete_contracts(contracts), "contract_length", mode="legacy", only_due=True
    )


def payment_plans(bundle: LegacyBundle) -> DataFrame:
    """``payment_plan, time, payment`` of each contract over the horizon."""
    keys = list(bundle.keys)
    plans = with_parameters(complete_contracts(bundle.contracts), rates(bundle), keys, LEGACY_GLOBALS, "name")
    named = plans.withColumnRenamed("name", "payment_plan")
    return payment_schedule(
        named,
        "time_horizon",
        discount="discount",
        firm_discount="firm_discount",
        mode="legacy",
        keep=[*keys, "plan", "payment_plan"],
    )


def forecast_variant(series: DataFrame, source: str, label: str, rate: float) -> DataFrame:
    """The series with a copy of one plan under a new label, discounted further by ``rate``."""
    copy = series.where(F.col("payment_plan") == source).select(
        *[
            {
                "payment_plan": F.lit(label).alias("payment_plan"),
                "payment": (F.col("payment") * discount_factor(F.lit(rate), F.col("time"))).alias(
                    "payment"
                ),
            }.get(c, F.col(c))
            for c in series.columns
        ]
    )
    return series.unionByName(copy)


def rates(bundle: LegacyBundle) -> DataFrame:
    return parameters(bundle.globals, bundle.keys, LEGACY_GLOBALS)


#: Treatments of a plan that are matched with its contracts in one place.
MATCHED = 1024


def _plan_blocks(bundle: LegacyBundle) -> DataFrame:
    """``plan, blocks``: how many places the treatments of a plan are dealt to, for plans with several.

    There is one such plan for ``MATCHED`` treatments at most, so these can be sent to all tasks.
    """
    plain = bundle.plain
    large = large_keys(plain.treatments, [*plain.keys, "plan"], "name", MATCHED)
    return large.withColumnRenamed("__blocks", "blocks")


def projected_treatments(bundle: LegacyBundle, partitions: int | None = None) -> DataFrame:
    """One row per treatment with rates, QALY by period and projected shares.

    Treatments of a plan that has very many are dealt into blocks by a hash of their names, numbered
    ``block``, so that a plan doesn't have to fit one task.
    """
    keys = list(bundle.keys)
    treatments = complete_treatments(bundle.treatments).join(
        F.broadcast(_plan_blocks(bundle)), [*bundle.plain.keys, "plan"], "left"
    )
    dealt = treatments.withColumn("block", F.expr("pmod(xxhash64(name), coalesce(blocks, 1))"))
    rated = with_parameters(dealt, rates(bundle), keys, LEGACY_GLOBALS, "name", bundle.plain.treatments)
    rows = spread(rated, [*keys, "plan", "block"], partitions)
    shares = project_shares(
        treatment_edges(), "health_states", "CAST(time_horizon AS INT)"
    )
    weighed = f"""transform(shares, (x, i) ->
        aggregate(zip_with(x, weights, (share, q) -> share * q), 0D, (total, part) -> total + part)
        * {discount_factor_sql("discount", "(i + 1)")})"""
    return (
        rows.withColumn("shares", F.expr(shares))
        .withColumn("weights", F.expr(quality_ramp()))
        .select(*keys, "plan", "block", "name", *LEGACY_GLOBALS, "shares", F.expr(weighed).alias("health"))
    )


def _matched(bundle: LegacyBundle, partitions: int | None) -> DataFrame:
    """One row per treatment and matching contract with its terms, shares and QALY by period.

    Contracts go to each block of their plan's treatments.
    """
    keys = list(bundle.keys)
    # A plan has as few contracts as a model lists.
    numbered = ordered_scan(
        complete_contracts(bundle.contracts), [*keys, "plan"], ["row_id"], cuts=None, nth=position()
    )
    contracts = numbered.join(F.broadcast(_plan_blocks(bundle)), [*bundle.plain.keys, "plan"], "left").select(
        *keys,
        "plan",
        F.expr("explode(sequence(0L, coalesce(blocks, 1) - 1L)) AS block"),
        F.col("name").alias("contract"),
        "nth",
        *LEGACY_CONTRACT_DEFAULTS,
    )
    matching = [*keys, "plan", "block"]
    return projected_treatments(bundle, partitions).join(spread(contracts, matching, partitions).hint("merge"), matching)


#: Figures of a matched row in the period with shares ``x`` and 0-based number ``i``.
_COSTS = payment_sql("(i + 1)", firm_on_continuous=True)
_CUMCOSTS = f"""IF(i = 0 OR (i + 1 > contract_length AND contract_length < time_horizon), 0D,
    {paid_before_sql("(i + 1)", firm_on_continuous=True)})"""
_FAILING = "coalesce(get(x, `end` - 1), 0D)"
_CUMFAIL = """aggregate(slice(shares, 1, i + 1), 0D,
    (total, s) -> total + coalesce(get(s, `end` - 1), 0D))"""
_PAYING = """IF(`end` = 2, x[0], aggregate(slice(x, start, greatest(`end` - start, 0)), 0D,
    (total, part) -> total + part))"""
_PAYMENT = f"""IF(aggregate_failure > 0, IF({_CUMFAIL} < aggregate_failure, {_COSTS}, 0D),
    {_PAYING} * ({_COSTS}) - {_FAILING} * refund * {_CUMCOSTS})"""


def contract_series(bundle: LegacyBundle, partitions: int | None = None) -> DataFrame:
    """One row per treatment, matching contract and period.

    ``failing`` is the share in the contract's end state. Payment is due for the states from
    start to before end (state 1 alone when the contract ends in state 2), less the refund to the
    failing of what was paid before; with an aggregate rule everybody pays until the failing
    shares sum up to its level.
    """
    named = [*bundle.keys, "plan", "name", "contract", "nth"]
    periods = _matched(bundle, partitions).selectExpr("*", "posexplode_outer(shares) AS (i, x)")
    figures = periods.selectExpr(
        *named,
        "refund",
        "aggregate_failure",
        "i + 1 AS time",
        "get(health, i) AS QALY",
        f"{_FAILING} AS failing",
        f"{_COSTS} AS costs",
        f"{_CUMCOSTS} AS cumcosts",
        f"{_CUMFAIL} AS cumfail",
        f"{_PAYING} AS paying",
    )
    return figures.selectExpr(
        *named,
        "time",
        "QALY",
        "failing",
        """IF(aggregate_failure > 0, IF(cumfail < aggregate_failure, costs, 0D),
            paying * costs - failing * refund * cumcosts) AS payment""",
        "costs",
        "cumcosts",
        "failing * refund * cumcosts AS reimburse",
        "cumfail",
        "IF(cumfail < aggregate_failure, 1D, 0D) AS aggcond",
    )


def over_time(bundle: LegacyBundle, partitions: int | None = None) -> DataFrame:
    """``name, plan, contract, time, QALY, Cost``.

    A treatment's QALY stands on its first contract, so that sums count it once.
    """
    once = F.expr("IF(nth = 1, QALY, NULL)").alias("QALY")
    series = contract_series(bundle, partitions)
    return series.select(*bundle.keys, "name", "plan", "contract", "time", once, F.col("payment").alias("Cost"))


def _folded(bundle: LegacyBundle, partitions: int | None) -> DataFrame:
    """``name, plan, contract, QALY, Cost`` of each match, its periods summed up inside the row; null
    where no period has a value."""

    def whole(values: str) -> str:
        given = f"filter({values}, v -> v IS NOT NULL)"
        total = "aggregate(given, 0D, (total, v) -> total + v)"
        return f"transform(array({given}), given -> IF(size(given) = 0, NULL, {total}))[0]"

    return _matched(bundle, partitions).selectExpr(
        *bundle.keys,
        "name",
        "plan",
        "contract",
        f"IF(nth = 1, {whole('health')}, NULL) AS QALY",
        f"{whole(f'transform(shares, (x, i) -> {_PAYMENT})')} AS Cost",
    )


def details(bundle: LegacyBundle, partitions: int | None = None) -> DataFrame:
    """``name, plan, contract, QALY, Cost`` totals over the horizon; contracts of one name together."""
    return (
        _folded(bundle, partitions)
        .groupBy(*bundle.keys, "name", "plan", "contract")
        .agg(F.sum("QALY").alias("QALY"), F.sum("Cost").alias("Cost"))
    )


def arm_totals(bundle: LegacyBundle, partitions: int | None = None) -> DataFrame:
    """``name, plan, QALY, Cost`` summed over contracts, blanks counting as nothing."""
    return (
        _folded(bundle, partitions)
        .groupBy(*bundle.keys, "name", "plan")
        .agg(
            F.expr("coalesce(sum(QALY), 0D)").alias("QALY"),
            F.expr("coalesce(sum(Cost), 0D)").alias("Cost"),
        )
    )


def compare_plans(
    bundle: LegacyBundle,
    active_plans: Sequence[int] | None = None,
    control_plan: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """Treatments of each active plan (all but the control plan by default) against controls.

    ``plan`` is no more than a filter on treatments, so only those compared are projected, once. A
    plan may be active and control.
    """
    control = F.col("plan") == control_plan
    active = ~control if active_plans is None else F.col("plan").isin(list(active_plans))
    arms = arm_totals(bundle, partitions).where(active | control)
    sides = F.array_compact(F.array(F.when(active, F.lit(False)), F.when(control, F.lit(True))))
    keys = list(bundle.keys)
    counts = bundle.treatments.groupBy(*keys).agg(
        F.count_if(active).alias("actives"), F.count_if(control).alias("controls")
    )
    sided = arms.withColumn("is_control", F.explode(sides))
    sized = meet(sided, counts, keys, deal="name", counted=bundle.plain.treatments, partitions=partitions)
    return compare_arms(sized, keys, name="name")
