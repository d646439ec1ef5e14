"""Cost and quality-adjusted life years of cohorts moving through priced health states.

Shuffles of the pipeline: knots by treatment into an explicit number of partitions, and the few
plans each treatment uses by plan and back. All that multiplies rows (periods x states) comes
after the last of them and stays inside its partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.functions import arm_label, discount_factor_sql, paid_before_sql, payment_sql, ratio
from cohortspan.operators.chain import (
    expanded_states,
    gather_chains,
    progressive_edges,
    project_shares,
)
from cohortspan.operators.columns import fill_defaults, parameters, with_parameters
from cohortspan.operators.expand import expand_states
from cohortspan.operators.scan import find_cuts, group_size, ordered_scan, position
from cohortspan.operators.schedule import payment_schedule
from cohortspan.plans.grid import RATES as _RATES
from cohortspan.session import meet, spread
from cohortspan.tables import GLOBAL_DEFAULTS, PAYMENT_DEFAULTS, VARIANT, ModelBundle

REFUND = "Refund"
QALY = "QALY"


def global_record(bundle: ModelBundle) -> DataFrame:
    """One row of rates, horizon and control count per scenario."""
    return parameters(bundle.globals, bundle.keys, GLOBAL_DEFAULTS)


def _rates(bundle: ModelBundle) -> DataFrame:
    """Rates by scenario; in a sweep by scenario and setting, numbered ``__rates``."""
    if bundle.grid is None:
        return global_record(bundle).select(*bundle.keys, *_RATES)
    varied = bundle.grid.rates(bundle.globals)
    return parameters(varied, [*bundle.keys, "__rates"], GLOBAL_DEFAULTS).select(*bundle.keys, "__rates", *_RATES)


def plan_terms(bundle: ModelBundle) -> DataFrame:
    """One row per plan, and one for "no plan", with terms and the scenario's rates.

    The row without a plan lets states without one receive their rates by the same join. In a sweep
    there is a row for each setting of the plan's cells and the rates, numbered ``variant_id``.
    """
    keys, grid, rates = list(bundle.keys), bundle.grid, _rates(bundle)
    none = rates.withColumn("payment", F.lit(None).cast("string"))
    if grid is None:
        plans = fill_defaults(bundle.payments, PAYMENT_DEFAULTS).select(*keys, "payment", *PAYMENT_DEFAULTS)
        none = none.select(*keys, "payment")
        every = plans.unionByName(none, allowMissingColumns=True)
        return meet(every, rates, keys, deal="payment", counted=bundle.plain.payments)
    plans = fill_defaults(grid.payments(bundle.payments), PAYMENT_DEFAULTS)
    plans = meet(plans.select(*keys, "__plan", "payment", *PAYMENT_DEFAULTS), rates, keys, deal="payment")
    terms = plans.unionByName(none, allowMissingColumns=True)
    number = F.expr("coalesce(__plan, 0L) + coalesce(__rates, 0L)")
    return terms.withColumn(VARIANT, number).drop("__plan", "__rates")


def _with_terms(bundle: ModelBundle, uses: DataFrame, terms: DataFrame, partitions: int | None) -> DataFrame:
    """The plans that treatments use beside their terms. States tell how often a plan is used at most."""
    counted = bundle.plain.states
    return meet(uses, terms, bundle.keys, safe=["payment"], deal="treatment", counted=counted, partitions=partitions)


def _plan_ranges() -> str:
    """SQL for the plans of a chain's ``knots`` with their first and last state.

    A knot covers the states up to the next one, so no state has to be expanded for this.
    """
    ranges = """filter(transform(knots, (k, j) -> named_struct('payment', k.payment,
        'low', k.state - knots[0].state + 1,
        'high', coalesce(get(knots, j + 1).state, k.state + 1) - knots[0].state)),
        r -> r.high >= r.low)"""
    return f"""transform(array({ranges}), every -> transform(array_distinct(every.payment),
        p -> named_struct('payment', p,
            'pstart', array_min(filter(every, r -> r.payment <=> p).low),
            'pend', array_max(filter(every, r -> r.payment <=> p).high))))[0]"""


_KNOT = ["p_prog", "QoL", "p_death", "payment"]
_SHARES = project_shares(progressive_edges(), "size(states)", "time_horizon")


def _chains_and_uses(states: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Each treatment with its states, and the plans that it uses with their spans."""
    named = [*keys, "treatment"]
    knots = gather_chains(states, keys, _KNOT)
    fields = ["p_prog", "p_death", "payment"]
    chains = knots.select(*named, F.expr(expanded_states(fields)).alias("states"))
    uses = knots.selectExpr(*named, f"inline_outer({_plan_ranges()}) AS (payment, pstart, pend)")
    return chains, uses


def _varied_rows(
    bundle: ModelBundle, span_scope: str, partitions: int | None, arms: DataFrame | None
) -> DataFrame:
    """``cohort_rows`` for a sweep: a row for each setting of the cells that touch an arm.

    A version of an arm's states is gathered and projected once, up to the longest horizon of its
    scenario. A plan's terms travel as one array of all their settings, so joins take a row per arm and
    plan; settings are told apart after the last of them, inside the row.
    """
    keys, grid = list(bundle.keys), bundle.grid
    named = [*keys, "treatment"]
    knots = gather_chains(spread(grid.states(bundle.states), named, partitions), [*keys, "__chain"], _KNOT)
    knots = knots.withColumn("__touched", F.expr(grid.touched("treatment", "knots.payment")))
    longest = _rates(bundle).groupBy(*keys).agg(F.max("time_horizon").alias("time_horizon"))
    horizon = F.coalesce("time_horizon", F.lit(GLOBAL_DEFAULTS["time_horizon"])).cast("int")
    states = expanded_states(["p_prog", "p_death", "payment"])
    chains = (
        knots.select(*named, "__chain", "__touched", F.expr(states).alias("states"))
        .transform(lambda made: meet(made, longest, keys, deal="treatment", counted=bundle.states, partitions=partitions))
        .withColumn("time_horizon", horizon)
        .select(*named, "__chain", "__touched", "states", F.expr(_SHARES).alias("shares"))
    )
    # all versions of an arm use the same plans in the same states
    uses = knots.where("__chain = 0").selectExpr(*named, f"inline_outer({_plan_ranges()}) AS (payment, pstart, pend)")
    setting = F.struct(F.col(VARIANT).alias("number"), *PAYMENT_DEFAULTS, *_RATES)
    terms = plan_terms(bundle).groupBy(*keys, "payment").agg(F.collect_list(setting).alias("settings"))
    if span_scope == "model":
        spans = uses.groupBy(*keys, "payment").agg(F.min("pstart").alias("pstart"), F.max("pend").alias("pend"))
        terms = meet(spans, terms, keys, safe=["payment"], partitions=partitions)
        uses = uses.drop("pstart", "pend")
    joined = _with_terms(bundle, uses, terms, partitions).select(*named, "payment", "pstart", "pend", "settings")
    plan = F.struct("pstart", "payment", "pend", "settings")
    offered = spread(joined, named, partitions).groupBy(*named).agg(F.array_sort(F.collect_list(plan)).alias("offered"))
    ready = chains.join(offered.hint("merge"), named)
    if arms is not None:
        ready = ready.join(spread(arms, named, partitions).hint("merge"), named, "left")
    number = F.explode(F.expr(grid.settings("__chain", "__touched"))).alias(VARIANT)
    mine = f"get(filter(o.settings, t -> t.number = {grid.terms_of(VARIANT, 'o.payment')}), 0)"
    filled = ", ".join(f"'{c}', coalesce(x.t.{c}, 0D)" for c in PAYMENT_DEFAULTS)
    told = ready.select("*", number).withColumn("__told", F.expr(f"transform(offered, o -> struct(o, {mine} AS t))"))
    rates = {name: F.coalesce(F.array_max(F.col(f"__told.t.{name}")), F.lit(GLOBAL_DEFAULTS[name])) for name in _RATES}
    priced = told.withColumns({**rates, "time_horizon": rates["time_horizon"].cast("int")}).withColumn(
        "plans",
        F.expr(f"""transform(__told, x -> named_struct('pstart', x.o.pstart, 'payment', x.o.payment,
            'pend', x.o.pend, {filled}))"""),
    )
    kept = priced.drop("__told", "offered", "__chain")
    return kept.withColumn("shares", F.slice("shares", 1, F.col("time_horizon")))


def _arm(bundle: ModelBundle, *passed: str) -> list[str]:
    """What an arm is known by: in a sweep also its setting and the cells that touch it."""
    setting = [] if bundle.grid is None else [VARIANT, "__touched"]
    return [*bundle.keys, *setting, "treatment", *passed]


def cohort_rows(
    bundle: ModelBundle,
    span_scope: str = "model",
    partitions: int | None = None,
    arms: DataFrame | None = None,
) -> DataFrame:
    """One row per treatment: its states, the plans they use, rates and projected shares.

    ``span_scope`` tells whether a plan spans its states in the whole model or in each treatment.
    ``arms`` adds its columns by ``(keys, treatment)`` before the projection, so that a later
    filter on them reaches below it.

    Knots are shuffled once. Only the plans that a treatment uses, not its states, are joined with
    their terms and brought back. In a sweep a treatment has a row for each setting of the cells that
    touch it.
    """
    if bundle.grid is not None:
        return _varied_rows(bundle, span_scope, partitions, arms)
    keys = list(bundle.keys)
    named = [*keys, "treatment"]
    chains, uses = _chains_and_uses(spread(bundle.states, named, partitions), keys)
    terms = plan_terms(bundle)
    if span_scope == "model":
        spans = uses.groupBy(*keys, "payment").agg(
            F.min("pstart").alias("pstart"), F.max("pend").alias("pend")
        )
        terms = meet(spans, terms, keys, safe=["payment"], partitions=partitions)
        uses = uses.drop("pstart", "pend")
    joined = _with_terms(bundle, uses, terms, partitions).select(
        *named,
        "payment",
        *[F.expr(f"coalesce({c}, 0D) AS {c}") for c in PAYMENT_DEFAULTS],
        "pstart",
        "pend",
        *_RATES,
    )
    # Spread like the knots, so that whichever side is streamed keeps its partitions.
    offered = spread(joined, named, partitions).groupBy(*named).agg(
        F.array_sort(F.collect_list(F.struct("pstart", "payment", "pend", *PAYMENT_DEFAULTS))).alias(
            "plans"
        ),
        # A scenario without globals has the defaults.
        F.coalesce(F.max("time_horizon"), F.lit(GLOBAL_DEFAULTS["time_horizon"]))
        .cast("int")
        .alias("time_horizon"),
        *[
            F.coalesce(F.max(c), F.lit(GLOBAL_DEFAULTS[c])).alias(c)
            for c in ("discount", "firm_discount")
        ],
    )
    ready = chains.join(offered.hint("merge"), named)
    if arms is not None:
        ready = ready.join(spread(arms, named, partitions).hint("merge"), named, "left")
    return ready.withColumn("shares", F.expr(_SHARES))


_SUM = "0D, (total, part) -> total + part"
_SPAN = "plan.pstart, plan.pend - plan.pstart + 1"


def _with_conditions(rows: DataFrame) -> DataFrame:
    """Add the stop flags and refunds by period of the treatment's plan with a total.

    ``several`` is true where a treatment has more than one such plan. It can't be priced then: its
    costs are null, and ``validate.check_rules`` names it.

    ``stopped`` (null unless the plan stops on aggregate failure) tells by period whether more
    than the agreed share has left the plan's states. ``refunds`` (null unless the plan refunds)
    holds the payment back by period, negative.
    """
    totals = "filter(plans, p -> p.tot_payment > 0)"
    planned = rows.withColumns(
        {"plan": F.expr(f"get({totals}, 0)"), "several": F.expr(f"size({totals}) > 1")}
    )

    entered = "get(get(shares, plan.pstart - 1), plan.pstart - 1)"
    inside = f"aggregate(slice(x, {_SPAN}), {_SUM})"
    stopped = planned.withColumn(
        "stopped",
        F.expr(f"""IF(plan.aggregate_failure > 0,
            transform(shares, x -> {entered} - {inside} > plan.aggregate_failure), NULL)"""),
    )

    # Stop rule: what the span paid while running comes back each time the rule turns.
    members = """transform(filter(states, s -> s.payment <=> p.payment
        AND s.state BETWEEN plan.pstart AND plan.pend), s -> get(x, s.state - 1))"""
    due = f"aggregate({members}, {_SUM}) * {payment_sql('(i + 1)', 'p.', start='p.pstart')}"
    span_paid = f"""aggregate(transform(shares, (x, i) -> IF(get(stopped, i), 0D,
        aggregate(transform(plans, p -> {due}), {_SUM}))), {_SUM})"""
    claimed = stopped.withColumn(
        "clawback",
        F.expr(f"""IF(plan.aggregate_failure > 0 AND plan.refund > 0,
            {span_paid} * plan.refund, NULL)"""),
    )
    turned = """transform(stopped, (now, i) ->
        IF(i > 0 AND now != get(stopped, i - 1), -clawback, 0D))"""

    # Individual refund: those who leave the plan's last state get back what was paid before.
    # Moving on from the state before death and dying there end in the same state.
    leaving = """(get(states, plan.pend - 1).p_prog * (1D - get(states, plan.pend - 1).p_death)
        + IF(plan.pend + 1 = size(states), get(states, plan.pend - 1).p_death, 0D))"""
    before = paid_before_sql("(i + 1)", "plan.", start="plan.pstart")
    counted = """i > 0
        AND (i + 1 <= plan.contract_length OR plan.contract_length >= time_horizon)"""
    paid_back = f"""transform(shares, (x, i) -> IF({counted},
        coalesce(-(get(x, plan.pend - 1) * {leaving} * plan.refund * {before}), 0D), 0D))"""
    return claimed.withColumn(
        "refunds",
        F.expr(f"""CASE WHEN clawback IS NOT NULL THEN {turned}
            WHEN plan.refund > 0 THEN {paid_back} END"""),
    )


def cells(
    bundle: ModelBundle,
    span_scope: str = "model",
    partitions: int | None = None,
    arms: DataFrame | None = None,
) -> DataFrame:
    """One row per treatment, period and state with share, cost, refund and QALY.

    The refund of a period stands on the row of state 1, null where no refund was agreed.
    ``cost`` is null in states without a plan. Columns of ``arms`` are passed on.
    """
    keys = list(bundle.keys)
    passed = [] if arms is None else [c for c in arms.columns if c not in (*keys, "treatment")]
    named = _arm(bundle, *passed)
    rows = _with_conditions(cohort_rows(bundle, span_scope, partitions, arms))
    terms = ", ".join(f"'{t}', p.{t}" for t in (*PAYMENT_DEFAULTS, "pstart"))
    priced = rows.withColumn(
        "states",
        F.expr(f"""transform(states, s -> transform(
            filter(plans, p -> p.payment <=> s.payment), p -> named_struct('state', s.state,
                'QoL', s.QoL, 'payment', s.payment, {terms}))[0])"""),
    )
    by_period = priced.selectExpr(
        *named,
        "states",
        "discount",
        "firm_discount",
        "plan.pstart AS first_paid",
        "plan.pend AS last_paid",
        "stopped",
        "refunds",
        "several",
        "posexplode_outer(shares) AS (elapsed, reached)",
    )
    by_state = by_period.selectExpr(
        *named,
        "elapsed + 1 AS time",
        "discount",
        "firm_discount",
        "first_paid",
        "last_paid",
        "get(stopped, elapsed) AS off",
        "get(refunds, elapsed) AS refund",
        "several",
        "reached",
        "explode_outer(states) AS s",
    )
    halted = "coalesce(off AND s.state BETWEEN first_paid AND last_paid, false)"
    share = "get(reached, s.state - 1)"
    return by_state.selectExpr(
        *named,
        "time",
        "s.state AS state",
        "s.payment AS payment",
        f"{share} AS share",
        f"""CASE WHEN s.payment IS NULL OR several THEN NULL WHEN {halted} THEN 0D
            ELSE {share} * {payment_sql("time", "s.", start="s.pstart")} END AS cost""",
        "IF(s.state = 1 AND NOT several, refund, NULL) AS refund",
        f"{share} * s.QoL * {discount_factor_sql('discount', 'time')} AS qaly",
    )


def _listed_lines(
    bundle: ModelBundle,
    span_scope: str,
    partitions: int | None,
    arms: DataFrame | None,
) -> tuple[DataFrame, list[str]]:
    """One row per treatment with its lines as an array ``listed``; and the names it is known by.

    A plan asks the same of all its states, so a line is one weighted sum of the period's shares
    times one amount.
    """
    keys = list(bundle.keys)
    passed = [] if arms is None else [c for c in arms.columns if c not in (*keys, "treatment")]
    named = _arm(bundle, *passed)
    rows = _with_conditions(cohort_rows(bundle, span_scope, partitions, arms))

    def line(kind: str, name: str, terms: str, weights: str, running: str) -> str:
        return f"""named_struct('kind', '{kind}', 'costben', {name}, 'terms', {terms},
            'weights', {weights}, 'stopped_weights', {running})"""

    uses = "s.payment <=> p.payment"
    free = f"{uses} AND NOT s.state BETWEEN plan.pstart AND plan.pend"
    none, nothing = "get(plans, size(plans))", "CAST(NULL AS ARRAY<DOUBLE>)"
    plan = line(
        "plan",
        "p.payment",
        "p",
        f"transform(states, s -> IF({uses}, 1D, 0D))",
        f"IF(stopped IS NULL, NULL, transform(states, s -> IF({free}, 1D, 0D)))",
    )
    health = line("qaly", f"'{QALY}'", none, "states.QoL", nothing)
    refund = line("refund", f"'{REFUND}'", none, nothing, nothing)
    listed = rows.selectExpr(
        *named,
        "discount",
        "firm_discount",
        "stopped",
        "refunds",
        "several",
        "shares",
        f"""concat(transform(filter(plans, p -> p.payment IS NOT NULL), p -> {plan}),
            array({health}), IF(refunds IS NULL, array(), array({refund}))) AS listed""",
    )
    return listed, named


def _line_value(line: str, reached: str, elapsed: str, off: str, refund: str) -> str:
    """SQL for what a line is worth in a period, from the shares reached in it."""
    weights = f"IF({line}.kind = 'plan' AND {off}, {line}.stopped_weights, {line}.weights)"
    dot = f"aggregate(zip_with({reached}, {weights}, (share, w) -> share * w), {_SUM})"
    time = f"({elapsed} + 1)"
    paid = payment_sql(time, f"{line}.terms.", start=f"{line}.terms.pstart")
    return f"""CASE WHEN {line}.kind = 'qaly' THEN {dot} * {discount_factor_sql('discount', time)}
        WHEN several THEN NULL WHEN {line}.kind = 'refund' THEN {refund} ELSE {dot} * {paid} END"""


def lines(
    bundle: ModelBundle,
    span_scope: str = "model",
    partitions: int | None = None,
    arms: DataFrame | None = None,
) -> DataFrame:
    """``treatment, time, costben, value``: each plan, the refund and the QALY by period.

    Rows come out final: nothing is exploded by state or summed up again.
    """
    listed, named = _listed_lines(bundle, span_scope, partitions, arms)
    by_line = listed.selectExpr(
        *named,
        "discount",
        "firm_discount",
        "stopped",
        "refunds",
        "several",
        "listed",
        "posexplode_outer(shares) AS (elapsed, reached)",
    ).selectExpr(
        *named,
        "elapsed",
        "discount",
        "firm_discount",
        "get(stopped, elapsed) AS off",
        "get(refunds, elapsed) AS refund",
        "several",
        "reached",
        "explode_outer(listed) AS l",
    )
    return by_line.selectExpr(
        *named,
        "elapsed + 1 AS time",
        "l.costben AS costben",
        "l.kind AS kind",
        f"{_line_value('l', 'reached', 'elapsed', 'off', 'refund')} AS value",
    )


def _summed_lines(
    bundle: ModelBundle,
    span_scope: str,
    partitions: int | None,
    arms: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """One row per treatment with ``sums``, an array of (kind, costben, value over all periods).

    The periods are folded inside the row; null where no period has a value.
    """
    listed, named = _listed_lines(bundle, span_scope, partitions, arms)
    value = _line_value("l", "x", "i", "get(stopped, i)", "get(refunds, i)")
    by_period = f"filter(transform(shares, (x, i) -> {value}), v -> v IS NOT NULL)"
    whole = f"""transform(array({by_period}),
        given -> IF(size(given) = 0, NULL, aggregate(given, {_SUM})))[0]"""
    sums = f"""transform(listed, l -> named_struct(
        'kind', l.kind, 'costben', l.costben, 'value', {whole}))"""
    return listed.selectExpr(*named, "several", f"{sums} AS sums"), named


def over_time(
    bundle: ModelBundle, span_scope: str = "model", partitions: int | None = None
) -> DataFrame:
    """``treatment, time, costben, value`` of every treatment."""
    return lines(bundle, span_scope, partitions).drop("kind")


def cost_series(series: DataFrame) -> DataFrame:
    return series.where(F.col("costben") != QALY)


def qaly_series(series: DataFrame) -> DataFrame:
    return series.where(F.col("costben") == QALY)


def detail(
    bundle: ModelBundle, span_scope: str = "model", partitions: int | None = None
) -> DataFrame:
    """``treatment, payment, cost, QALY``: a row per plan and one, without a plan, for QALY."""
    summed, named = _summed_lines(bundle, span_scope, partitions)
    # Each treatment has lines. A plain explode would have Spark ask below whether there are any,
    # by computing them all once more.
    return summed.selectExpr(*named, "explode_outer(sums) AS s").selectExpr(
        *named,
        "IF(s.kind = 'qaly', NULL, s.costben) AS payment",
        "IF(s.kind = 'qaly', NULL, s.value) AS cost",
        "IF(s.kind = 'qaly', s.value, NULL) AS QALY",
    )


def totals(
    bundle: ModelBundle,
    span_scope: str = "model",
    partitions: int | None = None,
    arms: DataFrame | None = None,
) -> DataFrame:
    """``treatment, Cost, QALY``: the lines of a treatment added up inside its row."""
    summed, named = _summed_lines(bundle, span_scope, partitions, arms)

    def added(kinds: str) -> str:
        chosen = f"filter(sums, s -> {kinds} AND s.value IS NOT NULL)"
        return f"aggregate({chosen}.value, {_SUM})"

    return summed.selectExpr(
        *named,
        f"IF(several, NULL, {added("s.kind != 'qaly'")}) AS Cost",
        f"{added("s.kind = 'qaly'")} AS QALY",
    )


def _compared(pairs: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Pairs of an arm ``a`` and a control ``c``, compared."""
    gain = F.col("a.QALY") - F.col("c.QALY")
    price = F.col("a.Cost") - F.col("c.Cost")
    return pairs.select(
        *keys,
        arm_label(F.col(f"a.{name}"), F.col(f"c.{name}")).alias("Treatments"),
        gain.alias("QALY"),
        price.alias("Cost"),
        ratio(price, gain).alias("ICER"),
    )


#: Arms, and controls, of a scenario that meet in one row.
ARMS = 64


def _met(arms: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Each active arm ``a`` beside each control ``c`` of its scenario.

    Arms and controls are dealt into blocks of about ``ARMS`` by a hash of their names. A row gathers
    one block of arms and one of controls, so each arm goes to every block of controls and the other
    way round: a scenario with very many arms is spread over as many rows as it has pairs of blocks, a
    small one meets in a single row. ``actives`` and ``controls`` tell how many there are at most.
    """

    def blocks(count: str) -> str:
        return f"greatest(CAST(ceil({count} / {ARMS}D) AS INT), 1)"

    is_control = "coalesce(is_control, false)"
    dealt = arms.selectExpr(
        *keys,
        f"struct({', '.join(fields)}) AS arm",
        f"{is_control} AS is_control",
        f"pmod(xxhash64({fields[0]}), IF({is_control}, {blocks('controls')}, {blocks('actives')})) AS own",
        f"explode(sequence(0L, IF({is_control}, {blocks('actives')}, {blocks('controls')}) - 1L)) AS other",
    )
    block = {"__a": F.expr("IF(is_control, other, own)"), "__c": F.expr("IF(is_control, own, other)")}
    # few bytes become many rows
    spread_out = spread(dealt.withColumns(block), [*keys, *block])
    return (
        spread_out.groupBy(*keys, *block)
        .agg(F.collect_list(F.struct("arm", "is_control")).alias("arms"))
        .selectExpr(
            *keys, "explode(filter(arms, x -> NOT x.is_control).arm) AS a", "filter(arms, x -> x.is_control).arm AS controls"
        )
        .selectExpr(*keys, "a", "explode(controls) AS c")
    )


def compare_arms(arms: DataFrame, keys: Sequence[str], name: str = "treatment") -> DataFrame:
    """Each active arm against each control of its scenario, from one frame whose ``is_control`` is
    true for controls and that says how many ``actives`` and ``controls`` a scenario has.

    Each arm is computed once, and nothing is joined.
    """
    return _compared(_met(arms, keys, [name, "Cost", "QALY"]), keys, name)


def compare_settings(arms: DataFrame, bundle: ModelBundle) -> DataFrame:
    """``compare_arms`` for every combination of a sweep, from arms priced by setting.

    A combination's number leads to the setting of each of the two arms.
    """
    keys, grid = list(bundle.keys), bundle.grid
    prices = F.array_sort(F.collect_list(F.struct(VARIANT, "Cost", "QALY"))).alias("prices")
    same = [F.first(c).alias(c) for c in ("is_control", "actives", "controls")]
    one = arms.groupBy(*keys, "treatment").agg(*same, F.first("__touched").alias("touched"), prices)
    pairs = _met(one, keys, ["treatment", "touched", "prices"]).selectExpr(
        *keys, "a", "c", f"explode(sequence(0, CAST({grid.total} AS INT) - 1)) AS {VARIANT}"
    )

    def priced(arm: str) -> str:
        found = f"get({arm}.prices, {grid.place(VARIANT, f'{arm}.touched')})"
        return f"named_struct('treatment', {arm}.treatment, 'Cost', {found}.Cost, 'QALY', {found}.QALY) AS {arm}"

    found = pairs.selectExpr(*keys, VARIANT, priced("a"), priced("c"))
    return _compared(found, [*keys, VARIANT], "treatment")


def incremental(
    bundle: ModelBundle, span_scope: str = "model", partitions: int | None = None
) -> DataFrame:
    """``Treatments, QALY, Cost, ICER`` of each active treatment against each control.

    Who is a control depends on names alone, so it is settled before the projection.
    """
    arms = totals(bundle, span_scope, partitions, arms_of(bundle))
    if bundle.grid is not None:
        return compare_settings(arms, bundle)
    return compare_arms(arms, bundle.keys)


def arms_of(bundle: ModelBundle) -> DataFrame:
    """``(keys, treatment, is_control, actives, controls)``: the role of each treatment, and how many
    there are at most in its scenario. The last ``control_count`` names of a scenario are controls."""
    keys = list(bundle.keys)
    named = [*keys, "treatment"]
    names = spread(bundle.states.select(*named), named).distinct()
    plain = bundle.plain
    every = plain.states.select(*plain.keys, "treatment")
    cuts = find_cuts(spread(every, [*plain.keys, "treatment"]).distinct(), plain.keys, ["treatment"])
    placed = ordered_scan(
        names, keys, ["treatment"], cuts=cuts, cut_keys=plain.keys, __at=position(), actives=group_size()
    )
    counts = global_record(bundle).select(*keys, "control_count")
    count = F.coalesce(F.col("control_count"), F.lit(1.0))
    return meet(placed, counts, keys, deal="treatment", counted=plain.states).select(
        *keys,
        "treatment",
        (F.col("actives") - F.col("__at") < count).alias("is_control"),
        "actives",
        F.least(F.col("actives").cast("double"), count).alias("controls"),
    )


def controls_of(bundle: ModelBundle) -> DataFrame:
    """``(keys, treatment)`` of the controls."""
    return arms_of(bundle).where("is_control").select(*bundle.keys, "treatment")


def plan_listing(bundle: ModelBundle) -> DataFrame:
    """Schedule of every plan from each state where it starts: ``payment_plan, start, time``.

    Continuous plans pay alike wherever they start, so they are listed once, from state 1. Terms
    left blank stay blank here.
    """
    keys = list(bundle.keys)
    plans = fill_defaults(bundle.payments, PAYMENT_DEFAULTS, blank=None)
    used = bundle.states.where(F.col("payment").isNotNull()).select(
        *keys, "payment", F.col("state").alias("start")
    ).distinct()
    starts = (
        meet(plans, used, [*keys, "payment"])
        .withColumn("start", F.when(F.col("tot_payment") > 0, F.col("start")).otherwise(F.lit(1)))
        .distinct()
        .withColumnRenamed("payment", "payment_plan")
    )
    starts = with_parameters(starts, global_record(bundle), keys, GLOBAL_DEFAULTS, "payment_plan")
    return payment_schedule(
        starts,
        "time_horizon",
        discount="discount",
        firm_discount="firm_discount",
        start="start",
        keep=[*keys, "payment_plan", "start"],
    )


def qol_profile(bundle: ModelBundle) -> DataFrame:
    """``treatment, state, QoL`` once gaps are filled."""
    return expand_states(bundle.states, bundle.keys).select(
        *bundle.keys, "treatment", "state", "QoL"
    )
