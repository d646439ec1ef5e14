"""Models that differ from part to part, and models with faults.

The mixed model of a part has its own horizon (1 to 25 periods) and rates, three or four arms, one
or two controls, a gap with a blank quality, a first instalment, a falling continuous payment and, in
one arm, a plan with a total that starts at state 2 under a stop rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.catalog.cohort_queries import _COMPARED, _MODEL, _PLAIN, _compared, _walk
from cohortspan.catalog.contract_queries import part_contracts
from cohortspan.catalog.part_model import part_bundle, read
from cohortspan.catalog.registry import query
from cohortspan.plans import cohort, sweep, validate
from cohortspan.session import meet
from cohortspan.sources import typed
from cohortspan.tables import ModelBundle

# treatment -> knots (state, p_prog, QoL, p_death, payment), as SQL
_ARMS = {
    "alpha": [
        (1, "(p_size % 10 + 1) / 20D", "1D", "0.01D", "'fixed'"),
        (2, "0.5D", "NULL", "0.02D", "'cont'"),
        (4, "0D", "0D", "0D", "NULL"),
    ],
    "beta": [
        (1, "0.8D", "0.9D", "0.01D", "'cont'"),
        (2, "0.1D", "0.8D", "0.01D", "'late'"),
        (3, "0.7D", "0.5D", "0.03D", "'cont'"),
        (4, "0D", "0D", "0D", "NULL"),
    ],
    "delta": [
        (1, "0.4D", "0.85D", "0.03D", "'cont'"),
        (2, "0.4D", "0.6D", "0.03D", "'cont'"),
        (3, "0.4D", "0.3D", "0.03D", "'cont'"),
        (4, "0D", "0D", "0D", "NULL"),
    ],
    "omega": [
        (1, "1D", "0.7D", "0.05D", "'cont'"),
        (2, "1D", "0.5D", "0.05D", "'cont'"),
        (3, "1D", "0.2D", "0.05D", "'cont'"),
        (4, "0D", "0D", "0D", "NULL"),
    ],
}


def mixed_bundle(spark, sf_dir) -> ModelBundle:
    part = read(spark, sf_dir, "part").selectExpr("p_partkey AS scenario_id", "p_size", "p_retailprice")
    knots = ", ".join(
        f"named_struct('treatment', '{arm}', 'state', {n}, 'p_prog', CAST({p} AS DOUBLE), "
        f"'QoL', CAST({q} AS DOUBLE), 'p_death', {d}, 'payment', CAST({plan} AS STRING))"
        for arm, rows in _ARMS.items()
        for n, p, q, d, plan in rows
    )
    fields = "payment, tot_payment, cont_payment, cost_trend, contract_length, initial_payment, refund, aggregate_failure"
    plans = {
        "fixed": "p_retailprice / 100D, 0D, 0D, CAST(1 + p_size % 10 AS DOUBLE), 0.2D, 0D, 0D",
        "late": "6D, 0D, 0D, 3D, 0D, 0.5D, 0.2D",
        "cont": "0D, 0.1D, 0.02D, 0D, 0D, 0D, 0D",
    }
    rows = ", ".join(f"struct('{name}', {terms})" for name, terms in plans.items())
    rates = """stack(4, 'discount', (p_size % 4) / 100D, 'firm_discount', (p_size % 3) / 50D,
        'time_horizon', CAST(1 + p_size % 25 AS DOUBLE),
        'control_count', CAST(1 + p_size % 2 AS DOUBLE)) AS (name, value)"""
    return ModelBundle(
        states=part.selectExpr("scenario_id", "p_size", f"inline(array({knots}))")
        .where("treatment != 'beta' OR p_size % 2 = 0")
        .drop("p_size"),
        payments=part.selectExpr("scenario_id", f"inline(array({rows})) AS ({fields})"),
        globals=part.selectExpr("scenario_id", rates),
    )


_MIXED = """WITH RECURSIVE
    arm AS (SELECT p_partkey AS scenario_id, p_retailprice / 100e0 AS total, 1 + p_size % 10 AS n,
                   1 + p_size % 25 AS horizon, (p_size % 4) / 100e0 AS d, (p_size % 3) / 50e0 AS f,
                   1 + p_size % 2 AS controls, a.treatment,
                   CASE a.treatment WHEN 'alpha' THEN (p_size % 10 + 1) / 20e0 ELSE a.p1 END AS p1,
                   p2, p3, q1, q2, q3, d1, d2, d3
            FROM part, (VALUES
                ('alpha', 0e0, 0.5e0, 0.5e0, 1e0, 2 / 3e0, 1 / 3e0, 0.01e0, 0.02e0, 0.02e0),
                ('beta', 0.8e0, 0.1e0, 0.7e0, 0.9e0, 0.8e0, 0.5e0, 0.01e0, 0.01e0, 0.03e0),
                ('delta', 0.4e0, 0.4e0, 0.4e0, 0.85e0, 0.6e0, 0.3e0, 0.03e0, 0.03e0, 0.03e0),
                ('omega', 1e0, 1e0, 1e0, 0.7e0, 0.5e0, 0.2e0, 0.05e0, 0.05e0, 0.05e0))
                a(treatment, p1, p2, p3, q1, q2, q3, d1, d2, d3)
            WHERE a.treatment <> 'beta' OR p_size % 2 = 0),
    r AS (SELECT *, 1 AS time, 1e0 AS x1, 0e0 AS x2, 0e0 AS x3 FROM arm
          UNION ALL
          SELECT scenario_id, total, n, horizon, d, f, controls, treatment, p1, p2, p3, q1, q2, q3,
                 d1, d2, d3, time + 1, x1 * (1 - p1) * (1 - d1),
                 x2 * (1 - p2) * (1 - d2) + x1 * p1 * (1 - d1),
                 x3 * (1 - p3) * (1 - d3) + x2 * p2 * (1 - d2)
          FROM r WHERE time < horizon),
    due AS (SELECT *, power(1 + d, -(time - 1)) AS v,
                   0.1e0 * power(1.02e0 * (1 + d), -(time - 1)) AS cont,
                   CASE WHEN time > n THEN 0e0 WHEN time = 1 THEN total * 0.2e0
                        ELSE total * 0.8e0 / greatest(n - 1, 1) END
                   * power((1 + f) / (1 + d), time - 1) AS fixed,
                   CASE WHEN time BETWEEN 2 AND 4 THEN 2 * power((1 + f) / (1 + d), time - 1)
                        ELSE 0e0 END AS late,
                   max(CASE WHEN time = 2 THEN x2 END) OVER (PARTITION BY scenario_id, treatment)
                       AS entered FROM r),
    halt AS (SELECT *, coalesce(treatment = 'beta' AND entered - x2 > 0.2e0, false) AS off FROM due),
    turn AS (SELECT *, coalesce(off <> lag(off) OVER w, false) AS turned,
                    sum(CASE WHEN off THEN 0 ELSE x2 * late END)
                        OVER (PARTITION BY scenario_id, treatment) AS paid
             FROM halt WINDOW w AS (PARTITION BY scenario_id, treatment ORDER BY time)),
    line AS (
        SELECT scenario_id, treatment, controls, 'fixed' AS costben, x1 * fixed AS value
        FROM turn WHERE treatment = 'alpha'
        UNION ALL SELECT scenario_id, treatment, controls, 'cont',
            cont * (x3 + CASE treatment WHEN 'alpha' THEN x2 WHEN 'beta' THEN x1 ELSE x1 + x2 END) FROM turn
        UNION ALL SELECT scenario_id, treatment, controls, 'late', CASE WHEN off THEN 0 ELSE x2 * late END
        FROM turn WHERE treatment = 'beta'
        UNION ALL SELECT scenario_id, treatment, controls, 'Refund', CASE WHEN turned THEN -0.5e0 * paid ELSE 0 END
        FROM turn WHERE treatment = 'beta'
        UNION ALL SELECT scenario_id, treatment, controls, 'QALY', (q1 * x1 + q2 * x2 + q3 * x3) * v FROM turn)
"""


@query(
    "incremental_mixed",
    _MIXED
    + """, t AS (SELECT scenario_id, treatment, controls,
                 sum(value) FILTER (WHERE costben <> 'QALY') AS cost,
                 sum(value) FILTER (WHERE costben = 'QALY') AS qaly,
                 row_number() OVER (PARTITION BY scenario_id ORDER BY treatment DESC) AS place
          FROM line GROUP BY scenario_id, treatment, controls)
    SELECT scenario_id, a.treatment || ' - ' || c.treatment AS Treatments,
           round(a.qaly - c.qaly, 6) AS QALY, round(a.cost - c.cost, 6) AS Cost,
           round((a.cost - c.cost) / nullif(a.qaly - c.qaly, 0), 4) AS ICER
    FROM t a JOIN t c USING (scenario_id)
    WHERE a.place > a.controls AND c.place <= c.controls""",
)
def incremental_mixed(spark, sf_dir):
    rows = cohort.incremental(mixed_bundle(spark, sf_dir))
    return rows.withColumns({"QALY": F.round("QALY", 6), "Cost": F.round("Cost", 6), "ICER": F.round("ICER", 4)})


@query(
    "detail_mixed",
    _MIXED
    + """SELECT scenario_id, treatment, nullif(costben, 'QALY') AS payment,
                round(sum(value) FILTER (WHERE costben <> 'QALY'), 9) + 0e0 AS cost,
                round(sum(value) FILTER (WHERE costben = 'QALY'), 9) AS QALY
         FROM line GROUP BY scenario_id, treatment, costben""",
)
def detail_mixed(spark, sf_dir):
    rows = cohort.detail(mixed_bundle(spark, sf_dir))
    return rows.withColumns({"cost": F.round("cost", 9) + F.lit(0.0), "QALY": F.round("QALY", 9)})


_DEFAULTS = (_PLAIN + _COMPARED.format("line")).replace("1.03e0", "1e0").replace("0.1e0) / 1e0", "0e0) / 1e0")


@query(
    "missing_globals",
    f"""SELECT * FROM ({_PLAIN + _COMPARED.format("line")}) WHERE scenario_id % 2 = 0
    UNION ALL SELECT * FROM ({_DEFAULTS}) WHERE scenario_id % 2 = 1""",
)
def missing_globals(spark, sf_dir):
    """Every other scenario has no globals and so the defaults."""
    bundle = part_bundle(spark, sf_dir)
    some = bundle.globals.where("scenario_id % 2 = 0")
    return _compared(cohort.incremental(bundle.with_tables(globals=some)))


_MIXED_COLUMNS = _PLAIN.replace(
    "1 + p_size % 10 AS n", "CASE WHEN p_partkey % 2 = 1 THEN 20 ELSE 1 + p_size % 10 END AS n"
)


@query("mixed_plan_columns", _MIXED_COLUMNS + _COMPARED.format("line"))
def mixed_plan_columns(spark, sf_dir):
    """Every other scenario's plan table lacks ``contract_length``, which then has its default."""
    bundle = part_bundle(spark, sf_dir)
    lacks = F.col("scenario_id") % 2 == 1
    names = [c for c in bundle.payments.columns if c != "contract_length"]
    payments = bundle.payments.withColumns(
        {
            "contract_length": F.when(~lacks, F.col("contract_length")),
            "present_columns": F.when(lacks, F.array(*map(F.lit, names))).otherwise(
                F.array(*map(F.lit, bundle.payments.columns))
            ),
        }
    )
    return _compared(cohort.incremental(bundle.with_tables(payments=payments)))


@query(
    "two_total_plans",
    f"""SELECT scenario_id, Treatments, QALY, CASE WHEN scenario_id % 3 > 0 THEN Cost END AS Cost,
               CASE WHEN scenario_id % 3 > 0 THEN ICER END AS ICER
        FROM ({_PLAIN + _COMPARED.format("line")})""",
)
def two_total_plans(spark, sf_dir):
    """In every third scenario the treated arm uses a second plan with a total."""
    bundle = part_bundle(spark, sf_dir)
    second = "scenario_id % 3 = 0 AND treatment = 'active' AND state = 3"
    states = bundle.states.withColumn(
        "payment", F.when(F.expr(second), "second").otherwise(F.col("payment"))
    )
    more = bundle.payments.where("payment = 'fixed'").withColumn("payment", F.lit("second"))
    return _compared(
        cohort.incremental(bundle.with_tables(states=states, payments=bundle.payments.unionByName(more)))
    )


@query(
    "unknown_variation",
    f"""SELECT scenario_id, i AS variant_id, p AS p_prog, Treatments,
               CASE WHEN false THEN QALY END AS QALY, CASE WHEN false THEN Cost END AS Cost,
               CASE WHEN false THEN ICER END AS ICER
        FROM ({_PLAIN + _COMPARED.format("line")}), (VALUES (0, 0.05e0), (1, 0.2e0)) g(i, p)""",
)
def unknown_variation(spark, sf_dir):
    """The varied row is misspelt: no scenario has it."""
    cells = [sweep.Cell("state_table", "activ/1", "p_prog", "array(0.05D, 0.2D)")]
    return sweep.sweep(part_bundle(spark, sf_dir), cells, cohort.incremental)


@query(
    "multi_value_sweep",
    """WITH RECURSIVE
    arm AS (SELECT p_partkey AS scenario_id, a.treatment, p_retailprice / 100e0 AS total,
                   CAST(g.n AS INTEGER) AS n, i AS variant_id,
                   CASE a.treatment WHEN 'active' THEN (p_size % 10 + 1) / 20e0 ELSE 1e0 END AS p
            FROM part, (VALUES ('active'), ('control')) a(treatment),
                 (VALUES (0, 0, 2), (0, 1, 5), (1, 0, 1), (1, 1, 4), (1, 2, 8)) g(odd, i, n)
            WHERE g.odd = p_partkey % 2),"""
    + _walk("arm", extra="variant_id")
    + """,
    t AS (SELECT scenario_id, variant_id, n, treatment,
                 sum(CASE treatment WHEN 'active' THEN x1 * fixed ELSE x1 * cont END
                     + (x2 + x3) * cont) AS cost,
                 sum((x1 + 0.67e0 * x2 + 0.33e0 * x3) * v) AS qaly FROM due GROUP BY ALL)
    SELECT scenario_id, variant_id, n::DOUBLE AS contract_length, 'active - control' AS Treatments,
           round(a.qaly - c.qaly, 6) AS QALY, round(a.cost - c.cost, 6) AS Cost,
           round((a.cost - c.cost) / nullif(a.qaly - c.qaly, 0), 6) AS ICER
    FROM t a JOIN t c USING (scenario_id, variant_id, n)
    WHERE a.treatment = 'active' AND c.treatment = 'control'""",
)
def multi_value_sweep(spark, sf_dir):
    """Each scenario lists its own instalment counts in one text cell."""
    bundle = part_bundle(spark, sf_dir)
    text = bundle.payments.selectExpr(
        "scenario_id",
        "payment",
        "IF(payment = 'cont', '0', IF(scenario_id % 2 = 0, '5 2', '8  1 4')) AS contract_length",
    )
    listed = sweep.variation_rows(text, "payment_table", "payment", keys=bundle.keys)
    cells, scenarios = sweep.scenario_cells(listed, bundle.keys)
    return _compared(sweep.sweep(bundle, cells, cohort.incremental, scenarios))


@query(
    "rule_errors",
    f"""WITH {_MODEL}
    SELECT p_partkey AS scenario_id, 'payment_table' AS "table", 'contract_length' AS "column", 1::BIGINT AS "row",
           'No instalment to pay the total of: fixed' AS message FROM part WHERE p_size % 10 = 0
    UNION ALL
    SELECT scenario_id, 'state_table', 'state', min(state), 'States must start at 1 and increase: ' || treatment
    FROM st WHERE scenario_id % 4 = 0 AND treatment = 'control' GROUP BY scenario_id, treatment
    UNION ALL
    SELECT scenario_id, 'state_table', 'payment', 1, 'active uses several plans with a total'
    FROM st WHERE scenario_id % 5 = 0 AND treatment = 'active' AND state = 2""",
)
def rule_errors(spark, sf_dir):
    bundle = part_bundle(spark, sf_dir)
    states = bundle.states.selectExpr(
        "scenario_id",
        "CAST(state AS BIGINT) AS row_id",
        "treatment",
        "IF(scenario_id % 4 = 0 AND treatment = 'control', state + 1, state) AS state",
        "IF(scenario_id % 5 = 0 AND treatment = 'active' AND state = 2, 'second', payment) AS payment",
    )
    payments = bundle.payments.selectExpr(
        "scenario_id",
        "IF(payment = 'fixed', 1L, 2L) AS row_id",
        "payment",
        "tot_payment",
        "IF(payment = 'fixed', contract_length - 1, contract_length) AS contract_length",
    )
    second = payments.where("payment = 'fixed'").selectExpr(
        "scenario_id", "3L AS row_id", "'second' AS payment", "tot_payment", "5D AS contract_length"
    )
    return validate.check_rules(bundle.with_tables(states=states, payments=payments.unionByName(second)))


@query(
    "treatment_errors",
    """SELECT p_partkey AS scenario_id, 'treatments' AS "table", 'health_states' AS "column",
              plan + 1::BIGINT AS "row",
              CASE WHEN n < 2 THEN 'health_states must be at least 2, now: ' || n
                   ELSE 'The random_state is too big compared with the number of health_states' END AS message
       FROM (SELECT p_partkey, plan, 1 + p_size % 4 AS n, 1 + p_size % 3 AS r
             FROM part, (VALUES (0::BIGINT), (1), (2)) t(plan))
       WHERE n < 2 OR n <= r + 1""",
)
def treatment_errors(spark, sf_dir):
    bundle = part_contracts(spark, sf_dir)
    sizes = read(spark, sf_dir, "part").selectExpr("p_partkey AS scenario_id", "p_size")
    treatments = meet(bundle.treatments, sizes, ["scenario_id"], how="inner").withColumns(
        {"health_states": F.expr("1 + p_size % 4"), "random_state": F.expr("1 + p_size % 3")}
    )
    return validate.check_treatments(bundle.with_tables(treatments=treatments))


@query(
    "typed_cells",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN floor(c_acctbal)::INTEGER END AS whole,
              CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS number FROM customer""",
)
def typed_cells(spark, sf_dir):
    """Text cells, some of which are no numbers."""
    text = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "IF(c_custkey % 7 = 0, 'n/a', concat(' ', CAST(FLOOR(c_acctbal) AS STRING), '.0')) AS whole",
        "IF(c_custkey % 5 = 0, '-', CAST(c_acctbal AS STRING)) AS number",
    )
    return typed(text, {"whole": "int", "number": "double"})
