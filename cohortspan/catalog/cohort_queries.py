"""The cohort pipeline on one model per part.

The SQL twins carry the four state shares as columns x1..x4 of a recursive query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.catalog.part_model import part_bundle, read
from cohortspan.catalog.registry import query
from cohortspan.operators import columns, reshape
from cohortspan.operators.chain import transition_edges, transition_table
from cohortspan.operators.expand import expand_states, state_table
from cohortspan.plans import cohort, sweep, validate
from cohortspan.tables import (
    GLOBAL_DEFAULTS,
    PAYMENT_FIELDS,
    STATE_FIELDS,
    ModelBundle,
    fields_frame,
)

STOPPING = {"initial_payment": 1.0, "refund": 0.5, "aggregate_failure": 0.3}
REFUNDING = {"refund": 0.5}

# The states of the part model as a relation s(state, qol, p_death).
_STATES = "(VALUES (1, 1e0, 0.01e0), (2, 0.67e0, 0.02e0), (3, 0.33e0, 0.02e0), (4, 0e0, 0e0))"

_MODEL = f"""
    arm AS (SELECT p_partkey AS scenario_id, a.treatment, p_retailprice / 100e0 AS total,
                   1 + p_size % 10 AS n,
                   CASE a.treatment WHEN 'active' THEN (p_size % 10 + 1) / 20e0 ELSE 1e0 END AS p
            FROM part, (VALUES ('active'), ('control')) a(treatment)),
    st AS (SELECT scenario_id, treatment, s.state, s.qol, s.p_death, total, n,
                  CASE s.state WHEN 1 THEN p WHEN 4 THEN 0e0 ELSE 1e0 END AS p_prog,
                  CASE WHEN s.state = 4 THEN NULL WHEN s.state = 1 AND treatment = 'active'
                       THEN 'fixed' ELSE 'cont' END AS payment
           FROM arm, {_STATES} s(state, qol, p_death))"""


def _walk(arm: str, extra: str = "", firm: str = "0.1e0", first: str = "0e0") -> str:
    """Shares x1..x4, and what the two plans ask for, by period."""
    more = f", {extra}" if extra else ""
    return f"""
    r AS (SELECT scenario_id, treatment, total, n, p{more}, 1 AS time,
                 1e0 AS x1, 0e0 AS x2, 0e0 AS x3, 0e0 AS x4 FROM {arm}
          UNION ALL
          SELECT scenario_id, treatment, total, n, p{more}, time + 1,
                 x1 * (1 - p) * 0.99e0, x1 * p * 0.99e0, x2 * 0.98e0,
                 x4 + x1 * 0.01e0 + x2 * 0.02e0 + x3
          FROM r WHERE time < 20),
    due AS (SELECT *, power(1.03e0, -(time - 1)) AS v, 0.1e0 * power(1.03e0, -(time - 1)) AS cont,
                   CASE WHEN time > n THEN 0e0
                        WHEN {first} > 0 AND time = 1 THEN total * {first}
                        WHEN {first} > 0 THEN total * (1 - {first}) / greatest(n - 1, 1)
                        ELSE total / n END * power((1 + {firm}) / 1.03e0, time - 1) AS fixed
            FROM r)"""


# Lines by plan, refund and QALY; {fixed} is what state 1 of the active arm pays in a period.
def _lines(fixed: str = "fixed", source: str = "due", extra: str = "") -> str:
    more = f"{extra}, " if extra else ""
    return f"""
    line AS (SELECT {more}scenario_id, treatment, time, 'fixed' AS costben, x1 * {fixed} AS value
             FROM {source} WHERE treatment = 'active'
             UNION ALL
             SELECT {more}scenario_id, treatment, time, 'cont',
                    cont * (x2 + x3 + CASE treatment WHEN 'control' THEN x1 ELSE 0 END)
             FROM {source}
             UNION ALL
             SELECT {more}scenario_id, treatment, time, 'QALY',
                    (x1 + 0.67e0 * x2 + 0.33e0 * x3) * v FROM {source})"""


_PLAIN = "WITH RECURSIVE" + _MODEL + "," + _walk("arm") + "," + _lines()

_STOPPED = (
    "WITH RECURSIVE"
    + _MODEL
    + ","
    + _walk("arm", first="1e0")
    + """,
    halt AS (SELECT *, treatment = 'active' AND 1 - x1 > 0.3e0 AS off FROM due),
    turn AS (SELECT *, coalesce(off <> lag(off) OVER w, false) AS turned,
                    sum(CASE WHEN off THEN 0 ELSE x1 * fixed END)
                        OVER (PARTITION BY scenario_id, treatment) AS paid
             FROM halt WINDOW w AS (PARTITION BY scenario_id, treatment ORDER BY time)),"""
    + _lines("(CASE WHEN off THEN 0 ELSE fixed END)", "turn")
    + """,
    every AS (SELECT * FROM line UNION ALL
              SELECT scenario_id, treatment, time, 'Refund',
                     CASE WHEN turned THEN -0.5e0 * paid ELSE 0 END
              FROM turn WHERE treatment = 'active')"""
)

_REFUNDED = (
    "WITH RECURSIVE"
    + _MODEL
    + ","
    + _walk("arm")
    + ","
    + _lines()
    + """,
    sofar AS (SELECT *, coalesce(sum(fixed) OVER (PARTITION BY scenario_id, treatment ORDER BY time
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paid FROM due),
    every AS (SELECT * FROM line UNION ALL
              SELECT scenario_id, treatment, time, 'Refund',
                     CASE WHEN time > n THEN 0 ELSE -(x1 * p * 0.99e0 * 0.5e0 * paid) END
              FROM sofar WHERE treatment = 'active')"""
)


@query(
    "transition_edges",
    f"""WITH {_MODEL},
    e AS (SELECT scenario_id, treatment, state AS from_state, state AS to_state,
                 (1 - p_prog) * (1 - p_death) AS p FROM st WHERE state < 4
          UNION ALL SELECT scenario_id, treatment, state, state + 1, p_prog * (1 - p_death)
          FROM st WHERE state < 4
          UNION ALL SELECT scenario_id, treatment, state, 4, p_death FROM st WHERE state < 4
          UNION ALL SELECT scenario_id, treatment, 4, 4, 1 FROM st WHERE state = 4)
    SELECT scenario_id, treatment, from_state, to_state, round(sum(p), 6) AS p FROM e GROUP BY ALL
    """,
)
def edges(spark, sf_dir):
    bundle = part_bundle(spark, sf_dir)
    found = transition_edges(expand_states(bundle.states, bundle.keys), bundle.keys)
    return found.withColumn("p", F.round("p", 6))


@query(
    "transition_matrix",
    f"""WITH {_MODEL}
    SELECT scenario_id, treatment, state AS from_state,
           CASE state WHEN 4 THEN 'D' ELSE 'S' || state END AS st,
           round(CASE state WHEN 1 THEN (1 - p_prog) * 0.99e0 ELSE 0e0 END, 6) AS S1,
           round(CASE state WHEN 1 THEN p_prog * 0.99e0 ELSE 0e0 END, 6) AS S2,
           round(CASE state WHEN 2 THEN 0.98e0 ELSE 0e0 END, 6) AS S3,
           CASE state WHEN 1 THEN 0.01e0 WHEN 2 THEN 0.02e0 ELSE 1e0 END AS D
    FROM st
    """,
)
def matrix(spark, sf_dir):
    bundle = part_bundle(spark, sf_dir)
    found = transition_edges(expand_states(bundle.states, bundle.keys), bundle.keys)
    table = transition_table(found, bundle.keys, 4)
    return table.withColumns({c: F.round(c, 6) for c in ("S1", "S2", "S3", "D")})


_GAPPED = f"""WITH {_MODEL},
    seen AS (SELECT scenario_id, treatment, i::INTEGER AS state, payment,
                    CASE i WHEN 1 THEN 1e0 WHEN 2 THEN 0.67e0
                           WHEN 3 THEN 0.67e0 - 0.67e0 / 2 ELSE 0e0 END AS QoL
             FROM st, generate_series(state, CASE state WHEN 2 THEN 3 ELSE state END) AS g(i)
             WHERE state <> 3)"""


@query(
    "plan_span",
    _GAPPED
    + """SELECT scenario_id, treatment, state, payment, round(QoL, 6) AS QoL,
         min(state) OVER (PARTITION BY scenario_id, payment) AS pstart,
         max(state) OVER (PARTITION BY scenario_id, payment) AS pend FROM seen""",
)
def plan_span(spark, sf_dir):
    bundle = part_bundle(spark, sf_dir)
    table = state_table(bundle.states.where("state != 3"), bundle.keys)
    return table.select(
        "scenario_id",
        "treatment",
        "state",
        "payment",
        F.round("QoL", 6).alias("QoL"),
        "pstart",
        "pend",
    )


@query(
    "qol_profile",
    _GAPPED + "SELECT scenario_id, treatment, state, round(QoL, 6) AS QoL FROM seen",
)
def qol_profile(spark, sf_dir):
    bundle = part_bundle(spark, sf_dir)
    gapped = bundle.with_tables(states=bundle.states.where("state != 3"))
    return cohort.qol_profile(gapped).withColumn("QoL", F.round("QoL", 6))


@query(
    "cohort_shares",
    "WITH RECURSIVE"
    + _MODEL
    + ","
    + _walk("arm")
    + """SELECT treatment, time, state::INTEGER AS state,
                round(sum([x1, x2, x3, x4][state]), 6) AS share
         FROM r, generate_series(1, 4) AS g(state) GROUP BY ALL""",
)
def cohort_shares(spark, sf_dir):
    rows = cohort.cohort_rows(part_bundle(spark, sf_dir)).select("treatment", "shares")
    cells = reshape.matrix_cells(rows, "shares", value="share")
    return cells.groupBy("treatment", "time", "state").agg(
        F.round(F.sum("share"), 6).alias("share")
    )


@query(
    "cohort_costs",
    _PLAIN
    + """SELECT treatment, time, costben, round(sum(value), 4) AS value FROM line
         WHERE costben <> 'QALY' GROUP BY ALL""",
)
def cohort_costs(spark, sf_dir):
    paid = cohort.cells(part_bundle(spark, sf_dir)).where("payment IS NOT NULL")
    return paid.groupBy("treatment", "time", F.col("payment").alias("costben")).agg(
        F.round(F.sum("cost"), 4).alias("value")
    )


@query(
    "cohort_qaly",
    _PLAIN
    + """SELECT treatment, time, round(sum(value), 6) AS qaly FROM line
         WHERE costben = 'QALY' GROUP BY ALL""",
)
def cohort_qaly(spark, sf_dir):
    cells = cohort.cells(part_bundle(spark, sf_dir))
    return cells.groupBy("treatment", "time").agg(F.round(F.sum("qaly"), 6).alias("qaly"))


_BY_LINE = """SELECT scenario_id, treatment, time, costben, round(sum(value), 6) + 0e0 AS value
    FROM {} GROUP BY ALL"""


def _rounded(series):
    return series.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("stop_and_clawback", _STOPPED + _BY_LINE.format("every"))
def stop_and_clawback(spark, sf_dir):
    return _rounded(cohort.over_time(part_bundle(spark, sf_dir, **STOPPING)))


@query("individual_refund", _REFUNDED + _BY_LINE.format("every"))
def individual_refund(spark, sf_dir):
    return _rounded(cohort.over_time(part_bundle(spark, sf_dir, **REFUNDING)))


@query("over_time", _PLAIN + _BY_LINE.format("line"))
def over_time(spark, sf_dir):
    return _rounded(cohort.over_time(part_bundle(spark, sf_dir)))


@query("cost_series", _PLAIN + _BY_LINE.format("line WHERE costben <> 'QALY'"))
def cost_series(spark, sf_dir):
    return _rounded(cohort.cost_series(cohort.over_time(part_bundle(spark, sf_dir))))


@query("qaly_series", _PLAIN + _BY_LINE.format("line WHERE costben = 'QALY'"))
def qaly_series(spark, sf_dir):
    return _rounded(cohort.qaly_series(cohort.over_time(part_bundle(spark, sf_dir))))


@query(
    "detail",
    _REFUNDED
    + """SELECT scenario_id, treatment, nullif(costben, 'QALY') AS payment,
                round(sum(value) FILTER (WHERE costben <> 'QALY'), 6) AS cost,
                round(sum(value) FILTER (WHERE costben = 'QALY'), 6) AS QALY
         FROM every GROUP BY scenario_id, treatment, costben""",
)
def detail(spark, sf_dir):
    rows = cohort.detail(part_bundle(spark, sf_dir, **REFUNDING))
    return rows.withColumns({c: F.round(c, 6) for c in ("cost", "QALY")})


_COMPARED = """,
    t AS (SELECT scenario_id, treatment, sum(value) FILTER (WHERE costben <> 'QALY') AS cost,
                 sum(value) FILTER (WHERE costben = 'QALY') AS qaly FROM {} GROUP BY ALL)
    SELECT scenario_id, a.treatment || ' - ' || c.treatment AS Treatments,
           round(a.qaly - c.qaly, 6) AS QALY, round(a.cost - c.cost, 6) AS Cost,
           round((a.cost - c.cost) / nullif(a.qaly - c.qaly, 0), 6) AS ICER
    FROM t a JOIN t c USING (scenario_id)
    WHERE a.treatment = 'active' AND c.treatment = 'control'"""


def _compared(rows):
    return rows.withColumns({c: F.round(c, 6) for c in ("QALY", "Cost", "ICER")})


@query("incremental", _PLAIN + _COMPARED.format("line"))
def incremental(spark, sf_dir):
    return _compared(cohort.incremental(part_bundle(spark, sf_dir)))


@query("incremental_refund", _REFUNDED + _COMPARED.format("every"))
def incremental_refund(spark, sf_dir):
    return _compared(cohort.incremental(part_bundle(spark, sf_dir, **REFUNDING)))


@query(
    "plan_listing",
    "WITH RECURSIVE"
    + _MODEL
    + ","
    + _walk("(SELECT * FROM arm WHERE treatment = 'active')")
    + """SELECT scenario_id, 'fixed' AS payment_plan, 1 AS start, time, round(fixed, 6) AS payment
         FROM due
         UNION ALL SELECT scenario_id, 'cont', 1, time, round(cont, 6) FROM due""",
)
def plan_listing(spark, sf_dir):
    return cohort.plan_listing(part_bundle(spark, sf_dir)).withColumn(
        "payment", F.round("payment", 6)
    )


@query(
    "parameters",
    """SELECT p_partkey AS scenario_id, 0.03e0 AS discount, 0.1e0 AS firm_discount,
              20e0 AS time_horizon, 1e0 AS control_count FROM part""",
)
def parameter_records(spark, sf_dir):
    bundle = part_bundle(spark, sf_dir)
    return columns.parameters(bundle.globals, bundle.keys, GLOBAL_DEFAULTS)


@query(
    "titled_states",
    f"""WITH {_MODEL}
    SELECT scenario_id, treatment AS "Treatment", state AS "State", p_prog AS "Pr.prog",
           p_death AS "Pr.death", payment AS "Payment", qol AS "QoL" FROM st""",
)
def titled_states(spark, sf_dir):
    states = part_bundle(spark, sf_dir).states
    return columns.with_titles(states, fields_frame(spark, STATE_FIELDS))


@query(
    "model_errors",
    f"""WITH {_MODEL},
    wrong AS (SELECT scenario_id, state + CASE treatment WHEN 'active' THEN 0 ELSE 4 END AS r,
                     p_prog * 3 AS p_prog, p_death - 0.015e0 AS p_death,
                     CASE WHEN scenario_id % 3 = 0 AND payment = 'fixed' THEN 'lost'
                          ELSE payment END AS payment
              FROM st)
    SELECT scenario_id, 'state' AS "table", 'Pr.prog' AS "column", r::BIGINT AS "row",
           'Value ' || printf('%.2f', p_prog) || ' is above maximum value' AS message
    FROM wrong WHERE p_prog > 1
    UNION ALL
    SELECT scenario_id, 'state', 'Pr.death', r,
           'Value ' || printf('%.2f', p_death) || ' is below minimum value'
    FROM wrong WHERE p_death < 0
    UNION ALL
    SELECT p_partkey, 'payment', 'Tot. payment', 1,
           'Value ' || printf('%.2f', 9.5e0 - p_retailprice / 100e0) || ' is below minimum value'
    FROM part WHERE 9.5e0 - p_retailprice / 100e0 < 0
    UNION ALL
    SELECT scenario_id, 'state_table', 'payment', r,
           'The payment plan: ''lost'' cannot be found in: payment_table'
    FROM wrong WHERE payment = 'lost'
    UNION ALL
    SELECT p_partkey, 'payment_table', 'payment', 1,
           'The payment plan: ''fixed'' cannot be found in: state_table'
    FROM part WHERE p_partkey % 3 = 0""",
)
def model_errors(spark, sf_dir):
    bundle = part_bundle(spark, sf_dir)
    states = bundle.states.selectExpr(
        "scenario_id",
        "CAST(state + IF(treatment = 'active', 0, 4) AS BIGINT) AS row_id",
        "treatment",
        "state",
        "p_prog * 3 AS p_prog",
        "QoL",
        "p_death - 0.015D AS p_death",
        "IF(scenario_id % 3 = 0 AND payment = 'fixed', 'lost', payment) AS payment",
    )
    payments = bundle.payments.selectExpr(
        "scenario_id",
        "IF(payment = 'fixed', 1L, 2L) AS row_id",
        "payment",
        "IF(payment = 'fixed', 9.5D - tot_payment, 0D) AS tot_payment",
        "cont_payment",
        "contract_length",
    )
    return validate.check_model(
        bundle.with_tables(
            states=states,
            payments=payments,
            state_fields=fields_frame(spark, STATE_FIELDS),
            payment_fields=fields_frame(spark, PAYMENT_FIELDS),
        )
    )


GRID = [
    sweep.Cell("state_table", "active/1", "p_prog", "array(0.05D, 0.2D)"),
    sweep.Cell("payment_table", "fixed", "contract_length", "array(1D, 5D, 10D)"),
    sweep.Cell("global_table", "firm_discount", "value", "array(0.03D, 0.1D)", "firm_discount"),
]


@query(
    "sweep",
    """WITH RECURSIVE
    arm AS (SELECT p_partkey AS scenario_id, a.treatment, p_retailprice / 100e0 AS total,
                   CAST(n AS INTEGER) AS n, firm, q, (i * 3 + j) * 2 + k AS variant_id,
                   CASE a.treatment WHEN 'active' THEN q ELSE 1e0 END AS p
            FROM part, (VALUES ('active'), ('control')) a(treatment),
                 (VALUES (0, 0.05e0), (1, 0.2e0)) g1(i, q),
                 (VALUES (0, 1e0), (1, 5e0), (2, 10e0)) g2(j, n),
                 (VALUES (0, 0.03e0), (1, 0.1e0)) g3(k, firm)),"""
    + _walk("arm", extra="variant_id, q, firm", firm="firm")
    + """,
    t AS (SELECT scenario_id, variant_id, q, n, firm, treatment,
                 sum(CASE treatment WHEN 'active' THEN x1 * fixed ELSE x1 * cont END
                     + (x2 + x3) * cont) AS cost,
                 sum((x1 + 0.67e0 * x2 + 0.33e0 * x3) * v) AS qaly FROM due GROUP BY ALL)
    SELECT scenario_id, variant_id, q AS p_prog, n::DOUBLE AS contract_length,
           firm AS firm_discount, 'active - control' AS Treatments,
           round(a.qaly - c.qaly, 6) AS QALY, round(a.cost - c.cost, 6) AS Cost,
           round((a.cost - c.cost) / nullif(a.qaly - c.qaly, 0), 6) AS ICER
    FROM t a JOIN t c USING (scenario_id, variant_id, q, n, firm)
    WHERE a.treatment = 'active' AND c.treatment = 'control'""",
)
def sweep_grid(spark, sf_dir):
    return _compared(sweep.sweep(part_bundle(spark, sf_dir), GRID, cohort.incremental))


#: 8 x 4 x 4 x 2 x 4 = 1,024 combinations, of which the treated arm needs 256 and the other one 8.
WIDE = [
    sweep.Cell("state_table", "active/1", "p_prog", "transform(sequence(1, 8), i -> i / 20D)"),
    sweep.Cell("state_table", "active/2", "QoL", "array(0.5D, 0.6D, 0.7D, 0.8D)"),
    sweep.Cell("payment_table", "fixed", "contract_length", "array(1D, 4D, 8D, 16D)"),
    sweep.Cell("global_table", "discount", "value", "array(0.02D, 0.04D)"),
    sweep.Cell("state_table", "control/1", "p_death", "array(0.01D, 0.02D, 0.05D, 0.1D)"),
]


@query(
    "wide_sweep",
    """WITH RECURSIVE
    arm AS (SELECT s_suppkey AS scenario_id, 'active' AS treatment, (s_acctbal + 1000) / 500e0 AS total, n, p, u, q, d,
                   i AS i1, j AS i2, k AS i3, l AS i4, 0 AS i5
            FROM supplier, (SELECT i, (i + 1) / 20e0 AS p FROM range(8) t(i)),
                 (VALUES (0, 0.5e0), (1, 0.6e0), (2, 0.7e0), (3, 0.8e0)) g2(j, q),
                 (VALUES (0, 1), (1, 4), (2, 8), (3, 16)) g3(k, n), (VALUES (0, 0.02e0), (1, 0.04e0)) g4(l, d),
                 (VALUES (0.01e0)) g5(u)
            UNION ALL
            SELECT s_suppkey, 'control', 0e0, 1, 1e0, u, 0.6e0, d, 0, 0, 0, l, m
            FROM supplier, (VALUES (0, 0.02e0), (1, 0.04e0)) g4(l, d),
                 (VALUES (0, 0.01e0), (1, 0.02e0), (2, 0.05e0), (3, 0.1e0)) g5(m, u)),
    r AS (SELECT *, 1 AS time, 1e0 AS x1, 0e0 AS x2 FROM arm UNION ALL
          SELECT * EXCLUDE (time, x1, x2), time + 1, x1 * (1 - p) * (1 - u), x1 * p * (1 - u)
          FROM r WHERE time < 12),
    t AS (SELECT scenario_id, treatment, i1, i2, i3, i4, i5,
                 sum(CASE treatment WHEN 'control' THEN x1 * 0.1e0 / power(1 + d, time - 1)
                     WHEN 'active' THEN CASE WHEN time <= n THEN
                       x1 * total / n * power(1.1e0 / (1 + d), time - 1) ELSE 0 END END) AS cost,
                 sum((x1 + q * x2) / power(1 + d, time - 1)) AS qaly
          FROM r GROUP BY ALL)
    SELECT a.scenario_id, 'active - control' AS Treatments,
           (((a.i1 * 4 + a.i2) * 4 + a.i3) * 2 + a.i4) * 4 + c.i5 AS variant_id,
           (a.i1 + 1) / 20e0 AS p_prog, 0.5e0 + a.i2 / 10e0 AS QoL,
           [1e0, 4e0, 8e0, 16e0][a.i3 + 1] AS contract_length, 0.02e0 * (a.i4 + 1) AS "value",
           [0.01e0, 0.02e0, 0.05e0, 0.1e0][c.i5 + 1] AS p_death,
           round(a.qaly - c.qaly, 6) AS QALY, round(a.cost - c.cost, 6) AS Cost,
           round((a.cost - c.cost) / nullif(a.qaly - c.qaly, 0), 6) AS ICER
    FROM t a JOIN t c USING (scenario_id, i4) WHERE a.treatment = 'active' AND c.treatment = 'control'""",
)
def wide_sweep(spark, sf_dir):
    """A model for each supplier over 1,024 combinations: two states alive, then death."""
    supplier = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS scenario_id", "s_acctbal")
    states = supplier.selectExpr(
        "scenario_id",
        """stack(6, 'active', 1, 0.1D, 1D, 0.01D, 'fixed', 'active', 2, 1D, 0.6D, 0D, NULL,
            'active', 3, 0D, 0D, 0D, NULL, 'control', 1, 1D, 1D, 0.01D, 'cont', 'control', 2, 1D, 0.6D, 0D, NULL,
            'control', 3, 0D, 0D, 0D, NULL) AS (treatment, state, p_prog, QoL, p_death, payment)""",
    )
    payments = supplier.selectExpr(
        "scenario_id",
        """stack(2, 'fixed', CAST((s_acctbal + 1000) / 500 AS DOUBLE), 0D, 8D, 'cont', 0D, 0.1D, 0D)
           AS (payment, tot_payment, cont_payment, contract_length)""",
    )
    rates = supplier.selectExpr(
        "scenario_id",
        """stack(4, 'discount', 0.03D, 'firm_discount', 0.1D, 'time_horizon', 12D, 'control_count', 1D)
           AS (name, value)""",
    )
    return _compared(sweep.sweep(ModelBundle(states, payments, rates), WIDE, cohort.incremental))
