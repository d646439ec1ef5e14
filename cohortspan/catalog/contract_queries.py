"""Plan-matched treatments and contracts on one model per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.catalog.registry import query
from cohortspan.plans import contracts, sweep, validate
from cohortspan.session import meet
from cohortspan.tables import LegacyBundle

_TREATMENT = "named_struct('plan', {0}, 'row_id', {0} + 1L, 'name', '{1}', 'p_HU', {2}, 'p_HD', 0.01D, 'p_UD', 0.02D, 'health_states', 4, 'QoL_start', 1D, 'QoL_end', 0.7D)"  # noqa: E501
_CONTRACT = "named_struct('plan', {0}, 'row_id', {1}L, 'name', '{2}', 'tot_payment', {3}, 'cont_payment', {4}, 'contract_length', {5}, 'refund', {6}, 'start', {7}, 'end', {8}, 'aggregate_failure', {9})"  # noqa: E501
_LENGTH = "CAST(1 + p_size % 10 AS DOUBLE)"


def part_contracts(spark, sf_dir) -> LegacyBundle:
    """Plan 1 treats with a refund contract and a follow-up, plan 2 with a stop rule."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS scenario_id", "p_size", "p_retailprice"
    )
    treated = "(p_size % 10 + 1) / 25D"
    total = "p_retailprice / 100D"
    treatments = [
        _TREATMENT.format(0, "Comparison", "0.9D"),
        _TREATMENT.format(1, "Refunded", treated),
        _TREATMENT.format(2, "Stopped", treated),
    ]
    plans = [
        _CONTRACT.format(0, 1, "usual", "0D", "0.5D", "0D", "0D", 1, 4, "0D"),
        _CONTRACT.format(1, 2, "refund", total, "0D", _LENGTH, "0.5D", 1, 2, "0D"),
        _CONTRACT.format(1, 3, "follow-up", "0D", "0.5D", "0D", "0D", 2, 4, "0D"),
        _CONTRACT.format(2, 4, "stop", total, "0D", _LENGTH, "0D", 1, 2, "0.3D"),
    ]
    return LegacyBundle(
        treatments=part.selectExpr("scenario_id", f"inline(array({', '.join(treatments)}))"),
        contracts=part.selectExpr("scenario_id", f"inline(array({', '.join(plans)}))"),
        globals=part.selectExpr(
            "scenario_id",
            "stack(3, 'discount', 0.03D, 'firm_discount', 0.1D, 'time_horizon', 20D)"
            " AS (name, value)",
        ),
    )


_WALK = """WITH RECURSIVE
    tr AS (SELECT p_partkey AS scenario_id, plan, name, p_size, p_retailprice / 100e0 AS total,
                  CASE plan WHEN 0 THEN 0.9e0 ELSE (p_size % 10 + 1) / 25e0 END AS hu
           FROM part, (VALUES (0, 'Comparison'), (1, 'Refunded'), (2, 'Stopped')) t(plan, name)),
    r AS (SELECT *, 1 AS time, 1e0 AS x1, 0e0 AS x2, 0e0 AS x3, 0e0 AS x4 FROM tr
          UNION ALL
          SELECT scenario_id, plan, name, p_size, total, hu, time + 1,
                 x1 * (1 - hu - 0.01e0), x1 * hu, x2 * 0.98e0,
                 x4 + x1 * 0.01e0 + x2 * 0.02e0 + x3 FROM r WHERE time < 20),
    con AS (SELECT * FROM (VALUES (0, 'usual', 1), (1, 'refund', 1), (1, 'follow-up', 2),
                                  (2, 'stop', 1)) c(plan, contract, nth)),
    due AS (SELECT *, 1 + p_size % 10 AS n, power(1.1e0 / 1.03e0, time - 1) AS grown,
                   CASE WHEN contract IN ('usual', 'follow-up') THEN 0.5e0
                        WHEN time <= 1 + p_size % 10 THEN total / (1 + p_size % 10) ELSE 0 END
                   * power(1.1e0 / 1.03e0, time - 1) AS costs,
                   CASE contract WHEN 'usual' THEN x4 WHEN 'follow-up' THEN x4 ELSE x2 END
                       AS failing,
                   CASE contract WHEN 'usual' THEN x1 + x2 + x3 WHEN 'follow-up' THEN x2 + x3
                        ELSE x1 END AS paying,
                   CASE contract WHEN 'refund' THEN 0.5e0 ELSE 0 END AS refund
            FROM r JOIN con USING (plan)),
    acc AS (SELECT *, sum(failing) OVER (w ROWS UNBOUNDED PRECEDING) AS cumfail,
                   CASE WHEN contract IN ('usual', 'follow-up') OR time > n THEN 0
                        ELSE coalesce(sum(costs) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
                                                       AND 1 PRECEDING), 0) END AS cumcosts
            FROM due WINDOW w AS (PARTITION BY scenario_id, plan, contract ORDER BY time)),
    fin AS (SELECT *, CASE WHEN contract = 'stop'
                           THEN CASE WHEN cumfail < 0.3e0 THEN costs ELSE 0 END
                           ELSE paying * costs - failing * refund * cumcosts END AS payment,
                   CASE nth WHEN 1 THEN (x1 + 0.85e0 * x2 + 0.7e0 * x3)
                                        * power(1.03e0, -(time - 1)) END AS qaly
            FROM acc)
"""


@query(
    "legacy_contract",
    _WALK
    + """SELECT scenario_id, name, plan, contract, time, round(qaly, 6) AS QALY,
                round(payment, 6) + 0e0 AS Cost FROM fin""",
)
def legacy_contract(spark, sf_dir):
    rows = contracts.over_time(part_contracts(spark, sf_dir))
    return rows.withColumns(
        {"QALY": F.round("QALY", 6), "Cost": F.round("Cost", 6) + F.lit(0.0)}
    )


@query(
    "legacy_series",
    _WALK
    + """SELECT plan, contract, time, round(sum(failing), 4) AS failing,
                round(sum(costs), 4) AS costs, round(sum(cumcosts), 4) AS cumcosts,
                round(sum(failing * refund * cumcosts), 4) AS reimburse,
                round(sum(cumfail), 4) AS cumfail
         FROM fin GROUP BY ALL""",
)
def legacy_series(spark, sf_dir):
    series = contracts.contract_series(part_contracts(spark, sf_dir))
    summed = ["failing", "costs", "cumcosts", "reimburse", "cumfail"]
    return series.groupBy("plan", "contract", "time").agg(
        *[F.round(F.sum(c), 4).alias(c) for c in summed]
    )


@query(
    "legacy_details",
    _WALK
    + """SELECT scenario_id, name, plan, contract, round(sum(qaly), 6) AS QALY,
                round(sum(payment), 6) AS Cost FROM fin GROUP BY ALL""",
)
def legacy_details(spark, sf_dir):
    rows = contracts.details(part_contracts(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("QALY", "Cost")})


@query(
    "legacy_compare",
    _WALK
    + """, t AS (SELECT scenario_id, plan, name, sum(qaly) AS q, sum(payment) AS c
                 FROM fin GROUP BY ALL)
    SELECT scenario_id, a.name || ' - ' || b.name AS Treatments, round(a.q - b.q, 6) AS QALY,
           round(a.c - b.c, 6) AS Cost, round((a.c - b.c) / nullif(a.q - b.q, 0), 6) AS ICER
    FROM t a JOIN t b USING (scenario_id) WHERE a.plan > 0 AND b.plan = 0""",
)
def legacy_compare(spark, sf_dir):
    rows = contracts.compare_plans(part_contracts(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("QALY", "Cost", "ICER")})


@query(
    "legacy_transitions",
    """SELECT p_partkey AS scenario_id, plan, name AS treatment, f AS from_state, t AS to_state,
              round(CASE WHEN f = 4 OR f = 3 THEN 1e0
                   WHEN f = 2 THEN CASE t WHEN 3 THEN 0.98e0 ELSE 0.02e0 END
                   WHEN t = 1 THEN 0.99e0 - hu WHEN t = 2 THEN hu ELSE 0.01e0 END, 6) AS p
       FROM (SELECT *, CASE plan WHEN 0 THEN 0.9e0 ELSE (p_size % 10 + 1) / 25e0 END AS hu
             FROM part, (VALUES (0, 'Comparison'), (1, 'Refunded'), (2, 'Stopped')) t(plan, name)),
            (VALUES (1, 1), (1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (4, 4)) e(f, t)""",
)
def legacy_transitions(spark, sf_dir):
    edges = contracts.treatment_transitions(part_contracts(spark, sf_dir))
    return edges.withColumn("p", F.round("p", 6))


@query(
    "legacy_matrix",
    """SELECT p_partkey AS scenario_id, treatment, f AS from_state,
              ['PF', 'P1', 'P2', 'D'][f] AS st,
              round(CASE f WHEN 1 THEN 0.99e0 - hu ELSE 0e0 END, 6) AS PF,
              round(CASE f WHEN 1 THEN hu ELSE 0e0 END, 6) AS P1,
              CASE f WHEN 2 THEN 0.98e0 ELSE 0e0 END AS P2,
              CASE f WHEN 1 THEN 0.01e0 WHEN 2 THEN 0.02e0 ELSE 1e0 END AS D
       FROM (SELECT p_partkey, treatment,
                    CASE treatment WHEN 'Comparison' THEN 0.9e0 ELSE (p_size % 10 + 1) / 25e0 END
                        AS hu
             FROM part, (VALUES ('Comparison'), ('Refunded'), ('Stopped')) t(treatment)),
            (VALUES (1), (2), (3), (4)) s(f)""",
)
def legacy_matrix(spark, sf_dir):
    table = contracts.treatment_table(part_contracts(spark, sf_dir), 4)
    return table.withColumns({c: F.round(c, 6) for c in ("PF", "P1", "P2", "D")})


@query(
    "legacy_quality",
    """SELECT p_partkey AS scenario_id, plan, name, state,
              CASE state WHEN 1 THEN 1e0 WHEN 2 THEN 0.85e0 WHEN 3 THEN 0.7e0 ELSE 0e0 END AS QoL
       FROM part, (VALUES (0, 'Comparison'), (1, 'Refunded'), (2, 'Stopped')) t(plan, name),
            (VALUES (1), (2), (3), (4)) s(state)""",
)
def legacy_quality(spark, sf_dir):
    table = contracts.quality_table(part_contracts(spark, sf_dir))
    return table.withColumn("QoL", F.round("QoL", 6))


@query(
    "legacy_payment_plans",
    _WALK
    + """, s AS (SELECT scenario_id, plan, contract AS payment_plan, time, costs FROM due)
    SELECT scenario_id, plan, payment_plan, time, round(costs, 6) AS payment FROM s
    UNION ALL
    SELECT scenario_id, plan, 'usual forecast', time, round(costs * power(1.05e0, -(time - 1)), 6)
    FROM s WHERE payment_plan = 'usual'""",
)
def legacy_payment_plans(spark, sf_dir):
    series = contracts.payment_plans(part_contracts(spark, sf_dir))
    varied = contracts.forecast_variant(series, "usual", "usual forecast", 0.05)
    return varied.withColumn("payment", F.round("payment", 6))


@query(
    "legacy_instalments",
    """SELECT p_partkey AS scenario_id, contract, t::INTEGER AS time,
              round(p_retailprice / 100e0 / (1 + p_size % 10), 6) AS payment
       FROM part, (VALUES ('refund'), ('stop')) c(contract),
            generate_series(1, 1 + p_size % 10) AS g(t)""",
)
def legacy_instalments(spark, sf_dir):
    due = contracts.contract_payments(part_contracts(spark, sf_dir).contracts)
    return due.select(
        "scenario_id", F.col("name").alias("contract"), "time", F.round("payment", 6).alias("payment")
    )


@query(
    "contract_errors",
    """SELECT p_partkey AS scenario_id, 'contracts' AS "table", 'end, health_states' AS "column",
              nth::BIGINT AS "row",
              CASE WHEN stop > 4 THEN 'end is set greater than number of health states'
                   ELSE 'end has to be later than start' END AS message
       FROM (SELECT p_partkey, nth, first, last + p_size % 5 - 2 AS stop FROM part,
                    (VALUES (1, 1, 4), (2, 1, 2), (3, 2, 4), (4, 1, 2)) c(nth, first, last))
       WHERE stop > 4 OR stop <= first""",
)
def contract_errors(spark, sf_dir):
    bundle = part_contracts(spark, sf_dir)
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS scenario_id", "p_size"
    )
    shifted = meet(bundle.contracts, sizes, ["scenario_id"], how="inner").selectExpr(
        "scenario_id", "plan", "row_id", "start", "`end` + p_size % 5 - 2 AS `end`"
    )
    return validate.check_contracts(bundle.with_tables(contracts=shifted))


LEGACY_GRID = [
    sweep.Cell("treatment_table", "Refunded", "p_HU", "array(0D, 0.05D)"),
    sweep.Cell("contract_table", "refund", "contract_length", "array(1D, 10D)"),
]


@query(
    "legacy_sweep",
    """WITH RECURSIVE
    tr AS (SELECT p_partkey AS scenario_id, plan, p_retailprice / 100e0 AS total, i * 2 + j AS id,
                  q, n, CASE plan WHEN 0 THEN 0.9e0 ELSE q END AS hu
           FROM part, (VALUES (0), (1)) t(plan), (VALUES (0, 0e0), (1, 0.05e0)) g1(i, q),
                (VALUES (0, 1), (1, 10)) g2(j, n)),
    r AS (SELECT *, 1 AS time, 1e0 AS x1, 0e0 AS x2, 0e0 AS x3 FROM tr
          UNION ALL
          SELECT scenario_id, plan, total, id, q, n, hu, time + 1,
                 x1 * (0.99e0 - hu), x1 * hu, x2 * 0.98e0 FROM r WHERE time < 20),
    due AS (SELECT *, power(1.1e0 / 1.03e0, time - 1) AS grown,
                   CASE WHEN time <= n THEN total / n ELSE 0 END
                   * power(1.1e0 / 1.03e0, time - 1) AS costs FROM r),
    acc AS (SELECT *, CASE WHEN time > n THEN 0 ELSE coalesce(sum(costs) OVER (
                   PARTITION BY scenario_id, plan, id ORDER BY time
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS paid FROM due),
    t AS (SELECT scenario_id, plan, id, q, n,
                 sum((x1 + 0.85e0 * x2 + 0.7e0 * x3) * power(1.03e0, -(time - 1))) AS qaly,
                 sum(CASE plan WHEN 0 THEN 0.5e0 * grown * (x1 + x2 + x3)
                     ELSE x1 * costs - x2 * 0.5e0 * paid + 0.5e0 * grown * (x2 + x3) END) AS cost
          FROM acc GROUP BY ALL)
    SELECT scenario_id, id AS variant_id, q AS p_HU, n::DOUBLE AS contract_length,
           'Refunded - Comparison' AS Treatments, round(a.qaly - b.qaly, 6) AS QALY,
           round(a.cost - b.cost, 6) AS Cost,
           round((a.cost - b.cost) / nullif(a.qaly - b.qaly, 0), 6) AS ICER
    FROM t a JOIN t b USING (scenario_id, id, q, n) WHERE a.plan = 1 AND b.plan = 0""",
)
def legacy_sweep(spark, sf_dir):
    swept = sweep.sweep(
        part_contracts(spark, sf_dir),
        LEGACY_GRID,
        lambda bundle: contracts.compare_plans(bundle, active_plans=[1]),
    )
    return swept.withColumns({c: F.round(c, 6) for c in ("QALY", "Cost", "ICER")})
