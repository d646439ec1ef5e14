"""The older model form against a plain calculation."""

import pytest
from pyspark.sql import functions as F

from cohortspan.plans import contracts, sweep, validate
from cohortspan.tables import LegacyBundle

RATES = {"discount": 0.03, "firm_discount": 0.05, "time_horizon": 12.0}
# plan, name, p_HU, p_HD, p_UD, health_states, QoL_start, QoL_end, random_state, second, p_HU2
TREATMENTS = [
    (0, "Comparison", 0.9, 0.01, 0.02, 6, 1.0, 0.0, 1, 0, 0.0),
    (1, "Early", 0.04, 0.01, 0.02, 6, 0.9, 0.6, 1, 0, 0.0),
    (2, "Late", 0.04, 0.01, 0.02, 6, 1.0, 0.0, 3, 0, 0.0),
    (3, "Twice", 0.03, 0.02, 0.05, 4, 0.8, 0.7, 1, 3, 0.1),
]
# plan, name, total, continuous, length, initial, refund, start, end, trend, threshold
CONTRACTS = [
    (0, "usual", 0.0, 0.5, 0.0, 0.0, 0.0, 1, 6, 0.05, 0.0),
    (1, "instalments", 10.0, 0.0, 10.0, 0.4, 0.5, 1, 2, 0.0, 0.0),
    (1, "follow-up", 0.0, 0.5, 0.0, 0.0, 0.0, 2, 6, 0.0, 0.0),
    (2, "stop", 8.0, 0.0, 20.0, 0.0, 0.0, 1, 4, 0.0, 0.3),
    (3, "one-off", 6.0, 0.0, 1.0, 0.0, 0.0, 1, 3, 0.0, 0.0),
]
TREATMENT_TYPE = (
    "plan int, name string, p_HU double, p_HD double, p_UD double, health_states int, "
    "QoL_start double, QoL_end double, random_state int, random_state2 int, p_HU2 double"
)
CONTRACT_TYPE = (
    "plan int, name string, tot_payment double, cont_payment double, contract_length double, "
    "initial_payment double, refund double, start int, end int, cost_trend double, "
    "aggregate_failure double"
)


@pytest.fixture(scope="module")
def bundle(spark):
    def table(rows, kind):
        data = [("s", at, *row) for at, row in enumerate(rows, start=1)]
        return spark.createDataFrame(data, f"scenario_id string, row_id long, {kind}")

    rates = [("s", k, v) for k, v in RATES.items()]
    return LegacyBundle(
        treatments=table(TREATMENTS, TREATMENT_TYPE),
        contracts=table(CONTRACTS, CONTRACT_TYPE),
        globals=spark.createDataFrame(rates, "scenario_id string, name string, value double"),
    )


def dense(row):
    _, _, up, down, later, n, _, _, first, second, up2 = row
    cells = [[0.0] * n for _ in range(n)]
    for i in range(n - 1):
        cells[i][i + 1] = 1 - later
        cells[i][n - 1] = later
    cells[n - 2][n - 1] = 1.0
    cells[n - 1][n - 1] = 1.0
    cells[first - 1][first - 1 : first + 1] = [1 - up - down, up]
    cells[first - 1][n - 1] = down
    if second:
        cells[second - 1][second - 1 : second + 1] = [1 - up2 - later, up2]
        cells[second - 1][n - 1] = later
    return cells


def reach(cells, horizon):
    at = [[1.0] + [0.0] * (len(cells) - 1)]
    while len(at) < horizon:
        at.append([sum(x * row[j] for x, row in zip(at[-1], cells)) for j in range(len(cells))])
    return at


def quality(row):
    n, first, last = row[5], row[6], row[7]
    if last > 0:
        return [first + (last - first) * i / (n - 2) for i in range(n - 1)] + [0.0]
    return [first + (last - first) * i / (n - 1) for i in range(n)]


def expected():
    horizon = int(RATES["time_horizon"])
    found = {}
    for tr in TREATMENTS:
        shares = reach(dense(tr), horizon)
        for con in [c for c in CONTRACTS if c[0] == tr[0]]:
            _, name, total, cont, length, initial, refund, start, end, trend, limit = con
            paid, failed = 0.0, 0.0
            for t in range(1, horizon + 1):
                x = shares[t - 1]
                if total > 0:
                    due = total / length if not initial else total * (1 - initial) / (length - 1)
                    due = total * initial if initial and t == 1 else due
                    due = due if t <= length else 0.0
                else:
                    due = cont * (1 + trend) ** (1 - t)
                due *= ((1 + RATES["firm_discount"]) / (1 + RATES["discount"])) ** (t - 1)
                before = 0.0 if t > length and length < horizon else paid
                paid += due
                failing = x[end - 1]
                failed += failing
                paying = x[0] if end == 2 else sum(x[start - 1 : end - 1])
                cost = paying * due - failing * refund * before
                if limit > 0:
                    cost = due if failed < limit else 0.0
                health = sum(a * b for a, b in zip(x, quality(tr))) * 1.03 ** (1 - t)
                found[(tr[1], name, t)] = (health, cost, failing, before)
    return found


def test_series(bundle):
    rows = contracts.contract_series(bundle).collect()
    found = {
        (r["name"], r["contract"], r["time"]): (r["QALY"], r["payment"], r["failing"], r["cumcosts"])
        for r in rows
    }
    wanted = expected()
    assert found.keys() == wanted.keys()
    for key in wanted:
        assert found[key] == pytest.approx(wanted[key], abs=1e-12), key


def test_transitions(bundle):
    edges = contracts.treatment_transitions(bundle).collect()
    for tr in TREATMENTS:
        found = [[0.0] * tr[5] for _ in range(tr[5])]
        for e in edges:
            if e["treatment"] == tr[1]:
                found[e["from_state"] - 1][e["to_state"] - 1] += e["p"]
        assert sum(found, []) == pytest.approx(sum(dense(tr), []))


def test_quality(bundle):
    rows = contracts.quality_table(bundle).orderBy("name", "state").collect()
    for tr in TREATMENTS:
        assert [r["QoL"] for r in rows if r["name"] == tr[1]] == pytest.approx(quality(tr))


def test_comparison_counts_health_once(bundle):
    series = expected()

    def total(name):
        first = next(c[1] for tr in TREATMENTS for c in CONTRACTS if tr[1] == name and tr[0] == c[0])
        health = sum(v[0] for (n, c, _), v in series.items() if n == name and c == first)
        return health, sum(v[1] for (n, _, _), v in series.items() if n == name)

    rows = contracts.compare_plans(bundle).collect()
    assert {r["Treatments"] for r in rows} == {
        f"{n} - Comparison" for n in ("Early", "Late", "Twice")
    }
    control = total("Comparison")
    for r in rows:
        health, cost = total(r["Treatments"].split(" - ")[0])
        gain, price = health - control[0], cost - control[1]
        assert (r["QALY"], r["Cost"], r["ICER"]) == pytest.approx((gain, price, price / gain))
    assert contracts.compare_plans(bundle, active_plans=[2]).count() == 1


def test_instalments_and_forecast(bundle):
    due = contracts.contract_payments(bundle.contracts.where("name = 'instalments'"))
    paid = [r["payment"] for r in due.orderBy("time").collect()]
    assert paid == pytest.approx([4.0] + [6 / 9] * 9)
    plans = contracts.payment_plans(bundle)
    varied = contracts.forecast_variant(plans, "usual", "cheaper", 0.05)
    assert varied.count() == plans.count() + 12
    both = {
        r["payment_plan"]: r["payment"]
        for r in varied.where("time = 3 AND payment_plan IN ('usual', 'cheaper')").collect()
    }
    assert both["cheaper"] == pytest.approx(both["usual"] / 1.05**2)


def test_defaults_of_absent_columns(spark, bundle):
    few = bundle.treatments.select("scenario_id", "row_id", "plan", "name", "health_states")
    filled = contracts.complete_treatments(few).first()
    assert (filled["p_HU"], filled["QoL_end"], filled["random_state"]) == (1.0, 0.0, 1)


def test_contract_and_treatment_checks(spark, bundle):
    assert validate.check_contracts(bundle).count() == 0
    wrong = bundle.contracts.selectExpr(
        "scenario_id", "row_id", "plan", "start",
        "CASE name WHEN 'usual' THEN 7 WHEN 'follow-up' THEN 2 ELSE `end` END AS `end`",
    )
    found = validate.check_contracts(bundle.with_tables(contracts=wrong)).orderBy("row").collect()
    assert [(r["row"], r["message"]) for r in found] == [
        (1, "end is set greater than number of health states"),
        (3, "end has to be later than start"),
    ]
    small = bundle.treatments.selectExpr(
        "scenario_id", "row_id", "random_state",
        "CASE row_id WHEN 1 THEN 1 WHEN 3 THEN 4 ELSE health_states END AS health_states",
    )
    found = validate.check_treatments(bundle.with_tables(treatments=small)).orderBy("row").collect()
    assert [r["row"] for r in found] == [1, 3]
    assert found[0]["message"] == "health_states must be at least 2, now: 1"


def test_sweep_of_contracts(spark, bundle):
    variations = spark.createDataFrame(
        [
            ("global_table", "firm_discount", "value", 0.03),
            ("global_table", "firm_discount", "value", 0.1),
            ("treatment_table", "Early", "p_HU", 0.0),
            ("treatment_table", "Early", "p_HU", 0.01),
            ("treatment_table", "Early", "p_HU", 0.05),
            ("contract_table", "instalments", "contract_length", 2.0),
            ("contract_table", "instalments", "contract_length", 5.0),
            ("contract_table", "instalments", "contract_length", 10.0),
        ],
        "table_name string, row_name string, column_name string, value double",
    )
    cells = sweep.cells_of(variations)
    swept = sweep.sweep(bundle, cells, contracts.compare_plans, add_row_names=True).collect()
    assert len(swept) == 18 * 3
    assert len({r["variant_id"] for r in swept}) == 18
    chosen = [
        r
        for r in swept
        if r["Treatments"] == "Early - Comparison"
        and (r["firm_discount value"], r["Early p_HU"], r["instalments contract_length"])
        == (0.03, 0.05, 5.0)
    ]
    one = bundle.with_tables(
        treatments=bundle.treatments.selectExpr(
            *[
                "IF(name = 'Early', 0.05D, p_HU) AS p_HU" if c == "p_HU" else c
                for c in bundle.treatments.columns
            ]
        ),
        contracts=bundle.contracts.selectExpr(
            *[
                "IF(name = 'instalments', 5D, contract_length) AS contract_length"
                if c == "contract_length"
                else f"`{c}`"
                for c in bundle.contracts.columns
            ]
        ),
        globals=bundle.globals.selectExpr(
            "scenario_id", "name", "IF(name = 'firm_discount', 0.03D, value) AS value"
        ),
    )
    alone = contracts.compare_plans(one).where("Treatments = 'Early - Comparison'").first()
    assert len(chosen) == 1
    for c in ("QALY", "Cost", "ICER"):
        assert chosen[0][c] == pytest.approx(alone[c])


def test_sweep_names_what_is_missing(bundle):
    with pytest.raises(ValueError, match="Could not find table"):
        sweep.vary(bundle, None, [sweep.Cell("no_table", "a", "b", "array(1D)")])
    with pytest.raises(ValueError, match="Could not find column: b"):
        sweep.vary(bundle, None, [sweep.Cell("global_table", "a", "b", "array(1D)")])


def test_a_plan_with_very_many_treatments_is_spread(spark, bundle, monkeypatch):
    """4,000 treatments on one plan are no single partition, and each gets what it gets alone."""
    monkeypatch.setattr(contracts, "MATCHED", 50)
    copies = bundle.treatments.where("plan = 1").selectExpr(
        "scenario_id", "explode(sequence(1L, 4000L)) AS row_id", "plan", "p_HU", "p_HD", "p_UD", "health_states",
        "QoL_start", "QoL_end", "random_state", "random_state2", "p_HU2",
    ).selectExpr("*", "concat('Early ', row_id) AS name")
    hot = bundle.with_tables(treatments=copies)
    spark.conf.set("spark.sql.adaptive.enabled", False)  # would put so few bytes together
    try:
        sizes = [r["count"] for r in contracts._matched(hot, 8).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert sum(sizes) == 8000 and len(sizes) >= 4 and max(sizes) < 2.5 * sum(sizes) / len(sizes)
    alone = {tuple(r[1:]) for r in contracts.details(bundle).where("plan = 1").drop("name").collect()}
    found = {(r["plan"], r["contract"], r["QALY"], r["Cost"]) for r in contracts.details(hot).collect()}
    assert found == alone
