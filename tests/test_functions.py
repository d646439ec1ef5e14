import random

import pytest
from pyspark.sql import functions as F

from cohortspan import functions as cf
from cohortspan.operators.schedule import payment_schedule


def values(spark, column, expression, data, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, {column} {kind}")
    return [r["out"] for r in df.orderBy("i").select(expression.alias("out")).collect()]


def test_two_decimals_print_like_c(spark):
    rng = random.Random(3)
    data = [0.125, -0.005, 0.005, 1.005, 2.675, 0.375, 1e6 + 0.125, -0.02, 0.0, 19.995, 0.045]
    data += [rng.randrange(-10**6, 10**6) / 1000 for _ in range(2000)]
    data += [rng.uniform(-1000, 1000) for _ in range(500)]
    assert values(spark, "v", cf.two_decimals(F.col("v")), data) == ["%.2f" % v for v in data]


def test_hazard(spark):
    found = values(spark, "s", cf.hazard(F.col("s"), F.lit(5)), [0.0, 1.0, 0.5])
    assert found == pytest.approx([1.0, 0.0, 1 - 0.5**0.2])


def test_discount_factor(spark):
    found = values(spark, "t", cf.discount_factor(F.lit(0.03), F.col("t")), [1, 2, 20], "int")
    assert found == pytest.approx([1, 1 / 1.03, 1.03**-19])


def test_linear_ramp(spark):
    found = values(spark, "n", cf.linear_ramp("1D", "0.4D", "n"), [1, 2, 4], "int")
    assert [pytest.approx(v) for v in found] == [[1.0], [1.0, 0.4], [1.0, 0.8, 0.6, 0.4]]


def test_to_number_and_lists(spark):
    data = [" 1.5 ", "x", "", None, "1e3"]
    assert values(spark, "t", cf.to_number(F.col("t")), data, "string") == [
        1.5,
        None,
        None,
        None,
        1000.0,
    ]
    lists = values(spark, "t", cf.is_number_list(F.col("t")), ["0.0 0.01 5", "1,2", "7"], "string")
    assert lists == [True, False, True]


def test_ratio_and_label(spark):
    found = values(spark, "d", cf.ratio(F.lit(6.0), F.col("d")), [3.0, 0.0, None])
    assert found == [2.0, None, None]
    labels = values(spark, "a", cf.arm_label(F.col("a"), F.lit("c")), ["x", None], "string")
    assert labels == ["x - c", None]


PLANS = {
    # name: (total, length, initial, expected by period)
    "even": (10.0, 4.0, 0.0, [2.5, 2.5, 2.5, 2.5, 0, 0]),
    "initial": (10.0, 3.0, 0.4, [4, 3, 3, 0, 0, 0]),
    "beyond": (12.0, 12.0, 0.0, [1] * 6),
    "rest is lost": (10.0, 1.0, 0.4, [4, 0, 0, 0, 0, 0]),
    "no length": (10.0, 0.0, 0.0, [0] * 6),
}


def test_schedules(spark):
    df = spark.createDataFrame(
        [(n, t, length, i) for n, (t, length, i, _) in PLANS.items()],
        "name string, tot_payment double, contract_length double, initial_payment double",
    )
    rows = payment_schedule(df, "6").collect()
    for name, (total, length, _, expected) in PLANS.items():
        paid = {r["time"]: r["payment"] for r in rows if r["name"] == name}
        assert [paid[t] for t in range(1, 7)] == pytest.approx(expected), name
        if name in ("even", "initial"):
            assert sum(paid.values()) == pytest.approx(total)
    due = payment_schedule(df, "6", only_due=True).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in due} == {
        "even": 4,
        "initial": 3,
        "beyond": 6,
        "rest is lost": 1,
    }


def test_schedule_start_and_rates(spark):
    df = spark.createDataFrame([(10.0, 2.0)], "tot_payment double, contract_length double")
    rows = payment_schedule(
        df, "5", start="3", discount="0.03D", firm_discount="0.1D"
    ).orderBy("time")
    grow = 1.1 / 1.03
    assert [r["payment"] for r in rows.collect()] == pytest.approx(
        [0, 0, 5 * grow**2, 5 * grow**3, 0]
    )


def test_continuous_schedule_by_mode(spark):
    df = spark.createDataFrame([(0.5, 0.05)], "cont_payment double, cost_trend double")
    rates = {"discount": "0.03D", "firm_discount": "0.1D"}
    now = payment_schedule(df, "3", start="2", **rates).orderBy("time").collect()
    assert [r["payment"] for r in now] == pytest.approx(
        [0.5 * 1.05**-k * 1.03**-k for k in range(3)]
    )
    old = payment_schedule(df, "3", mode="legacy", **rates).orderBy("time").collect()
    assert [r["payment"] for r in old] == pytest.approx(
        [0.5 * 1.05**-k * (1.1 / 1.03) ** k for k in range(3)]
    )


def test_paid_before_is_the_sum_of_payments(spark):
    """Closed form against adding up, with equal rates, near-equal ones, and plans of all kinds."""
    plans = [
        (total, ongoing, trend, length, initial, discount, firm, start)
        for total, ongoing in ((9.0, 0.0), (0.0, 0.4))
        for trend in (0.0, 0.06, -0.02)
        for length in (0.0, 1.0, 4.5, 40.0)
        for initial in (0.0, 0.25, 1.0)
        for discount, firm in ((0.03, 0.1), (0.05, 0.05), (0.03, 0.03 + 1e-12), (0.0, 0.0), (0.0, 0.02))
        for start in (1, 3)
    ]
    names = "tot_payment, cont_payment, cost_trend, contract_length, initial_payment, discount, firm_discount, start"
    df = spark.createDataFrame(plans, names.split(", ")).selectExpr("*", "explode(sequence(1, 30)) AS t")
    for continuous in (False, True):
        one = cf.payment_sql("s", start="start", firm_on_continuous=continuous)
        slow = f"aggregate(transform(IF(t > 1, sequence(1L, t - 1), array()), s -> {one}), 0D, (a, v) -> a + v)"
        fast = cf.paid_before_sql("t", start="start", firm_on_continuous=continuous)
        worst = df.selectExpr(f"max(abs({slow} - ({fast}))) AS off", f"max({slow}) AS most").first()
        assert worst["most"] > 5 and worst["off"] < 1e-11
