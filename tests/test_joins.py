"""Joins of tables that grow with the scenarios: nothing whole is sent to the driver."""

import re

import pytest

from cohortspan.catalog import QUERIES
from cohortspan.operators import matching
from cohortspan.operators.columns import parameters
from cohortspan.session import meet

SMALL = "/root/testdata/sf0.001"


def joins(df) -> list[str]:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if re.search(r"\bJoin (Inner|LeftOuter)", line)]


@pytest.mark.parametrize("name", ["legacy_contract", "legacy_details", "legacy_series", "legacy_sweep", "multi_value_sweep", "incremental", "detail_mixed", "qaly_series", "mixed_plan_columns", "plan_listing", "contract_errors"])
def test_no_join_is_left_to_the_size_of_compressed_rows(spark, name):
    found = joins(QUERIES[name](spark, SMALL))
    assert found
    assert not [line for line in found if "strategy=merge" not in line and "strategy=broadcast" not in line]


def test_edges_of_a_treatment_are_summed_up_where_they_are_made(spark):
    plan = QUERIES["legacy_matrix"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_meet_takes_nulls_and_large_keys(spark):
    rows = [(i % 2 if i % 5 else None, None if i % 3 else "x", i) for i in range(9000)]
    left = spark.createDataFrame(rows, "k int, s string, i int")
    right = spark.createDataFrame([(0, None, 1.0), (1, "x", 2.0), (1, "x", 3.0), (None, "x", 4.0)], "k int, s string, v double")
    for how in ("left", "inner"):
        found = meet(left, right, ["k"], how=how, safe=["s"], deal="i")
        assert set(found.columns) == {"k", "s", "i", "v"}
        values = {(0, None): [1.0], (1, "x"): [2.0, 3.0]}
        missing = [None] if how == "left" else []
        wanted = [(k, s, i, v) for k, s, i in rows for v in values.get((k, s), missing)]
        key = lambda row: (row[2], row[3] or 0.0)
        got = [tuple(r) for r in found.select("k", "s", "i", "v").collect()]
        assert sorted(got, key=key) == sorted(wanted, key=key)


def test_draws_of_a_large_group_are_dealt_and_looked_up_in_short_rows(spark, monkeypatch):
    """Three levels of chunks; a group's draws are in several blocks and not in one hash partition."""
    monkeypatch.setattr(matching, "DRAWN", 50, raising=False)
    bounds = [("a", i, (i + 1) / 400) for i in range(400)] + [(None, i, (i + 1) / 7) for i in range(7)]
    draws = [(g, n, None if n % 97 == 0 else n / 1000) for g in ("a", None, "none") for n in range(1, 1100)]
    found = matching.assign_buckets(
        spark.createDataFrame(draws, "g string, n int, u double"),
        spark.createDataFrame(bounds, "g string, label int, upper double"),
        ["g"], "u", "label", chunk=2,
    )
    wanted = set()
    for g, n, u in draws:
        over = [] if u is None else [label for h, label, upper in bounds if h == g and upper >= u]
        wanted.add((g, n, u, min(over) if over else None))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(draws) and set(got) == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "__met" in plan and "__part" in plan


@pytest.mark.parametrize("name", ["legacy_details", "legacy_series", "detail_mixed"])
def test_scenarios_are_spread_before_they_are_counted(spark, name):
    """A partial aggregate above a scan holds as many scenarios as compressed bytes have room for."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    early = [x for x in lines if "Aggregate(keys=" in x and re.search(r"partial_(count|max)\(", x)]
    assert early
    for at, line in enumerate(lines):
        if line in early:
            below = next(x for x in lines[at + 1 :] if re.search("Exchange|FileScan", x))
            assert "REPARTITION_BY_NUM" in below, line


def test_parameters_are_spread_by_scenario(spark):
    rows = [(i % 3 if i % 7 else None, name, float(i)) for i in range(40) for name in ("a", "b")]
    found = parameters(spark.createDataFrame(rows, "k int, name string, value double"), ["k"], {"a": 1.0, "c": 2.0})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert {tuple(r) for r in found.collect()} == {(0, 39.0, 2.0), (1, 37.0, 2.0), (2, 38.0, 2.0), (None, 35.0, 2.0)}


def test_combinations_are_not_joined_again_to_be_counted(spark):
    plan = QUERIES["multi_value_sweep"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 60


def test_meet_counts_by_the_columns_of_a_cheaper_table(spark):
    left = spark.createDataFrame([(k, v, i) for k in (0, None, 2) for v in (0, 1) for i in range(30)], "k int, v int, i int")
    right = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (2, 1, "c"), (2, 1, "d"), (None, 0, "e")], "k int, v int, s string")
    base = left.where("v = 0").drop("v")
    found = meet(left, right, ["k", "v"], how="inner", deal="i", counted=base, most=7)
    wanted = [(k, v, i, s) for k, v, s in [(0, 0, "a"), (0, 1, "b"), (2, 1, "c"), (2, 1, "d")] for i in range(30)]
    assert sorted(tuple(r) for r in found.select("k", "v", "i", "s").collect()) == sorted(wanted)
