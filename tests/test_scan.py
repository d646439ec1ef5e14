"""Cut groups must give what whole groups give, whatever the cuts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortspan.operators import scan
from cohortspan.operators.expand import expand_knots
from cohortspan.operators.filters import rows_between, top_by_group
from cohortspan.operators.matching import assign_buckets, cumulative_shares


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(900):
        # One key holds most rows; a null key is a group of its own; many times repeat.
        key = rng.choice([1, 1, 1, 1, 2, 3, None])
        value = rng.choice([None, None, float(rng.randrange(100))])
        data.append((key, rng.randrange(60), i, value, rng.choice("abc")))
    return spark.createDataFrame(
        data, "key long, at int, id long, value double, word string"
    ).cache()


def steps():
    return {
        "nth": scan.position(),
        "size": scan.group_size(),
        "run": scan.running_sum(F.col("value")),
        "before": scan.sum_before(F.col("value")),
        "total": scan.group_total(F.col("value")),
        "least": scan.group_min(F.col("value")),
        "top": scan.running_max(F.col("value")),
        "filled": scan.last_valid(F.col("value")),
        "ahead": scan.next_valid(F.col("value")),
        "was": scan.previous(F.col("value")),
        "then": scan.following(F.col("word")),
    }


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["key"], []).append(r)
    found = {}
    for group in groups.values():
        group.sort(key=lambda r: (r["at"], r["id"]))
        given = [r["value"] for r in group if r["value"] is not None]
        for i, r in enumerate(group):
            upto = [g["value"] for g in group[: i + 1] if g["value"] is not None]
            past = [g["value"] for g in group[:i] if g["value"] is not None]
            found[r["id"]] = {
                "nth": i + 1,
                "size": len(group),
                "run": sum(upto) if upto else None,
                "before": sum(past),
                "total": sum(given) if given else None,
                "least": min(given) if given else None,
                "top": max(upto) if upto else None,
                "filled": upto[-1] if upto else None,
                "ahead": next((g["value"] for g in group[i:] if g["value"] is not None), None),
                "was": group[i - 1]["value"] if i else None,
                "then": group[i + 1]["word"] if i + 1 < len(group) else None,
            }
    return found


@pytest.mark.parametrize("tasks", [None, 2, 20])
def test_scan_against_brute_force(rows, tasks):
    expected = brute(rows.collect())
    scanned = scan.ordered_scan(rows, ["key"], ["at", "id"], tasks=tasks, **steps())
    assert scanned.columns == [*rows.columns, *steps()]
    found = {r["id"]: {name: r[name] for name in steps()} for r in scanned.collect()}
    assert found == expected


def test_only_large_groups_are_cut(spark):
    df = spark.range(40_000).selectExpr("IF(id % 10 = 0, id, -1) AS key", "id AS at")
    cuts = scan.find_cuts(df, ["key"], ["at"], 8).collect()
    assert [r["key"] for r in cuts] == [-1]
    found = [c["at"] for c in cuts[0]["__cuts"]]
    assert found == sorted(found) and 10 <= len(found) <= 16
    assert [r.asDict() for r in scan.find_cuts(df, ["key"], ["at"], 8).collect()] == [
        r.asDict() for r in cuts
    ]


@pytest.mark.parametrize("order", [["at", "id"], ["word", "id"], ["same", "id"]])
def test_hot_key_ties_and_text_orders(spark, order):
    """One key has nine tenths of the rows; the first order column may be text or all alike."""
    df = spark.range(6_000).selectExpr(
        "IF(id % 10 = 0, id DIV 100, -1) AS key",
        "id",
        "hash(id) AS at",
        "CAST(hash(id) % 50 AS STRING) AS word",
        "7 AS same",
    )
    steps = {"nth": scan.position(), "was": scan.previous(F.col("id")), "size": scan.group_size()}
    cut = scan.ordered_scan(df, ["key"], order, tasks=8, **steps)
    whole = scan.ordered_scan(df, ["key"], order, cuts=None, **steps)
    assert scan.find_cuts(df, ["key"], order, 8).count() == 1
    assert cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0


def test_one_plan_for_all_sizes(spark):
    """Building runs no job, and the plan of a small frame is that of a large one."""
    def plan(rows):
        df = spark.range(rows).selectExpr("id % 3 AS key", "id AS at")
        done = scan.ordered_scan(df, ["key"], ["at"], nth=scan.position())
        text = done._jdf.queryExecution().optimizedPlan().toString()
        return [re.sub(r"[(#\[].*", "", line).strip(" :+-") for line in text.splitlines()]

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("built", "no job is expected here")
    small, large = plan(5_000), plan(50_000_000)
    assert tracker.getJobIdsForGroup("built") == []
    spark.sparkContext.setJobGroup("other", "")
    assert small == large


def test_order_by_time(spark):
    df = spark.range(300).selectExpr(
        "1 AS key", "id", "timestamp_seconds(id DIV 3) AS ts", "date_add(DATE'2024-01-01', "
        "CAST(id AS INT)) AS day", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id) AS n"
    )
    for column in ("ts", "day", "n"):
        done = scan.ordered_scan(
            df, ["key"], [column, "id"], tasks=4, nth=scan.position()
        )
        assert done.where("nth != id + 1").count() == 0


def test_expansion_is_the_same_in_blocks(spark):
    rng = random.Random(1)
    data = [(k, i, rng.choice([None, 1.0 * i, 5.0]), rng.randrange(4)) for k in "ab" for i in range(80)]
    df = spark.createDataFrame(data, "key string, at int, v double, n int")
    whole = expand_knots(df, ["key"], ["at"], "v", periods=F.col("n"), short_groups=True)
    parts = expand_knots(df, ["key"], ["at"], "v", periods=F.col("n"), tasks=4)
    order = ["key", "step"]
    assert parts.orderBy(*order).collect() == whole.orderBy(*order).collect()
    assert whole.count() == sum(r[3] for r in data)


def test_rows_between(rows):
    expected = {i for i, r in brute(rows.collect()).items() if 2 <= r["nth"] <= 3}
    first = rows_between(rows, ["key"], ["at", "id"], 2, 3)
    assert {r["id"] for r in first.collect()} == expected
    rest = rows_between(rows, ["key"], ["at", "id"], 4, tasks=20)
    expected = {i for i, r in brute(rows.collect()).items() if r["nth"] >= 4}
    assert {r["id"] for r in rest.collect()} == expected


@pytest.mark.parametrize("tasks", [None, 4])
def test_top_by_group(spark, tasks):
    df = spark.createDataFrame([(k, i, k + 1.0) for k in range(3) for i in range(50)], "k int, i int, n double")
    kept = top_by_group(df, ["k"], "i", F.col("n"), tasks=tasks).collect()
    assert {(r["k"], r["i"]) for r in kept} == {
        (0, 49), (1, 49), (1, 48), (2, 49), (2, 48), (2, 47),
    }


@pytest.mark.parametrize("options", [{}, {"chunk": 2}, {"chunk": 1, "tasks": 4}])
@pytest.mark.parametrize("placed", [True, False])
def test_buckets(spark, options, placed):
    rng = random.Random(2)
    weights = {"x": {"a": 1, "b": 3, "c": 4}, "y": {"d": 2, "e": 2}}
    table = spark.createDataFrame(
        [(g, label, w) for g, labels in weights.items() for label, w in labels.items()],
        "g string, label string, w long",
    )
    draws = [(i, rng.choice("xxxy"), rng.choice([0.125, 0.5, 1.0, rng.random()])) for i in range(200)]
    draws += [(200, "z", 0.5), (201, "x", None)]
    shares = cumulative_shares(table, ["g"], "label", "w")
    shares = shares if placed else shares.drop("place")
    # The top bound is lowered to see draws beyond the last bucket.
    shares = shares.withColumn("upper", F.when(F.col("label") == "e", 0.9).otherwise(F.col("upper")))
    df = spark.createDataFrame(draws, "i int, g string, u double")
    found = {
        r["i"]: r["label"]
        for r in assign_buckets(df, shares, ["g"], "u", "label", **options).collect()
    }
    bounds = {r["label"]: (r["g"], r["upper"]) for r in shares.collect()}
    for i, g, u in draws:
        fitting = sorted((b, label) for label, (h, b) in bounds.items() if h == g and u is not None and u <= b)
        assert found[i] == (fitting[0][1] if fitting else None)


def test_cut_points_come_from_a_sample_of_bounded_size(spark):
    """The sample is drawn by hash alone: no single task gathers it, and neither the number of rows
    nor how they are dealt over tasks changes it much."""
    sizes = {}
    for count, dealt in ((20_000, 3), (20_000, 60), (200_000, 60)):
        df = spark.range(0, count, 1, dealt).select(F.lit(1).alias("key"), "id")
        cuts = scan.find_cuts(df, ["key"], ["id"], tasks=8)
        plan = cuts._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" not in plan and "Limit" not in plan
        sizes[count, dealt] = cuts.first()["__cuts"]
    assert sizes[20_000, 3] == sizes[20_000, 60]
    expected = 8 * scan.SAMPLED / scan.APART
    assert all(abs(len(found) - expected) <= expected / 2 for found in sizes.values())
    blocks = sorted(r["id"] for r in sizes[200_000, 60])
    assert max(b - a for a, b in zip([0, *blocks], [*blocks, 200_000])) < 200_000 / 4


def test_cut_points_of_few_rows(spark):
    """Fewer rows than would be sampled, and none."""
    df = spark.range(100).select(F.lit(1).alias("key"), "id")
    assert len(scan.find_cuts(df, ["key"], ["id"], tasks=8).first()["__cuts"]) == 6
    assert scan.find_cuts(df.where("id < 0"), ["key"], ["id"], tasks=8).isEmpty()


def test_top_of_a_large_group_is_spread(spark):
    """100,000 of 300,000 rows of one group, found and kept in all tasks."""
    df = spark.range(0, 300_000, 1, 6).select(F.lit("g").alias("key"), F.expr("id * 7919 % 300000").alias("name"))
    kept = top_by_group(df, ["key"], "name", F.lit(100_000), tasks=8)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"  # few bytes, which would be put together
    spark.conf.set(merged, False)
    try:
        sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset(merged)
    assert sum(sizes) == 100_000 and len(sizes) > 2 and max(sizes) < 60_000
    assert kept.agg(F.min("name")).first()[0] == 200_000
