import pytest
from pyspark.sql import functions as F

from cohortspan.operators.chain import transition_edges, transition_table
from cohortspan.operators.columns import parameters
from cohortspan.operators.expand import expand_states, state_table
from cohortspan.plans import cohort, sweep, validate
from cohortspan.plans.grid import Grid
from cohortspan.tables import GLOBAL_DEFAULTS
from tests import brute
from tests.models import MODELS, bundle_of

PRICED = [name for name in MODELS if name != "faulty"]


@pytest.fixture(scope="module")
def bundle(spark):
    return bundle_of(spark, PRICED)


@pytest.fixture(scope="module")
def series(bundle):
    return cohort.over_time(bundle).collect()


@pytest.mark.parametrize("arms", [cohort.ARMS, 1])
def test_incremental(bundle, arms, monkeypatch):
    monkeypatch.setattr(cohort, "ARMS", arms)
    rows = cohort.incremental(bundle).collect()
    found = {(r["scenario_id"], r["Treatments"]): (r["QALY"], r["Cost"], r["ICER"]) for r in rows}
    expected = {
        (name, pair): values for name in PRICED for pair, values in brute.incremental(MODELS[name]).items()
    }
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        assert found[key] == pytest.approx(values, abs=1e-9), key


def test_the_asserted_ratio(bundle):
    only = bundle.with_tables(states=bundle.states.where("scenario_id = 'anchor'"))
    rows = cohort.incremental(only).collect()
    assert [round(r["ICER"], 2) for r in rows] == [1.09]


def test_lines_by_period(series):
    found = {}
    for r in series:
        key = (r["scenario_id"], r["treatment"], r["costben"])
        found.setdefault(key, {})[r["time"]] = r["value"]
    expected = {
        (name, *key): dict(enumerate(values, start=1))
        for name in PRICED
        for key, values in brute.series(MODELS[name]).items()
    }
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        assert found[key] == pytest.approx(values, abs=1e-9), key
    for name in ("gaps", "halting", "late"):
        assert any(v < 0 for v in found[name, "gene", "Refund"].values())


def test_detail(bundle):
    found = {
        (r["scenario_id"], r["treatment"], r["payment"] or "QALY"): r["cost"] if r["payment"] else r["QALY"]
        for r in cohort.detail(bundle).collect()
    }
    expected = {
        (name, *key): sum(values)
        for name in PRICED
        for key, values in brute.series(MODELS[name]).items()
    }
    assert found.keys() == expected.keys()
    assert found == pytest.approx(expected, abs=1e-9)


def test_several_totals_are_not_priced(bundle):
    """Two plans with a total in one treatment: no cost, rather than a part of it."""
    states = bundle.states.where("scenario_id = 'halting'").withColumn(
        "payment", F.when(F.expr("treatment = 'gene' AND state = 2"), "second").otherwise(F.col("payment"))
    )
    first = bundle.payments.where("scenario_id = 'halting' AND payment = 'bounded'")
    second = first.withColumn("payment", F.lit("second"))
    double = bundle.with_tables(states=states, payments=bundle.payments.unionByName(second))
    row = cohort.incremental(double).first()
    assert row["Cost"] is None and row["ICER"] is None
    kept = brute.incremental(MODELS["halting"])["gene - usual"]
    assert row["QALY"] == pytest.approx(kept[0])
    lost = cohort.over_time(double).where("treatment = 'gene' AND costben != 'QALY'")
    assert lost.count() > 0 and lost.where("value IS NOT NULL").count() == 0
    assert cohort.cells(double).where("treatment = 'gene' AND cost IS NOT NULL").count() == 0
    assert "gene uses several plans with a total" in {
        r["message"] for r in validate.check_rules(double).collect()
    }


def test_scenarios_without_globals_have_defaults(spark, bundle):
    only = bundle_of(spark, ["anchor"])
    none = only.with_tables(globals=only.globals.where("false"))
    rows = cohort.incremental(none).collect()
    assert [round(r["ICER"], 2) for r in rows] == [1.09]
    assert cohort.plan_listing(none).count() == 40
    record = parameters(none.globals, none.keys, GLOBAL_DEFAULTS, scenarios=none.states)
    assert [r.asDict() for r in record.collect()] == [{"scenario_id": "anchor", **GLOBAL_DEFAULTS}]


def test_gaps_are_interpolated(bundle):
    rows = (
        cohort.qol_profile(bundle)
        .where("scenario_id = 'gaps' and treatment = 'gene'")
        .orderBy("state")
        .collect()
    )
    assert [r["state"] for r in rows] == [1, 2, 3, 4, 5, 6]
    knots = [row[1:] for row in MODELS["gaps"][0] if row[0] == "gene"]
    assert [r["QoL"] for r in rows] == pytest.approx([s[1] for s in brute.expand(knots)])


def test_spans_reach_over_treatments(bundle):
    only = bundle.states.where("scenario_id = 'gaps'")
    model = state_table(only, bundle.keys).where("treatment = 'usual' and state = 2")
    own = state_table(only, bundle.keys, "treatment").where("treatment = 'gene' and state = 2")
    assert (model.first()["pstart"], model.first()["pend"]) == (1, 5)
    assert (own.first()["pstart"], own.first()["pend"]) == (2, 5)


def test_transition_matrix(bundle):
    states = expand_states(bundle.states.where("scenario_id = 'anchor'"), bundle.keys)
    edges = transition_edges(states, bundle.keys)
    rows = transition_table(edges, bundle.keys, 4).where("treatment = 'Active'").orderBy("from_state").collect()
    found = [[round(r[c], 2) for c in ("S1", "S2", "S3", "D")] for r in rows]
    assert [r["st"] for r in rows] == ["S1", "S2", "S3", "D"]
    assert found == [[0.94, 0.05, 0, 0.01], [0, 0, 0.98, 0.02], [0, 0, 0, 1], [0, 0, 0, 1]]
    older = transition_table(edges, bundle.keys, 4, legacy=True)
    assert older.columns[-4:] == ["PF", "P1", "P2", "D"]


def test_shares_are_a_distribution(bundle):
    cells = cohort.cells(bundle)
    sums = cells.groupBy("scenario_id", "treatment", "time").agg(F.sum("share").alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-12).count() == 0
    horizons = {name: int(MODELS[name][3]["time_horizon"]) for name in PRICED}
    assert sums.count() == sum(
        horizons[name] * len({row[0] for row in MODELS[name][0]}) for name in PRICED
    )
    last = cells.groupBy("scenario_id", "treatment").agg(F.max("state").alias("state"))
    dead = cells.join(last, ["scenario_id", "treatment", "state"]).orderBy("time").collect()
    seen = {}
    for row in dead:
        key = (row["scenario_id"], row["treatment"])
        assert row["share"] >= seen.get(key, 0) - 1e-12
        seen[key] = row["share"]


def test_edges_sum_to_one(bundle):
    edges = transition_edges(expand_states(bundle.states, bundle.keys), bundle.keys)
    sums = edges.groupBy("scenario_id", "treatment", "from_state").agg(F.sum("p").alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-12).count() == 0


def test_one_period(bundle):
    short = bundle.globals.withColumn(
        "value", F.when(F.col("name") == "time_horizon", 1.0).otherwise(F.col("value"))
    )
    cells = cohort.cells(bundle.with_tables(globals=short)).collect()
    assert {r["time"] for r in cells} == {1}
    assert all(r["share"] == (1.0 if r["state"] == 1 else 0.0) for r in cells)


def test_copies_of_a_scenario_agree(spark):
    one = bundle_of(spark, ["crowd"])

    def copies(df):
        return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn(
            "scenario_id", F.concat_ws("-", "scenario_id", "copy")
        ).drop("copy")

    many = one.with_tables(
        states=copies(one.states), payments=copies(one.payments), globals=copies(one.globals)
    )
    groups = (
        cohort.incremental(many)
        .groupBy("Treatments")
        .agg(F.count("*").alias("n"), F.min("Cost").alias("low"), F.max("Cost").alias("high"))
        .collect()
    )
    assert len(groups) == 4
    assert all(g["n"] == 50 and g["low"] == g["high"] for g in groups)


def test_control_count(spark):
    bundle = bundle_of(spark, ["crowd"])
    for count, controls in ((1, {"zeta"}), (3, {"beta", "gamma", "zeta"}), (4, set())):
        given = bundle.globals.withColumn(
            "value", F.when(F.col("name") == "control_count", count).otherwise(F.col("value"))
        )
        rows = cohort.incremental(bundle.with_tables(globals=given)).collect()
        assert {r["Treatments"].split(" - ")[1] for r in rows} == controls
        assert len(rows) == (4 - count) * len(controls)


def test_plan_listing(bundle):
    rows = cohort.plan_listing(bundle).where("scenario_id = 'late'").collect()
    starts = {(r["payment_plan"], r["start"]) for r in rows}
    assert starts == {("delayed", 2), ("upkeep", 1)}
    assert len(rows) == 24
    paid = {r["time"]: r["payment"] for r in rows if r["payment_plan"] == "delayed"}
    expected = {t: 2 * (1.02 / 1.03) ** (t - 1) for t in (2, 3, 4)}
    assert {t: v for t, v in paid.items() if v} == pytest.approx(expected)


def test_series_split(bundle, series):
    every = cohort.over_time(bundle)
    costs, health = cohort.cost_series(every), cohort.qaly_series(every)
    assert costs.count() + health.count() == len(series)
    assert {r["costben"] for r in health.select("costben").distinct().collect()} == {"QALY"}


def swept_model(name, **cells):
    """A copy of a model with single cells replaced; cells are named field__row__column."""
    rows, plans, present, record = MODELS[name]
    rows, plans, record = list(rows), [dict(p) for p in plans], dict(record)
    for place, value in cells.items():
        field, row, column = place.split("__")
        if field == "payments":
            next(p for p in plans if p["payment"] == row)[column] = value
        elif field == "globals":
            record[row] = value
        else:
            arm, state = row.split("_")
            at = next(i for i, r in enumerate(rows) if r[:2] == (arm, int(state)))
            rows[at] = (*rows[at][:2], value, *rows[at][3:])
    return rows, plans, present, record


def test_sweep_with_values_of_the_scenario(bundle):
    """Cells may take their values from scenario columns; other models stay as they are."""
    scenarios = bundle.globals.select("scenario_id").distinct().withColumn(
        "length", F.when(F.col("scenario_id") == "halting", 5.0).otherwise(1.0)
    )
    cells = [
        sweep.Cell("payment_table", "bounded", "contract_length", "array(2D, length)"),
        sweep.Cell("state_table", "gene/1", "p_prog", "array(0D, 0.05D)"),
    ]
    swept = sweep.sweep(bundle, cells, cohort.incremental, scenarios).where("scenario_id = 'halting'")
    rows = {(r["contract_length"], r["p_prog"]): r["ICER"] for r in swept.collect()}
    expected = {
        (length, p): brute.incremental(
            swept_model("halting", payments__bounded__contract_length=length, states__gene_1__p_prog=p)
        )["gene - usual"][2]
        for length in (2.0, 5.0)
        for p in (0.0, 0.05)
    }
    assert rows == pytest.approx(expected, abs=1e-9)


def test_sweep_over_an_unknown_row(bundle):
    """A misspelt row gives no numbers under labels that were never applied."""
    only = bundle.with_tables(
        **{t: getattr(bundle, t).where("scenario_id IN ('gaps', 'crowd')") for t in ("states", "payments", "globals")}
    )
    cells = [sweep.Cell("state_table", "gene/1", "p_prog", "array(0D, 0.5D)")]
    lost = sweep.unknown_rows(only, cells).collect()
    assert [(r["scenario_id"], r["message"]) for r in lost] == [
        ("crowd", "Could not find row: gene/1 in table: state_table")
    ]
    rows = sweep.sweep(only, cells, cohort.incremental).collect()
    assert len(rows) == 2 + 8
    assert all((r["Cost"] is None) == (r["scenario_id"] == "crowd") for r in rows)


def test_arms_are_priced_once_for_each_setting_that_touches_them(bundle):
    """A thousand combinations, but no more rows per arm than its own cells have settings; and each
    combination's result is that of the model with its values."""
    only = bundle.with_tables(
        **{t: getattr(bundle, t).where("scenario_id = 'halting'") for t in ("states", "payments", "globals")}
    )
    cells = [
        sweep.Cell("state_table", "gene/1", "p_prog", "array(0D, 0.05D)"),
        sweep.Cell("payment_table", "bounded", "contract_length", "array(2D, 5D)"),
        sweep.Cell("state_table", "usual/1", "p_death", "transform(sequence(1, 250), i -> i / 500D)"),
    ]
    grid = Grid(tuple(cells))
    assert grid.prices_arms()
    arms = cohort.totals(only.with_tables(grid=grid)).groupBy("treatment").count().collect()
    assert {r["treatment"]: r["count"] for r in arms} == {"gene": 4, "usual": 250}
    swept = sweep.sweep(only, cells, cohort.incremental)
    assert swept.count() == 1000
    p_death = F.col("usual/1 p_death") if "usual/1 p_death" in swept.columns else F.col("p_death")
    for r in swept.where(p_death.isin(0.002, 0.5)).collect():
        model = swept_model(
            "halting",
            payments__bounded__contract_length=r["contract_length"],
            states__gene_1__p_prog=r["p_prog"],
        )
        rows = [(*x[:4], r["p_death"], *x[5:]) if x[:2] == ("usual", 1) else x for x in model[0]]
        expected = brute.incremental((rows, *model[1:]))["gene - usual"]
        assert (r["QALY"], r["Cost"], r["ICER"]) == pytest.approx(expected, abs=1e-9)


def test_cells_that_change_the_pairs_are_swept_by_copies(bundle):
    """Who is a control depends on the count, so arms can't be priced apart from the combination."""
    cells = [
        sweep.Cell("global_table", "control_count", "value", "array(1D, 2D)"),
        sweep.Cell("global_table", "discount", "value", "array(0.03D)"),
    ]
    assert not Grid(tuple(cells)).prices_arms()
    only = bundle.with_tables(
        **{t: getattr(bundle, t).where("scenario_id = 'crowd'") for t in ("states", "payments", "globals")}
    )
    rows = sweep.sweep(only, cells, cohort.incremental, add_row_names=True).groupBy("variant_id").count().collect()
    arms = only.states.select("treatment").distinct().count()
    assert {r["variant_id"]: r["count"] for r in rows} == {0: arms - 1, 1: 2 * (arms - 2)}


def test_a_scenario_with_very_many_arms_is_spread(spark):
    """20,000 arms and 10 controls in one scenario: no task makes more than its share of the pairs."""
    arms = spark.range(20_010).selectExpr(
        "id DIV 1000000 AS scenario_id", "format_string('%05d', id) AS treatment", "CAST(id AS DOUBLE) AS Cost", "id / 7D AS QALY",
        "id >= 20000 AS is_control", "20010 AS actives", "10 AS controls",
    )
    pairs = cohort.compare_arms(arms, ["scenario_id"])
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == 200_000
    assert len(sizes) == tasks and max(sizes) < 1.5 * sum(sizes) / tasks
    found = pairs.where("Treatments LIKE '%00007 - %' OR Treatments LIKE '00007%'").orderBy("Treatments").collect()
    assert [(r["Cost"], round(r["QALY"], 9)) for r in found] == [(7.0 - c, round((7 - c) / 7, 9)) for c in range(20_000, 20_010)]
