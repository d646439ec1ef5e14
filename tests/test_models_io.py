import pytest
from pyspark.sql import functions as F

from cohortspan.plans import cohort, validate
from cohortspan.sources import (
    ModelReadError,
    read_legacy,
    read_model,
    read_text_table,
    typed,
    write_model,
)
from cohortspan.sources.bundles import read_optional
from cohortspan.tables import GLOBAL_COLUMNS, PAYMENT_COLUMNS, STATE_COLUMNS
from tests import brute
from tests.models import MODELS, bundle_of


def same_rows(a, b):
    names = sorted(a.columns)
    assert sorted(b.columns) == names
    left = sorted(map(str, a.select(*names).collect()))
    assert left == sorted(map(str, b.select(*names).collect()))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_round_trip(spark, tmp_path, fmt):
    bundle = bundle_of(spark, ["gaps", "halting"])
    path = str(tmp_path / "model")
    write_model(bundle, path, fmt)
    again = read_model(spark, path, fmt)
    for name in ("states", "payments", "globals", "state_fields"):
        same_rows(getattr(bundle, name), getattr(again, name))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_model(bundle, path, fmt)


def test_partition_folders(spark, tmp_path):
    bundle = bundle_of(spark, ["gaps", "late"])
    path = str(tmp_path / "model")
    write_model(bundle, path, partition_by=["scenario_id"])
    assert (tmp_path / "model" / "states" / "scenario_id=gaps").is_dir()
    same_rows(bundle.states, read_model(spark, path).states)


def test_missing_tables_fail_as_one(spark, tmp_path):
    bundle = bundle_of(spark, ["gaps"])
    (tmp_path / "m").mkdir()
    bundle.states.write.parquet(str(tmp_path / "m" / "states"))
    with pytest.raises(ModelReadError, match="payments.*globals"):
        read_model(spark, str(tmp_path / "m"))
    with pytest.raises(ModelReadError, match="contracts"):
        read_legacy(spark, str(tmp_path / "m"))


def test_optional_table(spark, tmp_path):
    none = read_optional(spark, str(tmp_path / "no"), "parquet", STATE_COLUMNS, ["scenario_id"])
    assert none.count() == 0 and none.columns == ["scenario_id", *STATE_COLUMNS]


def test_hand_written_csv(spark, tmp_path):
    """Blanks around names and values, blank cells and short rows; one model without a key."""
    files = {
        "states": """row_id,treatment , state, p_prog ,QoL,p_death,payment
1, gene,1 ,0.07,0.95,0.015,outright
2,gene , 2,0.6,   ,0.03, upkeep
3,gene,5,1,0.4,0.05,upkeep
4,gene,6,0,0,0
5,usual,1,0.8,0.9,0.02,upkeep
6, usual,3.0,0.5,0.45,0.04,upkeep
7,usual,6,0,0,0,
""",
        "payments": """row_id,payment,tot_payment,initial_payment,refund,contract_length,cont_payment
1,outright ,12,0.4,0.75,6
2, upkeep,,,,,0.25
""",
        "globals": "name,value\ndiscount , 0.02\nfirm_discount,0.05\ntime_horizon,15\n",
    }
    for name, text in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "table.csv").write_text(text)
    bundle = read_model(spark, str(tmp_path), "csv")
    kinds = {**STATE_COLUMNS, **PAYMENT_COLUMNS, **GLOBAL_COLUMNS}
    for df in (bundle.states, bundle.payments, bundle.globals):
        assert all(kinds[c] == t for c, t in df.dtypes if c in kinds)
    result = cohort.incremental(bundle).first()
    assert (result["QALY"], result["Cost"], result["ICER"]) == pytest.approx(
        brute.incremental(MODELS["gaps"])["gene - usual"], abs=1e-9
    )


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_models_with_different_columns(spark, tmp_path, fmt):
    """Plan tables that lack columns read side by side give what each gives alone."""
    names = ["anchor", "gaps", "crowd"]
    path = tmp_path / "all"
    for name in names:
        alone = bundle_of(spark, [name])
        kept = [c for c in PAYMENT_COLUMNS if c == "payment" or c in MODELS[name][2]]
        plans = alone.payments.select("row_id", *kept[::-1], "scenario_id")
        for table, df in {"states": alone.states, "payments": plans, "globals": alone.globals}.items():
            df.coalesce(1).write.mode("append").option("header", True).format(fmt).save(str(path / table))
    bundle = read_model(spark, str(path), fmt)
    found = {
        (r["scenario_id"], r["Treatments"]): r["ICER"] for r in cohort.incremental(bundle).collect()
    }
    expected = {
        (name, pair): v[2] for name in names for pair, v in brute.incremental(MODELS[name]).items()
    }
    assert found == pytest.approx(expected, abs=1e-9)


def test_text_then_typed(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a; b ;c\n 1.5 ;x; 4.0\nbad; ;oops\n")
    text = read_text_table(spark, str(tmp_path / "t.csv"), separator=";")
    assert text.dtypes == [("a", "string"), ("b", "string"), ("c", "string")]
    found = [tuple(r) for r in typed(text, {"a": "double", "c": "int"}).collect()]
    assert found == [(1.5, "x", 4), (None, None, None)]


def test_known_violations(spark):
    found = validate.check_model(bundle_of(spark, ["faulty"])).collect()
    rows = {(r["table"], r["column"], r["row"], r["message"]) for r in found}
    assert rows == {
        ("state", "Pr.prog", 1, "Value -0.10 is below minimum value"),
        ("state", "QoL", 1, "Value -2.00 is below minimum value"),
        ("state", "Pr.death", 4, "Value -0.30 is below minimum value"),
        ("state", "Pr.death", 5, "Value 1.50 is above maximum value"),
        ("payment", "Periods", 1, "Value 250.00 is above maximum value"),
    }


def test_good_models_pass(spark):
    bundle = bundle_of(spark, ["anchor", "halting", "crowd"])
    assert validate.check_model(bundle).count() == 0
    assert validate.check_rules(bundle).count() == 0


def test_rules(spark):
    bundle = bundle_of(spark, ["crowd"])
    states = bundle.states.selectExpr(
        "scenario_id", "row_id", "treatment", "IF(treatment = 'zeta', state + 1, state) AS state",
        "p_prog", "QoL", "p_death",
        "CASE WHEN treatment = 'alpha' AND state = 2 THEN 'seven' "
        "WHEN treatment = 'gamma' AND state = 1 THEN NULL ELSE payment END AS payment",
    ).withColumn(
        "state", F.expr("CAST(IF(treatment = 'beta' AND state = 2, 101, state) AS INT)")
    )
    plans = bundle.payments.selectExpr(
        *[
            "IF(payment = 'seven', 0D, contract_length) AS contract_length"
            if c == "contract_length"
            else "IF(payment = 'three', 1D, cont_payment) AS cont_payment"
            if c == "cont_payment"
            else c
            for c in bundle.payments.columns
        ]
    )
    found = validate.check_rules(bundle.with_tables(states=states, payments=plans)).collect()
    assert sorted(r["message"] for r in found) == [
        "A state before the last has no plan: gamma",
        "Both a total and a continuous payment: three",
        "No instalment to pay the total of: seven",
        "States beyond the longest horizon: beta",
        "States must start at 1 and increase: zeta",
        "alpha uses several plans with a total",
    ]


def test_both_checks_at_once(spark):
    """One pass gives what the two checks give; each table is read at most twice."""
    bundle = bundle_of(spark, ["faulty", "crowd", "gaps"])
    states = bundle.states.withColumn(
        "payment", F.expr("CASE WHEN treatment = 'alpha' AND state = 2 THEN 'seven' WHEN row_id = 3 THEN 'none' ELSE payment END")
    )
    broken = bundle.with_tables(states=states, payments=bundle.payments.withColumn("contract_length", F.expr("contract_length - 5")))
    found = validate.check(broken)
    same_rows(found, validate.check_model(broken).unionByName(validate.check_rules(broken)))
    kinds = {r["message"].split(":")[0] for r in found.collect()}
    assert len(kinds) > 4
    scans = found._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("LogicalRDD") + scans.count("LocalRelation") <= 4
