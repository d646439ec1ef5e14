"""Models written and read back, and what describes their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.catalog.cohort_queries import _COMPARED, _MODEL, _PLAIN, _compared
from cohortspan.catalog.part_model import part_bundle, read
from cohortspan.catalog.registry import query
from cohortspan.operators.columns import fill_defaults, get_titles
from cohortspan.operators.filters import number_ranges
from cohortspan.operators.scan import ordered_scan, position
from cohortspan.plans import cohort
from cohortspan.session import scratch_folder
from cohortspan.sources import read_model, write_model
from cohortspan.sources.bundles import read_optional
from cohortspan.tables import PAYMENT_DEFAULTS, STATE_COLUMNS, STATE_FIELDS, fields_frame

TABLES = ("states", "payments", "globals")


def _some(bundle, condition: str):
    return bundle.with_tables(**{t: getattr(bundle, t).where(condition) for t in TABLES})


@query("model_reread", _PLAIN + _COMPARED.format("line"))
def model_reread(spark, sf_dir):
    """A model per part, written in two versions; the second adds the other half of the parts."""
    path, bundle = scratch_folder(spark, "models"), part_bundle(spark, sf_dir)
    write_model(_some(bundle, "scenario_id % 2 = 0"), path)
    write_model(_some(bundle, "scenario_id % 2 = 1"), path, mode="append")
    return _compared(cohort.incremental(read_model(spark, path)))


@query(
    "versions_with_other_columns",
    """SELECT p_partkey AS scenario_id, payment,
              CASE WHEN p_partkey % 3 = 0 THEN 20e0 WHEN payment = 'cont' THEN 0e0 ELSE 1e0 + p_size % 10 END
                AS contract_length
       FROM part, (VALUES ('fixed'), ('cont')) v(payment) WHERE p_partkey % 3 < 2""",
)
def versions_with_other_columns(spark, sf_dir):
    """Overwritten, then appended by models without instalment counts, which so take the default."""
    path, bundle = scratch_folder(spark, "models"), part_bundle(spark, sf_dir)
    write_model(_some(bundle, "scenario_id % 3 = 2"), path)
    write_model(_some(bundle, "scenario_id % 3 = 1"), path, mode="overwrite")
    lacking = _some(bundle, "scenario_id % 3 = 0")
    write_model(lacking.with_tables(payments=lacking.payments.drop("contract_length")), path, mode="append")
    plans = fill_defaults(read_model(spark, path).payments, PAYMENT_DEFAULTS)
    return plans.select("scenario_id", "payment", "contract_length")


@query(
    "states_from_text",
    f"""WITH {_MODEL} SELECT scenario_id, treatment, CAST(state AS INTEGER) AS state, p_prog, qol AS "QoL", p_death,
        payment FROM st""",
)
def states_from_text(spark, sf_dir):
    """Written as delimited text and typed when read."""
    path = scratch_folder(spark, "models")
    write_model(part_bundle(spark, sf_dir), path, "csv")
    states = read_model(spark, path, "csv").states
    return states.select("scenario_id", *STATE_COLUMNS)


@query(
    "optional_tables",
    """SELECT p_partkey AS scenario_id, payment FROM part, (VALUES ('fixed'), ('cont')) v(payment)""",
)
def optional_tables(spark, sf_dir):
    """One table is there, the other is not."""
    path = scratch_folder(spark, "models")
    plans = part_bundle(spark, sf_dir).payments.select("scenario_id", "payment")
    plans.write.parquet(f"{path}/payments")
    columns = {"payment": "string"}
    found = [read_optional(spark, f"{path}/{t}", "parquet", columns, ["scenario_id"]) for t in ("payments", "older")]
    return found[0].select("scenario_id", "payment").unionByName(found[1])


@query(
    "titled_ranges",
    f"""WITH {_MODEL}
    SELECT 3 AS position, 'state' AS name, 'State' AS title, min(state)::DOUBLE AS low, max(state)::DOUBLE AS high FROM st
    UNION ALL SELECT 4, 'p_prog', 'Pr.prog', min(p_prog), max(p_prog) FROM st
    UNION ALL SELECT 5, 'QoL', 'QoL', min(qol), max(qol) FROM st
    UNION ALL SELECT 6, 'p_death', 'Pr.death', min(p_death), max(p_death) FROM st
    UNION ALL SELECT 1, 'scenario_id', NULL, min(p_partkey)::DOUBLE, max(p_partkey)::DOUBLE FROM part""",
)
def titled_ranges(spark, sf_dir):
    """Columns by position with their titles, and the range of each that holds numbers."""
    states = part_bundle(spark, sf_dir).states
    titles = get_titles(states, fields_frame(spark, STATE_FIELDS))
    ranges = number_ranges(states, ["scenario_id", "state", "p_prog", "QoL", "p_death"])
    return titles.join(ranges.withColumnRenamed("column", "name"), "name").select("position", "name", "title", "low", "high")


@query(
    "arranged",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders""",
)
def arranged(spark, sf_dir):
    """Place of each order by falling price: one group holds all rows."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("falling"))
    rows = orders.withColumn("every", F.lit(1))
    return ordered_scan(rows, ["every"], ["falling", "o_orderkey"], place=position()).select("o_orderkey", "place")
