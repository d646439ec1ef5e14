"""A bundle's tables appear together, and reading many files takes few jobs."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortspan.sources import ModelReadError, VersionConflict, bundles, expire, manifest, read_model, write_model
from tests.models import bundle_of
from tests.test_models_io import same_rows

TABLES = ("states", "payments", "globals")


def scenarios(spark, path, fmt="parquet"):
    model = read_model(spark, path, fmt)
    found = [{r[0] for r in getattr(model, t).select("scenario_id").distinct().collect()} for t in TABLES]
    assert found[0] == found[1] == found[2]
    return found[0]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_stopped_write_leaves_the_old_model(spark, tmp_path, fmt, monkeypatch):
    path, write, done = str(tmp_path / "model"), bundles._write, []
    write_model(bundle_of(spark, ["gaps"]), path, fmt)

    def stops(df, place, *rest):
        if len(done) == 2:
            raise OSError("lost")
        write(df, place, *rest)
        done.append(place)

    monkeypatch.setattr(bundles, "_write", stops)
    for mode in ("overwrite", "append"):
        done.clear()
        with pytest.raises(OSError, match="lost"):
            write_model(bundle_of(spark, ["late", "crowd"]), path, fmt, mode=mode)
        assert scenarios(spark, path, fmt) == {"gaps"}
    monkeypatch.setattr(bundles, "_write", write)
    write_model(bundle_of(spark, ["late", "crowd"]), path, fmt, mode="append")
    assert scenarios(spark, path, fmt) == {"gaps", "late", "crowd"}
    write_model(bundle_of(spark, ["late"]), path, fmt, mode="overwrite")
    again = read_model(spark, path, fmt)
    for table in TABLES:
        same_rows(getattr(bundle_of(spark, ["late"]), table), getattr(again, table))
    write_model(bundle_of(spark, ["gaps"]), path, fmt, mode="ignore")
    assert scenarios(spark, path, fmt) == {"late"}
    assert expire(spark, path) == [3]
    assert scenarios(spark, path, fmt) == {"late"}
    assert len(list((tmp_path / "model" / "_data").iterdir())) == 1


def test_a_stopped_first_write_is_no_model(spark, tmp_path, monkeypatch):
    path, write = str(tmp_path / "model"), bundles._write

    def stops(df, place, *rest):
        if place.endswith("globals"):
            raise OSError("lost")
        write(df, place, *rest)

    monkeypatch.setattr(bundles, "_write", stops)
    with pytest.raises(OSError, match="lost"):
        write_model(bundle_of(spark, ["gaps"]), path)
    with pytest.raises(ModelReadError, match="no version"):
        read_model(spark, path)
    monkeypatch.setattr(bundles, "_write", write)
    write_model(bundle_of(spark, ["gaps"]), path, mode="overwrite")
    assert scenarios(spark, path) == {"gaps"}


def test_the_slower_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "model")
    write_model(bundle_of(spark, ["gaps"]), path)
    first = manifest.read_version(spark, path)
    manifest.publish(spark, path, manifest.Manifest(2, "parquet", first.tables))
    with pytest.raises(VersionConflict):
        manifest.publish(spark, path, manifest.Manifest(2, "parquet", {}))
    assert manifest.read_version(spark, path).tables == first.tables
    assert not [f for f in (tmp_path / "model" / "_manifests").iterdir() if f.name.startswith(".") and "crc" not in f.name]


def test_versions_with_different_columns(spark, tmp_path):
    """Appended plans lack columns: absent ones take defaults, as in models of their own."""
    path = str(tmp_path / "model")
    for name in ("anchor", "crowd"):
        one = bundle_of(spark, [name])
        kept = [c for c in one.payments.columns if c not in ("present_columns", "refund", "initial_payment")]
        plans = one.payments.drop("present_columns") if name == "anchor" else one.payments.select(*kept)
        write_model(one.with_tables(payments=plans), path, mode="append")
    found = read_model(spark, path).payments.select("scenario_id", F.array_contains("present_columns", "refund"))
    assert {tuple(r) for r in found.distinct().collect()} == {("anchor", True), ("crowd", False)}


def test_many_files_take_few_jobs(spark, tmp_path):
    """No job per file, and the columns of each file all the same; two files share a column order."""
    folder = tmp_path / "plans"
    folder.mkdir()
    for i in range(300):
        columns = {"scenario_id": [i], "row_id": [1], "payment": ["p"], "tot_payment": [float(i)]}
        if i % 3:
            columns["refund"] = [0.5]
        pq.write_table(pa.table(columns), folder / f"{i:03d}.parquet")
    spark.sparkContext.setJobGroup("many-files", "")
    try:
        df = bundles._read_table(spark, str(folder), "parquet", bundles.PAYMENT_COLUMNS, ["scenario_id"])
        rows = df.select("scenario_id", "refund", "present_columns").collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("many-files")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 10
    assert len(rows) == 300
    for r in rows:
        assert ("refund" in r["present_columns"]) == (r["scenario_id"] % 3 > 0) == (r["refund"] is not None)


def test_the_schema_does_not_depend_on_the_files(spark, tmp_path):
    for name, extra in (("same", False), ("other", True)):
        folder = tmp_path / name
        folder.mkdir()
        for i in range(2):
            columns = {"scenario_id": [i], "payment": ["p"], "tot_payment": [1.0]}
            if not extra or i:
                columns["refund"] = [0.5]
            pq.write_table(pa.table(columns), folder / f"{i}.parquet")
    read = [bundles._read_table(spark, str(tmp_path / n), "parquet", bundles.PAYMENT_COLUMNS, ["scenario_id"]) for n in ("same", "other")]
    assert set(read[0].columns) == set(read[1].columns)
