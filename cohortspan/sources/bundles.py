"""Reading and writing the tables of one or many models.

A bundle is a folder with a sub-folder per table. Scenario keys are ordinary columns, or
partition folders (``scenario_id=.../``) where there are few scenarios. ``write_model`` publishes its
tables as one version (see ``manifest``); folders put together by other means are read as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.sources import manifest
from cohortspan.sources.manifest import Manifest, Part
from cohortspan.sources.text import read_text_table, typed
from cohortspan.tables import (
    FIELD_COLUMNS,
    GLOBAL_COLUMNS,
    GLOBAL_FIELDS,
    LEGACY_CONTRACT_COLUMNS,
    LEGACY_TREATMENT_COLUMNS,
    PAYMENT_COLUMNS,
    PAYMENT_FIELDS,
    SCENARIO,
    STATE_COLUMNS,
    STATE_FIELDS,
    LegacyBundle,
    ModelBundle,
    fields_frame,
)

_MODEL = {"states": STATE_COLUMNS, "payments": PAYMENT_COLUMNS, "globals": GLOBAL_COLUMNS}
_FIELDS = {
    "state_fields": STATE_FIELDS,
    "payment_fields": PAYMENT_FIELDS,
    "global_fields": GLOBAL_FIELDS,
}
_LEGACY = {
    "treatments": LEGACY_TREATMENT_COLUMNS,
    "contracts": LEGACY_CONTRACT_COLUMNS,
    "globals": GLOBAL_COLUMNS,
}


#: Types that text is read back as.
_TYPED = ("int", "bigint", "double", "float", "boolean", "date", "timestamp")


class ModelReadError(Exception):
    """A model could not be read; no part of it is returned."""


def _read_table(
    spark: SparkSession, path: str, fmt: str, columns: dict[str, str], keys: Sequence[str], parts: Sequence[Part] = ()
) -> DataFrame:
    """A table from its folder, or from the ``parts`` of a version, folders inside ``path``."""
    present = "present_columns" if columns is PAYMENT_COLUMNS else None
    folders: dict[tuple[str, ...] | None, list[str]] = {}
    for part in parts:
        folders.setdefault(part.columns, []).append(f"{path}/{part.folder}")
    if not parts:
        folders[None] = [path]
    frames = []
    for known, places in folders.items():
        some = [places] if known is not None else [[place] for place in places]
        frames += [_read_folders(spark, one, fmt, known, present) for one in some]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if fmt == "csv":
        written = {c: t for part in parts for c, t in zip(part.columns or (), part.types or ()) if t in _TYPED}
        df = typed(df, {**written, **columns, "row_id": "bigint"})
    missing = [k for k in keys if k not in df.columns]
    if missing == [SCENARIO]:
        # A single model without a key column is scenario 0.
        df = df.withColumn(SCENARIO, F.lit(0).cast("bigint"))
    elif missing:
        raise ModelReadError(f"no column {missing} in {path}")
    if "row_id" not in df.columns and columns is not GLOBAL_COLUMNS:
        # Order in the file; only ever compared within a table.
        df = df.withColumn("row_id", F.monotonically_increasing_id() + 1)
    return df


def _read_folders(
    spark: SparkSession, folders: list[str], fmt: str, known: tuple[str, ...] | None, present: str | None
) -> DataFrame:
    """Folders whose files all have the ``known`` columns, or one folder with any columns.

    ``present`` names an array column that says which columns a row's file has, unless the files have
    it already: a column that a model lacks isn't a blank one.
    """
    if fmt == "csv":
        df = read_text_table(spark, folders, present=present, uniform=known is not None)
    elif fmt == "parquet" and known is None:
        df = _read_parquet(spark, folders[0], present)
    else:
        df = spark.read.format(fmt).load(folders)
    if present is None:
        return df
    if present not in df.columns:
        return df.withColumn(present, F.array(*[F.lit(c) for c in df.columns]))
    if dict(df.dtypes)[present] == "string":
        return df.withColumn(present, F.split(present, ";"))
    return df


def _read_parquet(spark: SparkSession, path: str, present: str | None) -> DataFrame:
    """A folder whose files may have different columns."""
    merged = spark.read.option("mergeSchema", True).parquet(path)
    if present is None or present in merged.columns:
        return merged
    files = columns_by_file(spark, path).withColumnRenamed("columns", present)
    named = merged.withColumn("__file", F.col("_metadata.file_path"))
    return named.join(files, F.col("__file") == F.col("file"), "left").drop("__file", "file")


def columns_by_file(spark: SparkSession, path: str) -> DataFrame:
    """``file, columns`` of the Parquet files in a folder, in one pass of the executors.

    They read the files, of which only footers go on; nothing is sent to the driver. Meant for plan
    tables, which are small.
    """
    length = "conv(hex(concat(" + ", ".join(f"substring(content, {-5 - i}, 1)" for i in range(4)) + ")), 16, 10)"
    footers = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .selectExpr("_metadata.file_path AS file", f"substring(content, -(CAST({length} AS INT) + 8)) AS footer")
    )

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a footer is read from its end, so any bytes may stand before it
            read = [pq.read_schema(pa.BufferReader(b"PAR1" + f.as_py())).names for f in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(read, pa.list_(pa.string()))], ["file", "columns"])

    return footers.mapInArrow(parsed, "file string, columns array<string>")


def _version(spark: SparkSession, path: str, fmt: str) -> Manifest | None:
    """What the folder's last version names; None for a folder that no version was meant for."""
    found = manifest.read_version(spark, path)
    if found is None and manifest.is_managed(spark, path):
        raise ModelReadError(f"no version of {path} has been published")
    if found is not None and found.fmt != fmt:
        raise ModelReadError(f"{path} holds {found.fmt}, not {fmt}")
    return found


def _read_all(
    spark: SparkSession, path: str, fmt: str, tables: dict[str, dict], keys: Sequence[str], version: Manifest | None
) -> dict[str, DataFrame]:
    found, problems = {}, []
    for name, columns in tables.items():
        try:
            if version is None:
                found[name] = _read_table(spark, f"{path}/{name}", fmt, columns, keys)
            elif name in version.tables:
                found[name] = _read_table(spark, path, fmt, columns, keys, version.tables[name])
            else:
                problems.append(f"{name}: not in version {version.version}")
        except AnalysisException as error:
            problems.append(f"{name}: {error.getCondition() or error}")
    if problems:
        raise ModelReadError("; ".join(problems))
    return found


def read_optional(
    spark: SparkSession, path: str, fmt: str, columns: dict[str, str], keys: Sequence[str]
) -> DataFrame:
    """A table when its folder exists, else an empty one with the same columns."""
    if manifest.exists(spark, path):
        return _read_table(spark, path, fmt, columns, keys)
    kinds = {**{k: "bigint" for k in keys}, **columns}
    return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in kinds.items()))


def read_model(
    spark: SparkSession, path: str, fmt: str = "parquet", keys: Sequence[str] = (SCENARIO,)
) -> ModelBundle:
    """Read a bundle as one unit: all tables of its last version; any missing table fails the read.

    Field tables are optional and default to the built-in descriptions.
    """
    version = _version(spark, path, fmt)
    tables = _read_all(spark, path, fmt, _MODEL, keys, version)
    fields = {}
    for name, rows in _FIELDS.items():
        if version is not None:
            places = [f"{path}/{part.folder}" for part in version.tables.get(name, [])]
        else:
            places = [f"{path}/{name}"] if manifest.exists(spark, f"{path}/{name}") else []
        if not places:
            fields[name] = fields_frame(spark, rows)
        elif fmt == "csv":
            fields[name] = typed(read_text_table(spark, places), FIELD_COLUMNS)
        else:
            fields[name] = spark.read.format(fmt).load(places)
    return ModelBundle(**tables, **fields, keys=tuple(keys))


def read_legacy(
    spark: SparkSession, path: str, fmt: str = "parquet", keys: Sequence[str] = (SCENARIO,)
) -> LegacyBundle:
    tables = _read_all(spark, path, fmt, _LEGACY, keys, _version(spark, path, fmt))
    return LegacyBundle(**tables, keys=tuple(keys))


def write_model(
    bundle: ModelBundle | LegacyBundle,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Write every table of a bundle and publish them as one version; ``read_model`` returns the same
    rows. Until then, and if the write stops, readers see the version before.

    A first version lies in a folder per table, later ones (``overwrite``, ``append``) in folders of
    their own; an appended version also names the data before it. ``expire`` drops old versions.
    Scenario keys stay columns by default: a folder per scenario suits few of them only.
    """
    if mode not in ("error", "errorifexists", "overwrite", "append", "ignore"):
        raise ValueError(f"Unknown mode: {mode}")
    legacy = isinstance(bundle, LegacyBundle)
    names = [*(_LEGACY if legacy else _MODEL), *([] if legacy else [n for n in _FIELDS if getattr(bundle, n) is not None])]
    spark = getattr(bundle, names[0]).sparkSession
    before = manifest.read_version(spark, path)
    loose = [n for n in names if before is None and manifest.exists(spark, f"{path}/{n}")]
    if mode == "ignore" and (before is not None or loose):
        return
    if before is not None and mode == "append" and before.fmt != fmt:
        raise ValueError(f"{path} holds {before.fmt}, not {fmt}")
    later = mode in ("overwrite", "append") and (before is not None or bool(loose))
    place = f"{manifest.DATA}/{uuid.uuid4().hex}/" if later else ""
    tables: dict[str, list[Part]] = {}
    if mode == "append":
        tables = dict(before.tables) if before is not None else {n: [Part(n)] for n in loose}
    if not loose:
        manifest.begin(spark, path)  # nothing counts before a version is published
    for name in names:
        df = getattr(bundle, name)
        if mode == "append" and name in _FIELDS and name in tables:
            continue  # descriptions of columns, one for all models
        if fmt == "csv" and "present_columns" in df.columns:
            df = df.withColumn("present_columns", F.concat_ws(";", "present_columns"))
        _write(df, f"{path}/{place}{name}", fmt, partition_by if name not in _FIELDS else ())
        kinds = {c: t for c, t in df.dtypes if c not in partition_by}
        part = Part(f"{place}{name}", tuple(kinds), tuple(kinds.values()))
        tables[name] = [*(tables.get(name, []) if mode == "append" else []), part]
    manifest.publish(spark, path, Manifest(1 if before is None else before.version + 1, fmt, tables))


def _write(df: DataFrame, path: str, fmt: str, by: Sequence[str]) -> None:
    writer = df.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)
