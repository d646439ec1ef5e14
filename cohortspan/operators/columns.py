"""Renaming, parameter records, defaults and cell overrides."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.session import meet, spread


def with_titles(df: DataFrame, fields: DataFrame) -> DataFrame:
    """Rename columns to their titles. Only described columns present in ``df`` change.

    ``fields`` holds a row per column of a table; just those for ``df`` are read.
    """
    wanted = fields.where(F.col("name").isin(df.columns)).select("name", "title")
    return df.withColumnsRenamed({r["name"]: r["title"] for r in wanted.collect()})


def get_titles(df: DataFrame, fields: DataFrame) -> DataFrame:
    """``(position, name, title)`` of the columns of ``df``, null title when undescribed."""
    names = df.sparkSession.createDataFrame(
        list(enumerate(df.columns, start=1)), "position int, name string"
    )
    return names.join(fields.select("name", "title"), "name", "left").select(
        "position", "name", "title"
    )


def parameters(
    df: DataFrame,
    keys: Sequence[str],
    defaults: dict[str, float],
    scenarios: DataFrame | None = None,
    order: str | None = None,
) -> DataFrame:
    """Key/value rows to one record per scenario; a missing or null value gets its default.

    ``scenarios`` adds scenarios that may have no rows. Of several values the first along ``order``
    counts (``row_id`` where there is one), without an order the largest.
    """
    if order is None and "row_id" in df.columns:
        order = "row_id"
    rows = df.select(*keys, "name", "value", *([order] if order else []))
    if scenarios is not None:
        rows = rows.unionByName(scenarios.select(*keys).distinct(), allowMissingColumns=True)

    def picked(name: str) -> Column:
        given = (F.col("name") == name) & F.col("value").isNotNull()
        if order is None:
            return F.max(F.when(given, F.col("value")))
        return F.min_by("value", F.when(given, F.col(order)))

    # A scenario has few rows and they are small, so by bytes a task would get very many scenarios.
    wide = (spread(rows, keys) if keys else rows).groupBy(*keys).agg(*[picked(name).alias(name) for name in defaults])
    return wide.select(
        *keys, *[F.coalesce(F.col(n), F.lit(v)).alias(n) for n, v in defaults.items()]
    )


def with_parameters(
    df: DataFrame,
    records: DataFrame,
    keys: Sequence[str],
    defaults: dict[str, float],
    name: str,
    counted: DataFrame | None = None,
) -> DataFrame:
    """``df`` with the record of its scenario, or the defaults where it has none.

    ``name`` is a column that tells the rows of a scenario apart; ``counted`` a cheaper table with as
    many rows for each scenario.
    """
    joined = meet(df, records, keys, deal=name, counted=counted)
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in defaults.items()})


def parameter(
    df: DataFrame, keys: Sequence[str], name: str, default: float
) -> DataFrame:
    """One named value per scenario."""
    return parameters(df, keys, {name: default})


def fill_defaults(
    df: DataFrame,
    defaults: dict[str, float],
    *,
    blank: float | None = 0.0,
    present: str = "present_columns",
) -> DataFrame:
    """Complete optional columns.

    A column that a model does not have gets its default; a cell left blank in a column that it
    has becomes ``blank`` (or stays null when that is None). Tables that mix models with
    different columns say which ones each has in an ARRAY column ``present``.
    """
    mixed = present in df.columns
    made = {}
    for name, default in defaults.items():
        absent = F.lit(default)
        if name not in df.columns:
            made[name] = absent
            continue
        kept = F.col(name) if blank is None else F.coalesce(F.col(name), F.lit(blank))
        if mixed:
            has = F.col(present).isNull() | F.array_contains(present, name)
            kept = F.when(has, kept).otherwise(absent)
        made[name] = kept
    return df.withColumns(made).drop(present)


def map_columns(
    df: DataFrame,
    kind: type[T.DataType],
    change: Callable[[Column], Column],
    skip: Sequence[str] = (),
) -> DataFrame:
    """Apply ``change`` to each column of a type."""
    return df.select(
        *[
            change(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, kind) and f.name not in skip
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def sum_numeric(df: DataFrame, by: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """Sum of every numeric column by group, nulls counting as nothing (all null gives 0)."""
    totals = [
        F.coalesce(F.sum(f.name), F.lit(0)).alias(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in (*by, *skip)
    ]
    return df.groupBy(*by).agg(*totals)


def override_cells(
    df: DataFrame,
    overrides: DataFrame,
    row_key: Sequence[str],
    columns: Sequence[str],
    *,
    column: str = "column_name",
    value: str = "value",
    order: str | None = None,
) -> DataFrame:
    """Replace single cells, found by row key and column name.

    ``overrides`` holds ``row_key``, a column name and a value. They are turned to one row per
    key first, so the join never multiplies rows of ``df``. Of several values for a cell the last
    along ``order`` counts, without an order the largest.
    """

    def picked(c: str) -> Column:
        mine = F.col(column) == c
        if order is None:
            return F.max(F.when(mine, F.col(value)))
        return F.max_by(value, F.when(mine, F.col(order)))

    per_row = overrides.groupBy(*row_key).agg(*[picked(c).alias(f"__new_{c}") for c in columns])
    joined = df.join(per_row, list(row_key), "left")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return joined.select(
        *[
            F.coalesce(F.col(f"__new_{c}").cast(kinds[c]), F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        ]
    )


def unknown_overrides(
    df: DataFrame,
    overrides: DataFrame,
    row_key: Sequence[str],
    *,
    column: str = "column_name",
) -> DataFrame:
    """Overrides that match no row or no column, with a message."""
    no_column = overrides.where(~F.col(column).isin(df.columns)).withColumn(
        "message", F.concat(F.lit("Could not find column: "), F.col(column))
    )
    no_row = overrides.join(df.select(*row_key).distinct(), list(row_key), "left_anti")
    named = F.concat_ws("/", *[F.col(k).cast("string") for k in row_key])
    no_row = no_row.select(
        *overrides.columns, F.concat(F.lit("Could not find row: "), named).alias("message")
    )
    return no_column.unionByName(no_row)
