"""Long, wide, repeated, split and nested data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.functions import to_number


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    name: str = "name",
    value: str = "value",
) -> DataFrame:
    """One row per id and column; all numeric columns other than ``ids`` by default."""
    values = numeric_columns(df, ids) if values is None else list(values)
    same_type = [F.col(c).cast("double").alias(c) for c in values] if all(
        isinstance(df.schema[c].dataType, T.NumericType) for c in values
    ) else [F.col(c) for c in values]
    return df.select(*ids, *same_type).unpivot(list(ids), values, name, value)


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    name: str,
    value: str,
    names: Sequence[str],
    order: str | None = None,
) -> DataFrame:
    """One column per listed name. Naming them avoids a pass over the data to find them.

    Of several values the first along ``order`` counts, without an order the largest.
    """
    given = F.col(value).isNotNull()
    one = F.max(value) if order is None else F.min_by(value, F.when(given, F.col(order)))
    return df.groupBy(*ids).pivot(name, list(names)).agg(one)


def repeat_rows(df: DataFrame, times: Column, index: str) -> DataFrame:
    """Repeat each row ``times`` times with a 0-based ``index``; none for 0, less or null."""
    copies = F.sequence(F.lit(0), F.greatest(times, F.lit(1)).cast("int") - F.lit(1))
    return df.where(times > 0).select("*", F.explode(copies).alias(index))


def split_cells(df: DataFrame, column: str, delimiter: str = " +") -> DataFrame:
    """One row per value of a delimited text cell, as DOUBLE (null where it is no number)."""
    parts = F.explode(F.split(F.trim(F.col(column)), delimiter))
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, parts.alias(column)).withColumn(column, to_number(F.col(column)))


def matrix_cells(
    df: DataFrame, matrix: str, row: str = "time", column: str = "state", value: str = "value"
) -> DataFrame:
    """ARRAY<ARRAY<..>> to 1-based coordinates; empty rows and null matrices give none.

    The outer forms keep Spark from inferring a size filter on the matrix, which would evaluate
    an expensive matrix expression a second time.
    """
    rest = [c for c in df.columns if c != matrix]
    lines = df.select(*rest, F.posexplode_outer(matrix).alias("__row", "__line"))
    cells = lines.select(
        *rest,
        (F.col("__row") + 1).alias(row),
        F.posexplode_outer("__line").alias("__column", value),
    )
    return cells.where("__column IS NOT NULL").select(
        *rest, row, (F.col("__column") + 1).alias(column), value
    )


def flag_cells(
    df: DataFrame,
    ids: Sequence[str],
    flags: Sequence[str],
    name: str = "variable",
    empty: Sequence[str] = ("v1", "v2", "v3"),
) -> DataFrame:
    """The cells of a flag table that are set, with empty value columns to fill in."""
    marks = df.select(*ids, *[F.col(c).isNotNull().alias(c) for c in flags])
    long = marks.unpivot(list(ids), list(flags), name, "__set").where("__set").drop("__set")
    return long.withColumns({c: F.lit(None).cast("double") for c in empty})
