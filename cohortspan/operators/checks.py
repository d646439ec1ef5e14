"""Range checks driven by a limits table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.functions import plus_zero, two_decimals
from cohortspan.operators.reshape import numeric_columns

ERROR_COLUMNS = ["table", "column", "row", "message"]


def limits_of(fields: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """``column -> (title, min, max)`` for described columns; a row per table column is read."""
    rows = fields.where(F.col("name").isin(list(columns))).select("name", "title", "min", "max")
    return {r["name"]: (r["title"], r["min"], r["max"]) for r in rows.collect()}


def range_check(
    df: DataFrame,
    fields: DataFrame | dict[str, tuple],
    table: str,
    row: str,
    *,
    keys: Sequence[str] = (),
    skip: Sequence[str] = (),
    with_position: bool = False,
) -> DataFrame:
    """Values below or above their limits, one row each; nulls and open limits pass.

    ``row`` names the column that identifies the source row. ``with_position`` adds the place
    the value has once the numeric columns are unpivoted in order (1-based), for which ``row``
    must number the rows 1, 2, ...

    Good rows are dropped before the unpivot: limits are few, so they are stated in the
    expression rather than joined.
    """
    numbers = numeric_columns(df, (*keys, row, *skip))
    limits = fields if isinstance(fields, dict) else limits_of(fields, numbers)
    cells, broken = [], F.lit(False)
    for at, name in enumerate(numbers, start=1):
        title, low, high = limits.get(name, (None, None, None))
        value = F.col(name).cast("double")
        under = F.lit(False) if low is None else F.coalesce(value < low, F.lit(False))
        over = F.lit(False) if high is None else F.coalesce(value > high, F.lit(False))
        if low is None and high is None:
            continue
        broken = broken | under | over
        cells.append(
            F.struct(
                F.lit(title).alias("column"),
                F.lit(at).alias("__at"),
                value.alias("__value"),
                under.alias("__under"),
                over.alias("__over"),
            )
        )
    if not cells:
        cells = [
            F.struct(
                F.lit(None).cast("string").alias("column"),
                F.lit(0).alias("__at"),
                F.lit(0.0).alias("__value"),
                F.lit(False).alias("__under"),
                F.lit(False).alias("__over"),
            )
        ]
    wrong = (
        df.where(broken)
        .select(*keys, row, F.explode(F.array(*cells)).alias("c"))
        .select(*keys, row, "c.*")
        .where(F.col("__under") | F.col("__over"))
    )
    found = wrong.select(
        *keys,
        F.lit(table).alias("table"),
        "column",
        F.col(row).cast("long").alias("row"),
        range_message(F.col("__value"), F.col("__under")).alias("message"),
        *(
            [((F.col(row) - 1) * len(numbers) + F.col("__at")).cast("long").alias("position")]
            if with_position
            else []
        ),
    )
    return found


def range_violations(
    df: DataFrame, fields: DataFrame | dict[str, tuple], table: str, row: str, *, keys: Sequence[str] = ()
) -> Column:
    """The same as one expression: an array of (table, column, row, message) for each row of ``df``."""
    numbers = numeric_columns(df, (*keys, row))
    limits = fields if isinstance(fields, dict) else limits_of(fields, numbers)
    found = []
    for name in numbers:
        title, low, high = limits.get(name, (None, None, None))
        value = F.col(name).cast("double")
        under = F.lit(False) if low is None else F.coalesce(value < low, F.lit(False))
        over = F.lit(False) if high is None else F.coalesce(value > high, F.lit(False))
        if low is not None or high is not None:
            message = range_message(value, under)
            found.append(F.when(under | over, violation(table, F.lit(title), F.col(row), message)))
    return violations(found)


def violation(table: str, column: Column, row: Column, message: Column) -> Column:
    values = (F.lit(table), column.cast("string"), row.cast("long"), message)
    return F.struct(*[value.alias(name) for name, value in zip(ERROR_COLUMNS, values)])


def violations(found: Sequence[Column]) -> Column:
    """Those of ``found`` that aren't null, as an array."""
    none = F.lit(None).cast("struct<table: string, column: string, row: bigint, message: string>")
    return F.array_compact(F.array(none, *found))


def range_message(value: Column, under: Column) -> Column:
    side = F.when(under, F.lit("below minimum value")).otherwise(
        F.lit("above maximum value")
    )
    return F.concat(F.lit("Value "), two_decimals(plus_zero(value)), F.lit(" is "), side)
