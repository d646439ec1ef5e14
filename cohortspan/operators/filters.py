"""Predicates built from column types, profiles, and positional or top rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.operators.scan import group_size, ordered_scan, position


def choice_predicate(df: DataFrame, choices: dict[str, Sequence]) -> Column:
    """AND of one condition per column: a number lies in a range, a text is in a set.

    Columns without a choice, or of another type, let every row pass.
    """
    tests = []
    for name, choice in choices.items():
        kind, col = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.NumericType):
            low, high = choice
            tests.append(col.isNotNull() & col.between(low, high))
        elif isinstance(kind, T.StringType):
            tests.append(col.isin(list(choice)))
    return reduce(Column.__and__, tests, F.lit(True))


def first_matches(
    df: DataFrame, choices: dict[str, Sequence], order: Sequence[str], count: int = 12
) -> DataFrame:
    """The first ``count`` rows by ``order`` that satisfy the choices."""
    return df.where(choice_predicate(df, choices)).orderBy(*order).limit(count)


def number_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, low, high)`` of numeric columns from a single pass."""
    bounds = df.agg(
        *[F.min(c).cast("double").alias(f"low_{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"high_{c}") for c in columns],
    )
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"low_{c}").alias("low"),
            F.col(f"high_{c}").alias("high"),
        )
        for c in columns
    ]
    return bounds.select(F.inline(F.array(*pairs)))


def text_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct ``(column, level)`` of text columns, one row each."""
    long = df.select(*columns).unpivot([], list(columns), "column", "level")
    return long.where(F.col("level").isNotNull()).distinct()


def rows_between(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    first: int,
    last: int | None = None,
    **options,
) -> DataFrame:
    """Rows at 1-based positions ``first..last`` of each group (to the end without ``last``)."""
    if last is not None:
        # A bounded rank lets Spark drop rows before the shuffle, so a large group is no risk.
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        ranked = df.withColumn("__at", rank).where(F.col("__at") <= last)
    else:
        ranked = ordered_scan(df, keys, order, __at=position(), **options)
    return ranked.where(F.col("__at") >= first).drop("__at")


def top_by_group(
    df: DataFrame, keys: Sequence[str], by: str, count: Column, tasks: int | None = None
) -> DataFrame:
    """The last ``count`` rows of each group in order of ``by``; ``count`` is a column.

    A row is among them by its place from the end. Groups above a task's share are cut along their
    order and their blocks counted, so neither a large group nor a large ``count`` meets in one task.
    """
    placed = ordered_scan(df, keys, [by], tasks=tasks, __at=position(), __size=group_size())
    return placed.where(F.col("__size") - F.col("__at") < count).drop("__at", "__size")
