"""Every combination of listed cell values, analysed in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.functions import is_number_list, to_number
from cohortspan.operators.reshape import split_cells
from cohortspan.plans import cohort
from cohortspan.plans.grid import Cell, Grid
from cohortspan.session import meet
from cohortspan.tables import VARIANT, LegacyBundle, ModelBundle

# Table name in a variation row -> (bundle field, columns that name a row, as "a/b").
TABLES = {
    "global_table": ("globals", ("name",)),
    "state_table": ("states", ("treatment", "state")),
    "payment_table": ("payments", ("payment",)),
    "treatment_table": ("treatments", ("name",)),
    "contract_table": ("contracts", ("name",)),
}


def cells_of(variations: DataFrame) -> list[Cell]:
    """Cells of a variation table ``(table_name, row_name, column_name, value)``.

    The table is the grid's specification, a row per value tried.
    """
    grouped = variations.groupBy("table_name", "row_name", "column_name").agg(
        F.sort_array(F.collect_set("value")).alias("values")
    )
    rows = grouped.orderBy("table_name", "row_name", "column_name").collect()
    return [
        Cell(
            r["table_name"],
            r["row_name"],
            r["column_name"],
            "array(" + ", ".join(f"{v!r}D" for v in r["values"]) + ")",
        )
        for r in rows
    ]


def scenario_cells(variations: DataFrame, keys: Sequence[str]) -> tuple[list[Cell], DataFrame]:
    """Cells of a variation table with scenario keys, and the scenarios with each cell's values.

    ``variations`` is ``(keys, table_name, row_name, column_name, value)``. Only the names of cells
    go to the driver; values stay beside their scenario. A scenario without values for a cell keeps
    the cell as it is.
    """
    names = variations.select("table_name", "row_name", "column_name").distinct()
    found = names.orderBy("table_name", "row_name", "column_name").collect()
    cells, columns = [], []
    for at, (table, row, column) in enumerate(found):
        mine = (F.col("table_name") == table) & (F.col("row_name") == row)
        mine = F.when(mine & (F.col("column_name") == column), F.col("value"))
        columns.append(F.sort_array(F.collect_set(mine)).alias(f"cell{at}"))
        values = f"IF(size(cell{at}) = 0, array(CAST(NULL AS DOUBLE)), cell{at})"
        cells.append(Cell(table, row, column, values))
    return cells, variations.groupBy(*keys).agg(*columns)


def variation_rows(
    text_table: DataFrame,
    table: str,
    row: str,
    skip: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Cells holding several values, such as ``"0.0 0.01 0.05"``, as a variation table.

    ``text_table`` holds text; a cell that is one number, blank, or no list of numbers is left
    out. ``keys`` are scenario columns to pass on.
    """
    columns = [c for c in text_table.columns if c not in (row, *skip, *keys)]
    ids = [*keys, row]
    long = text_table.select(*ids, *columns).unpivot(ids, columns, "column_name", "value")
    several = long.where(to_number(F.col("value")).isNull() & is_number_list(F.col("value")))
    return split_cells(several, "value").select(
        *keys,
        F.lit(table).alias("table_name"),
        F.col(row).alias("row_name"),
        "column_name",
        "value",
    ).where("value IS NOT NULL")


def _exploded(df: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """A copy of each row per combination, with ``v0, v1, ...`` and the combination's number.

    Each cell's values are exploded in turn inside the row. The first cell varies slowest.
    """
    kept, number = df.columns, "0"
    for at, cell in enumerate(cells):
        df = df.selectExpr("*", f"posexplode({cell.values}) AS (i{at}, v{at})")
        number = f"({number}) * size({cell.values}) + i{at}"
    values = [f"v{at}" for at in range(len(cells))]
    return df.select(*kept, F.expr(number).alias(VARIANT), *values)


def variants(scenarios: DataFrame, keys: Sequence[str], cells: Sequence[Cell]) -> DataFrame:
    """``(keys, variant_id, v0, v1, ...)``: all combinations for each scenario."""
    return _exploded(scenarios, cells).select(
        *keys, VARIANT, *[f"v{at}" for at in range(len(cells))]
    )


def _vary(
    table: DataFrame,
    grid: DataFrame | None,
    keys: Sequence[str],
    cells: Sequence[Cell],
    mine: Sequence[int],
    names: Sequence[str],
) -> DataFrame:
    """One copy of the table's rows per variant, with the named cells replaced (not by nulls)."""
    copies = _exploded(table, cells) if grid is None else meet(table, grid, keys, how="inner", deal=names[0])
    label = F.concat_ws("/", *[F.col(n).cast("string") for n in names])
    changed: dict[str, Column] = {}
    for at in mine:
        cell = cells[at]
        kept = changed.get(cell.column, F.col(cell.column))
        kind = table.schema[cell.column].dataType
        given = (label == cell.row) & F.col(f"v{at}").isNotNull()
        changed[cell.column] = F.when(given, F.col(f"v{at}").cast(kind)).otherwise(kept)
    return copies.select(
        *keys,
        VARIANT,
        *[changed.get(c, F.col(c)).alias(c) for c in table.columns if c not in keys],
    )


def _fields(bundle: ModelBundle | LegacyBundle, cells: Sequence[Cell]) -> dict[str, list[int]]:
    """The cells of each table of the bundle; an error names a table or column that it lacks."""
    by_field: dict[str, list[int]] = {}
    for at, cell in enumerate(cells):
        field, _ = TABLES.get(cell.table, (None, None))
        if field is None or not hasattr(bundle, field):
            raise ValueError(f"Could not find table: {cell.table}")
        if cell.column not in getattr(bundle, field).columns:
            raise ValueError(f"Could not find column: {cell.column} in table: {cell.table}")
        by_field.setdefault(field, []).append(at)
    return by_field


def vary(
    bundle: ModelBundle | LegacyBundle, grid: DataFrame | None, cells: Sequence[Cell]
) -> ModelBundle | LegacyBundle:
    """The bundle of all variants, keyed by scenario and variant.

    Without a ``grid`` the cells' values are constants and are exploded in the tables' own rows,
    which takes no join.
    """
    keys = list(bundle.keys)
    by_field = _fields(bundle, cells)
    rows_of = {field: names for field, names in TABLES.values()}
    data = ["treatments", "contracts", "globals"]
    if isinstance(bundle, ModelBundle):
        data = ["states", "payments", "globals"]
    tables = {
        field: _vary(
            getattr(bundle, field), grid, keys, cells, by_field.get(field, []), rows_of[field]
        )
        for field in data
    }
    return bundle.with_tables(keys=(*keys, VARIANT), base=bundle.plain, **tables)


def unknown_rows(bundle: ModelBundle | LegacyBundle, cells: Sequence[Cell]) -> DataFrame:
    """``(keys, table, row, message)`` for each cell whose row a scenario doesn't have."""
    keys = list(bundle.keys)
    every = bundle.treatments if isinstance(bundle, LegacyBundle) else bundle.states
    rows = every.select(*keys)
    wanted = sorted({(cell.table, cell.row) for cell in cells})
    for name in dict.fromkeys(cell.table for cell in cells):
        field, names = TABLES[name]
        label = F.concat_ws("/", *[F.col(n).cast("string") for n in names])
        found = F.struct(F.lit(name).alias("table"), label.alias("row"))
        mine = label.isin([row for table, row in wanted if table == name])
        rows = rows.unionByName(
            getattr(bundle, field).where(mine).select(*keys, found.alias("found")),
            allowMissingColumns=True,
        )
    asked = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(r).alias("row")) for t, r in wanted])
    lost = rows.groupBy(*keys).agg(F.array_except(asked, F.collect_set("found")).alias("lost"))
    # Fixed value: the wording of the message.
    said = F.concat(F.lit("Could not find row: "), F.col("row"), F.lit(" in table: "), F.col("table"))
    return lost.select(*keys, F.inline("lost")).withColumn("message", said)


def sweep(
    bundle: ModelBundle | LegacyBundle,
    cells: Sequence[Cell],
    analyse: Callable[[ModelBundle | LegacyBundle], DataFrame],
    scenarios: DataFrame | None = None,
    add_row_names: bool = False,
) -> DataFrame:
    """Run ``analyse`` once over every combination and label its rows with the values used.

    ``cohort.incremental`` over constant values prices each arm once per setting of the cells that
    touch it and puts the combinations together afterwards; other analyses get a copy of every table
    row per combination.

    ``scenarios`` gives the scenarios with the columns that cell values refer to; without it the
    values are constants. Labels are column names, with the row's name in front when
    ``add_row_names`` or when two cells share a column. Scenarios that lack the row of a cell can't
    be varied: their results are null (``unknown_rows`` names the cells).
    """
    keys = list(bundle.keys)
    names = [c.name for c in cells]
    labels = [
        f"{c.row} {c.column}" if add_row_names or names.count(c.name) > 1 else c.name
        for c in cells
    ]
    digits = Grid(tuple(cells))
    grid = None if scenarios is None else variants(scenarios, keys, cells)
    if grid is None and analyse is cohort.incremental and digits.prices_arms():
        _fields(bundle, cells)
        result = cohort.incremental(bundle.with_tables(grid=digits))
    else:
        result = analyse(vary(bundle, grid, cells))
    taken = [c for c in result.columns if c not in (*keys, VARIANT)]
    lost = unknown_rows(bundle, cells).select(*keys, F.lit(True).alias("__lost")).distinct()
    every = bundle.treatments if isinstance(bundle, LegacyBundle) else bundle.states
    unvaried = meet(result, lost, keys, deal=VARIANT, counted=every)
    numbers = {f.name for f in result.schema if isinstance(f.dataType, T.NumericType)} & set(taken)
    blank = {c: F.when(F.col("__lost").isNull(), F.col(c)) for c in numbers}
    result = unvaried.withColumns(blank).drop("__lost")
    if grid is None:
        used = [digits.value(at, VARIANT).alias(label) for at, label in enumerate(labels)]
        return result.select(*keys, VARIANT, *used, *taken)
    known = grid.select(
        *keys, VARIANT, *[F.col(f"v{at}").alias(label) for at, label in enumerate(labels)]
    )
    return meet(known, result, [*keys, VARIANT], how="inner").select(*keys, VARIANT, *labels, *taken)
