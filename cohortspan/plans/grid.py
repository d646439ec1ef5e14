"""Combinations of cell values as mixed-radix numbers.

A combination is one whole number; the digit of a cell in it says which of the cell's values is used.
An arm of a model depends on few cells: those of its own states, of the plans that it uses and of the
rates. It is priced once for each setting of these, under the number whose other digits are 0, and
the number of any combination leads back to it by arithmetic. So no row carries a list of
combinations, whatever their count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameters that price an arm.
RATES = ["time_horizon", "discount", "firm_discount"]


@dataclass(frozen=True)
class Cell:
    """A cell to vary. ``values`` is SQL for an ARRAY<DOUBLE>, constant or over scenario columns."""

    table: str
    row: str
    column: str
    values: str
    label: str | None = None

    @property
    def name(self) -> str:
        return self.label or self.column


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Grid:
    """All combinations of cells with constant values; the first cell varies slowest."""

    cells: tuple[Cell, ...]

    def size(self, at: int) -> str:
        return f"size({self.cells[at].values})"

    def step(self, at: int) -> str:
        """What the number grows by from one value of the cell to the next."""
        return " * ".join([f"CAST({self.size(i)} AS BIGINT)" for i in range(at + 1, len(self.cells))]) or "1L"

    @property
    def total(self) -> str:
        return " * ".join(f"CAST({self.size(i)} AS BIGINT)" for i in range(len(self.cells)))

    def digit(self, at: int, number: str) -> str:
        return f"({number}) DIV ({self.step(at)}) % {self.size(at)}"

    def value(self, at: int, number: str) -> Column:
        return F.expr(f"get({self.cells[at].values}, CAST({self.digit(at, number)} AS INT))")

    def of(self, table: str) -> list[int]:
        return [at for at, cell in enumerate(self.cells) if cell.table == table]

    def prices_arms(self) -> bool:
        """Whether each cell changes what single arms cost, and nothing about how arms are paired or
        which states a plan spans."""
        columns = {
            "state_table": lambda cell: cell.column in ("p_prog", "p_death", "QoL"),
            "payment_table": lambda cell: cell.column != "payment",
            "global_table": lambda cell: cell.column == "value" and cell.row != "control_count",
        }
        return all(cell.table in columns and columns[cell.table](cell) for cell in self.cells)

    def varied(self, df: DataFrame, mine: Sequence[int], label: Column, where: dict[int, str], name: str) -> DataFrame:
        """A copy of each row per setting of the cells in ``mine`` that ``where`` (SQL) finds to touch
        it, with the cells in its own row replaced (not by nulls) and the setting's number ``name``."""
        kept, number = df.columns, "0L"
        for at in mine:
            values = self.cells[at].values
            tried = f"IF({where[at]}, {values}, slice({values}, 1, 1))"
            df = df.selectExpr("*", f"posexplode({tried}) AS (__i{at}, __v{at})")
            number = f"{number} + __i{at} * ({self.step(at)})"
        changed: dict[str, Column] = {}
        for at in mine:
            cell, value = self.cells[at], F.col(f"__v{at}")
            given = (label == cell.row) & value.isNotNull()
            before = changed.get(cell.column, F.col(cell.column))
            changed[cell.column] = F.when(given, value.cast(df.schema[cell.column].dataType)).otherwise(before)
        return df.select(*[changed.get(c, F.col(c)).alias(c) for c in kept], F.expr(number).alias(name))

    def states(self, states: DataFrame) -> DataFrame:
        """States copied by the cells that address their treatment, numbered ``__chain``."""
        mine = self.of("state_table")
        where = {at: f"treatment <=> {_quoted(self._treatment(at))}" for at in mine}
        label = F.concat_ws("/", "treatment", F.col("state").cast("string"))
        return self.varied(states, mine, label, where, "__chain")

    def payments(self, payments: DataFrame) -> DataFrame:
        """Plans copied by their own cells, numbered ``__plan``."""
        mine = self.of("payment_table")
        where = {at: f"payment <=> {_quoted(self.cells[at].row)}" for at in mine}
        return self.varied(payments, mine, F.col("payment"), where, "__plan")

    def rates(self, globals_: DataFrame) -> DataFrame:
        """Parameters copied by the cells of rates, numbered ``__rates``."""
        mine = self._rates()
        return self.varied(globals_, mine, F.col("name"), {at: "true" for at in mine}, "__rates")

    def _rates(self) -> list[int]:
        return [at for at in self.of("global_table") if self.cells[at].row in RATES]

    def _treatment(self, at: int) -> str:
        return self.cells[at].row.rpartition("/")[0]

    def touched(self, treatment: str, plans: str) -> str:
        """SQL for an array that tells by cell whether it touches an arm that uses ``plans``."""
        found = []
        for cell in self.cells:
            if cell.table == "state_table":
                found.append(f"{treatment} <=> {_quoted(cell.row.rpartition('/')[0])}")
            elif cell.table == "payment_table":
                found.append(f"exists({plans}, p -> p <=> {_quoted(cell.row)})")
            else:
                found.append(str(cell.row in RATES).lower())
        return f"array({', '.join(found)})"

    def settings(self, chain: str, touched: str) -> str:
        """SQL for the numbers under which an arm with a given version of its states is priced."""
        made = f"array({chain})"
        for at in [*self.of("payment_table"), *self._rates()]:
            moved = f"transform(sequence(0, {self.size(at)} - 1), d -> v + d * ({self.step(at)}))"
            made = f"flatten(transform({made}, v -> IF({touched}[{at}], {moved}, array(v))))"
        return made

    def terms_of(self, number: str, payment: str) -> str:
        """SQL for the number that a plan's terms and rates have in an arm's setting."""
        parts = [f"{self.digit(at, number)} * ({self.step(at)})" for at in self._rates()]
        for at in self.of("payment_table"):
            own = f"{payment} <=> {_quoted(self.cells[at].row)}"
            parts.append(f"IF({own}, {self.digit(at, number)} * ({self.step(at)}), 0L)")
        return " + ".join(["0L", *parts])

    def place(self, number: str, touched: str) -> str:
        """SQL for the place of a combination among an arm's settings, sorted by number."""
        place = "0L"
        for at in range(len(self.cells)):
            on = f"{touched}[{at}]"
            place = f"({place}) * IF({on}, {self.size(at)}, 1) + IF({on}, {self.digit(at, number)}, 0L)"
        return f"CAST({place} AS INT)"
