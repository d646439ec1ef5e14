"""Key checks between tables and assignment of values to cumulative-share buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.operators.scan import group_total, ordered_scan, position, running_sum
from cohortspan.session import meet


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with non-null keys that have no partner in ``right``."""
    given = left
    for key in on:
        given = given.where(F.col(key).isNotNull())
    # Only distinct keys travel, so a key that is frequent on the right costs nothing.
    return given.join(right.select(*on).distinct(), list(on), "left_anti")


def cumulative_shares(
    weights: DataFrame, group: Sequence[str], label: str, weight: str, **options
) -> DataFrame:
    """Upper bound of each label's bucket: running weight over the group's total, by label; and the
    label's ``place`` in that order."""
    summed = ordered_scan(
        weights,
        group,
        [label],
        __run=running_sum(F.col(weight)),
        __all=group_total(F.col(weight)),
        place=position(),
        **options,
    )
    return summed.select(
        *group, label, (F.col("__run") / F.col("__all")).alias("upper"), "place"
    )


#: Bounds in one row; a group with more is cut into chunks of this many. Each draw is copied beside
#: the rows that it is looked up in, so they have to be short.
CHUNK = 256
#: Draws of a group that are looked up in one place.
DRAWN = 1 << 18


def _first_reaching(bounds: str, value: str) -> str:
    """SQL for the place of the first of a sorted array's values that is at least ``value``.

    Lower-bound search in steps of falling powers of two; the array's size if there is none.
    """
    steps = f"transform(sequence(length(bin(size({bounds}))) - 1, 0, -1), e -> shiftleft(1, e))"
    return f"""aggregate({steps}, 0, (at, step) ->
        IF(coalesce(get({bounds}, at + step - 1) < {value}, false), at + step, at))"""


def assign_buckets(
    draws: DataFrame,
    buckets: DataFrame,
    group: Sequence[str],
    draw: str,
    label: str,
    upper: str = "upper",
    *,
    chunk: int | None = None,
    **options,
) -> DataFrame:
    """Give each row the first label of its group whose cumulative share reaches ``draw``.

    A draw above the last bound, or a null one, gets null. The bounds of a group are cut into chunks of
    ``chunk`` along their order (by ``place``, which is counted here where ``buckets`` lacks it), and
    these into parts of ``chunk`` chunks. A draw finds its part among the parts' last bounds, its chunk
    in that part, then its bound in that chunk, all in sorted arrays by halving. Draws are neither
    sorted nor paired with bounds.
    """
    chunk = chunk or CHUNK
    if "place" not in buckets.columns:
        buckets = ordered_scan(buckets, group, [upper, label], place=position(), **options)
    sizes = {"__part": chunk * chunk, "__chunk": chunk}
    numbers = [F.expr(f"(place - 1) DIV {size}L").alias(name) for name, size in sizes.items()]
    rows = buckets.select(*group, *numbers, F.col(upper).alias("u"), F.col(label).alias("v"))

    def held(of: DataFrame, by: Sequence[str]) -> DataFrame:
        """Sorted values ``u`` of a group's rows, and what each leads to."""
        found = of.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("__held"))
        return found.select(*by, F.col("__held.u").alias("__u"), F.col("__held.v").alias("__v"))

    def last(of: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        return of.select(*by, F.element_at("__u", -1).alias("u"), F.col(name).alias("v"))

    bounds = held(rows, [*group, "__part", "__chunk"])
    chunks = held(last(bounds, [*group, "__part"], "__chunk"), [*group, "__part"])
    parts = held(last(chunks, group, "__part"), group)
    at = F.expr(f"get(__v, {_first_reaching('__u', f'`{draw}`')})")
    given, taken = F.col(f"`{draw}`").isNotNull(), [F.col(f"`{c}`") for c in draws.columns]
    # A group has as many draws as there are, so it is dealt by them.
    sent = meet(draws, parts, [], safe=group, deal=draw, most=DRAWN)
    sent = sent.select(*taken, F.when(given, at).alias("__part"))
    for below, name in ((chunks, "__chunk"), (bounds.drop("__part"), label)):
        on = next(c for c in ("__chunk", "__part") if c in sent.columns)
        same = [F.col(f"d.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
        same.append(F.col(f"d.{on}") == F.col(f"b.{on}"))
        met = sent.alias("d").join(below.alias("b"), same, "left").select("d.*", "__u", "__v")
        sent = met.select(*taken, at.alias(name))
    return sent
