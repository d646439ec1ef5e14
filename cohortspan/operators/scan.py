"""Ordered calculations per group that survive a group holding a large part of all rows.

A plain window puts each group into one task. ``ordered_scan`` cuts every group with more than its
share of the rows into consecutive blocks along its order: each block is scanned on its own, a small
summary per block is carried from block to block, and the carry is joined back. There is one plan
for all sizes, and building it runs no job: the cut points come from a sample inside the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sampled rows for each task; a group with as many of them has a task's share and is cut.
SAMPLED = 32
# A cut after so many sampled rows of a group: blocks of about half a share.
APART = SAMPLED // 2

_BLOCK = "__block"


@dataclass(frozen=True)
class Step:
    """One ordered calculation; build it with the functions below."""

    kind: str
    value: Column


def position() -> Step:
    """1-based row number."""
    return Step("sum", F.lit(1).cast("long"))


def running_sum(value: Column) -> Step:
    """Sum up to and including the row."""
    return Step("sum", value)


def sum_before(value: Column) -> Step:
    """Sum of the rows before this one, 0 on the first."""
    return Step("sum_before", value)


def group_total(value: Column) -> Step:
    """Sum over the whole group on every row."""
    return Step("total", value)


def group_min(value: Column) -> Step:
    """Smallest value of the whole group on every row."""
    return Step("min", value)


def running_max(value: Column) -> Step:
    return Step("max", value)


def last_valid(value: Column) -> Step:
    """Last non-null value up to and including the row (fill forward)."""
    return Step("last_valid", value)


def next_valid(value: Column) -> Step:
    """First non-null value from the row on (fill backward)."""
    return Step("next_valid", value)


def previous(value: Column) -> Step:
    return Step("previous", value)


def following(value: Column) -> Step:
    return Step("following", value)


def group_size() -> Step:
    """Number of rows in the group, on every row."""
    return group_total(F.lit(1).cast("long"))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    tasks: int | None = None,
    cuts: DataFrame | None | str = "find",
    cut_keys: Sequence[str] | None = None,
    **steps: Step,
) -> DataFrame:
    """Add one column per step, computed over ``keys`` groups in ascending ``order``.

    The order must be total within a group; its columns may be of any sortable type. A group above
    one of ``tasks`` shares of the rows (the shuffle partitions by default) is cut. ``cuts`` passes
    on what ``find_cuts`` returned for groups of ``cut_keys`` (which ``keys`` extend), or None where
    groups are short by their nature.
    """
    if isinstance(cuts, str):
        cuts = find_cuts(df, keys, order, tasks)
    inputs = {f"__in_{name}": step.value for name, step in steps.items()}
    df = df.withColumns(inputs)
    if cuts is None:
        local = df.withColumns(_local(steps, Window.partitionBy(*keys), order))
        return local.drop(*inputs)

    blocks = _with_block(df, cut_keys or keys, order, cuts)
    group = Window.partitionBy(*keys, _BLOCK)
    edges = {
        f"__edge_{name}": (F.lag if step.kind == "previous" else F.lead)(F.lit(True)).over(
            group.orderBy(*order)
        )
        for name, step in steps.items()
        if step.kind in ("previous", "following")
    }
    local = blocks.withColumns({**_local(steps, group, order), **edges})
    carry = _carry(blocks.where(F.col(_BLOCK).isNotNull()), keys, order, steps)
    # Only groups in several blocks have a carry: at most two rows for each block edge.
    right = F.broadcast(carry).alias("c")
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    match.append(F.col(f"l.{_BLOCK}") == F.col(f"c.{_BLOCK}"))
    kept = [F.col(f"l.`{c}`") for c in df.columns if c not in inputs]
    merged = {name: _merge(name, step) for name, step in steps.items()}
    return local.alias("l").join(right, match, "left").select(
        *kept, *[col.alias(name) for name, col in merged.items()]
    )


def find_cuts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], tasks: int | None = None
) -> DataFrame:
    """Cut points of each group above a share of the rows: the keys and an array ``__cuts``.

    The sample is the rows whose hash of keys and order lies in the lowest part of the range, a part
    that is expected to hold ``SAMPLED`` rows for each task; the number of rows is a scalar subquery of
    the same plan. So it has the same rows whenever and wherever it is drawn, however the input is
    partitioned. The result is at most a row for each task.
    """
    if tasks is None:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = list(dict.fromkeys([*keys, *order]))
    share = float(SAMPLED * tasks) / df.agg(F.count(F.lit(1)).cast("double")).scalar()
    at = F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))
    sample = df.select(*keys, F.struct(*order).alias("__at")).where(at < share)
    found = sample.groupBy(*keys).agg(F.array_sort(F.collect_list("__at")).alias("__seen"))
    every = F.filter("__seen", lambda _, i: ((i + 1) % APART == 0) & (i + 1 < F.size("__seen")))
    return found.where(F.size("__seen") >= SAMPLED).select(*keys, every.alias("__cuts"))


def _with_block(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: DataFrame
) -> DataFrame:
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    at = F.struct(*[F.col(f"d.{c}") for c in order])
    # Cuts are sorted: those below a row are counted by halving, in steps of falling powers of two.
    steps = F.expr("transform(sequence(length(bin(size(__cuts))) - 1, 0, -1), e -> shiftleft(1, e))")
    stepped = cuts.withColumn("__steps", steps)

    def further(found: Column, step: Column) -> Column:
        below = F.get("__cuts", found + step - 1) < at
        return F.when(below, found + step).otherwise(found)

    block = F.when(F.col("__cuts").isNotNull(), F.aggregate("__steps", F.lit(0), further))
    return (
        df.alias("d")
        .join(F.broadcast(stepped).alias("k"), same, "left")
        .select(*[F.col(f"d.`{c}`") for c in df.columns], block.alias(_BLOCK))
    )


def _local(steps: dict[str, Step], group, order: Sequence[str]) -> dict[str, Column]:
    ordered = group.orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # Looking ahead is a running frame in reverse order: a frame that reaches to the end of the
    # group would be read again from every row.
    reverse = group.orderBy(*[F.col(c).desc_nulls_last() for c in order])
    onward = reverse.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {}
    for name, step in steps.items():
        value = F.col(f"__in_{name}")
        if step.kind == "sum":
            made[name] = F.sum(value).over(upto)
        elif step.kind == "sum_before":
            made[name] = F.coalesce(F.sum(value).over(before), F.lit(0))
        elif step.kind == "total":
            made[name] = F.sum(value).over(group)
        elif step.kind == "min":
            made[name] = F.min(value).over(group)
        elif step.kind == "max":
            made[name] = F.max(value).over(upto)
        elif step.kind == "last_valid":
            made[name] = F.last(value, ignorenulls=True).over(upto)
        elif step.kind == "next_valid":
            made[name] = F.last(value, ignorenulls=True).over(onward)
        elif step.kind == "previous":
            made[name] = F.lag(value).over(ordered)
        elif step.kind == "following":
            made[name] = F.lead(value).over(ordered)
        else:
            raise ValueError(step.kind)
    return made


def _carry(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], steps: dict[str, Step]
) -> DataFrame:
    """What each block of a group in several receives from the blocks before or after it."""
    at = F.struct(*order)
    sums = []
    for name, step in steps.items():
        value = F.col(f"__in_{name}")
        some = F.when(value.isNotNull(), at)
        whole = F.struct(value.alias("v"))
        fold = {
            "sum": F.sum(value),
            "sum_before": F.sum(value),
            "total": F.sum(value),
            "min": F.min(value),
            "max": F.max(value),
            "last_valid": F.max_by(value, some),
            "next_valid": F.min_by(value, some),
            "previous": F.max_by(whole, at),
            "following": F.min_by(whole, at),
        }[step.kind]
        sums.append(fold.alias(name))
    group = Window.partitionBy(*keys)
    summary = (
        rows.groupBy(*keys, _BLOCK)
        .agg(*sums)
        .withColumn("__blocks", F.count(F.lit(1)).over(group))
        .where("__blocks > 1")
    )
    ordered = group.orderBy(_BLOCK)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = group.orderBy(F.desc(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    made = []
    for name, step in steps.items():
        value = F.col(name)
        if step.kind in ("sum", "sum_before"):
            carried = F.sum(value).over(before)
        elif step.kind == "total":
            carried = F.sum(value).over(group)
        elif step.kind == "min":
            carried = F.min(value).over(group)
        elif step.kind == "max":
            carried = F.max(value).over(before)
        elif step.kind == "last_valid":
            carried = F.last(value, ignorenulls=True).over(before)
        elif step.kind == "next_valid":
            carried = F.last(value, ignorenulls=True).over(after)
        elif step.kind == "previous":
            carried = F.lag(value).over(ordered)
        else:
            carried = F.lead(value).over(ordered)
        made.append(carried.alias(name))
    return summary.select(*keys, _BLOCK, *made)


def _merge(name: str, step: Step) -> Column:
    local, carry = F.col(f"l.`{name}`"), F.col(f"c.`{name}`")
    zero = F.lit(0)
    if step.kind in ("sum", "sum_before"):
        both = F.coalesce(local, zero) + F.coalesce(carry, zero)
        return F.when(local.isNull() & carry.isNull(), local).otherwise(both)
    if step.kind in ("total", "min"):
        return F.coalesce(carry, local)
    if step.kind == "max":
        return F.greatest(local, carry)
    if step.kind in ("last_valid", "next_valid"):
        return F.coalesce(local, carry)
    return F.when(F.col(f"l.`__edge_{name}`").isNotNull(), local).otherwise(carry["v"])
