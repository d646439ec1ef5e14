"""Knots to one row per step, with gaps filled by linear interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.operators.reshape import repeat_rows
from cohortspan.operators.scan import (
    find_cuts,
    following,
    group_total,
    last_valid,
    ordered_scan,
    sum_before,
)


def expand_knots(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    periods: Column | None = None,
    step: str = "step",
    *,
    tasks: int | None = None,
    short_groups: bool = False,
) -> DataFrame:
    """Repeat each knot over its periods and interpolate ``value`` towards the next knot.

    A knot lasts until the next one along ``order[0]`` (the last knot lasts one period), or
    ``periods`` when given. A segment starts at each knot that has a value; knots without one
    belong to the segment before and take its value. Inside a segment of n periods the k-th is
    ``v - (v - next) * (k - 1) / n`` where ``next`` is the value on the row's own next knot, 0
    when that is missing. ``step`` numbers the periods of a group from 1.

    All ordered work is done on knots; the repeated rows are never sorted or shuffled.
    ``short_groups`` states that groups are small by their nature and need no cuts.
    """
    at = order[0]
    cuts = None if short_groups else find_cuts(df, keys, order, tasks)
    seen = ordered_scan(
        df,
        keys,
        order,
        __next_value=following(F.col(value)),
        __next_at=following(F.col(at)),
        __segment=last_valid(F.when(F.col(value).isNotNull(), F.struct(*order))),
        __filled=last_valid(F.col(value)),
        cuts=cuts,
    )
    lasts = F.coalesce(F.col("__next_at") - F.col(at), F.lit(1)) if periods is None else periods
    timed = seen.withColumn("__periods", F.greatest(lasts.cast("int"), F.lit(0)))
    numbered = ordered_scan(
        timed, keys, order, __before=sum_before(F.col("__periods")), cuts=cuts
    )
    placed = ordered_scan(
        numbered,
        [*keys, "__segment"],
        order,
        __inside=sum_before(F.col("__periods")),
        __length=group_total(F.col("__periods")),
        # A segment is part of a group and is cut where the group is.
        cuts=cuts,
        cut_keys=keys,
    )
    repeated = repeat_rows(placed, F.col("__periods"), "__k")
    done = F.col("__inside") + F.col("__k")
    filled, target = F.col("__filled"), F.coalesce(F.col("__next_value"), F.lit(0.0))
    columns = [
        (filled - (filled - target) * done / F.col("__length")).alias(c) if c == value else F.col(c)
        for c in df.columns
        if c != step
    ]
    return repeated.select(
        *columns, (F.col("__before") + F.col("__k") + 1).cast("int").alias(step)
    )


def expand_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State knots to one row per state, numbered 1..N in each treatment."""
    by = [*keys, "treatment"]
    return expand_knots(states, by, ["state"], "QoL", step="state", short_groups=True)


def plan_spans(
    expanded: DataFrame, keys: Sequence[str], span_scope: str = "model"
) -> DataFrame:
    """First and last state of each payment plan, over the model or within each treatment."""
    by = [*keys, "payment"] if span_scope == "model" else [*keys, "treatment", "payment"]
    return expanded.groupBy(*by).agg(
        F.min("state").alias("pstart"), F.max("state").alias("pend")
    )


def state_table(
    states: DataFrame, keys: Sequence[str], span_scope: str = "model"
) -> DataFrame:
    """Expanded states with the span of their payment plan on each row.

    The spans are aggregated and joined back instead of computed in a window, so that a plan
    used by many rows is pre-aggregated and its join can be split.
    """
    expanded = expand_states(states, keys)
    spans = plan_spans(expanded, keys, span_scope)
    by = [c for c in spans.columns if c not in ("payment", "pstart", "pend")]
    same = [F.col(f"e.{k}") == F.col(f"s.{k}") for k in by]
    same.append(F.col("e.payment").eqNullSafe(F.col("s.payment")))
    return (
        expanded.alias("e")
        .join(spans.alias("s"), same, "left")
        .select("e.*", "s.pstart", "s.pend")
    )
