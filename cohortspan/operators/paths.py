"""Operators on observed state sequences (one row per subject and event)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.operators.scan import (
    find_cuts,
    group_min,
    ordered_scan,
    position,
    previous,
    running_max,
)


def absorbed_paths(
    events: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: str,
    absorbing: str,
    **options,
) -> DataFrame:
    """Number the periods of each path and hold it in ``absorbing`` once it was reached."""
    arrived = F.col(state) == absorbing
    walked = ordered_scan(
        events, keys, order, period=position(), __in=running_max(arrived), **options
    )
    held = F.when(F.col("__in"), F.lit(absorbing)).otherwise(F.col(state))
    return walked.withColumn("path_state", held).drop("__in")


def first_hits(paths: DataFrame, keys: Sequence[str], absorbing: str) -> DataFrame:
    """Period in which each path first reaches ``absorbing``, null when it never does."""
    reached = F.when(F.col("path_state") == absorbing, F.col("period"))
    return paths.groupBy(*keys).agg(F.min(reached).alias("first_period"))


def occupancy(paths: DataFrame, period: str, state: str) -> DataFrame:
    """Number of paths by period and state."""
    return paths.groupBy(period, state).agg(F.count(F.lit(1)).alias("population"))


def inflow(
    events: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: str,
    target: str,
    **options,
) -> DataFrame:
    """Arrivals in ``target`` from other states, by period."""
    walked = ordered_scan(
        events, keys, order, period=position(), __from=previous(F.col(state)), **options
    )
    came = F.col("__from").isNotNull() & (F.col("__from") != target) & (F.col(state) == target)
    return walked.groupBy("period").agg(
        F.sum(came.cast("long")).alias("inflow"), F.count(F.lit(1)).alias("population")
    )


def transition_shares(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, **options
) -> DataFrame:
    """Observed ``(from_state, to_state, n, share)`` over all paths."""
    walked = ordered_scan(events, keys, order, from_state=previous(F.col(state)), **options)
    counts = (
        walked.where("from_state IS NOT NULL")
        .groupBy("from_state", F.col(state).alias("to_state"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Counts are few: pairs of state names.
    pairs = counts.groupBy("from_state").agg(
        F.collect_list(F.struct("to_state", "n")).alias("__to"), F.sum("n").alias("__all")
    )
    return pairs.select("from_state", "__all", F.inline("__to")).select(
        "from_state", "to_state", "n", (F.col("n") / F.col("__all")).alias("share")
    )


def weigh_path(paths: DataFrame, weights: DataFrame, state: str, weight: str) -> DataFrame:
    """Add the weight of each row's state; Spark broadcasts the weights when small."""
    return paths.join(weights.select(state, weight), state, "left")


def path_costs(
    paths: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outside: Column,
    schedule: Sequence[float],
    *,
    terminate: bool = True,
    reimburse_period: int = -1,
    **options,
) -> DataFrame:
    """Cost along one observed path per subject.

    ``outside`` is true while the path is out of its first state. The schedule is paid from
    period 1 unless the path leaves before ``reimburse_period``; nothing is paid while outside
    when ``terminate``.
    """
    cuts = find_cuts(paths, keys, order, **options)
    walked = ordered_scan(paths, keys, order, period=position(), cuts=cuts)
    listed = F.array(*[F.lit(float(v)) for v in schedule])
    due = F.coalesce(F.get(listed, (F.col("period") - 1).cast("int")), F.lit(0.0))
    if reimburse_period >= 0:
        left = group_min(F.when(outside, F.col("period")))
        walked = ordered_scan(walked, keys, order, __left=left, cuts=cuts)
        kept = F.col("__left").isNull() | (F.col("__left") >= reimburse_period)
        due = F.when(kept, due).otherwise(F.lit(0.0))
    cost = F.when(outside, F.lit(0.0)).otherwise(due) if terminate else due
    return walked.withColumn("cost", cost).drop("__left")
