"""Transition edges and the projection of cohort shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def progressive_edges(states: str = "states") -> str:
    """SQL for the edges of an ordered state array with fields ``p_prog`` and ``p_death``.

    Each state but the last is kept, left for the next one, or left for death (the last state),
    which absorbs. Two edges may share their ends; they add up.
    """

    def edge(target: str, p: str) -> str:
        return f"named_struct('from_state', i + 1, 'to_state', {target}, 'p', {p})"

    return f"""flatten(transform({states}, (s, i) -> IF(i + 1 < size({states}),
        array({edge("i + 1", "(1D - s.p_prog) * (1D - s.p_death)")},
              {edge("i + 2", "s.p_prog * (1D - s.p_death)")},
              {edge(f"size({states})", "s.p_death")}),
        array({edge("i + 1", "1D")}))))"""


def project_shares(edges: str, count: str, horizon: str) -> str:
    """SQL for ARRAY<ARRAY<DOUBLE>>: share of a cohort by period and state.

    Everybody is in state 1 in period 1; each later period moves the shares along the edges.
    The chain of one treatment is a short array, so the recurrence runs inside its row.

    A one-element ``transform`` binds its value once: the edges, sorted by where they lead, would
    be evaluated again in each period if they were written inside the recurrence.
    """
    start = f"transform(sequence(1, {count}), s -> IF(s = 1, 1D, 0D))"
    arrivals = f"""transform(array({edges}), every ->
        transform(sequence(1, {count}), s -> filter(every, e -> e.to_state = s)))[0]"""
    moved = """transform(inflow, arriving -> aggregate(arriving, 0D,
        (total, e) -> total + get(element_at(done, -1), e.from_state - 1) * e.p))"""
    later = f"""aggregate(sequence(2, greatest({horizon}, 2)), array({start}),
        (done, t) -> array_append(done, {moved}))"""
    return f"""transform(array({arrivals}), inflow ->
        IF({horizon} >= 2, {later}, array({start})))[0]"""


# One knot to the states it stands for. ``o`` runs over the knots of the same chain.
_GIVEN = "filter(knots, o -> o.QoL IS NOT NULL AND o.state <= k.state)"
_LATER = "filter(knots, o -> o.QoL IS NOT NULL AND o.state > k.state)"


def expanded_states(fields: Sequence[str]) -> str:
    """SQL for the states of a chain from its sorted array ``knots``, numbered from 1.

    The same rule as ``expand_knots`` on rows, for chains already gathered in one row: as knots
    are sorted, each sum of periods is a difference of two state numbers. ``fields`` are passed
    on from the knot.
    """
    facts = f"""named_struct(
        'k', k,
        'until', coalesce(get(knots, j + 1).state, k.state + 1),
        'target', coalesce(get(knots, j + 1).QoL, 0D),
        'segment', try_element_at({_GIVEN}, -1),
        'ends', coalesce(get({_LATER}, 0).state, element_at(knots, -1).state + 1))"""
    passed = ", ".join(f"'{f}', f.k.{f}" for f in fields)
    state = f"""named_struct(
        'state', n - knots[0].state + 1,
        'QoL', f.segment.QoL - (f.segment.QoL - f.target)
            * (n - f.segment.state) / (f.ends - f.segment.state),
        {passed})"""
    return f"""flatten(transform(
        filter(transform(knots, (k, j) -> {facts}), f -> f.until > f.k.state),
        f -> transform(sequence(f.k.state, f.until - 1), n -> {state})))"""


def gather_chains(
    states: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    extra: Sequence[Column] = (),
    name: str = "knots",
) -> DataFrame:
    """One row per treatment with its states as an array sorted by state.

    A chain is as long as the states of one treatment, which the horizon bounds, so the array
    is short whatever the number of treatments.
    """
    return states.groupBy(*keys, "treatment").agg(
        F.array_sort(F.collect_list(F.struct("state", *fields))).alias(name), *extra
    )


def transition_edges(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long transition matrix ``(keys, treatment, from_state, to_state, p)``: a row per possible move.

    ``states`` has a row per state (see ``expand_states``).
    """
    rows = gather_chains(states, keys, ["p_prog", "p_death"], name="states")
    edges = rows.select(
        *keys, "treatment", F.expr(f"inline({progressive_edges()})")
    )
    return edges.groupBy(*keys, "treatment", "from_state", "to_state").agg(
        F.sum("p").alias("p")
    )


def state_names(count: int, legacy: bool = False) -> list[str]:
    """Fixed values: ``S1..S(count-1), D``, or in the older model form ``PF, P1.., D``."""
    alive = [f"S{i}" for i in range(1, count)]
    if legacy:
        alive = ["PF", *[f"P{i}" for i in range(1, count - 1)]][: count - 1]
    return [*alive, "D"]


def transition_table(
    edges: DataFrame, keys: Sequence[str], count: int, legacy: bool = False
) -> DataFrame:
    """Edges as one row per state with a column for each of ``state_names``, for chains of ``count``."""
    names = state_names(count, legacy)
    cells = [
        F.coalesce(F.sum(F.when(F.col("to_state") == i, F.col("p"))), F.lit(0.0)).alias(name)
        for i, name in enumerate(names, start=1)
    ]
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("from_state"))
    return (
        edges.groupBy(*keys, "treatment", "from_state")
        .agg(*cells)
        .withColumn("st", label)
        .select(*keys, "treatment", "from_state", "st", *names)
    )
