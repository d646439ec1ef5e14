"""Operators on observed event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.catalog.part_model import read
from cohortspan.catalog.registry import query
from cohortspan.operators import paths
from cohortspan.operators.scan import last_valid, ordered_scan, previous

USER, ORDER = ["user_id"], ["ts", "event_id"]


def _events(spark, sf_dir, *more):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", *more)


@query(
    "locf_events",
    """
    SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS)
               OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled
    FROM events
    """,
)
def locf_events(spark, sf_dir):
    given = F.when(F.col("event_type") != "error", F.col("value"))
    filled = ordered_scan(_events(spark, sf_dir, "value"), USER, ORDER, filled=last_valid(given))
    return filled.select("event_id", "user_id", "filled")


@query(
    "change_points",
    """
    SELECT event_id, user_id FROM events
    QUALIFY (value > 50) <> lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def change_points(spark, sf_dir):
    high = F.col("value") > 50
    walked = ordered_scan(_events(spark, sf_dir, "value"), USER, ORDER, was=previous(high))
    return walked.where(high != F.col("was")).select("event_id", "user_id")


@query(
    "observed_transitions",
    """
    WITH m AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                          AS from_state, event_type AS to_state FROM events),
         c AS (SELECT from_state, to_state, count(*) AS n FROM m
               WHERE from_state IS NOT NULL GROUP BY ALL)
    SELECT from_state, to_state, n,
           round(n / sum(n) OVER (PARTITION BY from_state)::DOUBLE, 6) AS share
    FROM c
    """,
)
def observed_transitions(spark, sf_dir):
    shares = paths.transition_shares(_events(spark, sf_dir), USER, ORDER, "event_type")
    return shares.withColumn("share", F.round("share", 6))


_WALK = """
    WITH p AS (SELECT *, row_number() OVER w AS period,
                      coalesce(lag(event_type) OVER w <> 'purchase', false)
                          AND event_type = 'purchase' AS came,
                      bool_or(event_type = 'signup') OVER (w ROWS UNBOUNDED PRECEDING) AS held
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         q AS (SELECT *, CASE WHEN held THEN 'signup' ELSE event_type END AS path_state FROM p)
"""


@query(
    "occupancy_inflow",
    _WALK
    + """SELECT period, count(*) FILTER (WHERE came) AS inflow, count(*) AS population
         FROM p GROUP BY period""",
)
def occupancy_inflow(spark, sf_dir):
    return paths.inflow(_events(spark, sf_dir), USER, ORDER, "event_type", "purchase")


def _absorbed(spark, sf_dir):
    return paths.absorbed_paths(_events(spark, sf_dir), USER, ORDER, "event_type", "signup")


@query("absorbed_paths", _WALK + "SELECT event_id, user_id, period, path_state FROM q")
def absorbed_paths(spark, sf_dir):
    return _absorbed(spark, sf_dir).select("event_id", "user_id", "period", "path_state")


@query(
    "absorbed_occupancy",
    _WALK + "SELECT period, path_state, count(*) AS population FROM q GROUP BY ALL",
)
def absorbed_occupancy(spark, sf_dir):
    return paths.occupancy(_absorbed(spark, sf_dir), "period", "path_state")


@query(
    "first_hits",
    _WALK
    + """SELECT user_id, min(period) FILTER (WHERE path_state = 'signup') AS first_period
         FROM q GROUP BY user_id""",
)
def first_hits(spark, sf_dir):
    return paths.first_hits(_absorbed(spark, sf_dir), USER, "signup")


@query(
    "weighted_paths",
    _WALK
    + """, u AS (SELECT event_type AS path_state, avg(value) AS weight FROM events GROUP BY ALL)
         SELECT event_id, round(weight, 6) AS weight FROM q LEFT JOIN u USING (path_state)""",
)
def weighted_paths(spark, sf_dir):
    weights = (
        read(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("path_state"))
        .agg(F.avg("value").alias("weight"))
    )
    weighed = paths.weigh_path(_absorbed(spark, sf_dir), weights, "path_state", "weight")
    return weighed.select("event_id", F.round("weight", 6).alias("weight"))


@query(
    "path_costs",
    _WALK
    + """, f AS (SELECT user_id, min(period) FILTER (WHERE event_type = 'purchase') AS left_at
                 FROM p GROUP BY user_id)
         SELECT event_id, CASE WHEN event_type = 'purchase' OR left_at < 3 THEN 0e0
                               ELSE coalesce([8e0, 4e0, 2e0, 1e0][period], 0e0) END AS cost
         FROM p JOIN f USING (user_id)""",
)
def path_costs(spark, sf_dir):
    costs = paths.path_costs(
        _events(spark, sf_dir),
        USER,
        ORDER,
        F.col("event_type") == "purchase",
        [8, 4, 2, 1],
        reimburse_period=3,
    )
    return costs.select("event_id", "cost")
