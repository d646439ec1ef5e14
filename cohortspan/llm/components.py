"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import stored


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``links`` (a, b: long).

    Alternates large-star and small-star steps (Kiveris et al., 2014): each node sends its
    neighbours to the smallest one it knows, until every link leads from a node to the smallest of
    its component. A round halves long chains or better. Smallest neighbours are pre-aggregated and
    met in an equi-join, so a node with very many links is not gathered; each round is written to
    the shared folder and read back, which cuts the lineage. Only counts go to the
    driver.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links = stored(links, name)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = _sent(both.where("b > a"), least)
        least = large.groupBy("b").agg(F.min("a").alias("low")).select(F.col("b").alias("a"), "low")
        # small star: a node's smaller neighbours, and itself, go to the smallest of them
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        small = _sent(down, least).unionByName(least.select(F.col("low").alias("a"), F.col("a").alias("b")))
        after = stored(small.where("a < b").distinct(), name)
        settled = after.count() == links.count() and after.join(links, ["a", "b"], "left_anti").isEmpty()
        links = after
        if settled:
            break
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)


def _sent(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each (a, b) as (smallest neighbour of a, b)."""
    to = least.select("a", "low", F.xxhash64("a").alias("split"))
    sent = links.withColumn("split", F.xxhash64("a")).join(to, ["a", "split"])
    return sent.select(F.least("low", "b").alias("a"), F.greatest("low", "b").alias("b"))
