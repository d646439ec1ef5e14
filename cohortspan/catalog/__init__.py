"""Registered queries: each is a Spark query over the given tables and its SQL twin."""

from cohortspan.catalog import (
    cohort_queries,
    contract_queries,
    io_queries,
    mixed_queries,
    path_queries,
    table_queries,
)
from cohortspan.catalog.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "cohort_queries",
    "contract_queries",
    "io_queries",
    "mixed_queries",
    "path_queries",
    "table_queries",
]
