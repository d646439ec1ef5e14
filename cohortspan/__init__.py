"""Cohort payment analytics on Spark DataFrames.

Every table carries one or more scenario key columns, so that a run answers for one model or
for millions of them with the same plan.
"""

from cohortspan.tables import ModelBundle

__all__ = ["ModelBundle"]
