"""Queries binding every operator to the test tables."""

from cohortry.catalog import cohort, features, relational, statistics  # noqa: F401  (registration)
from cohortry.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
