"""Unions, duplicates and paired cohorts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def union_fill(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column missing on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def distinct_entities(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The unique ids of an event table."""
    return df.select(*([key] if isinstance(key, str) else key)).distinct()


def two_cohort_union(
    case: DataFrame,
    control: DataFrame,
    fn: Callable[[DataFrame], DataFrame] | None = None,
    tag: str = "cohort",
    names: tuple[str, str] = ("case", "control"),
) -> DataFrame:
    """Tag and stack both cohorts, then apply one transform to the stack.

    A grouped ``fn`` keeps the cohorts apart by including ``tag`` in its key.
    """
    stacked = union_by_name(
        case.withColumn(tag, F.lit(names[0])), control.withColumn(tag, F.lit(names[1]))
    )
    return fn(stacked) if fn else stacked
