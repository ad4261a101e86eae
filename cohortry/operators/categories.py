"""Categories: group sizes, rare ones, custom orders and level positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.labels import as_level, level_position, reversed_position
from cohortry.functions.nulls import na_ifelse
from cohortry.operators.joins import attach_aggregate
from cohortry.operators.ranking import global_position, row_hash


def group_size(df: DataFrame, by: str | Sequence[str], out: str = "cases") -> DataFrame:
    """Attach the size of its group to every row; NULL is a group of its own.

    Counts are combined before the shuffle and joined back, where a window would pull
    each whole group into one task.
    """
    keys = [by] if isinstance(by, str) else list(by)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return attach_aggregate(df, sizes, keys)


def lump_rare(df: DataFrame, column: str, min_n: int = 15, label: str = "Rare Case Cancer", keep_size: str | None = None) -> DataFrame:
    """Rename the categories with fewer than ``min_n`` rows."""
    size = keep_size or "__cases"
    sized = group_size(df, column, size)
    lumped = sized.withColumn(column, na_ifelse(F.col(size) < min_n, label, F.col(column)))
    return lumped if keep_size else lumped.drop(size)


def sort_by_levels(
    df: DataFrame, column: str, levels: Sequence[str], out: str = "level", reverse: bool = False, keep: bool = True
) -> DataFrame:
    """Order rows by a custom category order; unlisted values become NULL and go last.

    A hash of the row as last key spreads a level over several tasks.
    """
    position = reversed_position(column, levels) if reverse else level_position(column, levels)
    leveled = df.withColumn(out, position).withColumn(column, as_level(column, levels))
    ordered = leveled.orderBy(F.asc_nulls_last(out), row_hash(leveled))
    return ordered if keep else ordered.drop(out)


def first_appearance(df: DataFrame, column: str, order: Sequence[str], out: str = "level") -> DataFrame:
    """One row per category with its 1-based place by first appearance in the given order."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("__first"))
    return global_position(firsts, [F.col("__first"), F.col(column)], out).drop("__first")


def level_index(df: DataFrame, column: str, order: Sequence[str], out: str = "level") -> DataFrame:
    """Attach the place of its category by first appearance to every row."""
    return attach_aggregate(df, first_appearance(df, column, order, out), column)
