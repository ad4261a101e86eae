"""Projections, positional and pattern-based column handling, row filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from cohortry.functions.nulls import as_column, in_list


def select_renamed(df: DataFrame, columns: Mapping[str, str], **constants) -> DataFrame:
    """Keep ``columns`` (old name -> new name) and add literal columns."""
    kept = [F.col(old).alias(new) for old, new in columns.items()]
    return df.select(*kept, *(F.lit(v).alias(k) for k, v in constants.items()))


def rename_at(df: DataFrame, position: int, name: str) -> DataFrame:
    """Rename the column at a 0-based position."""
    names = list(df.columns)
    names[position] = name
    return df.toDF(*names)


def drop_at(df: DataFrame, position: int) -> DataFrame:
    """Drop the column at a 0-based position."""
    names = list(df.columns)
    del names[position]
    return df.select(*names)


def matching_columns(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def select_matching(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name matches a regex, after the ones in ``keep``."""
    return df.select(*keep, *(c for c in matching_columns(df, pattern) if c not in keep))


def mutate_matching(df: DataFrame, pattern: str, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to every column whose name matches a regex."""
    return df.withColumns({c: fn(F.col(c)) for c in matching_columns(df, pattern)})


def mutate_by_type(
    df: DataFrame, types: type[DataType] | tuple[type[DataType], ...], fn: Callable[[Column], Column]
) -> DataFrame:
    """Apply ``fn`` to every column of the given data types."""
    chosen = [f.name for f in df.schema.fields if isinstance(f.dataType, types)]
    return df.withColumns({c: fn(F.col(c)) for c in chosen}) if chosen else df


def row_total(df: DataFrame, columns: Iterable[str], out: str = "total") -> DataFrame:
    """Sum across columns of one row; NULL when one of them is NULL."""
    return df.withColumn(out, reduce(add, [F.col(c) for c in columns]))


def range_guard(df: DataFrame, column: str | Column, low: float, high: float) -> DataFrame:
    """Keep finite values inside ``[low, high]``."""
    return df.where(as_column(column).between(F.lit(low), F.lit(high)))


def cohort_scope(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Restrict to the rows whose category is in a named scope."""
    return df.where(in_list(column, values))
