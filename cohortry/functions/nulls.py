"""Expressions whose NULL behaviour follows statistical data frames rather than SQL.

Missing values are SQL ``NULL`` throughout.  The helpers differ from the bare Spark
built-ins in one respect each; the docstring names it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def na_ifelse(condition: Column, when_true, when_false) -> Column:
    """Conditional that yields NULL (not ``when_false``) for a NULL condition."""
    return F.when(condition, as_value(when_true)).when(~condition, as_value(when_false))


def matches(col: ColumnLike, pattern: str, regex: bool = False) -> Column:
    """Substring (or regex) predicate that is false, never NULL, for a NULL text.

    Written as a conjunction (false AND NULL is false), which a scan can take over
    where a ``coalesce`` could not; the same holds for ``in_list``.
    """
    c = as_column(col)
    return c.isNotNull() & (c.rlike(pattern) if regex else c.contains(pattern))


def in_list(col: ColumnLike, values: Iterable) -> Column:
    """Membership in a fixed list; false, never NULL, for a NULL value."""
    c = as_column(col)
    return c.isNotNull() & c.isin(list(values))


def not_in_list(col: ColumnLike, values: Iterable) -> Column:
    return ~in_list(col, values)


def paste_na(*cols: ColumnLike, sep: str = " ") -> Column:
    """Join texts; a NULL part appears as ``NA`` instead of vanishing."""
    return F.concat_ws(sep, *(F.coalesce(as_column(c).cast("string"), F.lit("NA")) for c in cols))


def log2_inf(col: ColumnLike) -> Column:
    """Base-2 logarithm with ``log2(0) = -Infinity`` (Spark alone gives NULL)."""
    c = as_column(col).cast("double")
    return F.when(c == 0, F.lit(float("-inf"))).otherwise(F.log2(c))


def safe_ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Quotient that is NULL for a zero denominator, under ANSI mode too."""
    d = as_column(denominator).cast("double")
    return as_column(numerator).cast("double") / F.when(d != 0, d)


def strict(agg, col: ColumnLike) -> Column:
    """Aggregate that is NULL as soon as one input is NULL (``strict(F.sum, "x")``)."""
    c = as_column(col)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def finite(col: ColumnLike) -> Column:
    """True for numbers other than NaN and the infinities; false for NULL."""
    c = as_column(col).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
