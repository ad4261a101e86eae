"""Ordered categories as a string column plus an index column, and text labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.nulls import ColumnLike, as_column

# Significance cutpoints and their symbols.
DEFAULT_CUTPOINTS = (
    (0.0001, "****"),
    (0.001, "***"),
    (0.01, "**"),
    (0.05, "*"),
)
SHORT_CUTPOINTS = (
    (0.001, "***"),
    (0.01, "**"),
    (0.05, "*"),
)
NOT_SIGNIFICANT = "ns"


def level_position(col: ColumnLike, levels: Sequence[str]) -> Column:
    """1-based position of the value in ``levels``; NULL for any value not listed."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), as_column(col))
    return F.nullif(position, F.lit(0).cast("bigint")).cast("int")


def reversed_position(col: ColumnLike, levels: Sequence[str]) -> Column:
    return F.lit(len(levels) + 1) - level_position(col, levels)


def as_level(col: ColumnLike, levels: Sequence[str]) -> Column:
    """The value itself when it is one of ``levels``, NULL otherwise."""
    c = as_column(col)
    return F.when(c.isin(list(levels)), c)


def relabel(col: ColumnLike, mapping: Mapping[str, str]) -> Column:
    """Replace whole values; those without an entry stay as they are."""
    c = as_column(col)
    if not mapping:
        return c
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[c], c)


def replace_text(col: ColumnLike, pattern: str, replacement: str) -> Column:
    """Replace every regex match inside the text."""
    return F.regexp_replace(as_column(col), pattern, replacement)


def multiline(col: ColumnLike) -> Column:
    """Presentation form of a class name: one word per line."""
    return F.replace(as_column(col), F.lit(" "), F.lit("\n"))


def without_word(col: ColumnLike, word: str) -> Column:
    """Presentation form of a class name with a leading word (and its blank) removed."""
    return F.replace(as_column(col), F.lit(f"{word} "), F.lit(""))


def significance_label(
    p: ColumnLike, cutpoints: Sequence[tuple[float, str]] = DEFAULT_CUTPOINTS
) -> Column:
    """Symbol of the first cutpoint that is not below ``p``; NULL for a NULL p-value."""
    c = as_column(p)
    label = F.when(c.isNull(), F.lit(None).cast("string"))
    for bound, symbol in sorted(cutpoints):
        label = label.when(c <= bound, F.lit(symbol))
    return label.otherwise(F.lit(NOT_SIGNIFICANT))
