"""Grouped counts, sums and texts.  All combine on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.labels import level_position
from cohortry.functions.nulls import ColumnLike, as_column, in_list, log2_inf, matches, safe_ratio, strict


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def count_by(df: DataFrame, key, where: Column | None = None, out: str = "n") -> DataFrame:
    """Rows per group after a filter; groups without a hit are absent."""
    kept = df if where is None else df.where(where)
    return kept.groupBy(*_keys(key)).agg(F.count(F.lit(1)).alias(out))


def sum_by(
    df: DataFrame, key, value: ColumnLike, where: Column | None = None, out: str = "total", na_strict: bool = True
) -> DataFrame:
    """Sum per group after a filter; NULL for a group holding a NULL unless ``na_strict`` is off."""
    kept = df if where is None else df.where(where)
    total = strict(F.sum, value) if na_strict else F.sum(as_column(value))
    return kept.groupBy(*_keys(key)).agg(total.alias(out))


def category_scores(
    df: DataFrame, key, category: str, value: str, groups: Mapping[str, Sequence[str]], na_strict: bool = False
) -> DataFrame:
    """One named sum per set of categories, all in a single pass.

    Entities with no row in any set are absent; a set an entity lacks is NULL.  With
    ``na_strict``, so is the sum of a set in which a value is NULL.
    """
    wanted = sorted({c for members in groups.values() for c in members})
    sums = []
    for name, members in groups.items():
        inside = F.col(category).isin(list(members))
        total = F.sum(F.when(inside, F.col(value)))
        if na_strict:
            total = F.when(F.count_if(inside & F.col(value).isNull()) == 0, total)
        sums.append(total.alias(name))
    return df.where(F.col(category).isin(wanted)).groupBy(*_keys(key)).agg(*sums)


def event_counts(
    entities: DataFrame,
    events: DataFrame,
    key: str,
    category: str,
    categories: Sequence[str],
    text: str,
    patterns: Mapping[str, str],
) -> DataFrame:
    """Per entity, the number of events in a category set for each text pattern; 0 when none.

    One aggregate over the filtered events serves all patterns and all later rules.
    """
    hits = {name: matches(text, p) for name, p in patterns.items()}
    counts = (
        events.where(in_list(category, categories) & reduce(or_, hits.values()))
        .groupBy(key)
        .agg(*(F.count_if(hit).alias(name) for name, hit in hits.items()))
    )
    return entities.join(counts, key, "left").fillna(0, subset=list(hits))


def first_texts(df: DataFrame, key, value: str, order: ColumnLike) -> DataFrame:
    """(key, text, first): the distinct texts of a group with the order in which they first occur."""
    text = F.coalesce(F.col(value).cast("string"), F.lit("NA"))
    return df.groupBy(*_keys(key), text.alias("text")).agg(F.min(as_column(order)).alias("first"))


def concat_by(
    df: DataFrame, key, value: str, order: ColumnLike, out: str | None = None, sep: str = ","
) -> DataFrame:
    """Distinct texts of a group joined in first-seen order.

    Duplicates collapse on the map side first, so a group gathers its distinct texts only.
    The result is one text per group, so a group's distinct texts must fit one row; keep the
    (group, text, first order) rows of :func:`first_texts` where they may not.
    """
    keys = _keys(key)
    firsts = first_texts(df, keys, value, order).withColumnsRenamed({"text": "__text", "first": "__order"})
    ordered = F.array_sort(F.collect_list(F.struct("__order", "__text")))
    return firsts.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["__text"]), sep).alias(out or value)
    )


def fraction_by(
    numerator: DataFrame,
    denominator: DataFrame,
    numerator_key: str | Sequence[str],
    denominator_key: str | Sequence[str],
    numerator_col: str,
    denominator_col: str,
    out: str = "fraction",
) -> DataFrame:
    """Ratio of two per-group counts whose keys may be named differently; inner join."""
    keys, others = _keys(numerator_key), _keys(denominator_key)
    renamed = [F.col(other).alias(key) for key, other in zip(keys, others, strict=True)]
    return numerator.join(denominator.select(*renamed, denominator_col), keys).select(
        *keys, safe_ratio(numerator_col, denominator_col).alias(out)
    )


def category_counts(df: DataFrame, column: str, levels: Sequence[str] | None = None, out: str = "n") -> DataFrame:
    """Rows per category in level order (NULL last), with the 1-based level position.

    With ``levels``, values outside the list count as NULL.
    """
    if levels is None:
        return df.groupBy(column).agg(F.count(F.lit(1)).alias(out)).orderBy(F.asc_nulls_last(column))
    position = level_position(column, levels)
    return (
        df.select(F.when(position.isNotNull(), F.col(column)).alias(column))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias(out))
        .withColumn("level", position)
        .orderBy(F.asc_nulls_last("level"))
    )


def log_burden(df: DataFrame, total: ColumnLike, out: str = "log2_total") -> DataFrame:
    """Base-2 logarithm of a per-entity total; a zero total gives -Infinity."""
    return df.withColumn(out, log2_inf(total))
