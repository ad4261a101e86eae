"""Standardisation of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nulls import safe_ratio
from cohortry.operators.joins import attach_aggregate


def _moments(columns: Sequence[str]) -> list:
    return [
        agg(F.col(c).cast("double")).alias(f"__{name}_{c}")
        for c in columns
        for name, agg in (("mean", F.avg), ("sd", F.stddev_samp))
    ]


def zscore(df: DataFrame, columns: Sequence[str], by=None, stats_from: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """``(x - mean) / sample sd``; a column without spread gives NULL.

    Statistics come from the table itself, or from ``stats_from``.  Without groups they
    are one scalar subquery; with groups, an aggregate joined back.
    """
    source = df if stats_from is None else stats_from
    moments = _moments(columns)
    if by is None:
        names = [f"__{m}_{c}" for c in columns for m in ("mean", "sd")]
        stats = source.agg(*moments).select(F.struct(*names)).scalar()
        return df.withColumns(
            {f"{c}{suffix}": safe_ratio(F.col(c) - stats[f"__mean_{c}"], stats[f"__sd_{c}"]) for c in columns}
        )
    keys = [by] if isinstance(by, str) else list(by)
    joined = attach_aggregate(df, source.groupBy(*keys).agg(*moments), keys)
    scaled = joined.withColumns(
        {f"{c}{suffix}": safe_ratio(F.col(c) - F.col(f"__mean_{c}"), F.col(f"__sd_{c}")) for c in columns}
    )
    return scaled.drop(*(f"__{m}_{c}" for c in columns for m in ("mean", "sd")))
