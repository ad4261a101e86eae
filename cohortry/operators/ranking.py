"""Global order without a global window: ranks, positions, exact quantiles, sampling.

A window without a partition key, or over one hot group, runs in a single task.  The
operators here sort by range instead, cut the sorted rows into the blocks the sort
already made, and add each block's starting offset.  The blocks are written once, so
block numbers stay the same for every later read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from cohortry.functions.nulls import ColumnLike, as_column
from cohortry.operators.joins import equi_join
from cohortry.session import fits_broadcast, materialise

SKETCH_SIZE = 2048  # entries of a quantile sketch
RANK_ERROR = 0.008  # over three times the error in rank that such a sketch keeps within in 99 of 100 cases
RANK_GRID = 256  # even ranks at which a sketch is read
SMALL_RANGE = 1_000_000  # rows around an order statistic that one task ranks
_BLOCK_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def _list(x) -> list:
    if x is None:
        return []
    return list(x) if isinstance(x, (list, tuple)) else [x]


def row_hash(df: DataFrame) -> Column:
    """A last sort key that lets a range sort split rows whose other keys are equal."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, MapType)))


def sort_nulls_last(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending sort with NULL at the end of every key; a hash of the row splits equal keys over tasks."""
    return df.orderBy(*(F.asc_nulls_last(c) for c in columns), row_hash(df))


def sorted_blocks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Globally sorted rows with ``__block`` and ``__row`` (0-based inside the block)."""
    numbered = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    return materialise(
        numbered.withColumn("__block", F.shiftright("__id", _BLOCK_BITS).cast("int"))
        .withColumn("__row", F.col("__id").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)))
        .drop("__id")
    )


def global_position(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """1-based position of every row in a total order."""
    blocks = sorted_blocks(df, order)
    # one row per sorted partition, so both the window and the broadcast stay small
    before = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        blocks.groupBy("__block")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    return (
        blocks.join(F.broadcast(starts), "__block")
        .withColumn(out, F.col("__start") + F.col("__row") + 1)
        .drop("__block", "__row", "__start")
    )


def value_blocks(hist: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """A histogram sorted by group and value, ready for ``running_total``."""
    return sorted_blocks(hist, [F.asc(c) for c in (*by, value)]).drop("__row")


def running_total(
    blocks: DataFrame,
    value: str,
    weight: str,
    by: Sequence[str] = (),
    out: str = "below",
    out_equal: str = "equal",
    out_total: str = "group_total",
    unique: bool = True,
) -> DataFrame:
    """Weight of the rows of the same group with a smaller, an equal and any value.

    ``blocks`` comes from ``value_blocks`` sorted by these groups or by coarser ones, so
    one sort serves several groupings.  Neither a hot group nor a hot value is held by
    one task: the sort splits a group over blocks, and a value repeats at most once per
    histogram key.  ``unique`` states that a group has one row per value.
    """
    by = list(by)
    totals = blocks.groupBy("__block", *by).agg(F.sum(weight).alias("__weight"))
    # at most one row per block and group
    group = W.partitionBy(*by)
    before = group.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "__block",
        *by,
        F.coalesce(F.sum("__weight").over(before), F.lit(0)).alias("__start"),
        F.sum("__weight").over(group).alias(out_total),
    )
    in_order = W.partitionBy("__block", *by).orderBy(value)
    if unique:
        up_to, equal = in_order.rowsBetween(W.unboundedPreceding, W.currentRow), None
    else:
        up_to = in_order.rangeBetween(W.unboundedPreceding, W.currentRow)
        equal = in_order.rangeBetween(W.currentRow, W.currentRow)  # the rows with this value
    counted = blocks.withColumns(
        {"__up_to": F.sum(weight).over(up_to), out_equal: F.col(weight) if unique else F.sum(weight).over(equal)}
    )
    return (
        equi_join(counted, starts, ["__block", *by], "inner", null_safe=bool(by))
        .withColumn(out, F.col("__start") + F.col("__up_to") - F.col(out_equal))
        .drop("__block", "__start", "__up_to")
    )


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "n") -> DataFrame:
    """Row count per distinct value and group, without NULL and NaN."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(*by, value).agg(F.count(F.lit(1)).alias(out))


def average_rank(df: DataFrame, column: str, by=None, out: str = "rank") -> DataFrame:
    """Mid-rank among the rows of a group: ties share the mean of their ranks; NULL has none."""
    by = _list(by)
    blocks = value_blocks(histogram(df, column, by), column, by)
    run = running_total(blocks, column, "n", by)
    ranks = run.select(*by, column, (F.col("below") + (F.col("equal") + 1) / 2).alias(out))
    # the ranks have as many rows as the blocks they come from
    small = fits_broadcast(blocks)
    return equi_join(df, F.broadcast(ranks) if small else ranks, [*by, column], "left", null_safe=True)


def _targets(place: Column, below: Column, inside: Column) -> list[Column]:
    """An order statistic within known bounds, and narrower bounds proposed by the sketch of the values inside."""
    share = (place - below) / inside
    # a sketch is asked for fixed ranks only, so the bounds are the even ranks around the wanted ones
    grid = F.kll_sketch_get_quantile_double("__sketch", F.array(*(F.lit(g / RANK_GRID) for g in range(RANK_GRID + 1))))
    under = F.greatest(F.floor((share - RANK_ERROR) * RANK_GRID), F.lit(0))
    over = F.least(F.ceil((share + RANK_ERROR) * RANK_GRID), F.lit(RANK_GRID))
    return [
        place.cast("long").alias("place"),
        below.cast("long").alias("below"),
        inside.cast("long").alias("inside"),
        F.col("lo"),
        F.col("hi"),
        F.get(grid, under.cast("int")).alias("lo2"),
        F.get(grid, over.cast("int")).alias("hi2"),
    ]


def _summary() -> list[Column]:
    return [
        F.min("__v").alias("lo"),
        F.max("__v").alias("hi"),
        F.kll_sketch_agg_double("__v", F.lit(SKETCH_SIZE)).alias("__sketch"),
    ]


def _meet(known: DataFrame, targets: DataFrame, by: Sequence[str], bounds: Sequence[str]) -> DataFrame:
    """Every row once per range that holds its value, with the places sought there.

    Targets with equal ``bounds`` share a range; the side that is joined has one row per group.
    """
    ranges = targets.groupBy(*by, *bounds).agg(F.collect_list(F.struct("j", "place")).alias("places"))
    listed = ranges.groupBy(*by).agg(F.collect_list(F.struct(*bounds, "places")).alias("__ranges"))
    if by:
        # targets are a written table, which is measured and not written again
        met = equi_join(known, F.broadcast(listed) if fits_broadcast(targets) else listed, by, "inner", null_safe=True)
    else:
        met = known.withColumn("__ranges", listed.select("__ranges").scalar())
    held = F.filter("__ranges", lambda r: (r["lo"] <= F.col("__v")) & (F.col("__v") <= r["hi"]))
    return met.select(*by, "__v", F.explode(held).alias("r")).select(*by, "__v", "r.*")


def _sought(first: Column, rows: Column) -> Column:
    """The targets among ``places`` that lie in ``rows`` rows from place ``first`` on."""
    found = F.filter("places", lambda t: (t["place"] >= first) & (t["place"] < first + rows))
    return F.explode(found).alias("t")


def _narrowed(known: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same targets within the part of their bounds that one counting pass finds them in."""
    bounds = ("below", "lo", "hi", "lo2", "hi2")
    v, low, high = F.col("__v"), F.col("lo2"), F.col("hi2")
    # the bounds are parts of their own: a value that holds many rows is found at once and never kept inside
    part = F.when(v < low, 0).when(v == low, 1).when(v < high, 2).when(v == high, 3).otherwise(4)
    met = _meet(known, targets, by, bounds).withColumn("__part", part)
    met = met.withColumnsRenamed({"lo": "__lo", "hi": "__hi"})
    key = [*by, "below", "__lo", "__hi", "lo2", "hi2"]
    parts = met.groupBy(*key, "__part").agg(
        F.any_value("places").alias("places"), F.count(F.lit(1)).alias("__n"), *_summary()
    )
    # at most five rows per range
    before = W.partitionBy(*key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("__below", F.col("below") + F.coalesce(F.sum("__n").over(before), F.lit(0)))
    chosen = parts.select(*by, "lo", "hi", "__sketch", "__n", "__below", _sought(F.col("__below"), F.col("__n")))
    return chosen.select(*by, F.col("t.j").alias("j"), *_targets(F.col("t.place"), F.col("__below"), F.col("__n")))


def quantiles(df: DataFrame, column: str, probs: Sequence[float], by=None, names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles per group, linear between order statistics (position ``(n-1)p``).

    Also returns ``n``.  No row is sorted by range or written: a mergeable sketch per group
    proposes bounds around each order statistic, a pass counts the rows below and inside
    them exactly, and passes go on until at most ``SMALL_RANGE`` rows are inside, each
    keeping about a fortieth of a target's rows.  A proposal that misses costs a
    further pass and never the result.  A last pass ranks the histogram of what is left.
    Groups and targets are the only tables written; the rows are read at least twice.
    """
    by = _list(by)
    names = list(names or (f"q{int(round(p * 100))}" for p in probs))
    value = F.col(column).cast("double")
    known = df.where(value.isNotNull() & ~F.isnan(value)).select(*by, value.alias("__v"))
    groups = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *_summary()).where(F.col("n") > 0)
    ends = [end((F.col("n") - 1) * F.lit(float(p))) for p in probs for end in (F.floor, F.ceil)]
    # the ends of the k-th probability are the targets 2 k and 2 k + 1
    ends = F.posexplode(F.array(*(e.cast("long") for e in ends))).alias("j", "__place")
    placed = groups.select(*by, "n", "lo", "hi", "__sketch", ends)
    targets = materialise(placed.select(*by, "j", "n", *_targets(F.col("__place"), F.lit(0), F.col("n"))))
    sizes, targets = targets.where(F.col("j") == 0).select(*by, "n"), targets.drop("n")
    done, wide = [], (F.col("inside") > SMALL_RANGE) & (F.col("lo") < F.col("hi"))
    while True:
        done.append(targets.where(~wide))
        targets = targets.where(wide)
        if targets.isEmpty():
            break
        targets = materialise(_narrowed(known, targets, by))
    found = reduce(DataFrame.unionByName, done)
    open_ranges = found.where(F.col("lo") < F.col("hi"))
    counted = _meet(known, open_ranges, by, ("below", "lo", "hi")).groupBy(*by, "below", "lo", "hi", "__v")
    counted = counted.agg(F.any_value("places").alias("places"), F.count(F.lit(1)).alias("__n"))
    # at most SMALL_RANGE rows per range
    before = W.partitionBy(*by, "below", "lo", "hi").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn("__first", F.col("below") + F.coalesce(F.sum("__n").over(before), F.lit(0)))
    picked = counted.select(*by, "__v", _sought(F.col("__first"), F.col("__n"))).select(*by, F.col("t.j").alias("j"), "__v")
    picked = picked.unionByName(found.where(F.col("lo") >= F.col("hi")).select(*by, "j", F.col("lo").alias("__v")))
    ends = picked.groupBy(*by).agg(
        *(F.max(F.when(F.col("j") == 2 * k + part, F.col("__v"))).alias(f"__{end}_{name}")
          for k, name in enumerate(names) for part, end in enumerate(("lo", "hi")))
    )
    if by:
        ends = equi_join(ends, sizes, by, "inner", null_safe=True)
    else:
        ends = ends.withColumn("n", sizes.scalar())
    return _between(ends, by, probs, names)


def _between(ends: DataFrame, by: Sequence[str], probs, names) -> DataFrame:
    """Quantiles between the order statistics on both sides of their positions."""
    between = {}
    for p, name in zip(probs, names, strict=True):
        position = (F.col("n") - 1) * F.lit(float(p))
        share = position - F.floor(position)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        # equal ends are returned as they are, which also keeps infinite ones
        between[name] = F.when((lo == hi) | (share == 0), lo).otherwise(lo + (hi - lo) * share)
    return ends.withColumns(between).select(*by, "n", *names)


def quantiles_of_blocks(blocks: DataFrame, column: str, probs, by, names, weight: str = "n") -> DataFrame:
    """Quantiles from a sorted histogram."""
    run = running_total(blocks, column, weight, by)
    last = F.col("group_total") - 1
    picks = []
    for p, name in zip(probs, names, strict=True):
        position = last * F.lit(float(p))
        for part, place in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("below") <= place) & (place < F.col("below") + F.col("equal"))
            picks.append(F.max(F.when(here, F.col(column).cast("double"))).alias(f"__{part}_{name}"))
    grouped = run.groupBy(*by).agg(F.max("group_total").alias("n"), *picks)
    return _between(grouped, by, probs, names)


def median_iqr(df: DataFrame, column: str, by=None, na_strict: bool = False) -> DataFrame:
    """``n``, quartiles, median and inter-quartile range.

    With ``na_strict`` a group in which a value is NULL has NULL statistics, beside the count of its known values.
    """
    q = quantiles(df, column, (0.25, 0.5, 0.75), by, ("q1", "median", "q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    if not na_strict:
        return q
    by, statistics = _list(by), ("q1", "median", "q3", "iqr")
    missing = df.groupBy(*by).agg(F.count_if(F.col(column).isNull()).alias("__missing"))
    if by:
        q = equi_join(missing, q, by, "left", null_safe=True)
    else:
        q = q.withColumn("__missing", missing.scalar())
    return q.withColumns({c: F.when(F.col("__missing") == 0, F.col(c)) for c in statistics}).drop("__missing")


def flag_outliers(
    df: DataFrame, column: str, k: float = 1.5, out: str = "is_outlier", cutoff_out: str = "cutoff"
) -> DataFrame:
    """Add the cutoff ``median + k * IQR`` (median, not Q3) and whether the value reaches it."""
    cutoff = median_iqr(df, column).select(F.col("median") + F.lit(k) * F.col("iqr")).scalar()
    return df.withColumn(cutoff_out, cutoff).withColumn(out, F.col(column) >= F.col(cutoff_out))


def sample_order(key: ColumnLike, seed: int | str) -> Column:
    """Repeatable pseudo-random order that depends on seed and key only."""
    return F.md5(F.concat(F.lit(f"{seed}|"), as_column(key).cast("string")))


def sample_n(df: DataFrame, n: int, seed: int | str, key: str, strict: bool = False) -> DataFrame:
    """``n`` rows without replacement; the same rows for any partitioning.

    Sorting with a limit keeps the first ``n`` per partition, then merges those.
    ``strict`` raises when there are too few rows.
    """
    drawn = df.orderBy(sample_order(key, seed), F.col(key)).limit(n)
    if strict:
        available = df.limit(n).count()
        if available < n:
            raise ValueError(f"cannot draw {n} rows, only {available} available")
    return drawn


def score_ranking(df: DataFrame, score: str, key: str, out: str = "position") -> DataFrame:
    """Entities by ascending score, NULL last, with their position (key breaks ties)."""
    return global_position(df, [F.asc_nulls_last(score), F.asc_nulls_last(key)], out)

