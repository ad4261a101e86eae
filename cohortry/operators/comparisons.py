"""Distribution comparisons between classes: rank tests, box and density summaries, correlation.

All work on histograms (distinct value, class, count), combined before the shuffle, so
cost follows the number of distinct values and heavy ties make the data smaller.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortry.functions.distributions import normal_upper_tail, student_quantile_975, student_two_sided
from cohortry.functions.labels import DEFAULT_CUTPOINTS, significance_label
from cohortry.functions.nulls import as_column, finite, safe_ratio
from cohortry.operators.joins import attach_aggregate, equi_join
from cohortry.operators.ranking import histogram, quantiles, quantiles_of_blocks, running_total, sorted_blocks, value_blocks
from cohortry.session import materialise

BOX_PROBS = (0.25, 0.5, 0.75)
BOX_NAMES = ("q1", "median", "q3")


def _list(x) -> list:
    if x is None:
        return []
    return list(x) if isinstance(x, (list, tuple)) else [x]


EXACT_MAX_PAIRS = 4_000_000  # largest product of two class sizes: 2,000 against 2,000 rows take 16 MB and some seconds


def rank_sum_masses(m: int, r: int) -> np.ndarray:
    """P(U = 0), P(U = 1), ... up to the middle, for tie-free samples of m and r; the rest mirrors it.

    The ways to reach each U are the coefficients of the Gaussian binomial, the product over k = 1..m of
    (1 - q**(r + k)) / (1 - q**k). One array is multiplied and divided by one factor at a time and scaled by
    k / (r + k), so it holds the probabilities for samples of k and r after each step. A coefficient only depends on
    lower ones, which are smaller up to the middle, so nothing cancels there.
    """
    m, r = min(m, r), max(m, r)
    masses = np.zeros(m * r // 2 + 1)
    masses[0] = 1.0
    for k in range(1, m + 1):
        if r + k < len(masses):
            masses[r + k :] -= masses[: -(r + k)].copy()
        padded = np.append(masses, np.zeros(-len(masses) % k)).reshape(-1, k)
        masses = padded.cumsum(axis=0).ravel()[: len(masses)] * (k / (r + k))
    return masses


@F.pandas_udf(DoubleType())
def _exact_upper_tail(u: pd.Series, m: pd.Series, r: pd.Series) -> pd.Series:
    """P(U >= u) of tie-free classes; one evaluation per class."""
    out = []
    for ui, mi, ri in zip(u, m, r):
        if pd.isna(ui):
            out.append(None)
            continue
        masses, least = rank_sum_masses(int(mi), int(ri)), max(0, math.ceil(ui))
        mirrored = int(mi) * int(ri) - least  # U >= least is as likely as U <= mirrored
        out.append(masses[: mirrored + 1].sum() if mirrored < len(masses) else 1.0 - masses[:least].sum())
    return pd.Series(out, dtype="float64")


def _p_value(direction: Column, method: str) -> Column:
    z = F.col("z")
    upper = normal_upper_tail(z)
    lower = normal_upper_tail(-z)
    normal = (
        F.when(direction > 0, upper)
        .when(direction < 0, lower)
        .otherwise(F.least(F.lit(1.0), F.lit(2.0) * F.least(upper, lower)))
    )
    if method == "normal":
        return normal
    # by symmetry P(U <= u) = P(U >= m*r - u), and the smaller tail belongs to the larger of the two
    mirrored = F.col("n") * F.col("n_ref") - F.col("u")
    above = F.when(direction > 0, F.col("u")).when(direction < 0, mirrored).otherwise(F.greatest(F.col("u"), mirrored))
    tied = F.raise_error(F.lit("the exact rank-sum distribution needs samples without ties"))
    large = F.raise_error(F.lit(f"classes with a product of sizes above {EXACT_MAX_PAIRS} need method='normal'"))
    checked = F.when(F.col("__ties") > 0, tied.cast("double")).when(
        F.col("n") * F.col("n_ref") > EXACT_MAX_PAIRS, large.cast("double")
    ).otherwise(above.cast("double"))
    tail = _exact_upper_tail(checked, F.col("n").cast("double"), F.col("n_ref").cast("double"))
    return F.least(F.lit(1.0), F.when(direction == 0, 2.0).otherwise(1.0) * tail)


def rank_sum_of_blocks(
    blocks: DataFrame,
    by: Sequence[str],
    group: str,
    value: str,
    is_ref: Column,
    alternative: Column,
    method: str = "normal",
) -> DataFrame:
    """Rank-sum test of every class against the reference class of its comparison.

    ``blocks`` is the histogram sorted by comparison and value.
    ``U`` of a class needs only the reference rows below and at each of its values; one
    running total over the reference counts serves all classes at once.
    """
    if method not in ("exact", "normal"):
        raise ValueError("method must be 'exact' or 'normal'")
    by = list(by)
    # the direction as a number: a text would rule out hash aggregation below
    direction = F.when(alternative == "greater", F.lit(1)).when(alternative == "less", F.lit(-1)).otherwise(F.lit(0))
    marked = blocks.withColumn("__is_ref", is_ref).withColumn("__alt", direction)
    marked = marked.withColumn("__ref", F.when(F.col("__is_ref"), F.col("n")).otherwise(F.lit(0)))
    run = running_total(marked, value, "__ref", by, "__below", "__equal", "n_ref", unique=False)
    n, ref = F.col("n").cast("double"), F.col("__equal").cast("double")
    joint = n + ref
    classes = run.groupBy(*by, group).agg(
        F.max("__is_ref").alias("__is_ref"),
        F.max("__alt").alias("__alt"),
        F.sum("n").alias("n_rows"),
        F.max("n_ref").alias("n_ref"),
        F.sum(n * (F.col("__below") + ref / 2)).alias("u"),
        F.sum((joint**3 - joint) - (ref**3 - ref)).alias("__extra_ties"),
        F.sum(n**3 - n).alias("__own_ties"),
    )
    # one row per class from here on; each meets the one reference row of its comparison
    classes = materialise(classes)
    reference = classes.where(F.col("__is_ref")).select(*by, F.col("__own_ties").alias("__ref_ties"))
    others = classes.where(~F.col("__is_ref") & (F.col("n_ref") > 0)).withColumnRenamed("n_rows", "n")
    if by:
        met = equi_join(others, reference, by, "inner", null_safe=True)
    else:
        met = others.withColumn("__ref_ties", reference.select("__ref_ties").scalar())
    tests = met.withColumn("__ties", F.col("__ref_ties") + F.col("__extra_ties"))
    m, r = F.col("n").cast("double"), F.col("n_ref").cast("double")
    total = m + r
    variance = m * r / 12 * (total + 1 - F.col("__ties") / (total * (total - 1)))
    centred = F.col("u") - m * r / 2
    correction = F.when(F.col("__alt") != 0, F.col("__alt") * 0.5).otherwise(F.signum(centred) * 0.5)
    return (
        tests.withColumn("z", safe_ratio(centred - correction, F.sqrt(variance)))
        .withColumn("p_value", _p_value(F.col("__alt"), method))
        .select(*by, group, "n", "n_ref", "u", "z", "p_value")
    )


def rank_sum_vs_ref(
    df: DataFrame,
    group: str,
    value: str,
    ref: str,
    alternative: str = "greater",
    by=None,
    method: str = "normal",
    cutpoints=DEFAULT_CUTPOINTS,
) -> DataFrame:
    """Wilcoxon rank-sum test of each class against ``ref`` with its significance label.

    ``greater`` asks whether the class lies above the reference.  ``method='normal'`` is the
    normal approximation with continuity and tie corrections; ``'exact'`` counts all rank
    arrangements and raises on ties and beyond ``EXACT_MAX_PAIRS``, the product of both class
    sizes, which is the memory it takes; nothing switches by itself.
    """
    by = _list(by)
    hist = histogram(df.where(F.col(group).isNotNull()), value, [*by, group])
    tests = rank_sum_of_blocks(
        value_blocks(hist, value, by), by, group, value, F.col(group) == F.lit(ref), F.lit(alternative), method
    )
    return tests.withColumn("label", significance_label("p_value", cutpoints))


def _boxes(quartiles: DataFrame, rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Whiskers beside quartiles, the furthest rows within the fences."""
    spread = F.col("q3") - F.col("q1")
    fences = quartiles.withColumn("__low", F.col("q1") - 1.5 * spread).withColumn("__high", F.col("q3") + 1.5 * spread)
    inside = (
        attach_aggregate(rows.select(*by, value), fences.select(*by, "__low", "__high"), by)
        .where(F.col(value).between(F.col("__low"), F.col("__high")))
        .groupBy(*by)
        .agg(F.min(value).cast("double").alias("__min"), F.max(value).cast("double").alias("__max"))
    )
    joined = equi_join(fences, inside, by, "left", null_safe=True)
    return joined.select(
        *by,
        "n",
        *BOX_NAMES,
        F.least("q1", F.col("__min")).alias("whisker_low"),
        F.greatest("q3", F.col("__max")).alias("whisker_high"),
    )


def box_of_blocks(blocks: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Box-plot numbers per group of a sorted histogram."""
    by = list(by)
    return _boxes(quantiles_of_blocks(blocks, value, BOX_PROBS, by, BOX_NAMES), blocks, by, value)


def box_summary(df: DataFrame, group, value: str) -> DataFrame:
    """n, quartiles and whiskers (furthest value within 1.5 IQR of the box) per class."""
    by = _list(group)
    return _boxes(materialise(quantiles(df, value, BOX_PROBS, by, BOX_NAMES)), df, by, value)


def bandwidth(n: Column, sd: Column, iqr: Column, low: Column) -> Column:
    """Rule-of-thumb kernel bandwidth with its fallbacks for degenerate spreads."""
    spread = F.least(sd, iqr / 1.34)
    fallback = F.when(sd > 0, sd).when(low != 0, F.abs(low)).otherwise(F.lit(1.0))
    return F.lit(0.9) * F.when(spread > 0, spread).otherwise(fallback) * F.pow(n.cast("double"), F.lit(-0.2))


def density_profile(df: DataFrame, group, value: str, n_grid: int = 512, n_bins: int = 512) -> DataFrame:
    """Gaussian kernel density per class on an even grid over the class's data range.

    Values are first shared out linearly over ``n_bins`` even nodes; the weights of a class's
    nodes, one array, are then convolved with the kernel.  Cost per class is nodes times grid
    points, whatever the number of rows, and no row but the result's.  A class with two rows
    or more has exactly ``n_grid`` rows.
    """
    by = _list(group)
    v = F.col(value).cast("double")
    rows = df.where(finite(value)).select(*by, v.alias(value))
    return density_of_blocks(value_blocks(histogram(rows, value, by, "__rows"), value, by), by, value, n_grid, n_bins)


def density_of_blocks(blocks: DataFrame, by: Sequence[str], value: str, n_grid: int = 512, n_bins: int = 512) -> DataFrame:
    """Density per group of a sorted histogram with the counts ``__rows``."""
    by, n = list(by), F.col("__rows").cast("double")
    mean = F.sum(n * F.col(value)) / F.sum(n)
    centred = attach_aggregate(blocks, blocks.groupBy(*by).agg(mean.alias("__mean")), by)
    off = F.col(value) - F.col("__mean")
    moments = centred.groupBy(*by).agg(
        F.sqrt(safe_ratio(F.sum(n * off * off), F.sum(n) - 1)).alias("__sd"),
        F.min(value).alias("__low"),
        F.max(value).alias("__high"),
    )
    spread = quantiles_of_blocks(blocks, value, (0.25, 0.75), by, ("__q1", "__q3"), weight="__rows")
    stats = (
        equi_join(spread, moments, by, "inner", null_safe=True)
        .where(F.col("n") > 1)
        .withColumn("__bw", bandwidth(F.col("n"), F.col("__sd"), F.col("__q3") - F.col("__q1"), F.col("__low")))
    )
    step = (F.col("__high") - F.col("__low")) / F.lit(float(n_grid - 1))
    places = F.sequence(F.lit(0), F.lit(n_grid - 1))

    def kernel(distance: Column) -> Column:
        u = distance / F.col("__bw")
        return F.exp(-u * u / 2)

    # with as many nodes as grid points the kernel depends on the difference of their numbers alone; written, so
    # that it is computed once per class
    shapes = F.transform(places, lambda d: kernel(d * step)) if n_bins == n_grid else F.lit(None)
    stats = materialise(stats.select(*by, "n", "__low", "__high", "__bw", shapes.cast("array<double>").alias("__kernel")))
    width = (F.col("__high") - F.col("__low")) / F.lit(float(n_bins - 1))
    place = F.coalesce(safe_ratio(F.col(value) - F.col("__low"), width), F.lit(0.0))
    node = F.least(F.floor(place), F.lit(n_bins - 2))
    share = place - node
    ranges = stats.select(*by, "__low", "__high", "__bw")
    halves = attach_aggregate(blocks.drop("__block"), ranges, by).where(F.col("__bw").isNotNull()).select(
        *by,
        F.explode(
            F.array(
                F.struct(node.alias("node"), (F.col("__rows") * (1 - share)).alias("weight")),
                F.struct((node + 1).alias("node"), (F.col("__rows") * share).alias("weight")),
            )
        ).alias("h"),
    )
    nodes = halves.groupBy(*by, F.col("h.node").cast("int").alias("node")).agg(F.sum("h.weight").alias("weight"))
    weights = F.array_sort(F.collect_list(F.struct("node", "weight")))  # one per node at most
    classes = equi_join(stats, nodes.where(F.col("weight") > 0).groupBy(*by).agg(weights.alias("__nodes")), by, "inner", null_safe=True)

    def density(point: Column) -> Column:
        def reached(s: Column) -> Column:
            if n_bins == n_grid:
                return F.get("__kernel", F.abs(point - s["node"]))
            return kernel(point * step - s["node"] * width)

        return F.aggregate("__nodes", F.lit(0.0), lambda total, s: total + s["weight"] * reached(s))

    scale = F.col("n") * F.col("__bw") * math.sqrt(2 * math.pi)
    grid = F.transform(
        places,
        lambda i: F.struct(
            i.cast("bigint").alias("point"), (F.col("__low") + i * step).alias("x"), (density(i) / scale).alias("density")
        ),
    )
    return classes.select(*by, F.inline(grid))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with its two-sided p-value, as one row (n, rho, t, p_value).

    Mid-ranks come from histograms, so no row is ranked on its own.
    """
    joint = df.where(finite(x) & finite(y)).groupBy(F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count(F.lit(1)).alias("n"))
    # sorted by y, so y is ranked where it lies; only the margin of x is sorted and joined besides
    blocks = value_blocks(joint, "__y")

    def centred(out: str) -> Column:
        return (F.col("below") + (F.col("equal") + 1) / 2 - (F.col("group_total") + 1) / 2).alias(out)

    by_y = running_total(blocks, "__y", "n", unique=False)
    by_y = by_y.select("__x", "n", centred("__ry"))
    margin = blocks.groupBy("__x").agg(F.sum("n").alias("n"))
    by_x = running_total(value_blocks(margin, "__x"), "__x", "n")
    ranked = by_y.join(by_x.select("__x", centred("__rx")), "__x")
    sums = ranked.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("__rx") * F.col("__ry")).alias("__xy"),
        F.sum(F.col("n") * F.col("__rx") * F.col("__rx")).alias("__xx"),
        F.sum(F.col("n") * F.col("__ry") * F.col("__ry")).alias("__yy"),
    )
    rho = safe_ratio(F.col("__xy"), F.sqrt(F.col("__xx")) * F.sqrt(F.col("__yy")))
    df_left = (F.col("n") - 2).cast("double")
    return (
        sums.withColumn("rho", rho)
        .withColumn("t", safe_ratio(F.col("rho") * F.sqrt(df_left), F.sqrt(1 - F.col("rho") * F.col("rho"))))
        .withColumn("p_value", F.when(df_left > 0, student_two_sided(F.col("t"), df_left)))
        .select("n", "rho", "t", "p_value")
    )


def linear_fit(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    """Least-squares line per group with what its confidence band needs; one aggregation."""
    by = _list(by)
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.where(finite(x) & finite(y))
    fit = both.groupBy(*by).agg(
        F.regr_count(yc, xc).alias("n"),
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_r2(yc, xc).alias("r2"),
        F.regr_avgx(yc, xc).alias("mean_x"),
        F.regr_sxx(yc, xc).alias("sxx"),
        F.regr_syy(yc, xc).alias("syy"),
        F.min(xc).alias("min_x"),
        F.max(xc).alias("max_x"),
    )
    residual = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"))
    return fit.withColumn("sigma", F.when(F.col("n") > 2, F.sqrt(residual / (F.col("n") - 2)))).drop("syy")


def linear_fit_band(df: DataFrame, x: str, y: str, grid: int = 80, by=None) -> DataFrame:
    """The fitted line and its 95 % confidence band on an even grid over the x range."""
    by = _list(by)
    fit = linear_fit(df, x, y, by).withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    )
    at = F.col("min_x") + F.col("point") * (F.col("max_x") - F.col("min_x")) / F.lit(float(grid - 1))
    centre = F.col("intercept") + F.col("slope") * F.col("x")
    distance = F.col("x") - F.col("mean_x")
    half = (
        student_quantile_975(F.col("n") - 2)
        * F.col("sigma")
        * F.sqrt(F.lit(1.0) / F.col("n") + safe_ratio(distance * distance, F.col("sxx")))
    )
    return (
        fit.withColumn("x", at)
        .withColumn("fit", centre)
        .withColumn("__half", half)
        .select(*by, "point", "x", "fit", (F.col("fit") - F.col("__half")).alias("lower"), (F.col("fit") + F.col("__half")).alias("upper"))
    )


@dataclass(frozen=True)
class Comparison:
    """One metric compared between classes within one scope.

    ``rank_by`` names the values that the rank test sorts by, where ``value`` is a rounded
    increasing function of them (a logarithm): the order is the same, without ties that
    only rounding makes.
    """

    metric: str
    value: str
    group: str
    reference: str
    low: float
    high: float
    alternative: str = "greater"
    scope: str = "all"
    scope_filter: Column | None = None
    cutpoints: tuple = DEFAULT_CUTPOINTS
    rank_by: str | None = None


def comparison_histogram(df: DataFrame, comparisons: Sequence[Comparison]) -> DataFrame:
    """All comparisons in one scan: (comparison, metric, scope, class, value, rank, n, is_ref, alternative).

    Each row yields one entry per comparison it takes part in: value inside the range,
    class known, row in scope.  ``comparison`` is the number in the list, so two
    comparisons of one metric and scope stay apart.
    """
    entries = []
    for number, c in enumerate(comparisons):
        v = as_column(c.value).cast("double")
        takes_part = v.between(F.lit(float(c.low)), F.lit(float(c.high))) & F.col(c.group).isNotNull()
        if c.scope_filter is not None:
            takes_part = takes_part & c.scope_filter
        entry = F.struct(
            F.lit(number).alias("comparison"),
            F.lit(c.metric).alias("metric"),
            F.lit(c.scope).alias("scope"),
            F.col(c.group).cast("string").alias("class"),
            v.alias("value"),
            (v if c.rank_by is None else F.col(c.rank_by).cast("double")).alias("rank"),
            (F.col(c.group) == F.lit(c.reference)).alias("is_ref"),
            F.lit(c.alternative).alias("alternative"),
        )
        entries.append(F.when(takes_part, entry))
    long = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    return long.groupBy("comparison", "metric", "scope", "class", "value", "rank", "is_ref", "alternative").agg(
        F.count(F.lit(1)).alias("n")
    )


REPORT_KEYS = ["comparison", "metric", "scope"]


def report_blocks(df: DataFrame, comparisons: Sequence[Comparison]) -> DataFrame:
    """The sorted histogram of all comparisons, from which tests, boxes and densities are taken."""
    order = [F.asc(c) for c in (*REPORT_KEYS, "rank", "value")]
    return sorted_blocks(comparison_histogram(df, comparisons), order).drop("__row")


def association_density(blocks: DataFrame, n_grid: int = 512, n_bins: int = 512) -> DataFrame:
    """Kernel density of every class in every comparison, from the blocks of the report."""
    counted = blocks.drop("rank").withColumnRenamed("n", "__rows")
    return density_of_blocks(counted, [*REPORT_KEYS, "class"], "value", n_grid, n_bins)


def association_report(
    df: DataFrame, comparisons: Sequence[Comparison], method: str = "normal", blocks: DataFrame | None = None
) -> DataFrame:
    """Box summary and rank-sum test of every class in every comparison.

    ``comparison`` numbers the comparisons as listed.  Reference classes appear with their
    box and a NULL test.  ``blocks`` may come from :func:`report_blocks`, so that one sort
    serves the densities as well.
    """
    by = REPORT_KEYS
    # one sort serves the tests (per comparison) and the boxes (per class)
    blocks = report_blocks(df, comparisons) if blocks is None else blocks
    boxes = box_of_blocks(blocks, [*by, "class"], "value")
    tests = rank_sum_of_blocks(
        blocks, by, "class", "rank", F.col("is_ref"), F.col("alternative"), method
    ).drop("n")
    label = F.lit(None).cast("string")
    for cut in {c.cutpoints for c in comparisons}:
        users = [number for number, c in enumerate(comparisons) if c.cutpoints == cut]
        label = F.when(F.col("comparison").isin(users), significance_label("p_value", cut)).otherwise(label)
    return boxes.join(tests, [*by, "class"], "left").withColumn("label", label)
