"""Cross-validated sparse classifier: labelled draw, lasso path, scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nulls import finite
from cohortry.operators.joins import anti_join
from cohortry.operators.ranking import global_position, sample_n, sample_order, score_ranking
from cohortry.operators.scaling import zscore
from cohortry.operators.sets import union_fill
from cohortry.session import fits_broadcast, materialise

VALUES_PER_PARTITION = 1 << 20  # numbers of the training table that a task holds
ROWS_AT_ONCE = 1024  # rows x problems is the largest array of a gradient pass
TOLERANCE = 1e-4  # largest optimality residual of a finished problem, as a share of its penalty
END_RATIO = 1e-4  # the last penalty of a path as a share of the first
SMALLEST_STEP = 2.0**-40  # of a round's step; below it no decrease is left to be found
DAMPING = 0.01  # share of the local curvature that keeps partitions near the common point


def labelled_sample(
    df: DataFrame,
    key: str,
    class_col: str,
    positive: str,
    negative: str,
    features: Sequence[str],
    n_pos: int = 22,
    n_neg: int = 100,
    seed: int | str = 12345,
    label: str = "label",
    strict: bool = True,
    scale: bool = True,
) -> DataFrame:
    """Seeded draw from both classes, labelled 1 and 0, with (scaled) features attached.

    The draw reads key and class only and has at most ``n_pos + n_neg`` rows, so it is
    the side to broadcast.  ``strict`` raises when a class has too few rows.
    """
    wanted = ((positive, n_pos, 1), (negative, n_neg, 0))
    drawn = materialise(
        union_fill(
            *(
                sample_n(df.where(F.col(class_col) == name).select(key), n, seed, key).withColumn(label, F.lit(value))
                for name, n, value in wanted
            )
        )
    )
    if strict:
        sizes = {row[label]: row["count"] for row in drawn.groupBy(label).count().collect()}
        for name, n, value in wanted:
            if sizes.get(value, 0) < n:
                raise ValueError(f"cannot draw {n} rows of {name!r}, only {sizes.get(value, 0)} available")
    # drawn keys exist in ``df``, so this inner join equals the left join of the draw
    side = F.broadcast(drawn) if fits_broadcast(drawn) else drawn
    sample = df.select(key, *features).join(side, key).select(key, label, *features)
    sample = materialise(sample)
    return zscore(sample, list(features)) if scale else sample


def feature_vector(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Numeric columns as one ML vector; rows with a missing feature are dropped."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip").transform(df)


def lambda_path(
    df: DataFrame, features: Sequence[str], label: str, n_lambda: int = 100, end_ratio: float = END_RATIO
) -> list[float]:
    """Log-spaced penalties from the smallest one that zeroes every coefficient downwards.

    ``lambda_max = max_j |x_j . (y - mean(y))| / n`` on columns scaled with the n-denominator deviation.
    ``end_ratio`` is the last penalty as a share of the first.
    """
    y = F.col(label).cast("double")
    complete = df.dropna(subset=[label, *features])
    # covariance over deviation equals the wanted inner product
    tops = [F.abs(F.covar_pop(F.col(f), y)) / F.nullif(F.stddev_pop(f), F.lit(0.0)) for f in features]
    row = complete.agg(F.array_max(F.array(*tops)).alias("top")).first()
    if not row["top"]:
        raise ValueError("no feature varies together with the label")
    return _path_from(row["top"], n_lambda, end_ratio)


def _path_from(top: float, n_lambda: int, end_ratio: float) -> list[float]:
    if n_lambda == 1:
        return [top]
    return [top * math.exp(math.log(end_ratio) * i / (n_lambda - 1)) for i in range(n_lambda)]


@dataclass(frozen=True)
class Certificate:
    """How far a fit can be from the optimum of its problem at most, on the scale of the mean negative log-likelihood."""

    held_out: int  # the fold left out, -1 for none
    penalty: float
    objective: float
    gap: float  # objective minus that of a feasible point of the dual problem


@dataclass(frozen=True)
class LassoFit:
    """Path and choice of a cross-validated lasso; coefficients are on the feature scale given."""

    features: tuple[str, ...]
    lambdas: tuple[float, ...]
    deviances: tuple[float, ...]
    lambda_min: float
    intercept: float
    coefficients: tuple[float, ...]
    certificates: tuple[Certificate, ...] = ()


def _summing(betas: np.ndarray, held_out: np.ndarray, scales: np.ndarray | None):
    """The task function of one pass; a closure, so workers need no copy of this package."""

    def sums_per_problem(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of every (held-out fold, penalty) problem over one partition, as many as there are features."""
        total = None
        slices = (batch.iloc[i : i + ROWS_AT_ONCE] for batch in batches for i in range(0, len(batch), ROWS_AT_ONCE))
        for batch in slices:
            x = np.column_stack([np.ones(len(batch)), *(batch[c] for c in batch.columns[2:])])
            y = batch["label"].to_numpy()[:, None]
            used = batch["fold"].to_numpy()[:, None] != held_out[None, :]
            margin = x @ betas.T
            loss = np.logaddexp(0.0, margin) - y * margin
            p = np.exp(-np.logaddexp(0.0, -margin))
            if scales is None:
                parts = [(y * (1 - p) * used).T @ x, ((1 - y) * -p * used).T @ x]
                parts.append(np.column_stack([used.sum(0), (2 * loss * used).sum(0), (2 * loss * ~used).sum(0)]))
            else:
                u = np.where(y == 1, scales[:, 0] * np.exp(-np.logaddexp(0.0, margin)), scales[:, 1] * p)
                entropy = -u * np.log(np.maximum(u, 1e-300)) - (1 - u) * np.log1p(-np.minimum(u, 1 - 1e-16))
                parts = [(entropy * used).sum(0)[:, None]]
            sums = np.hstack(parts)
            total = sums if total is None else total + sums
        if total is not None:
            yield pd.DataFrame({"problem": np.arange(len(total)), "sums": list(total)})

    return sums_per_problem


def problem_sums(table: DataFrame, betas: Sequence[Sequence[float]], held_out: Sequence[int]) -> DataFrame:
    """(held_out, n, gradient, positive_gradient, deviance, held_deviance) of problems with one held-out fold each.

    ``table`` has label, fold and the features; each beta starts with the intercept.  The positive gradient is that
    of the rows with label 1; the last two columns are of the rows used and held out.
    """
    width = len(betas[0])
    matrix = _one_pass(table, np.array(betas, dtype=float), np.array(held_out))
    rows = [
        (int(h), float(r[-3]), (r[:width] + r[width : 2 * width]).tolist(), r[:width].tolist(), float(r[-2]), float(r[-1]))
        for h, r in zip(held_out, matrix, strict=True)
    ]
    schema = "held_out int, n double, gradient array<double>, positive_gradient array<double>, deviance double, held_deviance double"
    return table.sparkSession.createDataFrame(rows, schema)


def _added_up(table: DataFrame, task, count: int, width: int) -> np.ndarray:
    """Run a task function that yields (problem, sums) over the table: a (problem x width) matrix of totals."""
    partial = table.mapInPandas(task, "problem int, sums array<double>")
    partial = partial.groupBy("problem").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    rows = partial.toArrow()
    out = np.zeros((count, width))
    sums = rows["sums"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    np.add.at(out, rows["problem"].to_numpy(), sums)
    return out


def _one_pass(table: DataFrame, betas: np.ndarray, held_out: np.ndarray) -> np.ndarray:
    """Gradients of the rows with label 1 and 0, rows, deviance and held-out deviance of all problems, in one scan."""
    return _added_up(table, _summing(betas, held_out, None), len(betas), 2 * betas.shape[1] + 3)


def _solving(start, gradient, penalty, held_out, step, damping: float, tolerance: float):
    """The task function of a round: each partition minimises its own loss, bent to the common gradient.

    A partition's loss gets a linear term that makes its gradient at ``start`` the one over all rows, and with
    ``damping`` a quadratic one around it. Any weighted mean of the partitions' solutions is then a direction in which
    the common objective falls, and with a single partition it is the solution. The problems of a held-out fold are
    solved along the path: each starts from the one before and first works on the features that the sequential strong
    rule keeps; those left out that violate the optimality conditions come back.
    """

    def quadratic_lasso(h, r, lam, b):
        """Minimise b.h.b / 2 - r.b + lam.|b| exactly, from a point whose signs are mostly right.

        With the signs of the non-zero places fixed this is a linear system. Where its solution changes a sign, the
        best of the points at which a place reaches zero is taken; a place at zero whose gradient exceeds its penalty
        joins. The objective falls with every step, so no set of signs comes back.
        """
        sign, free, least = np.sign(b), lam == 0, np.inf
        finite_lam = np.where(np.isinf(lam), 0.0, lam)
        while True:
            while (on := np.flatnonzero((sign != 0) | free)).size:
                target = np.linalg.solve(h[np.ix_(on, on)], r[on] - np.where(free[on], 0.0, lam[on] * sign[on]))
                if (free[on] | (np.sign(target) == sign[on])).all():
                    b = np.zeros_like(b)
                    b[on] = target
                    break
                crossing = ~free[on] & (target * sign[on] <= 0)
                ends = np.append(b[on][crossing] / (b[on][crossing] - target[crossing]), 1.0)
                points = np.repeat(b[None], len(ends), axis=0)
                points[:, on] += ends[:, None] * (target - b[on])
                for at, place in enumerate(on[crossing]):
                    points[at, place] = 0.0
                cost = (points @ h * points).sum(1) / 2 - points @ r + np.abs(points) @ finite_lam
                b = points[np.argmin(cost)]
                if (np.where(free, 0.0, np.sign(b)) == np.where(free, 0.0, sign)).all():
                    break  # rounding: the signs cannot be improved
                sign = np.sign(b)
            slope = r - h @ b
            reached = -(slope + r) @ b / 2 + np.abs(b) @ finite_lam
            if reached >= least:  # rounding hides any further fall
                return b
            least = reached
            excess = np.where((b == 0) & ~free, np.abs(slope) - lam, -np.inf)
            joins = int(np.argmax(excess))
            if excess[joins] <= 1e-12 * max(1.0, abs(slope[joins])):
                return b
            sign[joins] = np.sign(slope[joins])

    def penalised_step(beta, slope, curvature, penalty):
        """Minimise the local quadratic plus the L1 penalty, for some problems."""
        return np.array([
            quadratic_lasso(h, h @ b + g, lam, b) for b, g, h, lam in zip(beta, slope, curvature, penalty, strict=True)
        ])

    def residual(beta, slope, penalty):
        active = np.abs(slope - penalty * np.sign(beta))
        idle = np.maximum(np.abs(slope) - penalty, 0.0)
        return np.where((beta != 0) | (penalty == 0), active, idle)

    def solve(x, y, used, n, centre, bend, damp, beta, lam, kept):
        """All problems of one step; ``kept`` marks the features that the strong rule keeps."""
        width = x.shape[1]

        def objective(b, k):
            margin = x @ b.T
            loss = ((np.logaddexp(0.0, margin) - y * margin) * used[:, k]).sum(0) / n[k]
            away = b - centre[k]
            return loss + (bend[k] * b).sum(1) + (damp[k, None] * away * away).sum(1) / 2 + (lam[k] * np.abs(b)).sum(1)

        bound = np.where(lam > 0, lam, np.inf).min(axis=1)
        open_, value = np.arange(len(beta)), None
        value = objective(beta, open_)
        slopes = np.zeros_like(beta)
        while len(open_):
            margin = x @ beta[open_].T
            p = np.exp(-np.logaddexp(0.0, -margin))
            slope = ((y - p) * used[:, open_]).T @ x / n[open_, None]
            slope -= bend[open_] + damp[open_, None] * (beta[open_] - centre[open_])
            slopes[open_] = slope
            off = residual(beta[open_], slope, lam[open_])
            limit = tolerance * bound[open_]
            inside = np.where(kept[open_], off, 0.0).max(axis=1) <= limit
            kept[open_] |= inside[:, None] & (off > limit[:, None])  # violators come back
            go_on = off.max(axis=1) > limit
            open_, slope, p = open_[go_on], slope[go_on], p[:, go_on]
            if not len(open_):
                break
            columns = np.flatnonzero(kept[open_].any(axis=0))
            part = x[:, columns]
            curvature = np.empty((len(open_), len(columns), len(columns)))
            for at, k in enumerate(open_):
                weight = np.maximum(p[:, at] * (1 - p[:, at]), 1e-10) * used[:, k]
                curvature[at] = (part * weight[:, None]).T @ part / n[k]
            diagonal = np.maximum(curvature[:, range(len(columns)), range(len(columns))], 1e-12)
            ridge = 1e-9 * diagonal + damp[open_, None]
            curvature[:, range(len(columns)), range(len(columns))] = diagonal + ridge
            barred = np.where(kept[open_][:, columns], lam[open_][:, columns], np.inf)
            direction = np.zeros((len(open_), width))
            new = penalised_step(beta[open_][:, columns], slope[:, columns], curvature, barred)
            direction[:, columns] = new - beta[open_][:, columns]
            gain = lam[open_] * (np.abs(beta[open_] + direction) - np.abs(beta[open_]))
            promised = (gain - slope * direction).sum(1)
            share, left = np.ones(len(open_)), np.arange(len(open_))
            while len(left):
                trial = beta[open_[left]] + share[left, None] * direction[left]
                found = objective(trial, open_[left])
                floor = 1e-15 * np.abs(value[open_[left]])
                good = found <= value[open_[left]] + 1e-4 * share[left] * promised[left] + floor
                beta[open_[left[good]]], value[open_[left[good]]] = trial[good], found[good]
                left = left[~good]
                share[left] /= 2
                left = left[share[left] >= 2.0**-40]
            stuck = (share < 2.0**-40) | (np.abs(direction).max(axis=1) == 0)
            open_ = open_[~stuck]  # as far as these rows can tell
        return beta, slopes

    def solved_per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        table = pd.concat(frames)
        x = np.column_stack([np.ones(len(table)), *(table[c] for c in table.columns[2:])])
        y, fold = table["label"].to_numpy()[:, None], table["fold"].to_numpy()
        numbers, weights, solutions = [], [], []
        before = {}  # held-out fold -> solution, slope and penalties of the step before
        for k in np.unique(step):
            chosen = np.flatnonzero(step == k)
            used = fold[:, None] != held_out[chosen][None, :]
            n = used.sum(0)
            chosen, used, n = chosen[n > 0], used[:, n > 0], n[n > 0]
            if not len(chosen):
                continue
            centre, lam = start[chosen], penalty[chosen]
            p = np.exp(-np.logaddexp(0.0, -(x @ centre.T)))
            own = ((y - p) * used).T @ x / n[:, None]
            bend = own - gradient[chosen]
            diagonal = ((p * (1 - p) * used).T @ (x * x)).mean(axis=1) / n
            damp = damping * diagonal
            beta, kept = centre.copy(), np.ones_like(centre, dtype=bool)
            for at, number in enumerate(chosen):
                earlier = before.get(held_out[number])
                if earlier is not None:
                    solution, slope, above = earlier
                    kept[at] = (np.abs(slope) >= 2 * lam[at] - above) | (solution != 0) | (lam[at] == 0)
                    if not start[number, 1:].any():  # nothing is known of this problem yet
                        beta[at] = solution
                kept[at] |= beta[at] != 0
            beta, slopes = solve(x, y, used, n, centre, bend, damp, beta, lam, kept)
            for at, number in enumerate(chosen):
                before[held_out[number]] = (beta[at], slopes[at], lam[at])
            numbers += chosen.tolist()
            weights += n.tolist()
            solutions += beta.tolist()
        sums = [[w, *(w * v for v in b)] for w, b in zip(weights, solutions, strict=True)]
        yield pd.DataFrame({"problem": np.array(numbers, dtype=np.int32), "sums": sums})

    return solved_per_partition


def _directions(table: DataFrame, start, gradient, penalty, held_out, step, partitions: int, tolerance: float) -> np.ndarray:
    """Where the partitions' solutions lie on average, seen from ``start``."""
    # a lone partition holds the whole problem, so its solution needs no damping and can be taken further
    damping, share = (0.0, 1e-2) if partitions == 1 else (DAMPING, 1e-1)
    task = _solving(start, gradient, penalty, held_out, step, damping, share * tolerance)
    sums = _added_up(table, task, len(start), start.shape[1] + 1)
    return sums[:, 1:] / np.maximum(sums[:, :1], 1.0) - start


def optimality_residual(beta, gradient, penalty) -> np.ndarray:
    """Per problem, the largest violation of the lasso's optimality conditions.

    ``gradient`` is that of the mean log-likelihood.  It equals the signed penalty where a
    coefficient is not zero and does not exceed the penalty elsewhere.
    """
    active = np.abs(gradient - penalty * np.sign(beta))
    idle = np.maximum(np.abs(gradient) - penalty, 0.0)
    return np.where((beta != 0) | (penalty == 0), active, idle).max(axis=1)


def _solve(table: DataFrame, start, penalty, held_out, step, tolerance: float, partitions: int):
    """Solve all problems together; returns coefficients, held-out deviances and certificates.

    A round takes two scans: one in which the partitions solve their own problems, one that adds up the gradients of
    what they agree on. A step is halved until the objective falls as its slope promises, and a problem leaves the
    rounds once its optimality residual meets the tolerance; when a step cannot be shortened any more before that, an
    error is raised. A last scan adds up the objective of a dual point of every problem.
    """
    count, width = start.shape
    best, value, slope = start.copy(), np.full(count, np.inf), np.zeros(count)
    direction, share = np.zeros_like(start), np.ones(count)
    trial, held, sides = start.copy(), np.zeros(count), np.zeros((count, 2, width))
    rows = np.ones(count)
    open_ = np.arange(count)
    while len(open_):
        sums = _one_pass(table, trial[open_], held_out[open_])
        n = sums[:, -3]
        objective = sums[:, -2] / (2 * n) + (penalty[open_] * np.abs(trial[open_])).sum(1)
        promised = value[open_] + 1e-4 * share[open_] * slope[open_]
        decreased = np.where(np.isinf(value[open_]), True, objective <= promised + 1e-15 * np.abs(value[open_]))
        good, bad = open_[decreased], open_[~decreased]
        best[good], value[good], held[good] = trial[good], objective[decreased], sums[decreased, -1]
        rows[good] = n[decreased]
        sides[good] = sums[decreased, : 2 * width].reshape(-1, 2, width) / n[decreased, None, None]
        gradient = sides[good].sum(axis=1)
        bound = np.where(penalty[good] > 0, penalty[good], np.inf).min(axis=1)
        unfinished = optimality_residual(best[good], gradient, penalty[good]) > tolerance * bound
        go_on = good[unfinished]
        if len(go_on):
            gradient = gradient[unfinished]
            direction[go_on] = _directions(
                table, best[go_on], gradient, penalty[go_on], held_out[go_on], step[go_on], partitions, tolerance
            )
            gain = penalty[go_on] * (np.abs(best[go_on] + direction[go_on]) - np.abs(best[go_on]))
            slope[go_on] = (gain - gradient * direction[go_on]).sum(1)
            share[go_on] = 1.0
        share[bad] /= 2
        if len(bad) and share[bad].min() < SMALLEST_STEP:
            raise ArithmeticError(
                "the lasso stalls before it meets its optimality conditions; scale the features or end the path earlier"
            )
        open_ = np.sort(np.concatenate([go_on, bad]))
        trial[open_] = best[open_] + share[open_, None] * direction[open_]
    scales = _dual_scales(sides, penalty)
    dual = _added_up(table, _summing(best, held_out, scales), count, 1)[:, 0] / rows
    return best, held, value, value - dual


def _dual_scales(sides: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Factors for the residuals of the rows with label 1 and 0 that make them a feasible point of the dual problem.

    The residuals then add up to zero, as the intercept asks, and no feature's product with them exceeds its penalty.
    """
    positive, negative = sides[:, 0, 0], -sides[:, 1, 0]
    ratio = np.divide(negative, positive, out=np.ones_like(positive), where=positive > 0)
    scales = np.column_stack([np.minimum(1.0, ratio), np.minimum(1.0, np.divide(1.0, ratio, out=np.ones_like(ratio), where=ratio > 0))])
    products = np.abs((scales[:, :, None] * sides).sum(axis=1))[:, 1:]
    room = np.divide(penalty[:, 1:], products, out=np.full_like(products, np.inf), where=products > 0)
    return scales * np.minimum(1.0, room.min(axis=1))[:, None]


def fold_of(key: str, seed: int, folds: int) -> Column:
    """A fold by hash alone: the first 32 bits of an MD5 over seed and key, modulo ``folds``."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(folds))


def balanced_folds(
    df: DataFrame, label: str, folds: int, seed: int = 12345, key: str | None = None, out: str = "fold"
) -> DataFrame:
    """Add a fold from 0: rows are dealt in turn, class by class, in the order of a hash of seed and key.

    The sizes of the folds differ by one row at most, and so do those of a class in them; a class with as many rows as
    folds is in each. Without a key the order is drawn. The order comes from a sort by range, so no class is held by
    one task.
    """
    shuffled = sample_order(key, seed) if key else F.rand(seed)
    marked = df.withColumn("__shuffled", shuffled)
    order = [F.asc(label), F.asc("__shuffled"), *([F.asc(key)] if key else [])]
    placed = global_position(marked, order, "__position")
    return placed.withColumn(out, ((F.col("__position") - 1) % folds).cast("int")).drop("__shuffled", "__position")


def _training_table(df: DataFrame, names: Sequence[str], label: str, fold: str | None) -> DataFrame:
    """(label, fold, x0, x1, ...) of the complete rows."""
    complete = df.where(F.col(label).isNotNull())
    for f in names:
        complete = complete.where(finite(f))
    return complete.select(
        F.col(label).cast("double").alias("label"),
        (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
        *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(names)),
    )


def _fit(table: DataFrame, names, lambdas, n_lambda, end_ratio, held, tolerance: float) -> LassoFit:
    """Solve the problems of the whole table and of every fold in ``held`` left out, for all penalties."""
    xs = [f"x{i}" for i in range(len(names))]
    places = range(len(xs))
    # moments of each fold, for standardising: merged from means and variances, as raw sums would cancel
    moments = [F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")]
    moments += [
        g.alias(f"{n}{i}")
        for i, x in enumerate(xs)
        for n, g in (("m", F.avg(x)), ("v", F.var_pop(x)), ("c", F.covar_pop(F.col(x), F.col("label"))))
    ]
    per_fold = table.groupBy("fold").agg(*moments).toPandas().set_index("fold")

    def merged(parts: pd.DataFrame):
        """Rows, positives, means, deviations and covariances with the label of several folds together."""
        n = parts["n"].to_numpy(dtype=float)
        means, variances, covariances = (parts[[f"{c}{i}" for i in places]].to_numpy() for c in "mvc")
        mean = (n[:, None] * means).sum(0) / n.sum()
        share = parts["y"].to_numpy(dtype=float) / n
        apart = (share - parts["y"].sum() / n.sum())[:, None] * (means - mean)
        variance = (n[:, None] * (variances + (means - mean) ** 2)).sum(0) / n.sum()
        covariance = (n[:, None] * (covariances + apart)).sum(0) / n.sum()
        return n.sum(), parts["y"].sum(), mean, np.sqrt(variance), covariance

    rows_, positives, mean, sd, covariance = merged(per_fold)
    if lambdas is None:
        varies = sd > 0
        top = np.abs(covariance[varies] / sd[varies]).max(initial=0.0)
        if not top:
            raise ValueError("no feature varies together with the label")
        lambdas = _path_from(float(top), n_lambda, end_ratio)
    sd = np.where(sd == 0, 1.0, sd)
    standard = table.select(
        "label", "fold", *((F.col(x) - float(mean[i])) / F.lit(float(sd[i])) for i, x in enumerate(xs))
    ).toDF("label", "fold", *xs)
    partitions = max(1, math.ceil(rows_ * (len(xs) + 1) / VALUES_PER_PARTITION))
    # round robin deals the rows evenly, so a task holds its share of them
    standard = materialise(standard.repartition(partitions)) if partitions > 1 else standard.coalesce(1)

    groups = [-1, *(h for h in (sorted(per_fold.index) if held else []))]
    held_out = np.repeat(groups, len(lambdas))  # -1: nothing held out
    step = np.tile(np.arange(len(lambdas)), len(groups))
    penalty = np.zeros((len(held_out), len(xs) + 1))
    start = np.zeros_like(penalty)
    for g, h in enumerate(groups):
        rest_rows, positives, _, rest_sd, _ = merged(per_fold[per_fold.index != h])
        rows = slice(g * len(lambdas), (g + 1) * len(lambdas))
        penalty[rows, 1:] = np.outer(lambdas, rest_sd / sd)  # each fold is penalised on its own scale
        share = min(max(positives / rest_rows, 1e-6), 1 - 1e-6)
        start[rows, 0] = math.log(share / (1 - share))
    # a feature that does not vary in the rows used must keep its zero
    penalty[:, 1:] = np.where(penalty[:, 1:] == 0, max(lambdas), penalty[:, 1:])

    beta, held_deviance, objective, gap = _solve(standard, start, penalty, held_out, step, tolerance, partitions)
    deviances = held_deviance.reshape(len(groups), -1)[1:].sum(0) / rows_
    chosen = int(np.argmin(deviances)) if held else 0
    scaled = beta[chosen]
    coefficients = scaled[1:] / sd
    certificates = zip(held_out.tolist(), np.tile(lambdas, len(groups)).tolist(), objective.tolist(), gap.tolist(), strict=True)
    return LassoFit(
        tuple(names),
        tuple(lambdas),
        tuple(float(d) for d in deviances) if held else (),
        lambdas[chosen],
        float(scaled[0] - (coefficients * mean).sum()),
        tuple(float(c) for c in coefficients),
        tuple(Certificate(*c) for c in certificates),
    )


def fit_lasso(
    df: DataFrame, features: Sequence[str], penalty: float, label: str = "label", tolerance: float = TOLERANCE
) -> LassoFit:
    """L1 logistic regression at one penalty, on features scaled with their n-denominator deviation."""
    table = materialise(_training_table(df, list(features), label, None))
    return _fit(table, list(features), [float(penalty)], 1, END_RATIO, False, tolerance)


def fit_lasso_cv(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    key: str | None = None,
    folds: int = 10,
    n_lambda: int = 100,
    seed: int = 12345,
    end_ratio: float = END_RATIO,
    tolerance: float = TOLERANCE,
) -> LassoFit:
    """L1 logistic regression whose penalty minimises the cross-validated deviance.

    Every fit returned meets its optimality conditions to ``tolerance``, a share of its penalty, and comes with a
    duality gap; there is no limit on rounds.  All folds and penalties advance together, and what a scan adds up are
    gradients and solutions, (folds + 1) x penalties x twice the features, whatever the number of rows; second
    derivatives stay inside the tasks.  A table that one task can hold takes four scans.  Folds are balanced by class;
    ``key`` fixes them by hash, so they do not depend on partitioning.
    """
    names = list(features)
    dealt = balanced_folds(df.where(F.col(label).isNotNull()), label, folds, seed, key, "__fold")
    table = materialise(_training_table(dealt, names, label, "__fold"))
    return _fit(table, names, None, n_lambda, end_ratio, True, tolerance)


def score(
    fit: LassoFit,
    df: DataFrame,
    key: str,
    out: str = "score",
    exclude: DataFrame | None = None,
    scaler: str = "own",
    train: DataFrame | None = None,
) -> DataFrame:
    """Response probability of every entity outside ``exclude``; NULL where a feature is missing.

    ``scaler='own'`` standardises with the scored table's own statistics, ``'train'`` with
    those of the unscaled ``train`` table, ``'none'`` leaves the features alone.
    """
    target = df if exclude is None else anti_join(df, exclude, key)
    if scaler == "own":
        target = zscore(target, list(fit.features))
    elif scaler == "train":
        if train is None:
            raise ValueError("scaler='train' needs the unscaled training table")
        target = zscore(target, list(fit.features), stats_from=train)
    elif scaler != "none":
        raise ValueError("scaler must be 'own', 'train' or 'none'")
    margin = F.lit(fit.intercept)
    for name, coefficient in zip(fit.features, fit.coefficients):
        margin = margin + F.lit(coefficient) * F.col(name)
    return target.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))


def ranked_scores(scored: DataFrame, key: str, column: str = "score") -> DataFrame:
    """Scores in ascending order with their position."""
    return score_ranking(scored, column, key)
