import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from cohortry.operators import model as M

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.normal(size=(n, 4))
    x[:, 1] = 0.7 * x[:, 0] + 0.5 * x[:, 1]
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 1.0 * x[:, 2] - 0.5)))).astype(int)
    pdf = pd.DataFrame(x * [1, 10, 0.1, 3] + [0, 5, 0, 1], columns=FEATURES)
    pdf["label"], pdf["id"] = y, range(n)
    pdf["cls"] = np.where(y == 1, "pos", "neg")
    return spark.createDataFrame(pdf).repartition(4), pdf


@pytest.fixture(scope="module")
def fit(table):
    return M.fit_lasso_cv(table[0], FEATURES, key="id", folds=5, n_lambda=12)


def test_path_starts_where_all_coefficients_vanish(table):
    df, pdf = table
    path = M.lambda_path(df, FEATURES, "label", 7)
    x = pdf[FEATURES].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    y = pdf.label.to_numpy()
    assert path[0] == pytest.approx(np.abs(x.T @ (y - y.mean())).max() / len(y))
    assert path[-1] == pytest.approx(path[0] * 1e-4) and len(path) == 7
    assert path[1] / path[0] == pytest.approx(path[4] / path[3])


def test_fit_solves_the_lasso(table, fit):
    """Optimality conditions of the chosen problem, on the standardised scale."""
    _, pdf = table
    x = pdf[FEATURES].to_numpy()
    sd, mean = x.std(0), x.mean(0)
    p = 1 / (1 + np.exp(-(fit.intercept + x @ np.array(fit.coefficients))))
    residual = pdf.label.to_numpy() - p
    assert residual.mean() == pytest.approx(0, abs=1e-4)
    gradient = ((x - mean) / sd).T @ residual / len(x)
    for g, b in zip(gradient, fit.coefficients):
        if b == 0:
            assert abs(g) <= fit.lambda_min + 1e-4
        else:
            assert g == pytest.approx(math.copysign(fit.lambda_min, b), abs=1e-3)


def test_fit_is_close_to_spark_ml(table, fit):
    df, _ = table
    vectors = M.feature_vector(df, FEATURES).select("features", F.col("label").cast("double").alias("label"))
    ml = LogisticRegression(elasticNetParam=1.0, regParam=fit.lambda_min, tol=1e-9, maxIter=500).fit(vectors)
    np.testing.assert_allclose(fit.coefficients, ml.coefficients.toArray(), rtol=0.02, atol=1e-3)
    assert fit.intercept == pytest.approx(ml.intercept, rel=0.02)


def test_fit_does_not_depend_on_partitioning(table, fit):
    df, _ = table
    again = M.fit_lasso_cv(df.repartition(3), FEATURES, key="id", folds=5, n_lambda=12)
    np.testing.assert_allclose(again.coefficients, fit.coefficients, atol=1e-6)
    assert again.lambda_min == pytest.approx(fit.lambda_min)
    assert len(fit.deviances) == 12 and min(fit.deviances) == fit.deviances[fit.lambdas.index(fit.lambda_min)]


def test_several_partitions_agree_on_the_solution(table, fit, monkeypatch):
    """Partitions of some 100 rows solve their own problems; the common fit meets the same conditions."""
    monkeypatch.setattr(M, "VALUES_PER_PARTITION", 500)
    again = M.fit_lasso_cv(table[0], FEATURES, key="id", folds=5, n_lambda=12)
    np.testing.assert_allclose(again.coefficients, fit.coefficients, rtol=1e-2, atol=1e-3)
    np.testing.assert_allclose(again.deviances, fit.deviances, rtol=1e-4)
    assert max(c.gap / c.objective for c in again.certificates) < 1e-4


def test_certificates(table, fit):
    """One per problem; the gap is what the objective can still fall, and the objective is the definition's."""
    _, pdf = table
    assert [(c.held_out, c.penalty) for c in fit.certificates] == [(h, p) for h in range(-1, 5) for p in fit.lambdas]
    assert all(-1e-12 <= c.gap <= 1e-6 * c.objective for c in fit.certificates)
    x, y = pdf[FEATURES].to_numpy(), pdf.label.to_numpy()
    margin = fit.intercept + x @ np.array(fit.coefficients)
    loss = (np.logaddexp(0, margin) - y * margin).mean()
    whole = next(c for c in fit.certificates if c.held_out == -1 and c.penalty == fit.lambda_min)
    assert whole.objective == pytest.approx(loss + fit.lambda_min * np.abs(x.std(0) * fit.coefficients).sum())


def test_dual_point_is_feasible(table):
    """Away from the optimum the certificate is larger than what is really missing."""
    rng = np.random.default_rng(3)
    x, y = np.column_stack([np.ones(50), rng.normal(size=(50, 3))]), (rng.random(50) < 0.4).astype(float)
    beta, lam = np.array([0.1, 0.5, -0.2, 0.0]), np.array([[0, 0.05, 0.05, 0.05]])
    p = 1 / (1 + np.exp(-x @ beta))
    sides = np.array([[((1 - p) * y) @ x, (-p * (1 - y)) @ x]]) / 50
    (up, down), = M._dual_scales(sides, lam)
    residual = np.where(y == 1, up * (1 - p), -down * p)
    assert residual.sum() == pytest.approx(0, abs=1e-12) and 0 < min(up, down) and max(up, down) <= 1
    assert (np.abs(residual @ x / 50)[1:] <= 0.05 + 1e-12).all()


@pytest.mark.parametrize("n_pos, n_neg, folds", [(22, 100, 10), (10, 7, 10), (3, 4, 5), (40, 0, 7)])
def test_balanced_folds(spark, n_pos, n_neg, folds):
    pdf = pd.DataFrame({"label": [1] * n_pos + [0] * n_neg, "id": range(n_pos + n_neg)})
    df = spark.createDataFrame(pdf)
    got = M.balanced_folds(df, "label", folds, key="id").toPandas()
    sizes = got.groupby("fold").size().reindex(range(folds), fill_value=0)
    assert sizes.max() - sizes.min() <= 1 and set(got.fold) <= set(range(folds)) and len(got) == len(pdf)
    for _, part in got.groupby("label"):
        own = part.groupby("fold").size().reindex(range(folds), fill_value=0)
        assert own.max() - own.min() <= 1
    again = M.balanced_folds(df.repartition(5), "label", folds, key="id").toPandas()
    assert dict(zip(again.id, again.fold)) == dict(zip(got.id, got.fold))


def test_held_out_deviance(table, spark):
    """Deviance of one penalty against separate fits per fold, through the same solver."""
    df, pdf = table
    folds, key = 4, "id"
    fit = M.fit_lasso_cv(df, FEATURES, key=key, folds=folds, n_lambda=1)
    dealt = M.balanced_folds(df, "label", folds, key=key).select("id", "fold").toPandas().set_index("id")["fold"]
    fold = dealt.reindex(pdf.id)
    y = pdf.set_index("id").label
    total = 0.0
    for f in range(folds):
        share = y[fold != f].mean()  # the largest penalty leaves (about) the intercept only
        held = y[fold == f]
        total += -2 * (held * math.log(share) + (1 - held) * math.log(1 - share)).sum()
    assert fit.deviances[0] == pytest.approx(total / len(y), rel=0.02)


def test_a_feature_that_does_not_vary(table):
    """A constant column stays at zero, and a column that varies in one held-out row only does no harm."""
    df = table[0].withColumn("e", F.lit(3.0)).withColumn("g", F.when(F.col("id") == 7, 1.0).otherwise(0.0))
    fit = M.fit_lasso_cv(df, [*FEATURES, "e", "g"], key="id", folds=5, n_lambda=8)
    assert fit.coefficients[4] == 0 and max(c.gap for c in fit.certificates) < 1e-4


def test_constant_label_is_rejected(rows):
    with pytest.raises(ValueError, match="label"):
        M.lambda_path(rows("x double, label int", (1.0, 1), (2.0, 1)), ["x"], "label")


def test_labelled_sample(table):
    df, _ = table
    sample = M.labelled_sample(df, "id", "cls", "pos", "neg", FEATURES, 10, 20).toPandas()
    assert sample.label.value_counts().to_dict() == {1: 10, 0: 20}
    np.testing.assert_allclose(sample[FEATURES].mean(), 0, atol=1e-9)
    np.testing.assert_allclose(sample[FEATURES].std(), 1)
    again = M.labelled_sample(df.repartition(9), "id", "cls", "pos", "neg", FEATURES, 10, 20).toPandas()
    assert set(again.id) == set(sample.id)
    with pytest.raises(ValueError, match="cannot draw 10000"):
        M.labelled_sample(df, "id", "cls", "pos", "neg", FEATURES, 10_000, 20)


def test_scores(table, fit):
    df, pdf = table
    train = df.where("id < 100").select("id")
    raw = M.score(fit, df, "id", exclude=train, scaler="none").toPandas().set_index("id")["score"].sort_index()
    rest = pdf[pdf.id >= 100].set_index("id")
    margin = fit.intercept + rest[FEATURES].to_numpy() @ np.array(fit.coefficients)
    np.testing.assert_allclose(raw, 1 / (1 + np.exp(-margin)))
    own = M.score(fit, df, "id", exclude=train).toPandas().set_index("id").sort_index()
    z = (rest[FEATURES] - rest[FEATURES].mean()) / rest[FEATURES].std()
    np.testing.assert_allclose(own["score"], 1 / (1 + np.exp(-(fit.intercept + z.to_numpy() @ np.array(fit.coefficients)))))
    by_train = M.score(fit, df, "id", scaler="train", train=df.where("id < 100")).toPandas().set_index("id").sort_index()
    part = pdf[pdf.id < 100][FEATURES]
    np.testing.assert_allclose(by_train[FEATURES], (pdf.set_index("id")[FEATURES] - part.mean()) / part.std())
    ranked = M.ranked_scores(M.score(fit, df, "id"), "id").toPandas().sort_values("position")
    assert ranked["score"].is_monotonic_increasing and len(ranked) == len(pdf)
    with pytest.raises(ValueError):
        M.score(fit, df, "id", scaler="other")


def test_separable_correlated_rows_are_solved_to_optimality(spark):
    """22 and 100 rows, eight correlated features, classes far apart: every problem must still be finished."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=(122, 1))
    x = 0.9 * z + 0.3 * rng.normal(size=(122, 8))
    x[:22, :4] += 4
    names = [f"f{i}" for i in range(8)]
    pdf = pd.DataFrame(x, columns=names)
    pdf["label"], pdf["id"] = [1] * 22 + [0] * 100, range(122)
    fit = M.fit_lasso_cv(spark.createDataFrame(pdf), names, key="id")
    sd, mean = x.std(0), x.mean(0)
    p = 1 / (1 + np.exp(-(fit.intercept + x @ np.array(fit.coefficients))))
    gradient = ((x - mean) / sd).T @ (pdf.label.to_numpy() - p) / len(x)
    beta = np.array(fit.coefficients) * sd
    residual = M.optimality_residual(beta[None], gradient[None], np.full((1, 8), fit.lambda_min))
    assert residual[0] <= 2 * M.TOLERANCE * fit.lambda_min


def test_large_offsets_do_not_change_the_fit(table, fit):
    shifted = table[0].withColumn("c", F.col("c") + 1e6)
    again = M.fit_lasso_cv(shifted, FEATURES, key="id", folds=5, n_lambda=12)
    np.testing.assert_allclose(again.coefficients, fit.coefficients, rtol=1e-3, atol=1e-5)


def test_a_stalled_fit_is_not_returned(table, monkeypatch):
    monkeypatch.setattr(M, "_directions", lambda table, start, *rest: np.ones_like(start))  # no descent direction
    with pytest.raises(ArithmeticError, match="stalls"):
        M.fit_lasso_cv(table[0], FEATURES, key="id", folds=3, n_lambda=3)
