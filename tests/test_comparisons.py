import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.functions import distributions as D
from cohortry.operators import comparisons as T


@pytest.fixture(scope="module")
def measured(spark):
    rng = np.random.default_rng(11)
    n = 900
    cls = rng.choice(["ref", "a", "b", "c"], n, p=[0.5, 0.3, 0.15, 0.05])
    v = np.round(rng.normal(0, 2, n) + (cls == "a") * 0.5, 1)
    w = np.round(rng.exponential(3, n), 2)
    pdf = pd.DataFrame({"id": range(n), "cls": cls, "v": v, "w": w, "s": rng.choice(["x", "y"], n)})
    return spark.createDataFrame(pdf).repartition(5), pdf


def brute(x, r, alternative):
    """U, z and normal p from all pairs and pooled ranks."""
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in r)
    m, k = len(x), len(r)
    ties = pd.Series(np.concatenate([x, r])).value_counts()
    var = m * k / 12 * (m + k + 1 - (ties**3 - ties).sum() / ((m + k) * (m + k - 1)))
    shift = {"greater": 0.5, "less": -0.5, "two.sided": math.copysign(0.5, u - m * k / 2) if u != m * k / 2 else 0.0}
    z = (u - m * k / 2 - shift[alternative]) / math.sqrt(var)
    up = 0.5 * math.erfc(z / math.sqrt(2))
    return u, z, {"greater": up, "less": 1 - up, "two.sided": 2 * min(up, 1 - up)}[alternative]


@pytest.mark.parametrize("alternative", ["greater", "less", "two.sided"])
def test_rank_sum_equals_pair_counting(measured, alternative):
    df, pdf = measured
    got = T.rank_sum_vs_ref(df, "cls", "v", "ref", alternative, method="normal").collect()
    assert {r.cls for r in got} == {"a", "b", "c"}
    for r in got:
        x, ref = pdf[pdf.cls == r.cls].v.to_numpy(), pdf[pdf.cls == "ref"].v.to_numpy()
        u, z, p = brute(x, ref, alternative)
        assert (r.n, r.n_ref) == (len(x), len(ref))
        assert r.u == pytest.approx(u) and r.z == pytest.approx(z, rel=1e-9)
        assert r.p_value == pytest.approx(p, abs=3e-7)


def test_rank_sum_within_groups(measured):
    df, pdf = measured
    got = T.rank_sum_vs_ref(df, "cls", "v", "ref", by="s", method="normal").collect()
    assert len(got) == 6
    for r in got:
        part = pdf[pdf.s == r.s]
        assert r.u == brute(part[part.cls == r.cls].v.to_numpy(), part[part.cls == "ref"].v.to_numpy(), "greater")[0]


@pytest.mark.parametrize("alternative", ["greater", "less", "two.sided"])
def test_small_tie_free_samples_use_the_exact_distribution(rows, alternative):
    x, ref = [1.5, 4.0, 6.5, 7.25], [1.0, 2.0, 3.0, 5.0, 8.0]
    df = rows("c string, v double", *(("x", a) for a in x), *(("ref", b) for b in ref))
    got = T.rank_sum_vs_ref(df, "c", "v", "ref", alternative, method="exact").first()
    observed = sum(a > b for a in x for b in ref)
    pooled = sorted(x + ref)
    us = []
    for chosen in itertools.combinations(range(9), 4):
        rest = [i for i in range(9) if i not in chosen]
        us.append(sum(pooled[i] > pooled[j] for i in chosen for j in rest))
    up, down = np.mean(np.array(us) >= observed), np.mean(np.array(us) <= observed)
    want = {"greater": up, "less": down, "two.sided": min(1, 2 * min(up, down))}[alternative]
    assert got.p_value == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("m, r", [(1, 1), (1, 9), (4, 5), (5, 4), (7, 7), (3, 12)])
def test_masses_equal_enumeration(m, r):
    counts = np.zeros(m * r + 1)
    for chosen in itertools.combinations(range(m + r), m):
        counts[sum(c - k for k, c in enumerate(chosen))] += 1
    np.testing.assert_allclose(T.rank_sum_masses(m, r), counts[: m * r // 2 + 1] / counts.sum(), rtol=1e-12)


def test_masses_of_large_samples():
    """300 against 300: one array of 45,001 numbers, symmetric about the middle, with the known mean and variance."""
    masses = T.rank_sum_masses(300, 300)
    assert masses.nbytes == 45_001 * 8 and (masses >= 0).all() and (np.diff(masses) >= 0).all()
    whole = np.append(masses, masses[:-1][::-1])
    assert whole.sum() == pytest.approx(1, abs=1e-9)
    u = np.arange(90_001)
    assert (whole * (u - 45_000) ** 2).sum() == pytest.approx(300 * 300 * 601 / 12, rel=1e-9)
    assert masses[0] == pytest.approx(math.exp(2 * math.lgamma(301) - math.lgamma(601)), rel=1e-9)


def test_exact_test_of_300_against_300_rows(rows):
    """Close to the normal approximation, and refused beyond its stated size."""
    data = [("x", k + 0.5 + (k % 3) * 7) for k in range(300)] + [("ref", float(k)) for k in range(300)]
    df = rows("c string, v double", *data)
    exact, normal = (T.rank_sum_vs_ref(df, "c", "v", "ref", method=m).first() for m in ("exact", "normal"))
    assert exact.u == normal.u and exact.p_value == pytest.approx(normal.p_value, rel=1e-2)
    large = df.sparkSession.range(2 * 2001).selectExpr("if(id % 2 = 0, 'x', 'ref') AS c", "CAST(id AS DOUBLE) AS v")
    with pytest.raises(Exception, match="product of sizes"):
        T.rank_sum_vs_ref(large, "c", "v", "ref", method="exact").collect()


def test_exact_raises_on_ties_and_nothing_switches(rows):
    tied = rows("c string, v double", ("x", 1.0), ("x", 2.0), ("ref", 1.0), ("ref", 3.0))
    with pytest.raises(Exception, match="without ties"):
        T.rank_sum_vs_ref(tied, "c", "v", "ref", method="exact").collect()
    assert T.rank_sum_vs_ref(tied, "c", "v", "ref").first().p_value is not None
    with pytest.raises(ValueError, match="exact"):
        T.rank_sum_vs_ref(tied, "c", "v", "ref", method="auto")


def test_missing_reference_gives_no_tests(rows):
    df = rows("c string, v double", ("x", 1.0), ("y", 2.0))
    assert T.rank_sum_vs_ref(df, "c", "v", "ref").count() == 0


def test_box_summary(measured):
    df, pdf = measured
    for r in T.box_summary(df, "cls", "w").collect():
        w = pdf[pdf.cls == r.cls].w
        q1, q2, q3 = np.quantile(w, [0.25, 0.5, 0.75])
        inside = w[(w >= q1 - 1.5 * (q3 - q1)) & (w <= q3 + 1.5 * (q3 - q1))]
        assert r.n == len(w)
        np.testing.assert_allclose(
            [r.q1, r.median, r.q3, r.whisker_low, r.whisker_high], [q1, q2, q3, inside.min(), inside.max()]
        )


def test_density_is_close_to_the_direct_sum(measured):
    df, pdf = measured
    got = T.density_profile(df, "cls", "v", n_grid=40).toPandas()
    for name, part in got.groupby("cls"):
        part = part.sort_values("point")
        v = pdf[pdf.cls == name].v
        iqr = np.subtract(*np.quantile(v, [0.75, 0.25]))
        bw = 0.9 * min(v.std(), iqr / 1.34) * len(v) ** -0.2
        x = np.linspace(v.min(), v.max(), 40)
        direct = np.exp(-(((x[:, None] - v.to_numpy()[None, :]) / bw) ** 2) / 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
        np.testing.assert_allclose(part["x"], x, atol=1e-9)
        np.testing.assert_allclose(part["density"], direct, rtol=2e-3)


def test_density_has_every_grid_point_however_far_apart(rows):
    data = [("k", float(v)) for v in range(200)] + [("k", 1e6)]
    got = T.density_profile(rows("c string, v double", *data), "c", "v").collect()
    assert sorted(r.point for r in got) == list(range(512))
    assert any(r.density == 0 for r in got) and sum(r.density > 0 for r in got) >= 2


def test_density_of_a_constant_class(rows):
    got = T.density_profile(rows("c string, v double", ("k", 2.0), ("k", 2.0), ("one", 1.0)), "c", "v", n_grid=4).collect()
    assert len(got) == 4 and all(r.c == "k" and r.x == 2.0 and r.density > 0 for r in got)


def test_spearman(measured):
    df, pdf = measured
    got = T.spearman(df, "v", "w").first()
    rho = pdf.v.rank().corr(pdf.w.rank())
    assert got.n == len(pdf) and got.rho == pytest.approx(rho, abs=1e-12)
    assert got.t == pytest.approx(rho * math.sqrt((len(pdf) - 2) / (1 - rho**2)))
    assert 0 <= got.p_value <= 1


def t_tail(t, df):
    """Two-sided tail by integrating the density numerically."""
    x = np.linspace(0, abs(t), 200_001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 1 - 2 * np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x)


def test_probability_functions(rows):
    zs = [-5.0, -1.96, -0.3, 0.0, 0.5, 1.0, 2.33, 5.0]
    got = rows("z double", *((z,) for z in zs)).withColumn("p", D.normal_upper_tail(F.col("z"))).collect()
    for r in got:
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), abs=1.5e-7)
    cases = [(0.1, 10), (1.0, 5), (2.2, 8), (2.0, 30), (3.5, 100), (-2.5, 1000)]
    df = rows("t double, v double", *((float(t), float(v)) for t, v in cases))
    for r in df.withColumn("p", D.student_two_sided(F.col("t"), F.col("v"))).collect():
        assert r.p == pytest.approx(t_tail(r.t, r.v), abs=1e-5)
    quantiles = {1: 12.7062, 2: 4.30265, 5: 2.57058, 10: 2.22814, 30: 2.04227, 1000: 1.96234}
    df = rows("v int", *((v,) for v in quantiles)).withColumn("q", D.student_quantile_975(F.col("v")))
    for r in df.collect():
        assert r.q == pytest.approx(quantiles[r.v], rel=2e-4)


def test_linear_fit_and_band(measured):
    df, pdf = measured
    fit = T.linear_fit(df, "v", "w").first()
    slope, intercept = np.polyfit(pdf.v, pdf.w, 1)
    residual = pdf.w - intercept - slope * pdf.v
    sigma = math.sqrt((residual**2).sum() / (len(pdf) - 2))
    np.testing.assert_allclose([fit.slope, fit.intercept, fit.sigma], [slope, intercept, sigma], rtol=1e-9)
    band = T.linear_fit_band(df, "v", "w", 5).toPandas().sort_values("point")
    half = 1.9626 * sigma * np.sqrt(1 / len(pdf) + (band.x - pdf.v.mean()) ** 2 / ((pdf.v - pdf.v.mean()) ** 2).sum())
    np.testing.assert_allclose(band["upper"] - band["fit"], half, rtol=1e-4)
    np.testing.assert_allclose(band["fit"] - band["lower"], half, rtol=1e-4)


def test_report_agrees_with_single_comparisons(measured):
    df, _ = measured
    comparisons = [
        T.Comparison("v", "v", "cls", "ref", -3, 3),
        T.Comparison("w", "w", "cls", "ref", 0, 10, "less", cutpoints=T.DEFAULT_CUTPOINTS[1:]),
        T.Comparison("v", "v", "cls", "ref", -3, 3, scope="only x", scope_filter=F.col("s") == "x"),
    ]
    report = T.association_report(df, comparisons).toPandas()
    for c in comparisons:
        part = df.where(F.col(c.value).between(c.low, c.high))
        part = part if c.scope_filter is None else part.where(c.scope_filter)
        got = report[(report.metric == c.metric) & (report.scope == c.scope)].set_index("class")
        tests = T.rank_sum_vs_ref(part, "cls", c.value, "ref", c.alternative, cutpoints=c.cutpoints).toPandas().set_index("cls")
        boxes = T.box_summary(part, "cls", c.value).toPandas().set_index("cls")
        np.testing.assert_allclose(got.loc[boxes.index, "median"], boxes["median"])
        np.testing.assert_allclose(got.loc[tests.index, "p_value"].astype(float), tests["p_value"])
        assert list(got.loc[tests.index, "label"]) == list(tests["label"])
        assert got.loc["ref", "label"] is None and len(got) == 4


def test_comparisons_of_one_name_stay_apart(measured):
    df, _ = measured
    comparisons = [
        T.Comparison("v", "v", "cls", "ref", -9, 9, scope_filter=F.col("s") == x) for x in ("x", "y")
    ]
    report = T.association_report(df, comparisons).toPandas()
    for number, c in enumerate(comparisons):
        part = df.where(c.scope_filter & F.col("v").between(-9, 9))
        alone = T.rank_sum_vs_ref(part, "cls", "v", "ref").toPandas().set_index("cls")
        got = report[report.comparison == number].set_index("class")
        np.testing.assert_allclose(got.loc[alone.index, "u"].astype(float), alone["u"])
        assert set(got.loc[alone.index, "n_ref"]) == set(alone["n_ref"])


def test_densities_come_from_the_blocks_of_the_report(measured):
    df, _ = measured
    comparisons = [T.Comparison("v", "v", "cls", "ref", -3, 3), T.Comparison("w", "w", "cls", "ref", 0, 10)]
    blocks = T.report_blocks(df, comparisons)
    got = T.association_density(blocks, 40, 64).toPandas()
    assert len(got) == 2 * 4 * 40
    alone = T.density_profile(df.where("v BETWEEN -3 AND 3"), "cls", "v", 40, 64).toPandas().sort_values(["cls", "point"])
    same = got[got.comparison == 0].sort_values(["class", "point"])
    np.testing.assert_allclose(same["density"], alone["density"], rtol=1e-9)
