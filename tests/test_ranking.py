import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.operators import categories as G
from cohortry.operators import ranking as K
from cohortry.operators import scaling as S
from cohortry import session as SS


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, heavy ties, a few missing values and groups."""
    rng = np.random.default_rng(7)
    n = 3000
    g = np.where(rng.random(n) < 0.66, "hot", rng.choice(["a", "b", "c"], n)).astype(object)
    g[rng.random(n) < 0.02] = None
    v = np.round(rng.lognormal(0, 1, n), 1)
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v})
    rows = [(int(i), gg, None if i % 97 == 0 else float(x)) for i, gg, x in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(6)
    return df, pd.DataFrame(rows, columns=["id", "g", "v"])


@pytest.fixture(autouse=True)
def many_blocks(spark):
    """Small sorts stay in several blocks, so offsets between blocks are exercised."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blocks_split_a_hot_group(skewed):
    df, _ = skewed
    blocks = K.value_blocks(K.histogram(df, "v", ["g"]), "v", ["g"])
    assert blocks.where("g = 'hot'").select("__block").distinct().count() > 1


def test_average_rank_equals_pandas(skewed):
    df, pdf = skewed
    got = K.average_rank(df, "v", "g").toPandas().set_index("id")["rank"].sort_index()
    want = pdf.groupby("g", dropna=False)["v"].rank().set_axis(pdf["id"])
    np.testing.assert_allclose(got, want.sort_index())
    overall = K.average_rank(df, "v").toPandas().set_index("id")["rank"].sort_index()
    np.testing.assert_allclose(overall, pdf.set_index("id")["v"].rank().sort_index())


def test_average_rank_without_broadcast(skewed, monkeypatch):
    df, pdf = skewed
    monkeypatch.setattr(K, "fits_broadcast", lambda *_: False)
    got = K.average_rank(df, "v", "g").toPandas().set_index("id")["rank"].sort_index()
    np.testing.assert_allclose(got, pdf.groupby("g", dropna=False)["v"].rank().set_axis(pdf["id"]).sort_index())


def test_average_rank_of_one_two_two_four(rows):
    got = K.average_rank(rows("x int", (10,), (20,), (20,), (30,)), "x").collect()
    assert sorted(r["rank"] for r in got) == [1.0, 2.5, 2.5, 4.0]


def test_running_total_serves_finer_groups_from_one_sort(skewed):
    df, pdf = skewed
    hist = K.histogram(df.where("g is not null"), "v", ["g"])
    coarse = K.value_blocks(hist, "v")  # sorted by value only
    run = K.running_total(coarse, "v", "n", ["g"]).toPandas()
    known = pdf.dropna()
    for r in run.sample(40, random_state=1).itertuples():
        group = known[known.g == r.g].v
        assert (r.below, r.equal, r.group_total) == ((group < r.v).sum(), (group == r.v).sum(), len(group))


def test_quantiles_equal_numpy(skewed):
    df, pdf = skewed
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    names = [f"p{i}" for i in range(len(probs))]
    got = K.quantiles(df, "v", probs, "g", names).collect()
    for r in got:
        group = pdf[pdf.g.isna() if r.g is None else pdf.g == r.g].v.dropna()
        assert r.n == len(group)
        np.testing.assert_allclose([r[n] for n in names], np.quantile(group, probs))


def test_quantiles_of_one_to_four(rows):
    got = K.median_iqr(rows("x int", (1,), (2,), (3,), (4,)), "x").first()
    assert (got.q1, got.median, got.q3, got.iqr) == (1.75, 2.5, 3.25, 1.5)


def test_outlier_cutoff_uses_the_median(rows):
    got = K.flag_outliers(rows("x double", (1.0,), (2.0,), (3.0,), (4.0,), (4.75,)), "x").collect()
    assert {r.cutoff for r in got} == {3.0 + 1.5 * 2.0}
    assert not any(r.is_outlier for r in got)
    got = K.flag_outliers(rows("x double", (1.0,), (1.0,), (1.0,), (1.0,), (2.0,)), "x").collect()
    assert all(r.is_outlier for r in got)  # the cutoff itself counts


def test_positions_are_a_total_order(skewed):
    df, pdf = skewed
    got = K.score_ranking(df, "v", "id").toPandas().sort_values("position")
    assert list(got["position"]) == list(range(1, len(pdf) + 1))
    want = pdf.sort_values(["v", "id"], na_position="last")["id"]
    assert list(got["id"]) == list(want)


def test_positions_split_one_tied_score(spark):
    df = spark.range(5000).withColumn("s", F.lit(1.0))
    got = K.score_ranking(df, "s", "id")
    assert got.where("position <> id + 1").count() == 0 and got.count() == 5000


def test_sample_does_not_depend_on_partitioning(spark):
    ids = lambda parts: {r.id for r in K.sample_n(spark.range(0, 1000, 1, parts), 50, 3, "id").collect()}
    assert ids(1) == ids(7) and len(ids(3)) == 50
    other = {r.id for r in K.sample_n(spark.range(1000), 50, 4, "id").collect()}
    assert other != ids(1)
    with pytest.raises(ValueError, match="only 10"):
        K.sample_n(spark.range(10), 11, 1, "id", strict=True)


def test_group_size_and_lumping(skewed):
    df, pdf = skewed
    sizes = pdf.groupby("g", dropna=False).size()
    got = G.group_size(df, "g").select("g", "cases").distinct().collect()
    assert {(r.g, r.cases) for r in got} == {(None if pd.isna(g) else g, n) for g, n in sizes.items()}
    smallest = int(sizes.sort_values().iloc[1])
    lumped = G.lump_rare(df, "g", smallest, "rare").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in lumped}["rare"] == sizes[sizes < smallest].sum()


def test_level_index_is_first_appearance(rows):
    df = rows("o int, c string", (3, "a"), (1, "b"), (2, "a"), (4, "c"), (0, None))
    got = {(r.c, r.level) for r in G.level_index(df, "c", ["o"]).collect()}
    assert got == {("b", 1), ("a", 2), ("c", 3), (None, None)}


def test_sort_by_levels(rows):
    df = rows("c string", ("x",), ("lo",), ("hi",), (None,))
    assert [r.c for r in G.sort_by_levels(df, "c", ["hi", "lo"], keep=False).collect()] == ["hi", "lo", None, None]
    assert [r.level for r in G.sort_by_levels(df, "c", ["hi", "lo"], reverse=True).collect()] == [1, 2, None, None]


def test_zscore(skewed, rows):
    df, pdf = skewed
    got = S.zscore(df, ["v"]).toPandas().set_index("id")["v"].sort_index()
    want = (pdf.v - pdf.v.mean()) / pdf.v.std()
    np.testing.assert_allclose(got, want)
    grouped = S.zscore(df, ["v"], by="g", suffix="_z").toPandas().set_index("id")["v_z"].sort_index()
    by = pdf.groupby("g", dropna=False)["v"]
    np.testing.assert_allclose(grouped, (pdf.v - by.transform("mean")) / by.transform("std"))
    assert [r.x for r in S.zscore(rows("x int", (1,), (1,)), ["x"]).collect()] == [None, None]


def test_broadcast_only_within_measured_bounds(spark):
    df = spark.range(100)
    assert SS.fits_broadcast(df, max_rows=100)
    assert not SS.fits_broadcast(df, max_rows=99)
    wide = df.select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert not SS.fits_broadcast(wide, max_rows=100, max_bytes=50_000)


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("small", [40, 1_000_000])
def test_quantiles_narrow_to_the_exact_place(spark, monkeypatch, by, small):
    """A hot group, a value with half of a group's rows, infinite ends, a null group: any number of passes agrees."""
    monkeypatch.setattr(K, "SMALL_RANGE", small)
    n = F.col("id")
    group = F.when(n % 3 < 2, "hot").when(n % 60 == 2, None).otherwise((n % 7).cast("string"))
    value = F.when(n % 2 == 0, 5.0).when(n == 11, float("-inf")).when(n == 13, float("nan")).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**6)) / 7)
    df = spark.range(30000).select(group.alias("g"), F.when(n % 17 != 0, value).alias("v"))
    probs, names = (0.0, 0.1, 0.25, 0.5, 0.901, 1.0), list("abcdef")
    got = {(r.g if by else 0): r for r in K.quantiles(df, "v", probs, by, names).collect()}
    known = df.toPandas().dropna(subset="v")
    groups = known.groupby("g", dropna=False).v if by else [(0, known.v)]
    want = {(None if k != k else k): v for k, v in groups}
    assert set(got) == set(want)
    for k, values in want.items():
        assert got[k].n == len(values)
        ordered = np.sort(values)
        for p, name in zip(probs, names, strict=True):
            place = (len(ordered) - 1) * p
            lo, hi = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
            expected = lo if lo == hi or place == int(place) else lo + (hi - lo) * (place - np.floor(place))
            assert got[k][name] == pytest.approx(expected, rel=1e-12)


def test_quantiles_of_nothing(rows):
    nothing = rows("g string, v double", ("a", None))
    assert K.quantiles(nothing, "v", (0.5,), "g").count() == 0
    row = K.median_iqr(nothing, "v").first()
    assert row.n is None and row.median is None


def test_quantiles_sort_nothing_by_range(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    plan = K.median_iqr(df, "v", "g")._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan
