"""One small table per rule where missing values behave unlike plain SQL."""

import math

import pytest
from pyspark.sql import functions as F

from cohortry.functions import labels as L
from cohortry.functions import nulls as N
from cohortry.operators import aggregates as A
from cohortry.operators import columns as C
from cohortry.operators import joins as J
from cohortry.operators import ranking as K


def values(df, column, order="id"):
    return [r[column] for r in df.orderBy(order).collect()]


@pytest.fixture()
def flags(rows):
    return rows("id int, b boolean, s string, x double", (1, True, "BRCA1", 0.0), (2, False, "TP53", 8.0), (3, None, None, None))


def test_conditional_propagates_missing(flags):
    assert values(flags.withColumn("r", N.na_ifelse(F.col("b"), "yes", "no")), "r") == ["yes", "no", None]


def test_three_valued_and_or(flags):
    df = flags.withColumn("f", F.lit(False) & F.col("b")).withColumn("t", F.lit(True) | F.col("b"))
    assert values(df, "f") == [False, False, False]
    assert values(df, "t") == [True, True, True]


def test_pattern_on_missing_is_false(flags):
    df = flags.withColumn("c", N.matches("s", "BRCA")).withColumn("r", N.matches("s", "^T", regex=True))
    assert values(df, "c") == [True, False, False]
    assert values(df, "r") == [False, True, False]


def test_paste_spells_out_missing(flags):
    assert values(flags.withColumn("p", N.paste_na("s", "id")), "p") == ["BRCA1 1", "TP53 2", "NA 3"]


def test_filter_drops_unknown_condition(flags):
    assert values(flags.where("b"), "id") == [1]
    assert values(flags.where("not b"), "id") == [2]


def test_log_of_zero_is_minus_infinity(flags):
    assert values(flags.withColumn("l", N.log2_inf("x")), "l") == [-math.inf, 3.0, None]


def test_quantile_accepts_minus_infinity(rows):
    df = rows("x double", (-math.inf,), (1.0,), (2.0,), (3.0,), (4.0,))
    got = K.quantiles(df, "x", (0.0, 0.5, 0.75), names=("lo", "mid", "hi")).first()
    assert (got["lo"], got["mid"], got["hi"]) == (-math.inf, 2.0, 3.0)


@pytest.mark.parametrize("how, count", [("inner", 2), ("left", 2), ("full_outer", 3)])
def test_missing_keys_match_each_other_when_asked(rows, how, count):
    left = rows("k string, a int", ("x", 1), (None, 2))
    right = rows("k string, b int", ("x", 3), (None, 4), ("y", 5))
    joined = J.equi_join(left, right, "k", how, null_safe=True)
    assert joined.columns == ["k", "a", "b"]
    assert joined.count() == count
    assert {(r.a, r.b) for r in joined.collect()} >= {(1, 3), (2, 4)}
    assert J.equi_join(left, right, "k", "inner").count() == 1


def test_membership_is_never_missing(flags):
    df = flags.withColumn("i", N.in_list("s", ["TP53"])).withColumn("n", N.not_in_list("s", ["TP53"]))
    assert values(df, "i") == [False, True, False]
    assert values(df, "n") == [True, False, True]


def test_anti_join_keeps_missing_keys(rows):
    left = rows("k string", ("x",), (None,))
    right = rows("k string", ("x",), (None,))
    assert [r.k for r in J.anti_join(left, right, "k").collect()] == [None]
    assert J.anti_join(left, right, "k", null_safe=True).count() == 0
    assert J.semi_join(left, right, "k").count() == 1
    assert J.semi_join(left, right, "k", null_safe=True).count() == 2
    extra = rows("k string, b int", ("x", 1), (None, 2))
    assert {(r.k, r.b) for r in J.natural_left_join(left, extra, null_safe=True).collect()} == {("x", 1), (None, 2)}


def test_strict_category_scores(rows):
    df = rows("id int, c string, v double", (1, "a", 1.0), (1, "a", None), (1, "b", 2.0), (2, "a", 3.0))
    sets = {"x": ["a"], "y": ["a", "b"], "z": ["b"]}
    loose = {r.id: tuple(r)[1:] for r in A.category_scores(df, "id", "c", "v", sets).collect()}
    strict = {r.id: tuple(r)[1:] for r in A.category_scores(df, "id", "c", "v", sets, na_strict=True).collect()}
    assert loose == {1: (1.0, 3.0, 2.0), 2: (3.0, 3.0, None)}
    assert strict == {1: (None, None, 2.0), 2: (3.0, 3.0, None)}


def test_strict_aggregates_turn_missing(rows):
    df = rows("k int, v double", (1, 1.0), (1, None), (2, 2.0))
    assert {tuple(r) for r in A.sum_by(df, "k", "v").collect()} == {(1, None), (2, 2.0)}
    assert {tuple(r) for r in A.sum_by(df, "k", "v", na_strict=False).collect()} == {(1, 1.0), (2, 2.0)}
    total = C.row_total(rows("a int, b int", (1, 2), (1, None)), ["a", "b"])
    assert [r.total for r in total.collect()] == [3, None]


def test_sort_puts_missing_last(rows):
    df = rows("a int, b int", (None, 1), (2, None), (2, 1), (1, 5))
    assert [tuple(r) for r in K.sort_nulls_last(df, "a", "b").collect()] == [(1, 5), (2, 1), (2, None), (None, 1)]


def test_division_by_zero_is_missing(rows):
    df = rows("id int, a int, b int", (1, 1, 0), (2, 3, 2)).withColumn("q", N.safe_ratio("a", "b"))
    assert values(df, "q") == [None, 1.5]


def test_range_guard_drops_non_finite(rows):
    df = rows("x double", (-math.inf,), (math.inf,), (math.nan,), (None,), (0.0,), (5.0,), (5.1,))
    assert sorted(r.x for r in C.range_guard(df, "x", 0, 5).collect()) == [0.0, 5.0]
    assert sorted(r.x for r in df.where(N.finite("x")).collect()) == [0.0, 5.0, 5.1]


def test_levels_and_labels(rows):
    df = rows("id int, c string", (1, "b"), (2, "a"), (3, "other"), (4, None))
    levels = ["b", "a"]
    assert values(df.withColumn("p", L.level_position("c", levels)), "p") == [1, 2, None, None]
    assert values(df.withColumn("p", L.reversed_position("c", levels)), "p") == [2, 1, None, None]
    assert values(df.withColumn("p", L.as_level("c", levels)), "p") == ["b", "a", None, None]
    assert values(df.withColumn("p", L.relabel("c", {"a": "A"})), "p") == ["b", "A", "other", None]


def test_presentation_labels(rows):
    df = rows("id int, c string", (1, "BRCA Wildtype Tumor"), (2, "Biallelic Inactivation"))
    assert values(df.withColumn("m", L.multiline(L.without_word("c", "BRCA"))), "m") == [
        "Wildtype\nTumor",
        "Biallelic\nInactivation",
    ]


def test_significance_symbols(rows):
    df = rows("id int, p double", (1, 0.0), (2, 0.0001), (3, 0.001), (4, 0.01), (5, 0.05), (6, 0.5), (7, None))
    assert values(df.withColumn("s", L.significance_label("p")), "s") == ["****", "****", "***", "**", "*", "ns", None]
    assert values(df.withColumn("s", L.significance_label("p", L.SHORT_CUTPOINTS)), "s")[:3] == ["***", "***", "***"]
