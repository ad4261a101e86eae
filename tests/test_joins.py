import random
import time

import pytest
from pyspark.sql import functions as F

from cohortry.operators import joins as J
from cohortry.operators import sets as U
from conftest import as_set


@pytest.fixture()
def events(rows):
    return rows(
        "barcode string, gene string",
        ("s_C_1", "A"), ("s_C_1", "B"), ("s_C_10", "C"), ("x_s_C_10_d", "D"), ("P-7", "E"), (None, "F"), ("", "G"),
    )


def test_contains_join_equals_brute_force(rows, events):
    ids = rows("id string", ("s_C_1",), ("s_C_10",), ("s_C_1",), ("7",), ("none",), ("much longer than any text",), (None,))
    got = J.contains_join(ids, events, "id", "barcode")
    wanted = {
        (e.barcode, e.gene, i)
        for e in events.collect()
        for i in {r.id for r in ids.collect()}
        if i is not None and e.barcode is not None and i in e.barcode
    }
    assert as_set(got.select("barcode", "gene", "id")) == wanted
    assert got.count() == len(wanted)


def test_contains_join_with_repeated_letters(rows):
    texts = rows("t string", ("aaaa",), ("éaé",), ("ba",))
    ids = rows("id string", ("a",), ("aa",), ("é",), ("",))
    got = J.contained_pairs(ids, texts, "id", "t").collect()
    wanted = {(i, t) for t in ("aaaa", "éaé", "ba") for i in ("a", "aa", "é", "") if i in t}
    assert {(r.id, r.t) for r in got} == wanted and len(got) == len(wanted)


def test_containment_of_thirty_lengths_in_a_long_text(spark, rows):
    """Ids of 1 to 30 characters in a text of 200,000: the grams cut have four lengths, and chunk borders hide nothing."""
    draw = random.Random(7)
    alphabet = "ACGTü😀."
    long = "".join(draw.choice(alphabet) for _ in range(200_000))
    border = J.CHUNK_CHARS
    cuts = [(border + k, n) for n in range(1, 31) for k in (-n, -n // 2, -1, 0)]
    found = [long[at : at + n] for at, n in cuts]
    absent = ["".join(draw.choice("ACGTX") for _ in range(n)) for n in range(8, 31)]
    texts = [long, long[:40], "", "ACGT\n" * 20, None] + [draw.choice(found) + "x" for _ in range(20)]
    ids = [*found, *absent, "", "T\nA", None]
    start = time.perf_counter()
    got = J.contained_pairs(rows("id string", *((i,) for i in ids)), rows("t string", *((t,) for t in texts)), "id", "t").collect()
    assert time.perf_counter() - start < 60
    wanted = {(i, t) for i in ids for t in texts if i is not None and t is not None and i in t}
    assert {(r.id, r.t) for r in got} == wanted and len(got) == len(wanted)


def test_containment_reads_the_events_once(spark, rows, tmp_path):
    """Events are read when they are written; index and join read the written rows, with an equality join."""
    rows("barcode string, gene string", ("s_C_1_x", "a"), ("s_C_12", "b")).write.parquet(f"{tmp_path}/events")
    events = spark.read.parquet(f"{tmp_path}/events")
    joined = J.contains_join(rows("id string", ("s_C_1",)), events, "id", "barcode")
    plan = joined._jdf.queryExecution().toString()
    assert f"{tmp_path}/events" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert joined.count() == 2


def test_exact_match_is_stricter(rows, events):
    ids = rows("id string", ("s_C_1",))
    assert J.contains_join(ids, events, "id", "barcode").count() == 4
    assert J.contains_join(ids, events, "id", "barcode", match="exact").count() == 2
    with pytest.raises(ValueError):
        J.contains_join(ids, events, "id", "barcode", match="fuzzy")


def test_first_match_follows_the_order_column(rows):
    dim = rows("k string, o int, v string", ("a", 2, "late"), ("a", 1, "early"), ("b", None, "unordered"), ("b", 9, "ordered"))
    df = rows("k string", ("a",), ("b",), ("c",))
    got = as_set(J.first_match_lookup(df, dim, "k", "o", ["v"], {"v": "none"}))
    assert got == {("a", "early"), ("b", "ordered"), ("c", "none")}


def test_map_ids_takes_first_and_rewrites(rows):
    df = rows("id string, score int", ("H1", 5), ("H2", 6), ("H9", 7))
    mapping = rows("src string, dst string", ("x_H1_d", "P-1-IM6"), ("y_H1", "P-0-IM6"), ("H2", None))
    got = J.map_ids(df, mapping, "id", "src", "dst", "sample", rewrite=("IM6", "WES"))
    assert as_set(got.select("id", "score", "sample")) == {("H1", 5, "P-1-WES")}
    kept = J.map_ids(df, mapping, "id", "src", "dst", "sample", drop_unmatched=False)
    assert as_set(kept.select("id", "sample")) == {("H1", "P-1-IM6"), ("H2", None), ("H9", None)}


def test_convert_ids_keeps_unknown_forms_as_missing(rows):
    df = rows("id string", ("P-1-WES",), ("s_C_1",), ("s_C_2",), ("other",))
    mapping = rows("src string, dst string, rank int", ("s_C_1", "second", 1), ("s_C_1", "first", 0))
    got = J.convert_ids(df, mapping, "id", "src", "dst", "dmp", ["rank"], ("WES", "IM6"), "s_C_")
    assert as_set(got.select("id", "dmp")) == {("P-1-WES", "P-1-IM6"), ("s_C_1", "first"), ("s_C_2", None), ("other", None)}


def test_join_forms(rows):
    a = rows("k int, a string", (1, "x"), (1, "y"), (2, "z"))
    b = rows("k int, b string", (1, "p"), (1, "q"), (3, "r"))
    assert J.inner_join(a, b, "k").count() == 4
    assert as_set(J.left_join(a, b, "k", {"b": "none"}).where("k = 2")) == {(2, "z", "none")}
    assert as_set(J.full_outer_join(a, b, "k").where("a is null")) == {(3, None, "r")}
    assert J.semi_join(a, b, "k").count() == 2
    assert as_set(J.anti_join(a, b, "k")) == {(2, "z")}
    renamed = b.withColumnRenamed("k", "other")
    assert J.join_on(a, renamed, "k", "other").columns == ["k", "a", "b"]
    with pytest.raises(ValueError):
        J.natural_left_join(a, renamed.drop("b"))


def test_assert_unique(rows):
    df = rows("k int, v int", (1, 1), (2, 2), (2, 3))
    with pytest.raises(ValueError, match="not unique"):
        J.assert_unique(df, "k")
    assert J.assert_unique(df, ["k", "v"]) is df


def test_assembly_never_grows_and_reports_losses(rows):
    base = rows("k int", *((i,) for i in range(10)))
    tables = {"a": rows("k int, a int", *((i, i) for i in range(8))), "b": rows("k int, b int", *((i, i) for i in range(3, 12)))}
    assert J.assemble_features(base, list(tables.values()), "k").count() == 5
    assert as_set(J.assembly_report(base, tables, "k")) == {("base", 10), ("a", 8), ("b", 5)}


def test_score_lookup_keeps_every_entity(rows):
    got = J.score_lookup(rows("k int", (1,), (2,)), rows("k int, s double", (2, 0.5)), "k")
    assert as_set(got) == {(1, None), (2, 0.5)}


def test_two_cohort_union_commutes_with_grouped_aggregates(rows):
    case, control = rows("k int, v int", (1, 1), (1, 2)), rows("k int, v int", (1, 10), (2, 20))
    count = lambda df, *key: df.groupBy(*key).agg(F.sum("v").alias("s"))
    together = U.two_cohort_union(case, control, lambda df: count(df, "cohort", "k"))
    apart = {("case", *t) for t in as_set(count(case, "k"))} | {("control", *t) for t in as_set(count(control, "k"))}
    assert as_set(together) == apart


def test_union_fill_and_distinct(rows):
    a, b = rows("x int, y int", (1, 2), (1, 2)), rows("x int", (5,))
    assert as_set(U.union_fill(a, b)) == {(1, 2), (5, None)}
    assert U.distinct_rows(a).count() == 1
    assert as_set(U.distinct_entities(a, "x")) == {(1,)}


def test_hot_key_is_attached_whole(spark):
    """A third of the rows share one key; no row is lost or doubled."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = J.attach_aggregate(df, counts, "k")
    assert got.count() == 30_000
    assert got.where("k = 0").select("n").distinct().first()["n"] == 10_000
