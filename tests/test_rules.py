"""Cascades against a step-by-step evaluation, for all truth values."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators import rules as R
from cohortry.plans import tumour_cohort as P


def test_cascade_equals_sequential_rules_for_all_truth_values(spark):
    truth = (True, False, None)
    table = [(i, *combo) for i, combo in enumerate(itertools.product(truth, repeat=4))]
    df = spark.createDataFrame(table, "id int, c1 boolean, c2 boolean, c3 boolean, c4 boolean")
    rules = [(F.col(f"c{k}"), f"v{k}") for k in range(1, 5)]
    got = {r.id: r.out for r in R.rule_cascade(df, "out", rules, "default").collect()}
    for i, *conditions in table:
        expected = "default"
        for k, c in enumerate(conditions, 1):
            expected = None if c is None else (f"v{k}" if c else expected)
        assert got[i] == expected, conditions


@pytest.mark.parametrize("n_rules", [0, 1, 4, 63, 64, 130])
def test_coverage_equals_counting_row_by_row(spark, n_rules):
    """Three-valued conditions drawn at random; masks are split into words of 63 rules."""
    draw = random.Random(n_rules)
    table = [(i, [draw.choice((True, False, False, None, False)) for _ in range(n_rules)]) for i in range(200)]
    df = spark.createDataFrame(table * 2, "id int, c array<boolean>")
    rules = [(F.col("c")[k], f"v{k + 1}") for k in range(n_rules)]
    expected = {k: [0] * 5 for k in range(n_rules + 1)}
    for _, found in table * 2:
        found = [True, *found]
        last = max(k for k, f in enumerate(found) if f is not False)
        for k, f in enumerate(found):
            flags = (f is True, f is None, f is True and k == last, f is None and k == last, f is True and k < last)
            expected[k] = [n + flag for n, flag in zip(expected[k], flags, strict=True)]
    got = R.rule_coverage(df, rules, "none").collect()
    assert {r.rule: [r.hits, r.unknown, r.decided, r.erased, r.shadowed] for r in got} == expected
    assert [r.value for r in got] == ["none", *(v for _, v in rules)]
    assert all(r.decided == r.hits == 0 for r in R.rule_coverage(df.limit(0), rules, "none").collect())


def test_cascade_without_rules_gives_the_default(spark):
    assert R.rule_cascade(spark.range(1), "out", [], "d").first()["out"] == "d"


def conj(*parts):
    """AND of three-valued conditions."""
    if any(p is False for p in parts):
        return False
    return None if any(p is None for p in parts) else True


def eq(a, b):
    return None if a is None else a == b


def ne(a, b):
    return None if a is None else a != b


def has(text, word):
    return text is not None and word in text


def expected_broad(z, g, s, p):
    """The broad classes written as an if-chain over the situation of one sample."""
    steps = [
        (conj(p == 0, eq(z, "AI_LOH_ALT"), has(g, "BRCA")), P.BIALLELIC),
        (eq(z, "Germline Deletion Rare Case"), P.GERMLINE_DELETION),
        (conj(eq(z, "None"), has(g, "BRCA"), p == 0), P.MONO_GERMLINE),
        (conj(eq(z, "AI_LOH_REF"), has(g, "BRCA"), p == 0), P.MONO_GERMLINE),
        (conj(eq(z, "AI_LOH_REF"), has(g, "BRCA"), p == 1), P.BIALLELIC),
        (conj(eq(z, "None"), eq(g, "WT"), eq(s, "WT")), P.WILDTYPE),
        (conj(eq(z, "None"), eq(g, "WT"), p == 1), P.MONO_SOMATIC),
        (conj(eq(g, "Unknown"), eq(z, "None"), p == 1), P.MONO_SOMATIC),
        (conj(eq(z, "AI_LOH_ALT"), eq(g, "WT"), p == 1), P.BIALLELIC),
        (conj(eq(z, "AI_LOH_ALT"), eq(g, "Unknown"), p == 1), P.BIALLELIC),
        (conj(eq(z, "subclonal"), p >= 1), P.SUBCLONAL),
        (conj(eq(z, "AI_ALT"), eq(g, "Unknown"), p == 1), P.MONO_SOMATIC),
        (conj(eq(z, "AI_ALT"), p == 0, has(g, "BRCA")), P.MONO_GERMLINE),
        (conj(eq(z, "AI_ALT"), p == 0, not has(g, "BRCA")), P.WILDTYPE),
        (conj(eq(z, "AI_REF"), eq(g, "Unknown"), p == 1), P.MONO_SOMATIC),
        (conj(eq(z, "AI_REF"), s is None), P.MONO_GERMLINE),
        (conj(eq(z, "Homozygous Deletion"), has(s, "BRCA")), P.BIALLELIC),
        (conj(eq(z, "AI_LOH_ALT"), p > 1, eq(g, "WT")), P.BIALLELIC),
        (conj(eq(z, "AI_LOH_ALT"), p > 1, eq(g, "Unknown")), P.BIALLELIC),
        (conj(eq(z, "AI_LOH_ALT"), p == 1, has(g, "BRCA")), P.BIALLELIC),
        (conj(eq(z, "None"), has(g, "BRCA"), p == 1), P.BIALLELIC),
    ]
    return apply_steps(steps)


def apply_steps(steps):
    out = P.OTHERS
    for condition, value in steps:
        out = None if condition is None else (value if condition else out)
    return out


def expected_detail(t, z, g, s, p1, p2):
    bi, loh = eq(t, P.BIALLELIC), eq(z, "AI_LOH_ALT")
    b1, b2, none = has(g, "BRCA1"), has(g, "BRCA2"), not has(g, "BRCA")
    return apply_steps(
        [
            (conj(bi, eq(s, "Deletion BRCA1")), "Homodels BRCA1"),
            (conj(bi, eq(s, "Deletion BRCA2")), "Homodels BRCA2"),
            (conj(bi, p1 == 0, b1, loh), "Germline BRCA1 + LOH"),
            (conj(bi, p2 == 0, b2, loh), "Germline BRCA2 + LOH"),
            (conj(bi, p2 == 1, b2, loh), "Germline BRCA2 + LOH"),
            (conj(bi, p1 >= 1, none, loh), "Somatic BRCA1 + LOH"),
            (conj(bi, p2 >= 1, none, loh), "Somatic BRCA2 + LOH"),
            (conj(bi, p2 == 1, b2, ne(z, "AI_LOH_ALT")), "Germline BRCA2 + second mutation"),
            (conj(eq(t, P.MONO_GERMLINE), b1, p1 == 0), "Monoallelic BRCA1 Germline Inactivation"),
            (conj(eq(t, P.MONO_GERMLINE), b2, p2 == 0), "Monoallelic BRCA2 Germline Inactivation"),
            (conj(eq(t, P.MONO_SOMATIC), p1 >= 1), "Monoallelic BRCA1 Somatic Inactivation"),
            (conj(eq(t, P.MONO_SOMATIC), p2 >= 1), "Monoallelic BRCA2 Somatic Inactivation"),
            (conj(eq(t, P.SUBCLONAL), p1 >= 1), "Subclonal BRCA1 Inactivation"),
            (conj(eq(t, P.SUBCLONAL), p2 >= 1), "Subclonal BRCA2 Inactivation"),
            (eq(t, P.WILDTYPE), "BRCA Wildtype Tumor"),
            (conj(eq(t, P.GERMLINE_DELETION), b1), "BRCA1 Germline Deletion"),
        ]
    )


def test_tumour_classes_over_the_whole_domain(spark):
    zygosities = [
        "AI_LOH_ALT", "AI_LOH_REF", "AI_ALT", "AI_REF", "subclonal", "None",
        "Homozygous Deletion", "Germline Deletion Rare Case", None,
    ]
    germlines = ["WT", "Unknown", "p.A1 BRCA1", "p.A1 BRCA2", "p.A1 BRCA1,p.B2 BRCA2", None]
    somatics = ["WT", "Deletion BRCA1", "Deletion BRCA2", "p.C3 BRCA2", "p.D4 TP53", None]
    counts = [(a, b) for a in range(3) for b in range(3)]
    domain = [
        (f"s{i}", g, s, z, p1, p2)
        for i, (z, g, s, (p1, p2)) in enumerate(itertools.product(zygosities, germlines, somatics, counts))
    ]
    samples = spark.createDataFrame(
        [d[:4] for d in domain], "sample string, Germline_mutation string, Somatic_mutation string, Tumor_zygosity string"
    )
    calls = [
        (d[0], gene, "Splice_Site") for d in domain for gene, n in (("BRCA1", d[4]), ("BRCA2", d[5])) for _ in range(n)
    ] + [(d[0], "BRCA1", "Silent") for d in domain[:50]]
    mutations = spark.createDataFrame(calls, "Tumor_Sample_Barcode string, Hugo_Symbol string, Variant_Classification string")
    got = {r["sample"]: (r.pattern, r.detailed_pattern) for r in P.classify(samples, mutations).collect()}
    for sample, g, s, z, p1, p2 in domain:
        broad = expected_broad(z, g, s, p1 + p2)
        detail = expected_detail(broad, z, g, s, p1, p2)
        assert got[sample] == (broad if broad in P.CLASS_LEVELS else None, detail), (z, g, s, p1, p2)


def test_refine_and_mechanism(rows):
    df = rows("id int, c string, d string", (1, "B", "Germline x"), (2, "B", None), (3, "W", "Germline"), (4, None, "Germline"))
    got = {r.id: r.o for r in R.refine_class(df, "c", "B", "d", {"Germline": "GB"}, "o").collect()}
    assert got == {1: "GB", 2: "B", 3: "W", 4: None}
    scores = rows(
        "id int, i double, m double, a double, p double",
        (1, 9.0, 0.6, 0.1, 0.1), (2, 9.0, 0.6, 0.5, 0.1), (3, 9.0, 0.6, 0.5, 0.5),
        (4, 1.0, 0.6, 0.1, 0.1), (5, 9.0, None, 0.1, 0.1), (6, 9.0, 0.6, None, 0.6),
    )
    got = {r.id: r.o for r in R.propose_mechanism(scores, "o", "i", 5.0, "m", "a", "p").collect()}
    assert got == {
        1: "MSI High", 2: "APOBEC Mutation", 3: "POLE Mutation", 4: "Unknown Significance", 5: None, 6: "POLE Mutation",
    }
