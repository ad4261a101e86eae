"""The tumour cohort on small hand-made tables covering the value domains."""

import math

import pytest
from pyspark.sql import functions as F

from cohortry.plans import tumour_cohort as P
from cohortry.session import materialise
from cohortry.sources import schemas as S

M = "p.M1"


@pytest.fixture(scope="module")
def inputs(spark):
    def table(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    def call(sample, gene, effect="Splice_Site", kind="DEL", protein="p.X", coding="c.X"):
        return (sample, gene, protein, coding, effect, kind)

    def clinical(sample, brca, consent="YES", kind="point", qc=None, cancer="Breast Cancer"):
        return (sample, f"dmp-{sample}", qc, consent, brca, kind, "Deletion", "BRCA1", cancer)

    case = ["s1", "s2", "s3", "s4", "s5", "s_C_6", "s7", "s8"]
    control = ["P-1-WES", "P-2-WES"]
    everyone = [*case, *control]
    return P.CohortInputs(
        mutations=table(
            S.MUTATIONS,
            call("s1", "BRCA2", protein="p.Q"),
            call("s10", "BRCA1", protein="p.R"),  # the id s1 is contained in s10
            call("s3", "BRCA1", "Silent", "SNP"),
            call("s5", "BRCA1", coding="c.9del"),
            call("s2", "POLE", "Missense_Mutation", "INS", "p.P286R"),
            call("s2", "POLE2", "Missense_Mutation", "INS", "p.V411L"),
            *(call(s, "TP53", "Silent", "DEL") for s in case),
        ),
        control_mutations=table(
            S.MUTATIONS,
            *(call(s, "TP53", "Silent", "INS") for s in [*control, *P.EXCLUDED_CONTROLS[:2]]),
        ),
        variants=table(
            S.VARIANTS,
            ("s1", "Germline", "p.G", "BRCA1", "AI_LOH_ALT"),
            ("s2", "Somatic", "p.S", "BRCA2", "AI_ALT"),
            ("s2", "Somatic", "p.S", "BRCA2", "None"),
            ("s7", "Somatic", "p.T", "BRCA1", None),
        ),
        clinical=table(
            S.CLINICAL,
            clinical("s1", "Germline"),
            clinical("s2", "Somatic", "NO", cancer="Ovarian Cancer"),
            clinical("s3", "WT", cancer="Glioma"),
            clinical("s4", "Somatic", kind="deletion"),
            clinical("s5", "Germline", kind="deletion"),
            clinical("s_C_6", "WT"),
            clinical("s7", "Somatic,Somatic"),
            clinical("s8", "WT", qc="failed"),
        ),
        control_clinical=table(S.CONTROL_CLINICAL, *((s, "Melanoma") for s in control)),
        signatures=table(
            S.SIGNATURES,
            *((s, "Signature.3", 0.25) for s in case),
            *((s, "Signature.8", 0.5) for s in case if s != "s4"),
            ("s2", "Signature.6", 0.3), ("s2", "Signature.20", 0.3), ("s2", "Signature.2", 0.1), ("s2", "Signature.10", 0.1),
        ),
        control_signatures=table(S.SIGNATURES, *((s, k, 0.1) for s in control for k in ("Signature.3", "Signature.8"))),
        spectrum=table("Tumor_Sample_Barcode string, A int, B int, C int", *((s, 2, 1, 1) for s in case if s not in ("s2", "s4")), ("s2", 4000, 90, 6), ("s4", 0, 0, 0)),
        control_spectrum=table("Tumor_Sample_Barcode string, A int", *((s, 8) for s in control)),
        msi=table(S.MSI, ("dmp-s_C_6", 1.0)),
        id_mapping=table(S.ID_MAPPING, ("xx_h1_yy", "P-1-IM6"), ("h2", None)),
        microhomology=table(S.MICROHOMOLOGY, *((s, n) for s in case for n in (10, 11))),
        control_microhomology=table(S.MICROHOMOLOGY, *((s, 30) for s in control)),
        ntai=table(S.NTAI, *((s, i) for i, s in enumerate(case))),
        control_ntai=table(S.NTAI, ("h1", 9), ("h2", 8), ("h3", 7)),
        lst=table(S.LST, *((s, 2 * i) for i, s in enumerate(case))),
        control_lst=table(S.LST, ("h1", 3)),
        hrd_loh=table(S.HRD_LOH, *((s, 10 - i) for i, s in enumerate(case))),
        control_hrd_loh=table(S.HRD_LOH, ("h1", 4)),
    ), everyone


@pytest.fixture(scope="module")
def annotated(inputs):
    return materialise(P.annotate(inputs[0], P.KNOWN_DUPLICATE, P.EXCLUDED_CONTROLS))


def test_texts_zygosity_and_classes(annotated):
    got = {tuple(r) for r in annotated.select("sample", "Germline_mutation", "Somatic_mutation", "Tumor_zygosity", "pattern").collect()}
    assert got == {
        ("s1", "p.G BRCA1", "p.Q BRCA2", "AI_LOH_ALT", P.BIALLELIC),
        ("s10", None, "p.R BRCA1", None, None),
        ("s2", "Unknown", "p.S BRCA2", "AI_ALT", P.WILDTYPE),
        ("s2", "Unknown", "p.S BRCA2", "None", None),
        ("s7", "WT", "p.T BRCA1", None, None),
        ("s3", "WT", "WT", "None", P.WILDTYPE),
        ("s4", None, "Deletion BRCA1", "Homozygous Deletion", P.BIALLELIC),
        ("s5", "Deletion BRCA1", "c.9del BRCA1", "Germline Deletion Rare Case", P.GERMLINE_DELETION),
        ("s_C_6", "WT", "WT", "None", P.WILDTYPE),
        ("P-1-WES", "WT", "WT", "None", P.WILDTYPE),
        ("P-2-WES", "WT", "WT", "None", P.WILDTYPE),
    }


def test_exact_matching_leaves_out_the_longer_id(inputs):
    labels = {r["sample"] for r in P.somatic_labels(inputs[0], match="exact").collect()}
    assert labels == {"s1", "s2", "s7"}


def test_details(annotated):
    got = {r["sample"]: r.detailed_pattern for r in annotated.where("pattern is not null").collect()}
    assert got["s4"] == "Homodels BRCA1"
    # n_BRCA1 = 0 with a BRCA1 germline text and loss of the other allele
    assert got["s1"] == "Germline BRCA1 + LOH"
    assert got["s5"] == "BRCA1 Germline Deletion"
    assert got["P-1-WES"] == "BRCA Wildtype Tumor"


def test_known_duplicate_is_dropped(spark, inputs):
    x = inputs[0]
    dropped = P.annotate(x, drop_known=("s2", "None"))
    assert dropped.where("sample = 's2'").count() == 1
    # an unknown zygosity makes the condition unknown, which drops the row as well
    assert P.annotate(x, drop_known=("s7", "None")).where("sample = 's7'").count() == 0


def test_nothing_is_excluded_unless_asked(inputs):
    kept = {r["sample"] for r in P.annotate(inputs[0]).collect()}
    assert set(P.EXCLUDED_CONTROLS[:2]) <= kept
    assert not set(P.EXCLUDED_CONTROLS) & {r["sample"] for r in P.annotate(inputs[0], excluded=P.EXCLUDED_CONTROLS).collect()}


def test_measures(inputs, annotated):
    x, _ = inputs
    got = {r["sample"]: r for r in P.measured_samples(annotated, x).where("coalesce(Tumor_zygosity, '') <> 'AI_ALT'").collect()}
    assert got["s1"].signature_3_activity == 1.0 and got["s1"].Total_Mutational_Burdens == 2.0
    assert got["s4"].Total_Mutational_Burdens == -math.inf and got["s4"].signature_8_percentage is None
    assert got["s1"].Total_Indel_log2 == 1.0  # two deletions
    assert got["s1"].Microhomology_Percent == 0.5
    assert (got["P-1-WES"].NtAI, got["P-1-WES"].LST, got["P-1-WES"].HRD_LOH) == (9, 3, 4)
    assert got["P-2-WES"].NtAI is None
    assert got["s10"].signature_3_percentage is None


def test_hypermutation_and_mechanism(inputs, annotated):
    got = P.hypermutation(annotated.where("coalesce(Tumor_zygosity, '') <> 'None' or sample <> 's2'"), inputs[0])
    rows = {r["sample"]: r for r in got.collect()}
    s2 = rows["s2"]
    assert s2.is_hypermutated and s2.POLE_Somatic_Mutation == "p.P286R" and s2.DMP_ID is None and s2.MSI_SCORE == 0.04
    assert s2.Proposed_mechanism == "Unknown Significance"
    assert rows["s1"].Proposed_mechanism == "nonhypermutated tumor"
    lowered = P.hypermutation(annotated, inputs[0], msi_cutoff=0.01)
    assert {r.Proposed_mechanism for r in lowered.where("sample = 's2'").collect()} == {"MSI High"}


def test_model_table_needs_every_feature(inputs, annotated):
    got = {r["sample"] for r in P.model_table(annotated, inputs[0]).collect()}
    assert got == {"s1", "s2", "s3", "s5", "s_C_6", "s7", "P-1-WES"}


def test_report_covers_all_comparisons(inputs, annotated):
    measured = materialise(P.measured_samples(annotated, inputs[0]))
    report = P.cohort_report(measured).toPandas()
    assert len(P.cohort_comparisons()) == 16
    activity = report[(report.metric == "signature 3 activity") & (report.scope == "all")].set_index("class")
    # s2 (activity 1024) lies outside 0-510 and leaves its class
    assert activity.loc[P.WILDTYPE, "n"] == 4 and activity.loc[P.BIALLELIC, "n"] == 2
    refined = report[report.scope == "refined classes"]
    assert {"Germline Biallelic Inactivation", "Homozygous Deletion"} <= set(refined["class"])
    pairs = {r.pair: r for r in P.scar_correlations(measured).collect()}
    assert set(pairs) == {"NtAI ~ LST", "NtAI ~ HRD_LOH"} and pairs["NtAI ~ HRD_LOH"].rho < 0 < pairs["NtAI ~ LST"].rho


def test_counts_and_subset(inputs, annotated):
    x, _ = inputs
    counts = {r.pattern: r.n for r in P.class_counts(annotated)["pattern"].collect()}
    levels = {r.pattern: r.level for r in P.class_counts(annotated)["pattern"].collect()}
    assert levels == {P.WILDTYPE: 6, P.BIALLELIC: 5, P.GERMLINE_DELETION: 2, None: 7}
    assert counts == {P.WILDTYPE: 5, P.BIALLELIC: 2, P.GERMLINE_DELETION: 1, None: 3}
    kinds = {r.Cancer_Type: (r.n, r.level) for r in P.cancer_type_counts(annotated, x).collect()}
    assert kinds == {"Others": (10, 1)}
    assert P.monoallelic_subset(annotated).count() == 0


def test_ids_can_be_normalised(inputs):
    x = P.normalise_ids(inputs[0], lambda c: F.replace(c, F.lit("s_C_"), F.lit("case-")))
    assert "case-6" in {r["sample"] for r in P.merged_samples(x).collect()}


def test_derived_cohort_reaches_every_rule_and_class(spark):
    """No rule, class or mechanism of the test tables is empty, nor are the excluded and the duplicate rows."""
    from cohortry.catalog import cohort as C
    from cohortry.catalog.registry import Tables

    x = C.cohort_inputs(Tables(spark, "/root/testdata/sf0.01"))
    coverage = P.rule_coverage(x, P.KNOWN_DUPLICATE, P.EXCLUDED_CONTROLS).collect()
    sizes = {name: sum(r.cascade == name for r in coverage) for name in ("broad", "detailed", "mechanism")}
    assert sizes == {"broad": 22, "detailed": 17, "mechanism": 4}
    assert all(r.decided > 0 for r in coverage), [r for r in coverage if not r.decided]
    whole, kept = materialise(P.annotate(x)), materialise(C.annotated_rows(x))
    assert {r["pattern"] for r in kept.select("pattern").distinct().collect()} == {*P.CLASS_LEVELS, None}
    sample, zygosity = P.KNOWN_DUPLICATE
    named = f"sample = '{sample}'"
    assert whole.where(f"{named} and Tumor_zygosity = '{zygosity}'").count() == 1
    assert kept.where(named).count() == whole.where(named).count() - 1 > 0
    excluded = F.col("sample").isin(P.EXCLUDED_CONTROLS)
    assert (whole.where(excluded).count(), kept.where(excluded).count()) == (len(P.EXCLUDED_CONTROLS), 0)
