"""Tumour cohort analysis: annotate samples, explain outliers, compare classes, train and score.

Inputs are tables (see ``sources.schemas``); all results are DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.labels import SHORT_CUTPOINTS, as_level, level_position, multiline
from cohortry.functions.nulls import in_list, log2_inf, matches, na_ifelse, not_in_list, paste_na
from cohortry.operators import aggregates as A
from cohortry.operators import comparisons as T
from cohortry.operators import joins as J
from cohortry.operators import model as M
from cohortry.operators import ranking as K
from cohortry.operators import rules as R
from cohortry.operators import sets as U
from cohortry.operators.columns import cohort_scope
from cohortry.session import materialise
from cohortry.sources.delimited import write_delimited
from cohortry.sources.schemas import read_tables

# --- Fixed values -----------------------------------------------------------------

WILDTYPE = "BRCA Wildtype Tumor"
BIALLELIC = "Biallelic Inactivation"
MONO_GERMLINE = "Monoallelic Germline Inactivation"
MONO_SOMATIC = "Monoallelic Somatic Inactivation"
GERMLINE_DELETION = "Germline Deletion"
SUBCLONAL = "Subclonal BRCA Inactivation"
OTHERS = "Others"

CLASS_LEVELS = [WILDTYPE, BIALLELIC, MONO_GERMLINE, MONO_SOMATIC, GERMLINE_DELETION, SUBCLONAL]

REFINED_PARTS = {
    "Germline": "Germline Biallelic Inactivation",
    "Somatic": "Somatic Biallelic Inactivation",
    "Homodels": "Homozygous Deletion",
}
REFINED_LEVELS = [
    WILDTYPE,
    "Germline Biallelic Inactivation",
    "Somatic Biallelic Inactivation",
    "Homozygous Deletion",
    MONO_GERMLINE,
    MONO_SOMATIC,
    GERMLINE_DELETION,
    SUBCLONAL,
]

CANCER_LEVELS = [
    "Ovarian Cancer",
    "Breast Cancer",
    "Bladder Cancer",
    "Colorectal Cancer",
    "Glioma",
    "Non-Small Cell Lung Cancer",
    "Prostate Cancer",
    "Endometrial Cancer",
    "Melanoma",
    "Hepatobiliary Cancer",
    "Rare Case Cancer",
    "Cancer of Unknown Primary",
    "Pancreatic Cancer",
    "Soft Tissue Sarcoma",
]
SCOPE_TYPES = ["Breast Cancer", "Prostate Cancer", "Ovarian Cancer"]
RARE_LABEL = "Rare Case Cancer"
RARE_BELOW = 15

PATHOGENIC = [
    "Frame_Shift_Ins",
    "Nonsense_Mutation",
    "Frame_Shift_Del",
    "Translation_Start_Site",
    "Nonstop_Mutation",
    "Splice_Site",
]
INDEL_TYPES = ["DEL", "INS"]

EXCLUDED_CONTROLS = [
    "P-0020647-T01-WES",
    "P-0021156-T01-WES",
    "P-0021154-T01-WES",
    "P-0009423-T02-WES",
    "P-0021254-T01-WES",
    "P-0021100-T01-WES",
    "P-0020719-T01-WES",
    "P-0020399-T01-WES",
    "P-0020831-T01-WES",
    "P-0020791-T01-WES",
    "P-0020841-T01-WES",
    "P-0014885-T02-WES",
    "P-0020633-T01-WES",
    "P-0020639-T01-WES",
    "P-0020673-T01-WES",
    "P-0020668-T01-WES",
]
KNOWN_DUPLICATE = ("s_C_001261_T001_d", "subclonal")  # sample and zygosity of the row to drop

SIGNATURE_GROUPS = {
    "MMR_Signature_Percentage": ["Signature.6", "Signature.15", "Signature.20", "Signature.26"],
    "APOBEC_Score": ["Signature.2", "Signature.13"],
    "POLE_Score": ["Signature.10"],
}
HOTSPOT_GENE = "POLE"
HOTSPOT_RESIDUES = ["P286", "V411"]
NO_HOTSPOT = "POLE Somatic WT"
DEFAULT_MSI = 0.04
HOMOLOGY_ABOVE = 10

MODEL_FEATURES = [
    "Total_Mutational_Burdens",
    "Total_Indel_log2",
    "signature_3_percentage",
    "signature_8_percentage",
    "LST",
    "HRD_LOH",
    "NtAI",
    "Microhomology_Percent",
]

# Broad classes, in order; the last rule that applies decides.
# class, zygosity, germline text, somatic text, pathogenic events
BROAD_RULES = (
    (BIALLELIC, "AI_LOH_ALT", "mutated", None, "none"),
    (GERMLINE_DELETION, "Germline Deletion Rare Case", None, None, None),
    (MONO_GERMLINE, "None", "mutated", None, "none"),
    (MONO_GERMLINE, "AI_LOH_REF", "mutated", None, "none"),
    (BIALLELIC, "AI_LOH_REF", "mutated", None, "one"),
    (WILDTYPE, "None", "WT", "WT", None),
    (MONO_SOMATIC, "None", "WT", None, "one"),
    (MONO_SOMATIC, "None", "Unknown", None, "one"),
    (BIALLELIC, "AI_LOH_ALT", "WT", None, "one"),
    (BIALLELIC, "AI_LOH_ALT", "Unknown", None, "one"),
    (SUBCLONAL, "subclonal", None, None, "some"),
    (MONO_SOMATIC, "AI_ALT", "Unknown", None, "one"),
    (MONO_GERMLINE, "AI_ALT", "mutated", None, "none"),
    (WILDTYPE, "AI_ALT", "not mutated", None, "none"),
    (MONO_SOMATIC, "AI_REF", "Unknown", None, "one"),
    (MONO_GERMLINE, "AI_REF", None, "missing", None),
    (BIALLELIC, "Homozygous Deletion", None, "mutated", None),
    (BIALLELIC, "AI_LOH_ALT", "WT", None, "several"),
    (BIALLELIC, "AI_LOH_ALT", "Unknown", None, "several"),
    (BIALLELIC, "AI_LOH_ALT", "mutated", None, "one"),
    (BIALLELIC, "None", "mutated", None, "one"),
)

# Detailed patterns, in order.
# pattern, broad class, gene, zygosity, germline text, somatic text, pathogenic events in the gene
DETAIL_RULES = (
    ("Homodels BRCA1", BIALLELIC, None, None, None, "Deletion BRCA1", None),
    ("Homodels BRCA2", BIALLELIC, None, None, None, "Deletion BRCA2", None),
    ("Germline BRCA1 + LOH", BIALLELIC, "BRCA1", "AI_LOH_ALT", "gene mutated", None, "none"),
    ("Germline BRCA2 + LOH", BIALLELIC, "BRCA2", "AI_LOH_ALT", "gene mutated", None, "none"),
    ("Germline BRCA2 + LOH", BIALLELIC, "BRCA2", "AI_LOH_ALT", "gene mutated", None, "one"),
    ("Somatic BRCA1 + LOH", BIALLELIC, "BRCA1", "AI_LOH_ALT", "not mutated", None, "some"),
    ("Somatic BRCA2 + LOH", BIALLELIC, "BRCA2", "AI_LOH_ALT", "not mutated", None, "some"),
    ("Germline BRCA2 + second mutation", BIALLELIC, "BRCA2", "not AI_LOH_ALT", "gene mutated", None, "one"),
    ("Monoallelic BRCA1 Germline Inactivation", MONO_GERMLINE, "BRCA1", None, "gene mutated", None, "none"),
    ("Monoallelic BRCA2 Germline Inactivation", MONO_GERMLINE, "BRCA2", None, "gene mutated", None, "none"),
    ("Monoallelic BRCA1 Somatic Inactivation", MONO_SOMATIC, "BRCA1", None, None, None, "some"),
    ("Monoallelic BRCA2 Somatic Inactivation", MONO_SOMATIC, "BRCA2", None, None, None, "some"),
    ("Subclonal BRCA1 Inactivation", SUBCLONAL, "BRCA1", None, None, None, "some"),
    ("Subclonal BRCA2 Inactivation", SUBCLONAL, "BRCA2", None, None, None, "some"),
    ("BRCA Wildtype Tumor", WILDTYPE, None, None, None, None, None),
    ("BRCA1 Germline Deletion", GERMLINE_DELETION, "BRCA1", None, "gene mutated", None, None),
)

# --- End of fixed values ----------------------------------------------------------

EVENT_PATTERNS = {"n_BRCA": "BRCA", "n_BRCA1": "BRCA1", "n_BRCA2": "BRCA2"}


@dataclass(frozen=True)
class CohortInputs:
    """Case and control input tables."""

    mutations: DataFrame
    control_mutations: DataFrame
    variants: DataFrame
    clinical: DataFrame
    control_clinical: DataFrame
    signatures: DataFrame
    control_signatures: DataFrame
    spectrum: DataFrame
    control_spectrum: DataFrame
    msi: DataFrame
    id_mapping: DataFrame
    microhomology: DataFrame
    control_microhomology: DataFrame
    ntai: DataFrame
    control_ntai: DataFrame
    lst: DataFrame
    control_lst: DataFrame
    hrd_loh: DataFrame
    control_hrd_loh: DataFrame


def cohort_from_files(spark: SparkSession, files: Mapping[str, str | list[str]], **options) -> CohortInputs:
    """Inputs from one delimited file (or list of files) per field of ``CohortInputs``.

    Files may hold further columns in any order.
    """
    return CohortInputs(**read_tables(spark, files, **options))


def normalise_ids(x: CohortInputs, convert: Callable[[Column], Column]) -> CohortInputs:
    """Apply a caller's sample-id expression where ids come from other naming schemes."""
    return CohortInputs(
        **{
            **vars(x),
            "variants": x.variants.withColumn("sample", convert(F.col("sample"))),
            "clinical": x.clinical.withColumn("CMO_ID", convert(F.col("CMO_ID"))),
            "id_mapping": x.id_mapping.withColumn("SAMPLE_ID", convert(F.col("SAMPLE_ID"))),
        }
    )


def passing_clinical(x: CohortInputs) -> DataFrame:
    """Clinical rows without a quality remark, keyed by ``sample``."""
    return x.clinical.where(F.col("Sample_QC").isNull()).withColumnRenamed("CMO_ID", "sample")


# --- Annotation ---------------------------------------------------------------------


def _labelled(df: DataFrame, out: str, text: Column | str, rank: int) -> DataFrame:
    value = F.lit(text) if isinstance(text, str) else text
    return df.select("sample", value.alias(out), F.lit(rank).alias("__rank"))


def _mutation_text() -> Column:
    return paste_na("HGVSp_Short", "Hugo_Symbol")


def germline_labels(x: CohortInputs) -> DataFrame:
    """WT or Unknown for samples with somatic variants only, by consent; else the mutation texts."""
    covered = J.semi_join(passing_clinical(x), x.variants, "sample")
    somatic_only = covered.where(in_list("BRCA_Type", ["Somatic", "Somatic,Somatic"]))
    consent = F.col("12_245_PartC_Consented")
    mutated = x.variants.where(in_list("BRCA_Type", ["Germline", "Germline,Somatic"]))
    labels = U.union_by_name(
        _labelled(somatic_only.where(consent == "YES"), "Germline_mutation", "WT", 0),
        _labelled(somatic_only.where(consent == "NO"), "Germline_mutation", "Unknown", 1),
        _labelled(mutated, "Germline_mutation", _mutation_text(), 2),
    )
    return A.concat_by(labels, "sample", "Germline_mutation", "__rank")


def brca_mutations(x: CohortInputs) -> DataFrame:
    return x.mutations.where(matches("Hugo_Symbol", "BRCA1") | matches("Hugo_Symbol", "BRCA2"))


def somatic_labels(x: CohortInputs, match: str = "contains") -> DataFrame:
    """Mutation texts from the annotated variants, then from the matching mutation calls."""
    annotated = x.variants.where(in_list("BRCA_Type", ["Somatic", "Germline,Somatic"]))
    ids = x.variants.select(F.col("sample").alias("__id"))
    called = J.contains_join(ids, brca_mutations(x), "__id", "Tumor_Sample_Barcode", match)
    called = called.withColumnRenamed("Tumor_Sample_Barcode", "sample")
    labels = U.union_by_name(
        _labelled(annotated, "Somatic_mutation", _mutation_text(), 0),
        _labelled(called, "Somatic_mutation", _mutation_text(), 1),
    )
    return A.concat_by(labels, "sample", "Somatic_mutation", "__rank")


def uncovered_samples(x: CohortInputs) -> DataFrame:
    """Samples without annotated variants: deletions and wildtypes known from the clinical table."""
    rest = J.anti_join(passing_clinical(x), x.variants, "sample")
    deleted = F.col("Variant_Type") == "deletion"
    nothing = F.lit(None).cast("string")
    columns = ("sample", "Germline_mutation", "Somatic_mutation", "Tumor_zygosity")
    homozygous = rest.where((F.col("BRCA_Type") == "Somatic") & deleted).select(
        "sample", nothing, _mutation_text(), F.lit("Homozygous Deletion")
    )
    wildtype = rest.where(F.col("BRCA_Type") == "WT").select("sample", F.lit("WT"), F.lit("WT"), F.lit("None"))
    germline = rest.where((F.col("BRCA_Type") == "Germline") & deleted).select(
        "sample", _mutation_text().alias("Germline_mutation")
    )
    called = brca_mutations(x).select(
        F.col("Tumor_Sample_Barcode").alias("sample"), F.col("HGVSc").alias("__c"), F.col("Hugo_Symbol").alias("__g")
    )
    germline = J.first_match_lookup(germline, called, "sample", [F.col("__c"), F.col("__g")], ["__c", "__g"])
    found = F.col("__g").isNotNull()
    germline = germline.select(
        "sample", "Germline_mutation", F.when(found, paste_na("__c", "__g")), F.lit("Germline Deletion Rare Case")
    )
    return U.union_by_name(*(part.toDF(*columns) for part in (homozygous, wildtype, germline)))


def control_samples(x: CohortInputs, excluded: Sequence[str] = ()) -> DataFrame:
    """Every control sample outside the exclusion list, as wildtype; the analysis passes ``EXCLUDED_CONTROLS``."""
    kept = x.control_mutations.where(not_in_list("Tumor_Sample_Barcode", excluded))
    return U.distinct_entities(kept, "Tumor_Sample_Barcode").select(
        F.col("Tumor_Sample_Barcode").alias("sample"),
        F.lit("WT").alias("Germline_mutation"),
        F.lit("WT").alias("Somatic_mutation"),
        F.lit("None").alias("Tumor_zygosity"),
    )


def merged_samples(x: CohortInputs, excluded: Sequence[str] = ()) -> DataFrame:
    """One row per sample and zygosity flag with its germline and somatic texts."""
    zygosity = x.variants.select("sample", F.col("zygosity_flag").alias("Tumor_zygosity"))
    covered = J.full_outer_join(germline_labels(x), somatic_labels(x), "sample")
    covered = J.full_outer_join(covered, zygosity, "sample")
    case = U.distinct_rows(U.union_by_name(covered, uncovered_samples(x)))
    return U.union_by_name(case, control_samples(x, excluded))


def _germline_is(token: str, gene: str | None) -> Column:
    text = F.col("Germline_mutation")
    if token == "mutated":
        return matches(text, "BRCA")
    if token == "not mutated":
        return ~matches(text, "BRCA")
    if token == "gene mutated":
        return matches(text, gene)
    return text == token


def _somatic_is(token: str) -> Column:
    text = F.col("Somatic_mutation")
    if token == "missing":
        return text.isNull()
    if token == "mutated":
        return matches(text, "BRCA")
    return text == token


def _zygosity_is(token: str) -> Column:
    if token.startswith("not "):
        return F.col("Tumor_zygosity") != token.removeprefix("not ")
    return F.col("Tumor_zygosity") == token


def _events_are(token: str, gene: str | None) -> Column:
    n = F.col(f"n_{gene or 'BRCA'}")
    return {"none": n == 0, "one": n == 1, "some": n >= 1, "several": n > 1}[token]


def _all(conditions: list[Column]) -> Column:
    combined = conditions[0]
    for c in conditions[1:]:
        combined = combined & c
    return combined


def broad_rules() -> list[R.Rule]:
    rules = []
    for name, zygosity, germline, somatic, events in BROAD_RULES:
        conditions = [_zygosity_is(zygosity)]
        conditions += [_germline_is(germline, None)] if germline else []
        conditions += [_somatic_is(somatic)] if somatic else []
        conditions += [_events_are(events, None)] if events else []
        rules.append((_all(conditions), name))
    return rules


def detail_rules(class_col: str = "pattern") -> list[R.Rule]:
    rules = []
    for name, broad, gene, zygosity, germline, somatic, events in DETAIL_RULES:
        conditions = [F.col(class_col) == broad]
        conditions += [_zygosity_is(zygosity)] if zygosity else []
        conditions += [_germline_is(germline, gene)] if germline else []
        conditions += [_somatic_is(somatic)] if somatic else []
        conditions += [_events_are(events, gene)] if events else []
        rules.append((_all(conditions), name))
    return rules


def broad_classes(samples: DataFrame, mutations: DataFrame) -> DataFrame:
    """Event counts and the broad class, unlisted ones included."""
    events = mutations.withColumnRenamed("Tumor_Sample_Barcode", "sample")
    counted = A.event_counts(
        samples, events, "sample", "Variant_Classification", PATHOGENIC, "Hugo_Symbol", EVENT_PATTERNS
    )
    return R.rule_cascade(counted, "pattern", broad_rules(), OTHERS)


def classify(samples: DataFrame, mutations: DataFrame) -> DataFrame:
    """Add the broad class (``pattern``; unlisted ones NULL) and the detailed pattern."""
    broad = broad_classes(samples, mutations)
    detailed = R.rule_cascade(broad, "detailed_pattern", detail_rules(), OTHERS)
    return detailed.withColumn("pattern", as_level("pattern", CLASS_LEVELS)).drop(*EVENT_PATTERNS)


def annotate(
    x: CohortInputs, drop_known: tuple[str, str] | None = None, excluded: Sequence[str] = ()
) -> DataFrame:
    """The annotated table: sample, texts, zygosity, broad class and detailed pattern.

    Nothing is dropped unless the caller says so: the analysis passes ``KNOWN_DUPLICATE`` and
    ``EXCLUDED_CONTROLS``.  An unknown zygosity makes the condition unknown, which drops the row as well.
    """
    annotated = classify(merged_samples(x, excluded), x.mutations)
    if drop_known:
        sample, zygosity = drop_known
        annotated = annotated.where(~((F.col("sample") == sample) & (F.col("Tumor_zygosity") == zygosity)))
    return annotated


# --- Measures -----------------------------------------------------------------------


def signature_rows(x: CohortInputs, signatures: Sequence[str]) -> DataFrame:
    """The rows of some signatures, both cohorts."""
    return U.union_by_name(x.signatures, x.control_signatures).where(in_list("Signature", signatures))


def signature_share(rows: DataFrame, signature: str, out: str) -> DataFrame:
    return rows.where(F.col("Signature") == signature).select(
        F.col("Tumor_Sample_Barcode").alias("sample"), F.col("mean").alias(out)
    )


def mutation_totals(x: CohortInputs) -> DataFrame:
    """Row total over every count column of the spectrum."""

    def totals(spectrum: DataFrame) -> DataFrame:
        counts = spectrum.columns[1:]
        return spectrum.select(
            F.col(spectrum.columns[0]).alias("sample"), sum((F.col(c) for c in counts[1:]), F.col(counts[0])).alias("total")
        )

    return U.union_by_name(totals(x.spectrum), totals(x.control_spectrum))


def signature_activity(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Share times total."""
    share = signature_share(rows, "Signature.3", "share")
    return J.inner_join(share, totals, "sample").select(
        "sample", (F.col("share") * F.col("total")).alias("signature_3_activity")
    )


def mutation_burden(x: CohortInputs, totals: DataFrame | None = None) -> DataFrame:
    return (mutation_totals(x) if totals is None else totals).select("sample", log2_inf("total").alias("Total_Mutational_Burdens"))


def _tagged(case: DataFrame, control: DataFrame, fn) -> DataFrame:
    return U.two_cohort_union(case, control, fn)


def indel_counts(x: CohortInputs) -> DataFrame:
    """Insertions and deletions per sample, each cohort counted on its own."""
    columns = ["Tumor_Sample_Barcode", "Variant_Type"]
    return _tagged(
        x.mutations.select(*columns),
        x.control_mutations.select(*columns),
        lambda df: A.count_by(df, ["cohort", "Tumor_Sample_Barcode"], in_list("Variant_Type", INDEL_TYPES), "Total_Indel"),
    ).select("cohort", F.col("Tumor_Sample_Barcode").alias("sample"), "Total_Indel")


def indel_burden(x: CohortInputs, indels: DataFrame | None = None) -> DataFrame:
    return (indel_counts(x) if indels is None else indels).select("sample", log2_inf("Total_Indel").alias("Total_Indel_log2"))


def microhomology_share(x: CohortInputs, indels: DataFrame | None = None) -> DataFrame:
    """Long microhomologies per insertion or deletion."""
    long = _tagged(
        x.microhomology.select("Sample", "Homology_Length"),
        x.control_microhomology.select("Sample", "Homology_Length"),
        lambda df: A.count_by(df, ["cohort", "Sample"], F.col("Homology_Length") > HOMOLOGY_ABOVE, "hits"),
    )
    fractions = A.fraction_by(
        long, indel_counts(x) if indels is None else indels, ["cohort", "Sample"], ["cohort", "sample"], "hits", "Total_Indel", "Microhomology_Percent"
    )
    return fractions.select(F.col("Sample").alias("sample"), "Microhomology_Percent")


def control_ids(x: CohortInputs) -> DataFrame:
    """(id, sample): the ids of all control scar tables, mapped in one containment join."""
    tables = (x.control_ntai, x.control_lst, x.control_hrd_loh)
    ids = U.union_by_name(*(table.select(F.col(table.columns[0]).alias("__id")) for table in tables)).distinct()
    mapping = x.id_mapping.select(F.col("SAMPLE_ID").alias("__source"), F.col("DMP_ID").alias("__target"))
    return J.map_ids(ids, mapping, "__id", "__source", "__target", "sample", rewrite=("IM6", "WES"))


def scar_score(case: DataFrame, control: DataFrame, ids: DataFrame, value: str) -> DataFrame:
    """Scar scores of both cohorts; control ids are replaced, unmatched ones are dropped."""
    mapped = control.withColumnRenamed(control.columns[0], "__id").join(ids, "__id")
    return U.union_by_name(
        case.select(F.col(case.columns[0]).alias("sample"), value), mapped.select("sample", value)
    )


def cancer_types(x: CohortInputs) -> DataFrame:
    case = passing_clinical(x).select("sample", "Cancer_Type")
    control = x.control_clinical.select(F.col("SAMPLE_ID").alias("sample"), F.col("CANCER_TYPE").alias("Cancer_Type"))
    return U.union_by_name(control, case)


def measure_tables(x: CohortInputs) -> dict[str, DataFrame]:
    """Every measure as (sample, value); what several of them need is computed once."""
    totals, indels, ids = materialise(mutation_totals(x)), materialise(indel_counts(x)), materialise(control_ids(x))
    shares = materialise(signature_rows(x, ["Signature.3", "Signature.8"]))
    return {
        "signature_3_percentage": signature_share(shares, "Signature.3", "signature_3_percentage"),
        "signature_8_percentage": signature_share(shares, "Signature.8", "signature_8_percentage"),
        "signature_3_activity": signature_activity(shares, totals),
        "Microhomology_Percent": microhomology_share(x, indels),
        "NtAI": scar_score(x.ntai, x.control_ntai, ids, "NtAI"),
        "LST": scar_score(x.lst, x.control_lst, ids, "LST"),
        "HRD_LOH": scar_score(x.hrd_loh, x.control_hrd_loh, ids, "HRD_LOH"),
        "Total_Indel_log2": indel_burden(x, indels),
        "Total_Mutational_Burdens": mutation_burden(x, totals),
    }


def measured_samples(annotated: DataFrame, x: CohortInputs) -> DataFrame:
    """Annotated rows with every measure that exists for the sample, and the cancer type."""
    typed = cancer_types(x).withColumn("has_type", F.lit(True))
    wide = annotated
    for table in (typed, *measure_tables(x).values()):
        wide = wide.join(table, "sample", "left")
    return wide


# --- Outliers -----------------------------------------------------------------------


def outlier_scores(annotated: DataFrame, x: CohortInputs, default_msi: float = DEFAULT_MSI) -> tuple[DataFrame, DataFrame]:
    """Annotated rows with burden, cutoff and outlier flag, and the scores of the outlying samples."""
    burden = J.inner_join(annotated, mutation_burden(x), "sample")
    flagged = materialise(K.flag_outliers(burden, "Total_Mutational_Burdens", 1.5, "is_hypermutated"))
    outliers = flagged.where("is_hypermutated").select("sample", "cutoff").distinct()

    ids = U.union_by_name(
        passing_clinical(x).select(F.col("sample").alias("__source"), F.col("DMP_ID").alias("__target"), F.lit(0).alias("__rank")),
        x.id_mapping.select(F.col("SAMPLE_ID").alias("__source"), F.col("DMP_ID").alias("__target"), F.lit(1).alias("__rank")),
    )
    converted = J.convert_ids(
        outliers, ids, "sample", "__source", "__target", "DMP_ID", ["__rank", "__target"], ("WES", "IM6"), "s_C_"
    ).drop("__rank")
    msi = x.msi.withColumnRenamed("SAMPLE_ID", "DMP_ID")
    scored = J.first_match_lookup(converted, msi, "DMP_ID", "MSI_SCORE", ["MSI_SCORE"]).fillna(
        {"MSI_SCORE": default_msi}
    )
    scored = J.first_match_lookup(
        scored, hotspots(x), "sample", "POLE_Somatic_Mutation", ["POLE_Somatic_Mutation"], {"POLE_Somatic_Mutation": NO_HOTSPOT}
    )
    shares = A.category_scores(
        U.union_by_name(x.signatures, x.control_signatures).withColumnRenamed("Tumor_Sample_Barcode", "sample"),
        "sample",
        "Signature",
        "mean",
        SIGNATURE_GROUPS,
    )
    return flagged, J.score_lookup(scored, shares, "sample")


def mechanism_rules(msi_cutoff: float | None = None) -> list[R.Rule]:
    """``msi_cutoff`` defaults to the burden cutoff, as the original analysis has it."""
    cutoff = F.col("cutoff") if msi_cutoff is None else msi_cutoff
    return R.mechanism_rules("MSI_SCORE", cutoff, "MMR_Signature_Percentage", "APOBEC_Score", "POLE_Score")


def hypermutation(annotated: DataFrame, x: CohortInputs, msi_cutoff: float | None = None, default_msi: float = DEFAULT_MSI) -> DataFrame:
    """Annotated rows with burden, outlier flag and proposed mechanism."""
    flagged, scored = outlier_scores(annotated, x, default_msi)
    explained = R.rule_cascade(scored, "Proposed_mechanism", mechanism_rules(msi_cutoff), R.MECHANISMS["unknown"])
    return J.left_join(
        flagged.drop("cutoff"), explained.drop("cutoff"), "sample", {"Proposed_mechanism": R.MECHANISMS["not_outlier"]}
    )


def rule_coverage(
    x: CohortInputs, drop_known: tuple[str, str] | None = None, excluded: Sequence[str] = ()
) -> DataFrame:
    """What every rule of the three cascades does on the cohort: (cascade, rule, value, hits, ...).

    Broad and detailed rules are counted over all merged samples, mechanisms over the outlying ones.
    """
    classed = materialise(broad_classes(merged_samples(x, excluded), x.mutations))
    _, scored = outlier_scores(annotate(x, drop_known, excluded), x)
    cascades = {
        "broad": R.rule_coverage(classed, broad_rules(), OTHERS),
        "detailed": R.rule_coverage(classed, detail_rules(), OTHERS),
        "mechanism": R.rule_coverage(scored, mechanism_rules(), R.MECHANISMS["unknown"]),
    }
    return U.union_by_name(*(df.withColumn("cascade", F.lit(name)) for name, df in cascades.items()))


def hotspots(x: CohortInputs) -> DataFrame:
    """Protein changes at the hotspot residues of one gene, both cohorts."""
    columns = ["Tumor_Sample_Barcode", "Hugo_Symbol", "HGVSp_Short"]
    calls = U.union_by_name(x.mutations.select(*columns), x.control_mutations.select(*columns))
    residue = matches("HGVSp_Short", HOTSPOT_RESIDUES[0])
    for r in HOTSPOT_RESIDUES[1:]:
        residue = residue | matches("HGVSp_Short", r)
    return calls.where(matches("Hugo_Symbol", HOTSPOT_GENE) & residue).select(
        F.col("Tumor_Sample_Barcode").alias("sample"), F.col("HGVSp_Short").alias("POLE_Somatic_Mutation")
    )


# --- Comparisons --------------------------------------------------------------------


def lumped_type(measured: DataFrame, measure: str, out: str) -> DataFrame:
    """Cancer type for one measure: types with few measured samples lumped, unlisted ones NULL."""
    counts = F.col(measure).isNotNull() & F.coalesce(F.col("has_type"), F.lit(False))
    sizes = measured.where(counts).groupBy("Cancer_Type").agg(F.count(F.lit(1)).alias("__cases"))
    sized = J.attach_aggregate(measured, sizes, "Cancer_Type")
    lumped = na_ifelse(F.col("__cases") < RARE_BELOW, RARE_LABEL, F.col("Cancer_Type"))
    return sized.withColumn(out, F.when(counts, as_level(lumped, CANCER_LEVELS))).drop("__cases")


def cohort_comparisons() -> list[T.Comparison]:
    """The sixteen class comparisons of the analysis with their value ranges."""
    three = in_list("Cancer_Type", SCOPE_TYPES)
    whole = [
        # metric, value, low, high, cutpoints
        ("signature 3 activity", "signature_3_activity", 0, 510, SHORT_CUTPOINTS),
        ("signature 3 share", "signature_3_percentage", 0, 1.2, SHORT_CUTPOINTS),
        ("log2 mutational burden", "Total_Mutational_Burdens", 3.5, 15, T.DEFAULT_CUTPOINTS),
        ("microhomology share", "Microhomology_Percent", 0, 0.6, T.DEFAULT_CUTPOINTS),
        ("NtAI", "NtAI", 0, 38, SHORT_CUTPOINTS),
        ("LST", "LST", 0, 52, T.DEFAULT_CUTPOINTS),
        ("HRD-LOH", "HRD_LOH", 0, 38, T.DEFAULT_CUTPOINTS),
        ("log2 indels", "Total_Indel_log2", 0, 10, T.DEFAULT_CUTPOINTS),
    ]
    scoped = [
        ("signature 3 activity", "signature_3_activity", 0, 470),
        ("signature 3 share", "signature_3_percentage", 0, 1),
        ("NtAI", "NtAI", 0, 40),
        ("LST", "LST", 0, 50),
        ("HRD-LOH", "HRD_LOH", 0, 38),
    ]
    by_type = [
        ("log2 signature 3 activity", "log2_signature_3_activity", "type_by_activity", 0, 12),
        ("signature 3 share", "signature_3_percentage", "type_by_share", 0, 1),
    ]
    out = [T.Comparison(m, v, "pattern", WILDTYPE, lo, hi, cutpoints=c) for m, v, lo, hi, c in whole]
    out += [
        T.Comparison(m, v, "pattern", WILDTYPE, lo, hi, scope="three types", scope_filter=three)
        for m, v, lo, hi in scoped
    ]
    out += [
        T.Comparison(
            m, v, g, "Ovarian Cancer", lo, hi, "less", scope="cancer types", rank_by=v.removeprefix("log2_")
        )
        for m, v, g, lo, hi in by_type
    ]
    out.append(
        T.Comparison(
            "signature 3 activity", "signature_3_activity", "refined_pattern", WILDTYPE, 0, 480, scope="refined classes"
        )
    )
    return out


def comparison_table(measured: DataFrame) -> DataFrame:
    """Measured samples with the class columns that the comparisons need."""
    typed = lumped_type(measured, "signature_3_activity", "type_by_activity")
    typed = lumped_type(typed, "signature_3_percentage", "type_by_share")
    typed = typed.withColumn("log2_signature_3_activity", log2_inf("signature_3_activity"))
    refined = R.refine_class(typed, "pattern", BIALLELIC, "detailed_pattern", REFINED_PARTS, "refined_pattern")
    return refined.withColumn("refined_pattern", as_level("refined_pattern", REFINED_LEVELS))


def cohort_report(measured: DataFrame, method: str = "normal") -> DataFrame:
    """Box summaries and tests of all comparisons."""
    return T.association_report(comparison_table(measured), cohort_comparisons(), method)


def cohort_density(measured: DataFrame, n_grid: int = 512, n_bins: int = 512) -> DataFrame:
    """Kernel density of every class in every comparison, in one pass over the sorted values."""
    return T.association_density(T.report_blocks(comparison_table(measured), cohort_comparisons()), n_grid, n_bins)


def scar_fits(measured: DataFrame, grid: int = 80) -> DataFrame:
    """Fitted lines of NtAI against LST and HRD-LOH with their confidence bands."""
    complete = measured.where(F.col("NtAI").isNotNull() & F.col("LST").isNotNull() & F.col("HRD_LOH").isNotNull())
    bands = [T.linear_fit_band(complete, "NtAI", y, grid).withColumn("pair", F.lit(f"NtAI ~ {y}")) for y in ("LST", "HRD_LOH")]
    return U.union_by_name(*bands)


def scar_correlations(measured: DataFrame) -> DataFrame:
    """NtAI against LST and against HRD-LOH, over samples with all three scores."""
    complete = measured.where(F.col("NtAI").isNotNull() & F.col("LST").isNotNull() & F.col("HRD_LOH").isNotNull())
    rows = [T.spearman(complete, "NtAI", y).withColumn("pair", F.lit(f"NtAI ~ {y}")) for y in ("LST", "HRD_LOH")]
    return U.union_by_name(*rows)


def class_counts(annotated: DataFrame) -> dict[str, DataFrame]:
    """(class, n, level) per broad class, per biallelic detail and per other detail, in the order of the charts.

    ``level`` numbers the bars from 1: broad classes against their usual order, unlisted ones last; biallelic details
    by name; other details against the order in which they appear when rows are sorted by class and detail.
    """
    broad = A.category_counts(annotated, "pattern", CLASS_LEVELS)
    position = F.coalesce(F.lit(len(CLASS_LEVELS) + 1) - F.col("level"), F.lit(len(CLASS_LEVELS) + 1))
    biallelic = annotated.where(F.col("pattern") == BIALLELIC).groupBy("detailed_pattern").agg(F.count(F.lit(1)).alias("n"))
    listed = annotated.where(F.col("pattern").isNotNull() & ~F.col("pattern").isin(BIALLELIC, WILDTYPE))
    first = F.min(level_position("pattern", CLASS_LEVELS)).alias("__first")
    other = listed.groupBy("detailed_pattern").agg(F.count(F.lit(1)).alias("n"), first)
    # a row per rule at most, so these windows stay small
    by_name = W.orderBy(F.asc_nulls_last("detailed_pattern"))
    backwards = W.orderBy(F.desc("__first"), F.desc_nulls_first("detailed_pattern"))
    return {
        "pattern": broad.withColumn("level", position.cast("int")),
        "biallelic": biallelic.withColumn("level", F.row_number().over(by_name)),
        "other": other.withColumn("level", F.row_number().over(backwards)).drop("__first"),
    }


def cancer_type_counts(annotated: DataFrame, x: CohortInputs, label: str = OTHERS) -> DataFrame:
    """Rows per cancer type, smallest first, rare types under one label."""
    sizes = J.inner_join(annotated, cancer_types(x), "sample").groupBy("Cancer_Type").agg(F.count(F.lit(1)).alias("n"))
    lumped = sizes.withColumn("Cancer_Type", na_ifelse(F.col("n") < RARE_BELOW, label, F.col("Cancer_Type")))
    totals = lumped.groupBy("Cancer_Type").agg(F.sum("n").alias("n"), F.min("n").alias("__smallest"))
    return K.global_position(totals, [F.asc("__smallest"), F.asc_nulls_last("Cancer_Type")], "level").drop("__smallest")


# --- Classifier ---------------------------------------------------------------------


def model_table(annotated: DataFrame, x: CohortInputs) -> DataFrame:
    """Annotated samples that have the cancer type and all eight features."""
    tables = measure_tables(x)
    return J.assemble_features(annotated, [cancer_types(x), *(tables[f] for f in MODEL_FEATURES)], "sample")


def train(table: DataFrame, n_pos: int = 22, n_neg: int = 100, seed: int = 12345, **options) -> tuple[M.LassoFit, DataFrame]:
    """Draw the training sample and fit the classifier; returns the fit and the sample."""
    sample = M.labelled_sample(table, "sample", "pattern", BIALLELIC, WILDTYPE, MODEL_FEATURES, n_pos, n_neg, seed)
    return M.fit_lasso_cv(sample, MODEL_FEATURES, key="sample", seed=seed, **options), sample


def score_cohort(fit: M.LassoFit, table: DataFrame, sample: DataFrame, scope: Sequence[str] | None = None, **options) -> DataFrame:
    """Scores of the samples outside training, in ascending order, for the cohort or a scope."""
    target = cohort_scope(table, "Cancer_Type", scope) if scope else table
    scored = M.score(fit, target, "sample", "HRD_detection_score", exclude=sample, **options)
    return M.ranked_scores(scored, "sample", "HRD_detection_score")


def monoallelic_subset(table: DataFrame) -> DataFrame:
    """The samples with one inactivated allele, germline or somatic."""
    return table.where(matches("pattern", "Monoallelic"))


def export_monoallelic(table: DataFrame, path: str) -> None:
    """Write the monoallelic samples as delimited text; class names keep their line breaks, as escapes."""
    write_delimited(monoallelic_subset(table).withColumn("pattern", multiline("pattern")), path, escapes=True)
