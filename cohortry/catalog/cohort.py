"""The tumour cohort analysis over inputs derived from the test tables.

Customers stand for samples (one market segment for the control cohort), order lines for
mutation calls.  The derivations are plain SQL read by Spark and by the oracle alike; the
analysis itself is written twice, with the operators and as oracle SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortry.catalog.registry import query
from cohortry.catalog.relational import coverage_sql
from cohortry.catalog.statistics import BOX_COLUMNS, _rounded_box_sql, box_sql, label_sql, rank_sum_sql, t975_sql, upper_tail_sql
from cohortry.operators import sets as U
from cohortry.plans import tumour_cohort as P
from cohortry.session import materialise, scratch_path
from cohortry.sources.delimited import read_delimited, write_delimited

_KEY = "lpad('' || c_custkey, 10, '0')"

# The first customers bear the ids that the analysis names: the excluded controls, then the known duplicate.
_NAMED = [*P.EXCLUDED_CONTROLS, P.KNOWN_DUPLICATE[0]]
_N_EXCLUDED = len(P.EXCLUDED_CONTROLS)
_DUPLICATE_KEY = len(_NAMED)

_BASES = {
    "samples": f"""
        SELECT c_custkey, c_nationkey, c_acctbal, control, coalesce(named, CASE WHEN c_mktsegment = 'BUILDING' THEN 's_C_' || {_KEY}
                                                                               ELSE 'P-' || {_KEY} || '-T01-WES' END) AS sid,
               coalesce(replace(named, 'WES', 'IM6'), 'P-' || {_KEY} || '-T01-IM6') AS dmp, 'H' || {_KEY} AS scar_id
        FROM (SELECT *, c_custkey <= {_N_EXCLUDED} OR (c_mktsegment = 'HOUSEHOLD' AND c_custkey <> {_DUPLICATE_KEY}) AS control,
                     CASE c_custkey {" ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(_NAMED, 1))} END AS named
              FROM customer) c
    """,
    "calls": """
        SELECT s.sid, s.scar_id, s.control, s.c_nationkey, l_partkey, l_linenumber, l_quantity, l_discount, l_tax,
               l_returnflag, l_linestatus, o_orderpriority
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN samples s ON o_custkey = s.c_custkey
    """,
}

_MUTATIONS = """
    SELECT sid AS Tumor_Sample_Barcode,
           CASE WHEN l_quantity = 1 THEN 'BRCA1' WHEN l_quantity = 2 THEN 'BRCA2' WHEN l_quantity = 3 THEN 'POLE'
                WHEN l_quantity = 4 THEN 'POLE2' ELSE 'TP53' END AS Hugo_Symbol,
           'p.' || CASE l_linenumber WHEN 1 THEN 'P286R' WHEN 2 THEN 'V411L' ELSE 'K' || l_partkey || 'fs' END AS HGVSp_Short,
           'c.' || l_partkey || 'del' AS HGVSc,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'Frame_Shift_Del' WHEN '2-HIGH' THEN 'Nonsense_Mutation'
                WHEN '3-MEDIUM' THEN 'Splice_Site' WHEN '5-LOW' THEN 'Silent' ELSE 'Missense_Mutation' END AS Variant_Classification,
           CASE l_returnflag WHEN 'A' THEN 'DEL' WHEN 'R' THEN 'INS' ELSE 'SNP' END AS Variant_Type
    FROM calls WHERE {cohort}
"""
_SIGNATURES = """
    SELECT sid AS Tumor_Sample_Barcode, 'Signature.' || k AS Signature,
           sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY sid) AS mean
    FROM (SELECT sid, l_quantity,
                 CASE WHEN c_nationkey = 3 AND l_linenumber IN (2, 3, 4, 6) THEN '15'
                      WHEN c_nationkey < 7 AND c_nationkey <> 3 AND l_linenumber BETWEEN 3 AND 6 THEN '15'
                      WHEN c_nationkey BETWEEN 7 AND 12 AND l_linenumber BETWEEN 3 AND 6 THEN '13'
                      WHEN c_nationkey BETWEEN 13 AND 18 AND l_linenumber BETWEEN 3 AND 6 THEN '10'
                      WHEN l_linenumber = 1 AND c_nationkey < 24 THEN '3' WHEN l_linenumber <= 2 THEN '8'
                      WHEN l_linenumber = 3 THEN '6' WHEN l_linenumber = 4 THEN '20' WHEN l_linenumber = 5 THEN '2'
                      WHEN l_linenumber = 6 THEN '26' ELSE '10' END AS k
          FROM calls WHERE {cohort}) t
    GROUP BY sid, k
"""
_SPECTRUM = """
    SELECT sid AS Tumor_Sample_Barcode,
           count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F')
               * max(CASE WHEN c_nationkey % 6 = 3 THEN 16 ELSE 1 END) AS AF,
           count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS AO,
           count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'F') AS NF,
           count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS NO_,
           count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS RF,
           count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS RO
    FROM calls WHERE {cohort} GROUP BY sid
"""
_MICROHOMOLOGY = """
    SELECT sid AS Sample, CAST(l_quantity AS INT) - 25 AS Homology_Length FROM calls
    WHERE l_returnflag <> 'N' AND {cohort}
"""
_SCAR = "SELECT {id} AS Sample, CAST(count(*) FILTER (WHERE {hit}) AS INT) AS {value} FROM calls WHERE {cohort} GROUP BY {id}"
_CANCER = """
    CASE WHEN c_acctbal > 9900 THEN 'Thymic Tumor' WHEN c_acctbal < -800 THEN 'Glioma'
         WHEN c_acctbal < 1500 THEN 'Ovarian Cancer' WHEN c_acctbal < 3500 THEN 'Breast Cancer'
         WHEN c_acctbal < 5500 THEN 'Prostate Cancer' WHEN c_acctbal < 7000 THEN 'Melanoma'
         WHEN c_acctbal < 8500 THEN 'Unlisted Cancer' WHEN c_acctbal < 9500 THEN 'Bladder Cancer' END
"""


def _inputs() -> dict[str, str]:
    case, control = "NOT control", "control"
    tables = {
        # a fifth of the case samples has no variants, a fifth only somatic and a fifth only germline ones
        "variants": f"""
            SELECT sid AS sample,
                   CASE WHEN c_custkey % 5 = 1 THEN 'Somatic' WHEN c_custkey % 5 = 2 THEN 'Germline'
                        WHEN o_orderstatus = 'F' THEN 'Germline' WHEN o_orderstatus = 'O' THEN 'Somatic'
                        ELSE 'Germline,Somatic' END AS BRCA_Type,
                   'p.G' || o_orderkey || 'fs' AS HGVSp_Short,
                   CASE WHEN month(o_orderdate) <= 6 THEN 'BRCA1' ELSE 'BRCA2' END AS Hugo_Symbol,
                   CASE WHEN c_custkey = {_DUPLICATE_KEY} AND o_orderkey % 2 = 0 THEN '{P.KNOWN_DUPLICATE[1]}'
                        WHEN day(o_orderdate) <= 9 THEN 'AI_LOH_ALT' WHEN day(o_orderdate) <= 12 THEN 'AI_LOH_REF'
                        WHEN day(o_orderdate) <= 16 THEN 'AI_ALT' WHEN day(o_orderdate) <= 19 THEN 'AI_REF'
                        WHEN day(o_orderdate) <= 22 THEN 'subclonal' WHEN day(o_orderdate) <= 28 THEN 'None' END AS zygosity_flag
            FROM orders JOIN samples ON o_custkey = c_custkey
            WHERE NOT control AND c_custkey % 5 <> 0
        """,
        "clinical": f"""
            SELECT sid AS CMO_ID, dmp AS DMP_ID, CASE WHEN c_acctbal BETWEEN 0 AND 100 THEN 'failed' END AS Sample_QC,
                   CASE WHEN c_acctbal >= 4500 THEN 'YES' ELSE 'NO' END AS `12_245_PartC_Consented`,
                   CASE WHEN c_nationkey < 9 THEN 'Somatic' WHEN c_nationkey < 14 THEN 'Somatic,Somatic'
                        WHEN c_nationkey < 19 THEN 'Germline' ELSE 'WT' END AS BRCA_Type,
                   CASE WHEN c_acctbal < 3000 THEN 'deletion' ELSE 'point' END AS Variant_Type,
                   'Deletion' AS HGVSp_Short, CASE WHEN c_acctbal < 1000 THEN 'BRCA1' ELSE 'BRCA2' END AS Hugo_Symbol,
                   {_CANCER} AS Cancer_Type
            FROM samples WHERE NOT control
        """,
        "control_clinical": f"SELECT sid AS SAMPLE_ID, {_CANCER} AS CANCER_TYPE FROM samples WHERE control",
        "msi": "SELECT dmp AS SAMPLE_ID, (c_acctbal + 1000) / 1000 AS MSI_SCORE FROM samples WHERE c_acctbal > 500",
        "id_mapping": "SELECT 'x_' || scar_id || '_d' AS SAMPLE_ID, dmp AS DMP_ID FROM samples WHERE control AND c_acctbal > -500",
    }
    for prefix, cohort in (("", case), ("control_", control)):
        tables[prefix + "mutations"] = _MUTATIONS.format(cohort=cohort)
        tables[prefix + "signatures"] = _SIGNATURES.format(cohort=cohort)
        tables[prefix + "spectrum"] = _SPECTRUM.format(cohort=cohort)
        tables[prefix + "microhomology"] = _MICROHOMOLOGY.format(cohort=cohort)
        scar_id = "scar_id" if prefix else "sid"
        for name, value, hit in (
            ("ntai", "NtAI", "l_tax >= 0.04"),
            ("lst", "LST", "l_discount >= 0.05"),
            ("hrd_loh", "HRD_LOH", "l_linestatus = 'F' AND l_tax > 0.01"),
        ):
            tables[prefix + name] = _SCAR.format(id=scar_id, hit=hit, value=value, cohort=cohort)
    return tables


INPUT_SQL = _inputs()


def cohort_inputs(t) -> P.CohortInputs:
    """The nineteen input tables; the join below all call tables and the variants are computed once."""
    tables = {name: getattr(t, name) for name in ("customer", "orders", "lineitem")}

    def derived(sql: str, names) -> object:
        marked = sql
        for name in names:
            marked = marked.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
        used = {name: tables[name] for name in names if f"{{{name}}}" in marked}
        return t.spark.sql(marked, **used)

    tables["samples"] = derived(_BASES["samples"], ["customer"])
    tables["calls"] = materialise(derived(_BASES["calls"], ["lineitem", "orders", "samples"]))
    inputs = {name: derived(sql, list(tables)) for name, sql in INPUT_SQL.items()}
    inputs["variants"] = materialise(inputs["variants"])  # a join, and read by most annotation steps
    return P.CohortInputs(**inputs)


def with_sql(*steps: str, last: str) -> str:
    """Oracle statement: derived inputs, the given CTEs, final SELECT."""
    ctes = [f"{name} AS MATERIALIZED ({sql})" for name, sql in {**_BASES, **INPUT_SQL}.items()]
    return ("WITH " + ",\n".join([*ctes, *steps]) + f"\n{last}").replace("`", '"')


# --- Annotation -----------------------------------------------------------------------

_TEXT = "coalesce(HGVSp_Short, 'NA') || ' ' || coalesce(Hugo_Symbol, 'NA')"

_MERGED = f"""
    passed AS (SELECT * FROM clinical WHERE Sample_QC IS NULL),
    covered AS (SELECT * FROM passed WHERE CMO_ID IN (SELECT sample FROM variants)),
    uncovered AS (SELECT * FROM passed WHERE CMO_ID NOT IN (SELECT sample FROM variants)),
    g AS (SELECT CMO_ID AS sample, CASE `12_245_PartC_Consented` WHEN 'YES' THEN 'WT' ELSE 'Unknown' END AS v,
                 CASE `12_245_PartC_Consented` WHEN 'YES' THEN 0 ELSE 1 END AS r
          FROM covered WHERE BRCA_Type IN ('Somatic', 'Somatic,Somatic')
          UNION ALL SELECT sample, {_TEXT}, 2 FROM variants WHERE BRCA_Type IN ('Germline', 'Germline,Somatic')),
    s AS (SELECT sample, {_TEXT} AS v, 0 AS r FROM variants WHERE BRCA_Type IN ('Somatic', 'Germline,Somatic')
          UNION ALL
          SELECT Tumor_Sample_Barcode, {_TEXT}, 1 FROM mutations
          WHERE (contains(Hugo_Symbol, 'BRCA1') OR contains(Hugo_Symbol, 'BRCA2'))
            AND EXISTS (SELECT 1 FROM (SELECT DISTINCT sample FROM variants) i WHERE contains(Tumor_Sample_Barcode, i.sample))),
    gl AS (SELECT sample, string_agg(v, ',' ORDER BY r, v) AS Germline_mutation
           FROM (SELECT sample, v, min(r) AS r FROM g GROUP BY 1, 2) GROUP BY sample),
    sl AS (SELECT sample, string_agg(v, ',' ORDER BY r, v) AS Somatic_mutation
           FROM (SELECT sample, v, min(r) AS r FROM s GROUP BY 1, 2) GROUP BY sample),
    merged AS (
        SELECT DISTINCT * FROM (
            SELECT sample, Germline_mutation, Somatic_mutation, zygosity_flag AS Tumor_zygosity
            FROM (SELECT * FROM gl FULL JOIN sl USING (sample)) FULL JOIN variants USING (sample)
            UNION ALL SELECT CMO_ID, NULL, {_TEXT}, 'Homozygous Deletion' FROM uncovered
                      WHERE BRCA_Type = 'Somatic' AND Variant_Type = 'deletion'
            UNION ALL SELECT CMO_ID, 'WT', 'WT', 'None' FROM uncovered WHERE BRCA_Type = 'WT'
            UNION ALL SELECT CMO_ID, {_TEXT}, f.c || ' ' || f.g, 'Germline Deletion Rare Case'
                      FROM uncovered LEFT JOIN (
                          SELECT Tumor_Sample_Barcode, min(struct_pack(c := HGVSc, g := Hugo_Symbol)) AS f FROM mutations
                          WHERE contains(Hugo_Symbol, 'BRCA1') OR contains(Hugo_Symbol, 'BRCA2') GROUP BY 1
                      ) ON CMO_ID = Tumor_Sample_Barcode
                      WHERE BRCA_Type = 'Germline' AND Variant_Type = 'deletion')
        UNION ALL SELECT DISTINCT Tumor_Sample_Barcode, 'WT', 'WT', 'None' FROM control_mutations
                  WHERE Tumor_Sample_Barcode NOT IN ({", ".join(f"'{name}'" for name in P.EXCLUDED_CONTROLS)})
    ),
    counted AS (
        SELECT merged.*, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2,
               coalesce(contains(Germline_mutation, 'BRCA'), false) AS g0,
               coalesce(contains(Germline_mutation, 'BRCA1'), false) AS g1,
               coalesce(contains(Germline_mutation, 'BRCA2'), false) AS g2
        FROM merged LEFT JOIN (
            SELECT Tumor_Sample_Barcode, count(*) FILTER (contains(Hugo_Symbol, 'BRCA')) AS n0,
                   count(*) FILTER (contains(Hugo_Symbol, 'BRCA1')) AS n1, count(*) FILTER (contains(Hugo_Symbol, 'BRCA2')) AS n2
            FROM mutations WHERE Variant_Classification IN ('Frame_Shift_Ins', 'Nonsense_Mutation', 'Frame_Shift_Del',
                                                            'Translation_Start_Site', 'Nonstop_Mutation', 'Splice_Site')
            GROUP BY 1
        ) ON sample = Tumor_Sample_Barcode
    )
"""

_Z, _G, _S = "Tumor_zygosity", "Germline_mutation", "Somatic_mutation"
_BI, _MG, _MS = "Biallelic Inactivation", "Monoallelic Germline Inactivation", "Monoallelic Somatic Inactivation"
_WT = "BRCA Wildtype Tumor"
_SUB, _DEL = "Subclonal BRCA Inactivation", "Germline Deletion"

# The cascades once more, as plain conditions for the oracle.
_BROAD_STEPS = [
    (f"n0 = 0 AND {_Z} = 'AI_LOH_ALT' AND g0", _BI),
    (f"{_Z} = 'Germline Deletion Rare Case'", _DEL),
    (f"{_Z} = 'None' AND g0 AND n0 = 0", _MG),
    (f"{_Z} = 'AI_LOH_REF' AND g0 AND n0 = 0", _MG),
    (f"{_Z} = 'AI_LOH_REF' AND g0 AND n0 = 1", _BI),
    (f"{_Z} = 'None' AND {_G} = 'WT' AND {_S} = 'WT'", _WT),
    (f"{_Z} = 'None' AND {_G} = 'WT' AND n0 = 1", _MS),
    (f"{_G} = 'Unknown' AND {_Z} = 'None' AND n0 = 1", _MS),
    (f"{_Z} = 'AI_LOH_ALT' AND {_G} = 'WT' AND n0 = 1", _BI),
    (f"{_Z} = 'AI_LOH_ALT' AND {_G} = 'Unknown' AND n0 = 1", _BI),
    (f"{_Z} = 'subclonal' AND n0 >= 1", _SUB),
    (f"{_Z} = 'AI_ALT' AND {_G} = 'Unknown' AND n0 = 1", _MS),
    (f"{_Z} = 'AI_ALT' AND n0 = 0 AND g0", _MG),
    (f"{_Z} = 'AI_ALT' AND n0 = 0 AND NOT g0", _WT),
    (f"{_Z} = 'AI_REF' AND {_G} = 'Unknown' AND n0 = 1", _MS),
    (f"{_Z} = 'AI_REF' AND {_S} IS NULL", _MG),
    (f"{_Z} = 'Homozygous Deletion' AND coalesce(contains({_S}, 'BRCA'), false)", _BI),
    (f"{_Z} = 'AI_LOH_ALT' AND n0 > 1 AND {_G} = 'WT'", _BI),
    (f"{_Z} = 'AI_LOH_ALT' AND n0 > 1 AND {_G} = 'Unknown'", _BI),
    (f"{_Z} = 'AI_LOH_ALT' AND n0 = 1 AND g0", _BI),
    (f"{_Z} = 'None' AND g0 AND n0 = 1", _BI),
]
_DETAIL_STEPS = [
    (f"c = '{_BI}' AND {_S} = 'Deletion BRCA1'", "Homodels BRCA1"),
    (f"c = '{_BI}' AND {_S} = 'Deletion BRCA2'", "Homodels BRCA2"),
    (f"c = '{_BI}' AND n1 = 0 AND g1 AND {_Z} = 'AI_LOH_ALT'", "Germline BRCA1 + LOH"),
    (f"c = '{_BI}' AND n2 = 0 AND g2 AND {_Z} = 'AI_LOH_ALT'", "Germline BRCA2 + LOH"),
    (f"c = '{_BI}' AND n2 = 1 AND g2 AND {_Z} = 'AI_LOH_ALT'", "Germline BRCA2 + LOH"),
    (f"c = '{_BI}' AND n1 >= 1 AND NOT g0 AND {_Z} = 'AI_LOH_ALT'", "Somatic BRCA1 + LOH"),
    (f"c = '{_BI}' AND n2 >= 1 AND NOT g0 AND {_Z} = 'AI_LOH_ALT'", "Somatic BRCA2 + LOH"),
    (f"c = '{_BI}' AND n2 = 1 AND g2 AND {_Z} <> 'AI_LOH_ALT'", "Germline BRCA2 + second mutation"),
    (f"c = '{_MG}' AND g1 AND n1 = 0", "Monoallelic BRCA1 Germline Inactivation"),
    (f"c = '{_MG}' AND g2 AND n2 = 0", "Monoallelic BRCA2 Germline Inactivation"),
    (f"c = '{_MS}' AND n1 >= 1", "Monoallelic BRCA1 Somatic Inactivation"),
    (f"c = '{_MS}' AND n2 >= 1", "Monoallelic BRCA2 Somatic Inactivation"),
    (f"c = '{_SUB}' AND n1 >= 1", "Subclonal BRCA1 Inactivation"),
    (f"c = '{_SUB}' AND n2 >= 1", "Subclonal BRCA2 Inactivation"),
    (f"c = '{_WT}'", "BRCA Wildtype Tumor"),
    (f"c = '{_DEL}' AND g1", "BRCA1 Germline Deletion"),
]


def _step_ctes(prefix: str, base: str, out: str, steps) -> list[str]:
    """One CTE per rule, each rewriting the class of the one before."""
    ctes = [f"{prefix}0 AS (SELECT *, 'Others' AS {out} FROM {base})"]
    for i, (condition, value) in enumerate(steps):
        ctes.append(
            f"{prefix}{i + 1} AS (SELECT * REPLACE (CASE WHEN ({condition}) IS NULL THEN NULL "
            f"WHEN {condition} THEN '{value}' ELSE {out} END AS {out}) FROM {prefix}{i})"
        )
    return ctes


_ANNOTATED = [
    _MERGED,
    *_step_ctes("b", "counted", "c", _BROAD_STEPS),
    *_step_ctes("d", f"b{len(_BROAD_STEPS)}", "detailed_pattern", _DETAIL_STEPS),
    f"""annotated AS MATERIALIZED (
        SELECT sample, Germline_mutation, Somatic_mutation, Tumor_zygosity, nullif(c, 'Others') AS pattern, detailed_pattern
        FROM d{len(_DETAIL_STEPS)}
        WHERE NOT (sample = '{P.KNOWN_DUPLICATE[0]}' AND Tumor_zygosity = '{P.KNOWN_DUPLICATE[1]}'))""",
]


def annotated_rows(x: P.CohortInputs):
    """The annotation with the analysis' exclusions."""
    return P.annotate(x, P.KNOWN_DUPLICATE, P.EXCLUDED_CONTROLS)


def annotated_cohort(t):
    x = cohort_inputs(t)
    return x, materialise(annotated_rows(x))


@query("cohort_annotation", with_sql(*_ANNOTATED, last="SELECT * FROM annotated"))
def cohort_annotation(t):
    return annotated_rows(cohort_inputs(t))


@query("cohort_from_files", with_sql(*_ANNOTATED, last="SELECT * FROM annotated"))
def cohort_from_files(t):
    """The annotation of inputs that were written as wide files and read back by name."""
    files = {}
    for name, table in vars(cohort_inputs(t)).items():
        files[name] = scratch_path(t.spark, name)
        if not name.endswith("spectrum"):  # further columns, and the wanted ones in another order
            table = table.select(F.lit(1).alias("extra"), *reversed(table.columns), F.lit("x").alias("further"))
        write_delimited(table, files[name])
    return annotated_rows(P.cohort_from_files(t.spark, files))


# the bar of a class, from the last of the usual order
_BAR = f"""CASE pattern WHEN '{_WT}' THEN 6 WHEN '{_BI}' THEN 5 WHEN '{_MG}' THEN 4 WHEN '{_MS}' THEN 3 WHEN '{_DEL}' THEN 2
                        WHEN '{_SUB}' THEN 1 END"""


@query(
    "cohort_class_counts",
    with_sql(
        *_ANNOTATED,
        last=f"""
        SELECT 'pattern' AS chart, pattern AS class, count(*) AS n, CAST(coalesce({_BAR}, 7) AS INT) AS level
        FROM annotated GROUP BY pattern
        UNION ALL SELECT 'biallelic', detailed_pattern, count(*), CAST(row_number() OVER (ORDER BY detailed_pattern NULLS LAST) AS INT)
                  FROM annotated WHERE pattern = '{_BI}' GROUP BY detailed_pattern
        UNION ALL SELECT 'other', detailed_pattern, count(*),
                         CAST(row_number() OVER (ORDER BY max({_BAR}), detailed_pattern DESC NULLS FIRST) AS INT)
                  FROM annotated WHERE pattern <> '{_BI}' AND pattern <> '{_WT}' GROUP BY detailed_pattern
        """,
    ),
)
def cohort_class_counts(t):
    _, annotated = annotated_cohort(t)
    charts = [
        df.select(F.lit(name).alias("chart"), F.col(df.columns[0]).alias("class"), "n", "level")
        for name, df in P.class_counts(annotated).items()
    ]
    return U.union_by_name(*charts)


@query(
    "cohort_cancer_types",
    with_sql(
        *_ANNOTATED,
        """types AS (SELECT SAMPLE_ID AS sample, CANCER_TYPE AS Cancer_Type FROM control_clinical
                     UNION ALL SELECT CMO_ID, Cancer_Type FROM passed)""",
        """sizes AS (SELECT Cancer_Type, count(*) AS n FROM annotated JOIN types USING (sample) GROUP BY 1)""",
        last="""
        SELECT Cancer_Type, n, row_number() OVER (ORDER BY smallest, Cancer_Type NULLS LAST) AS level
        FROM (SELECT CASE WHEN n < 15 THEN 'Others' ELSE Cancer_Type END AS Cancer_Type, CAST(sum(n) AS BIGINT) AS n,
                     min(n) AS smallest FROM sizes GROUP BY 1)
        """,
    ),
)
def cohort_cancer_types(t):
    x, annotated = annotated_cohort(t)
    return P.cancer_type_counts(annotated, x)


# --- Measures and outliers --------------------------------------------------------------


def _mapped(name: str, value: str) -> str:
    return f"""
        SELECT Sample AS sample, {value} FROM {name}
        UNION ALL
        SELECT replace(min(struct_pack(a := SAMPLE_ID, b := DMP_ID)).b, 'IM6', 'WES'), any_value({value})
        FROM control_{name} JOIN id_mapping ON contains(SAMPLE_ID, Sample) GROUP BY Sample
    """


_MEASURES = [
    """types AS (SELECT SAMPLE_ID AS sample, CANCER_TYPE AS Cancer_Type FROM control_clinical
                 UNION ALL SELECT CMO_ID, Cancer_Type FROM passed)""",
    "sig AS (SELECT * FROM signatures UNION ALL SELECT * FROM control_signatures)",
    """totals AS (SELECT Tumor_Sample_Barcode AS sample, AF + AO + NF + NO_ + RF + RO AS total
                  FROM (SELECT * FROM spectrum UNION ALL SELECT * FROM control_spectrum))""",
    """indels AS (SELECT Tumor_Sample_Barcode AS sample, count(*) AS n
                  FROM (SELECT * FROM mutations UNION ALL SELECT * FROM control_mutations)
                  WHERE Variant_Type IN ('DEL', 'INS') GROUP BY 1)""",
    """homology AS (SELECT Sample AS sample, count(*) AS hits
                    FROM (SELECT * FROM microhomology UNION ALL SELECT * FROM control_microhomology)
                    WHERE Homology_Length > 10 GROUP BY 1)""",
    f"scar_ntai AS ({_mapped('ntai', 'NtAI')})",
    f"scar_lst AS ({_mapped('lst', 'LST')})",
    f"scar_loh AS ({_mapped('hrd_loh', 'HRD_LOH')})",
    """measured AS MATERIALIZED (
        SELECT a.*, t.Cancer_Type, t.sample IS NOT NULL AS has_type, s3.mean AS signature_3_percentage,
               s8.mean AS signature_8_percentage, s3.mean * totals.total AS signature_3_activity,
               CAST(hits AS DOUBLE) / indels.n AS Microhomology_Percent, NtAI, LST, HRD_LOH, log2(indels.n) AS Total_Indel_log2,
               log2(totals.total) AS Total_Mutational_Burdens
        FROM annotated a
        LEFT JOIN types t ON a.sample = t.sample
        LEFT JOIN sig s3 ON a.sample = s3.Tumor_Sample_Barcode AND s3.Signature = 'Signature.3'
        LEFT JOIN sig s8 ON a.sample = s8.Tumor_Sample_Barcode AND s8.Signature = 'Signature.8'
        LEFT JOIN totals ON a.sample = totals.sample
        LEFT JOIN indels ON a.sample = indels.sample
        LEFT JOIN homology ON a.sample = homology.sample
        LEFT JOIN scar_ntai ON a.sample = scar_ntai.sample
        LEFT JOIN scar_lst ON a.sample = scar_lst.sample
        LEFT JOIN scar_loh ON a.sample = scar_loh.sample)""",
]

_DIGITS = {
    "signature_3_percentage": 6,
    "signature_8_percentage": 6,
    "Microhomology_Percent": 6,
    "Total_Indel_log2": 6,
    "Total_Mutational_Burdens": 6,
}
_ROUNDED = ", ".join(f"round({c}, {d}) AS {c}" for c, d in _DIGITS.items())


@query(
    "cohort_measures",
    with_sql(
        *_ANNOTATED,
        *_MEASURES,
        last=f"""SELECT sample, Tumor_zygosity, pattern, Cancer_Type, round(signature_3_activity, 6) AS signature_3_activity,
                        NtAI, LST, HRD_LOH, {_ROUNDED} FROM measured""",
    ),
)
def cohort_measures(t):
    x, annotated = annotated_cohort(t)
    digits = {**_DIGITS, "signature_3_activity": 6}
    return P.measured_samples(annotated, x).select(
        "sample", "Tumor_zygosity", "pattern", "Cancer_Type", "NtAI", "LST", "HRD_LOH",
        *(F.round(c, d).alias(c) for c, d in digits.items()),
    )


@query(
    "cohort_model_table",
    with_sql(
        *_ANNOTATED,
        *_MEASURES,
        last=f"""SELECT sample, Tumor_zygosity, pattern, Cancer_Type, NtAI, LST, HRD_LOH, {_ROUNDED} FROM measured
                 WHERE has_type AND signature_3_percentage IS NOT NULL AND signature_8_percentage IS NOT NULL
                   AND Microhomology_Percent IS NOT NULL AND NtAI IS NOT NULL AND LST IS NOT NULL AND HRD_LOH IS NOT NULL
                   AND Total_Indel_log2 IS NOT NULL AND Total_Mutational_Burdens IS NOT NULL""",
    ),
)
def cohort_model_table(t):
    x, annotated = annotated_cohort(t)
    return P.model_table(annotated, x).select(
        "sample", "Tumor_zygosity", "pattern", "Cancer_Type", "NtAI", "LST", "HRD_LOH",
        *(F.round(c, d).alias(c) for c, d in _DIGITS.items()),
    )


_OUTLIERS = [
    """burden AS (SELECT a.*, log2(total) AS b FROM annotated a JOIN totals USING (sample))""",
    """cut AS (SELECT median(b) + 1.5 * (quantile_cont(b, 0.75) - quantile_cont(b, 0.25)) AS cutoff FROM burden)""",
    """ids AS (SELECT source, min(struct_pack(r := r, t := target)).t AS target
               FROM (SELECT CMO_ID AS source, DMP_ID AS target, 0 AS r FROM passed
                     UNION ALL SELECT SAMPLE_ID, DMP_ID, 1 FROM id_mapping) GROUP BY source)""",
    """outliers AS (
        SELECT DISTINCT sample, CASE WHEN contains(sample, 'WES') THEN replace(sample, 'WES', 'IM6')
                                     WHEN contains(sample, 's_C_') THEN target END AS DMP_ID
        FROM burden LEFT JOIN ids ON sample = source, cut WHERE b >= cutoff)""",
    """shares AS (
        SELECT Tumor_Sample_Barcode AS sample,
               sum(mean) FILTER (Signature IN ('Signature.6', 'Signature.15', 'Signature.20', 'Signature.26')) AS mmr,
               sum(mean) FILTER (Signature IN ('Signature.2', 'Signature.13')) AS apobec,
               sum(mean) FILTER (Signature = 'Signature.10') AS pole FROM sig GROUP BY 1)""",
    """hot AS (SELECT Tumor_Sample_Barcode AS sample, min(HGVSp_Short) AS hotspot
               FROM (SELECT * FROM mutations UNION ALL SELECT * FROM control_mutations)
               WHERE contains(Hugo_Symbol, 'POLE') AND (contains(HGVSp_Short, 'P286') OR contains(HGVSp_Short, 'V411'))
               GROUP BY 1)""",
    """scores AS (
        SELECT o.sample, o.DMP_ID, coalesce(MSI_SCORE, 0.04) AS MSI_SCORE, coalesce(hotspot, 'POLE Somatic WT') AS hotspot,
               mmr, apobec, pole
        FROM outliers o LEFT JOIN msi ON o.DMP_ID = msi.SAMPLE_ID
        LEFT JOIN shares ON o.sample = shares.sample LEFT JOIN hot ON o.sample = hot.sample)""",
]


@query(
    "cohort_hypermutation",
    with_sql(
        *_ANNOTATED,
        *_MEASURES,
        *_OUTLIERS,
        """mechanism AS (
            SELECT scores.*, CASE WHEN pole IS NULL THEN NULL WHEN pole >= 0.5 THEN 'POLE Mutation'
                                  WHEN apobec IS NULL THEN NULL WHEN apobec >= 0.5 THEN 'APOBEC Mutation'
                                  WHEN (MSI_SCORE >= cutoff AND mmr >= 0.5) IS NULL THEN NULL
                                  WHEN MSI_SCORE >= cutoff AND mmr >= 0.5 THEN 'MSI High' ELSE 'Unknown Significance' END AS m
            FROM scores, cut)""",
        last="""
        SELECT burden.sample, burden.pattern, round(b, 6) AS burden, b >= cutoff AS is_hypermutated, DMP_ID,
               round(MSI_SCORE, 6) AS MSI_SCORE, hotspot, round(apobec, 6) AS apobec, round(mmr, 6) AS mmr, round(pole, 6) AS pole,
               coalesce(m, 'nonhypermutated tumor') AS mechanism
        FROM burden LEFT JOIN mechanism ON burden.sample = mechanism.sample, cut
        """,
    ),
)
def cohort_hypermutation(t):
    x, annotated = annotated_cohort(t)
    return P.hypermutation(annotated, x).select(
        "sample",
        "pattern",
        F.round("Total_Mutational_Burdens", 6).alias("burden"),
        "is_hypermutated",
        "DMP_ID",
        F.round("MSI_SCORE", 6).alias("MSI_SCORE"),
        F.col("POLE_Somatic_Mutation").alias("hotspot"),
        F.round("APOBEC_Score", 6).alias("apobec"),
        F.round("MMR_Signature_Percentage", 6).alias("mmr"),
        F.round("POLE_Score", 6).alias("pole"),
        F.col("Proposed_mechanism").alias("mechanism"),
    )


_MECHANISM_STEPS = [
    ("MSI_SCORE >= cutoff AND mmr >= 0.5", "MSI High"),
    ("apobec >= 0.5", "APOBEC Mutation"),
    ("pole >= 0.5", "POLE Mutation"),
]


@query(
    "cohort_rule_coverage",
    with_sql(
        *_ANNOTATED,
        *_MEASURES,
        *_OUTLIERS,
        last=" UNION ALL ".join([
            coverage_sql("broad", "counted", _BROAD_STEPS, "Others"),
            coverage_sql("detailed", f"b{len(_BROAD_STEPS)}", _DETAIL_STEPS, "Others"),
            coverage_sql("mechanism", "scores, cut", _MECHANISM_STEPS, "Unknown Significance"),
        ]),
    ),
)
def cohort_rule_coverage(t):
    return P.rule_coverage(cohort_inputs(t), P.KNOWN_DUPLICATE, P.EXCLUDED_CONTROLS)


# --- Comparisons ------------------------------------------------------------------------

_LEVELS_SQL = ", ".join(f"'{v}'" for v in P.CANCER_LEVELS)


def _lumped_sql(measure: str) -> str:
    return f"""
        SELECT m.*, CASE WHEN lumped IN ({_LEVELS_SQL}) THEN lumped END AS cls
        FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY Cancer_Type) < 15 THEN 'Rare Case Cancer'
                             ELSE Cancer_Type END AS lumped
              FROM measured WHERE has_type AND {measure} IS NOT NULL) m
    """


_REFINED_SQL = f"""
    SELECT *, CASE WHEN pattern = '{_BI}' AND contains(detailed_pattern, 'Germline') THEN 'Germline Biallelic Inactivation'
                   WHEN pattern = '{_BI}' AND contains(detailed_pattern, 'Somatic') THEN 'Somatic Biallelic Inactivation'
                   WHEN pattern = '{_BI}' AND contains(detailed_pattern, 'Homodels') THEN 'Homozygous Deletion'
                   WHEN pattern <> '{_BI}' THEN pattern END AS cls
    FROM measured
"""


def _comparison_sources():
    """(metric, scope, source of (cls, v), reference, alternative, cutpoints) for the oracle."""
    three = "Cancer_Type IN ('Breast Cancer', 'Prostate Cancer', 'Ovarian Cancer')"
    short = ((0.001, "***"), (0.01, "**"), (0.05, "*"))
    rows = []
    for metric, value, low, high, cuts in [
        ("signature 3 activity", "signature_3_activity", 0, 510, short),
        ("signature 3 share", "signature_3_percentage", 0, 1.2, short),
        ("log2 mutational burden", "Total_Mutational_Burdens", 3.5, 15, None),
        ("microhomology share", "Microhomology_Percent", 0, 0.6, None),
        ("NtAI", "NtAI", 0, 38, short),
        ("LST", "LST", 0, 52, None),
        ("HRD-LOH", "HRD_LOH", 0, 38, None),
        ("log2 indels", "Total_Indel_log2", 0, 10, None),
    ]:
        source = f"SELECT pattern AS cls, {value} AS v FROM measured WHERE pattern IS NOT NULL AND {value} BETWEEN {low} AND {high}"
        rows.append((metric, "all", source, _WT, "greater", cuts))
    for metric, value, low, high in [
        ("signature 3 activity", "signature_3_activity", 0, 470),
        ("signature 3 share", "signature_3_percentage", 0, 1),
        ("NtAI", "NtAI", 0, 40),
        ("LST", "LST", 0, 50),
        ("HRD-LOH", "HRD_LOH", 0, 38),
    ]:
        source = f"SELECT pattern AS cls, {value} AS v FROM measured WHERE pattern IS NOT NULL AND {three} AND {value} BETWEEN {low} AND {high}"
        rows.append((metric, "three types", source, _WT, "greater", None))
    for metric, measure, value, high in [
        ("log2 signature 3 activity", "signature_3_activity", "log2(signature_3_activity)", 12),
        ("signature 3 share", "signature_3_percentage", "signature_3_percentage", 1),
    ]:
        source = f"SELECT cls, {value} AS v, {measure} AS raw FROM ({_lumped_sql(measure)}) WHERE cls IS NOT NULL AND {value} BETWEEN 0 AND {high}"
        rows.append((metric, "cancer types", source, "Ovarian Cancer", "less", None))
    source = f"SELECT cls, signature_3_activity AS v FROM ({_REFINED_SQL}) WHERE cls IS NOT NULL AND signature_3_activity BETWEEN 0 AND 480"
    rows.append(("signature 3 activity", "refined classes", source, _WT, "greater", None))
    return rows


def _cohort_report_sql() -> str:
    ctes, parts = [], []
    for i, (metric, scope, source, ref, alternative, cuts) in enumerate(_comparison_sources()):
        ctes.append(f"src{i} AS MATERIALIZED ({source})")
        label = label_sql("p_value", cuts) if cuts else "label"
        rank = "raw" if scope == "cancer types" else "v"  # ties are those of the values before a logarithm
        parts.append(
            f"""SELECT '{metric}' AS metric, '{scope}' AS scope, b.cls AS class, b.n, q1, median, q3, whisker_low, whisker_high,
                       n_ref, u, z, p_value, {label} AS label
                FROM ({_rounded_box_sql(box_sql(f'SELECT * FROM src{i}', 'cls'), 'cls')}) b
                LEFT JOIN ({rank_sum_sql(f'SELECT cls, {rank} AS v FROM src{i}', ref, alternative)}) r ON b.cls = r.cls"""
        )
    return with_sql(*_ANNOTATED, *_MEASURES, *ctes, last=" UNION ALL ".join(parts))


@query("cohort_report", _cohort_report_sql())
def cohort_report(t):
    x, annotated = annotated_cohort(t)
    report = P.cohort_report(materialise(P.measured_samples(annotated, x)), method="normal")
    return report.select(
        "metric", "scope", "class", "n", *(F.round(c, 6).alias(c) for c in BOX_COLUMNS),
        "n_ref", "u", F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"), "label",
    )


def _cohort_density_sql() -> str:
    ctes, parts = [], []
    for i, (metric, scope, source, *_rest) in enumerate(_comparison_sources()):
        ctes.append(f"src{i} AS MATERIALIZED ({source})")
        parts.append(f"SELECT {i} AS comparison, '{metric}' AS metric, '{scope}' AS scope, cls AS class, v FROM src{i}")
    keys = "comparison, metric, scope, class"
    steps = [
        f"""all_rows AS MATERIALIZED ({" UNION ALL ".join(parts)})""",
        f"""spread AS (SELECT {keys}, count(*) AS n, min(v) AS lo, max(v) AS hi, coalesce(stddev_samp(v), 0) AS sd,
                   quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM all_rows GROUP BY {keys} HAVING count(*) > 1)""",
        """width AS (SELECT *, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd
                             WHEN lo <> 0 THEN abs(lo) ELSE 1 END * pow(n, -0.2) AS bw, (hi - lo) / 511.0 AS w FROM spread)""",
        f"""placed AS (SELECT {keys}, CASE WHEN w > 0 THEN (v - lo) / w ELSE 0 END AS place,
                   least(floor(CASE WHEN w > 0 THEN (v - lo) / w ELSE 0 END), 510) AS node FROM all_rows JOIN width USING ({keys}))""",
        f"""nodes AS (SELECT {keys}, node, sum(weight) AS weight FROM (
                   SELECT {keys}, node, 1 - (place - node) AS weight FROM placed
                   UNION ALL SELECT {keys}, node + 1, place - node FROM placed) GROUP BY {keys}, node HAVING sum(weight) > 0)""",
    ]
    last = f"""
        SELECT {keys}, point, round(any_value(lo + point * w), 6) AS x,
               round(sum(weight * exp(-pow((lo + point * w - (lo + node * w)) / bw, 2) / 2) / (n * bw * {math.sqrt(2 * math.pi)!r})), 6)
               AS density
        FROM nodes JOIN width USING ({keys}), (SELECT unnest(range(512)) AS point) GROUP BY {keys}, point
    """
    return with_sql(*_ANNOTATED, *_MEASURES, *ctes, *steps, last=last)


@query("cohort_density", _cohort_density_sql())
def cohort_density(t):
    x, annotated = annotated_cohort(t)
    density = P.cohort_density(materialise(P.measured_samples(annotated, x)))
    return density.select(
        "comparison", "metric", "scope", "class", "point", F.round("x", 6).alias("x"), F.round("density", 6).alias("density")
    )


def _fit_band_sql(y: str) -> str:
    return f"""
        SELECT 'NtAI ~ {y}' AS pair, point, round(place, 6) AS x, round(fit, 6) AS fit, round(fit - half, 6) AS lower,
               round(fit + half, 6) AS upper
        FROM (SELECT *, intercept + slope * place AS fit,
                     {t975_sql('(n - 2)')} * sigma * sqrt(1.0 / n + (place - mx) * (place - mx) / sxx) AS half
        FROM (SELECT *, lo + point * (hi - lo) / 79.0 AS place, sqrt(greatest(0, syy - slope * slope * sxx) / (n - 2)) AS sigma
        FROM (SELECT regr_count({y}, NtAI) AS n, regr_slope({y}, NtAI) AS slope, regr_intercept({y}, NtAI) AS intercept,
                     regr_avgx({y}, NtAI) AS mx, regr_sxx({y}, NtAI) AS sxx, regr_syy({y}, NtAI) AS syy,
                     min(NtAI) AS lo, max(NtAI) AS hi
              FROM measured WHERE NtAI IS NOT NULL AND LST IS NOT NULL AND HRD_LOH IS NOT NULL),
             (SELECT CAST(unnest(range(80)) AS INTEGER) AS point)))
    """


@query(
    "cohort_scar_fit",
    with_sql(*_ANNOTATED, *_MEASURES, last=f"{_fit_band_sql('LST')} UNION ALL {_fit_band_sql('HRD_LOH')}"),
)
def cohort_scar_fit(t):
    x, annotated = annotated_cohort(t)
    bands = P.scar_fits(materialise(P.measured_samples(annotated, x)))
    return bands.select("pair", "point", *(F.round(c, 6).alias(c) for c in ("x", "fit", "lower", "upper")))


def _correlation_sql(x: str, y: str) -> str:
    return f"""
        SELECT 'NtAI ~ {y}' AS pair, n, round(rho, 6) AS rho, round(t, 6) AS t, round(2.0 * {upper_tail_sql('dev')}, 6) AS p_value
        FROM (SELECT *, (((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b + 1.0) * sqrt(y) AS dev
        FROM (SELECT *, a * ln(1 + t * t / (n - 2)) AS y, 48 * a * a AS b
        FROM (SELECT n, rho, rho * sqrt(n - 2) / sqrt(1 - rho * rho) AS t, n - 2.5 AS a
        FROM (SELECT count(*) AS n, corr(rx, ry) AS rho
        FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx,
                     rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry
              FROM measured WHERE NtAI IS NOT NULL AND LST IS NOT NULL AND HRD_LOH IS NOT NULL)))))
    """


@query(
    "cohort_scar_correlations",
    with_sql(
        *_ANNOTATED,
        *_MEASURES,
        last=f"{_correlation_sql('NtAI', 'LST')} UNION ALL {_correlation_sql('NtAI', 'HRD_LOH')}",
    ),
)
def cohort_scar_correlations(t):
    x, annotated = annotated_cohort(t)
    pairs = P.scar_correlations(materialise(P.measured_samples(annotated, x)))
    return pairs.select("pair", "n", *(F.round(c, 6).alias(c) for c in ("rho", "t", "p_value")))


@query(
    "monoallelic_export",
    with_sql(
        *_ANNOTATED,
        *_MEASURES,
        last=f"""SELECT sample, Germline_mutation, Somatic_mutation, Tumor_zygosity, replace(pattern, ' ', chr(10)) AS pattern,
                        detailed_pattern, Cancer_Type, NtAI, LST, HRD_LOH
                 FROM measured WHERE contains(pattern, 'Monoallelic')""",
    ),
)
def monoallelic_export(t):
    x, annotated = annotated_cohort(t)
    table = P.measured_samples(annotated, x).select(*annotated.columns, "Cancer_Type", "NtAI", "LST", "HRD_LOH")
    path = scratch_path(t.spark, "monoallelic")
    P.export_monoallelic(table, path)
    return read_delimited(t.spark, path, schema=table.schema, escapes=True)


@query("cohort_scores")
def cohort_scores(t):
    x, annotated = annotated_cohort(t)
    table = materialise(P.model_table(annotated, x))
    fit, sample = P.train(table)
    whole = P.score_cohort(fit, table, sample).withColumn("scope", F.lit("all"))
    three = P.score_cohort(fit, table, sample, P.SCOPE_TYPES).withColumn("scope", F.lit("three types"))
    columns = ("scope", "sample", "pattern", "detailed_pattern", "HRD_detection_score", "position")
    return U.union_by_name(whole.select(*columns), three.select(*columns))
