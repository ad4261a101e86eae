"""Declared schemas of the cohort input files (read with ``read_delimited``).

Every file may hold more columns, in any order: declared columns are found by name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.sources.delimited import read_delimited

MUTATIONS = (
    "Tumor_Sample_Barcode string, Hugo_Symbol string, HGVSp_Short string, HGVSc string, "
    "Variant_Classification string, Variant_Type string"
)
SIGNATURES = "Tumor_Sample_Barcode string, Signature string, mean double"
VARIANTS = "sample string, BRCA_Type string, HGVSp_Short string, Hugo_Symbol string, zygosity_flag string"
CLINICAL = (
    "CMO_ID string, DMP_ID string, Sample_QC string, `12_245_PartC_Consented` string, BRCA_Type string, "
    "Variant_Type string, HGVSp_Short string, Hugo_Symbol string, Cancer_Type string"
)
CONTROL_CLINICAL = "SAMPLE_ID string, CANCER_TYPE string"
MSI = "SAMPLE_ID string, MSI_SCORE double"
ID_MAPPING = "SAMPLE_ID string, DMP_ID string"
MICROHOMOLOGY = "Sample string, Homology_Length int"
NTAI = "Sample string, NtAI int"
LST = "Sample string, LST int"
HRD_LOH = "Sample string, HRD_LOH int"
# The mutation spectrum has the sample barcode first, then one count column per mutation
# type, however many; read it with inference or with a schema of its own.

# The input tables by name; a control cohort has the same columns unless listed itself.
TABLES = {
    "mutations": MUTATIONS, "variants": VARIANTS, "clinical": CLINICAL, "control_clinical": CONTROL_CLINICAL,
    "signatures": SIGNATURES, "msi": MSI, "id_mapping": ID_MAPPING, "microhomology": MICROHOMOLOGY,
    "ntai": NTAI, "lst": LST, "hrd_loh": HRD_LOH,
}


def read_spectrum(spark: SparkSession, path, **options) -> DataFrame:
    """The mutation spectrum: the first column is the sample, all others are counts."""
    table = read_delimited(spark, path, schema=None, **options)
    sample, *counts = table.columns
    return table.select(
        F.col(f"`{sample}`").cast("string").alias(sample), *(F.col(f"`{c}`").cast("bigint").alias(c) for c in counts)
    )


def read_tables(spark: SparkSession, files: Mapping[str, str | list[str]], **options) -> dict[str, DataFrame]:
    """The input tables of a cohort from delimited files; ``options`` go to ``read_delimited``."""
    tables = {}
    for name, path in files.items():
        kind = name if name in TABLES else name.removeprefix("control_")
        if kind == "spectrum":
            tables[name] = read_spectrum(spark, path, **options)
        elif kind in TABLES:
            tables[name] = read_delimited(spark, path, schema=TABLES[kind], **options)
        else:
            raise ValueError(f"unknown input table {name!r}")
    return tables
