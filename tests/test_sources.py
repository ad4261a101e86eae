import pytest
from pyspark.sql import functions as F

from cohortry import session as SS
from cohortry.operators import columns as C
from cohortry.sources import schemas
from cohortry.sources.delimited import read_delimited, write_delimited, write_report
from pyspark.sql.types import IntegerType
from conftest import as_set


def test_round_trip_keeps_line_breaks_quotes_and_missing_values(spark, rows, tmp_path):
    df = rows("id int, t string", (1, "Wildtype\nTumor"), (2, None), (3, 'say "x"\tnow'), (4, "back\\slash"))
    write_delimited(df, str(tmp_path / "out"))
    back = read_delimited(spark, str(tmp_path / "out"), schema=df.schema, multiline=True)
    assert as_set(back) == as_set(df)
    with pytest.raises(Exception, match="already exists"):
        write_delimited(df, str(tmp_path / "out"))


def test_reads_headers_comments_and_declared_types(spark, tmp_path):
    path = tmp_path / "ntai.txt"
    path.write_text("#version 2.4\nSample\tNtAI\ns1\t5\ns2\tNA\n")
    df = read_delimited(spark, str(path), schema=schemas.NTAI, comment="#")
    assert as_set(df) == {("s1", 5), ("s2", None)}
    inferred = read_delimited(spark, str(path), comment="#")
    assert dict(inferred.dtypes) == {"Sample": "string", "NtAI": "int"}


def test_declared_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "wide.txt"
    path.write_text("Hugo_Symbol\tEntrez\tTumor_Sample_Barcode\tScore\nBRCA1\t672\tT-01\t0.5\nTP53\tNA\tT-02\tNA\n")
    df = read_delimited(spark, str(path), schema="Tumor_Sample_Barcode string, Score double, Hugo_Symbol string")
    assert as_set(df) == {("T-01", 0.5, "BRCA1"), ("T-02", None, "TP53")}
    with pytest.raises(ValueError, match="Absent"):
        read_delimited(spark, str(path), schema="Hugo_Symbol string, Absent int")


def test_texts_that_equal_the_marker_are_not_lost(spark, rows, tmp_path):
    df = rows("id int, t string", (1, "NA"), (2, None))
    with pytest.raises(Exception, match="marker"):
        write_delimited(df, str(tmp_path / "clash"))
    write_delimited(df, str(tmp_path / "ok"), na="\\N")
    assert as_set(read_delimited(spark, str(tmp_path / "ok"), schema=df.schema, na="\\N")) == {(1, "NA"), (2, None)}


AWKWARD = [
    None, "", "NA", "\\eNA", "\\", "\\\\n", "a\nb", "\n", "a\r\nb\tc", 'say "x"', '"', " blanks ", "\\N", "\0", "é\u2028x", "#c", "a,b;c",
]


@pytest.mark.parametrize("sep, na", [("\t", "NA"), (",", ""), (";", "missing")])
def test_escapes_keep_every_text(spark, rows, tmp_path, sep, na):
    df = rows("id int, `t\tx` string, d double", *((k, t, None if t is None else k / 4) for k, t in enumerate(AWKWARD)))
    write_delimited(df, str(tmp_path / "out"), sep=sep, na=na, escapes=True)
    back = read_delimited(spark, str(tmp_path / "out"), sep=sep, schema=df.schema, na=na, escapes=True)
    assert as_set(back) == as_set(df) and back.columns == df.columns


def test_one_escaped_file_is_read_by_several_tasks(spark, rows, tmp_path):
    df = spark.range(20_000).selectExpr("id", r"concat('line one\nline two ', id, '\t') AS t").coalesce(1)
    write_delimited(df, str(tmp_path / "out"), escapes=True)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        back = read_delimited(spark, str(tmp_path / "out"), schema=df.schema, escapes=True)
        assert back.select(F.spark_partition_id()).distinct().count() > 3 and len(back.inputFiles()) == 1
        assert back.exceptAll(df).isEmpty() and back.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


def test_escapes_refuse_what_they_cannot_keep(spark, rows, tmp_path):
    df = rows("t string", ("a",))
    for sep, na in (("\\", "NA"), ("n", "NA"), ("\t", "a\tb"), ("\t", "\\N"), (".", "NA")):
        with pytest.raises(ValueError):
            write_delimited(df, str(tmp_path / "no"), sep=sep, na=na, escapes=True)
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "no"), escapes=True)


def test_blanks_at_the_ends_stay(spark, rows, tmp_path):
    df = rows("t string", (" a ",), ("\tb",))
    write_delimited(df, str(tmp_path / "out"))
    assert as_set(read_delimited(spark, str(tmp_path / "out"), schema=df.schema)) == as_set(df)


def test_report_is_partitioned_by_metric(spark, rows, tmp_path):
    write_report(rows("metric string, n int", ("a", 1), ("b", 2)), str(tmp_path / "r"))
    assert {p.name for p in (tmp_path / "r").iterdir() if p.is_dir()} == {"metric=a", "metric=b"}
    assert spark.read.parquet(str(tmp_path / "r")).where("metric = 'a'").first()["n"] == 1


def test_column_helpers(rows):
    df = rows("a int, b_x string, c_x double", (1, "t", 2.0))
    assert C.rename_at(df, 1, "z").columns == ["a", "z", "c_x"]
    assert C.drop_at(df, 0).columns == ["b_x", "c_x"]
    assert C.select_matching(df, "_x$", keep=["a"]).columns == ["a", "b_x", "c_x"]
    assert C.mutate_matching(df, "^c", lambda c: c * 2).first()["c_x"] == 4.0
    assert dict(C.mutate_by_type(df, IntegerType, lambda c: c.cast("string")).dtypes)["a"] == "string"
    assert C.select_renamed(df, {"a": "k"}, tag="v").first().asDict() == {"k": 1, "tag": "v"}


def test_scratch_paths_lie_in_the_shared_folder(spark):
    shared = SS.shared_folder(spark)
    assert SS.scratch_path(spark, "x").startswith(shared + "/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or shared == configured.rstrip("/")


def test_temporary_tables_are_deleted_by_their_owner(spark, rows):
    from pathlib import Path

    with SS.temporary_tables(spark):
        kept = SS.materialise(rows("k int", (1,), (2,)))
        path = Path(kept.inputFiles()[0].removeprefix("file:").removeprefix("//")).parent
        assert kept.count() == 2 and path.exists()
    assert not path.exists()


def test_checkpoint_survives_without_its_source(spark, rows):
    kept = SS.materialise(rows("k int", (1,), (2,)).withColumn("r", F.rand()))
    assert as_set(kept) == as_set(kept)
