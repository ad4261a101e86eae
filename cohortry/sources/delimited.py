"""Delimited text in and out, and the report sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# The backslash comes first on the way out and last on the way in; after it an escape has one of these letters.
ESCAPES = {"\\": "b", "\n": "n", "\r": "r", "\t": "t", "\0": "0"}
NOTHING = "\\e"  # marks a text that would be read as missing otherwise
NO_QUOTE = "\0"


def _escapes(sep: str) -> dict[str, str]:
    return ESCAPES if sep in ESCAPES else {**ESCAPES, sep: "s"}


def escaped(text: Column, sep: str = "\t", na: str = "NA") -> Column:
    """A text without line breaks and separators that is neither empty nor the marker for missing values."""
    out = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit("\\" + e[1])), _escapes(sep).items(), text)
    return F.when((text == "") | (text == na), F.concat(F.lit(NOTHING), out)).otherwise(out)


def unescaped(text: Column, sep: str = "\t") -> Column:
    """The text that ``escaped`` was given."""
    plain = F.replace(text, F.lit(NOTHING), F.lit(""))
    return reduce(lambda t, e: F.replace(t, F.lit("\\" + e[1]), F.lit(e[0])), [*_escapes(sep).items()][::-1], plain)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    sep: str = "\t",
    schema: StructType | str | None = None,
    na: str = "NA",
    comment: str | None = None,
    multiline: bool = False,
    escapes: bool = False,
) -> DataFrame:
    """Delimited text with a header row.

    With ``schema``, its columns are taken from the file by name, wherever they stand, and
    cast; columns beside them are not read, and a declared column that the header lacks
    raises an error.  Without it types are inferred, which costs one more pass.  All files of
    one call have the same header.  The unquoted text ``na`` is a missing value; choose
    another marker where that can be a value.  ``multiline`` is needed only for quoted values
    holding line breaks and makes each file one unsplittable task.  ``escapes`` reads what
    ``write_delimited(..., escapes=True)`` wrote: line breaks and separators are escaped, so
    every line is a row and a large file is read by many tasks; it needs a ``schema``.
    """
    reader = (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("nullValue", na)
        .option("quote", NO_QUOTE if escapes else '"')
        .option("escape", NO_QUOTE if escapes else '"')
        .option("multiLine", multiline)
    )
    if escapes and (schema is None or multiline):
        raise ValueError("escaped files need a schema, and no multiline")
    if comment:
        reader = reader.option("comment", comment)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    texts = reader.csv(path)
    if escapes:
        texts = texts.select(*(unescaped(F.col(f"`{c}`"), sep).alias(_plain(c, sep)) for c in texts.columns))
    missing = [f.name for f in wanted if f.name not in texts.columns]
    if missing:
        raise ValueError(f"no column {missing} in {path}; the header has {texts.columns}")
    return texts.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted))


def _plain(name: str, sep: str) -> str:
    """A column name as it was before escaping."""
    name = name.replace(NOTHING, "")
    for sign, letter in [*_escapes(sep).items()][::-1]:
        name = name.replace("\\" + letter, sign)
    return name


def _written(name: str, sep: str) -> str:
    for sign, letter in _escapes(sep).items():
        name = name.replace(sign, "\\" + letter)
    return name


def write_delimited(
    df: DataFrame, path: str, sep: str = "\t", na: str = "NA", mode: str = "errorifexists", escapes: bool = False
) -> None:
    """Delimited text, one file per partition, header in each, every value quoted.

    Missing values are written as ``na``.  A text that equals ``na`` would be read back as
    missing, so it raises an error; choose a marker that no text has.  With ``escapes``
    nothing is quoted: line breaks, separators and backslashes become a backslash and a
    letter, and a text that is empty or equals ``na`` gets a mark, so every text survives.
    """
    if escapes:
        if len(sep) != 1 or sep.isalnum() or sep in "\\\n\r\0.+-" or any(sign in na for sign in (*ESCAPES, sep)):
            raise ValueError("separator and marker must not hold what is escaped or part of a number")
        columns = []
        for f in df.schema:
            value = F.col(f"`{f.name}`")
            plain = escaped(value, sep, na) if isinstance(f.dataType, StringType) else value
            columns.append(plain.alias(_written(f.name, sep)))
        _writer(df.select(*columns), mode, sep, na).option("quote", NO_QUOTE).option("escape", NO_QUOTE).csv(path)
        return
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    clash = F.raise_error(F.lit(f"a text equals the marker {na!r} for missing values"))
    checked = df.withColumns({c: F.when(F.col(f"`{c}`") == na, clash.cast("string")).otherwise(F.col(f"`{c}`")) for c in texts})
    _writer(checked, mode, sep, na).option("quoteAll", True).option("escape", '"').csv(path)


def _writer(df: DataFrame, mode: str, sep: str, na: str):
    """Blanks at the ends of a text are part of it."""
    writer = df.write.mode(mode).option("sep", sep).option("header", True).option("nullValue", na)
    return writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def write_report(
    df: DataFrame, path: str, partition_by: str = "metric", mode: str = "errorifexists"
) -> None:
    """Plot-ready aggregate table as parquet, one folder per metric."""
    df.write.mode(mode).partitionBy(partition_by).parquet(path)
