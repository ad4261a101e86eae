"""Row identity, stored intermediates and names shared by the training-data operators."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import cohortry
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import scratch_path

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(cohortry.__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:  # on the driver; Spark serves the file to the executors
        sources = Path(folder, "sources", package.name)
        shutil.copytree(package, sources, ignore=shutil.ignore_patterns("__pycache__"))
        kept = Path(tempfile.mkdtemp(prefix="cohortry-package-"), package.name)
        context.addPyFile(shutil.make_archive(str(kept), "zip", sources.parent))
    _shipped.add(context.applicationId)


def in_tasks(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once, compressed, in the shared folder and read it back.

    The rows keep their values, lost executors cost a re-read, and later readers take only the columns they need.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables in which every key of column 0 (a long, sorted) has all its rows.

    Holds the rows of one key besides the batch at hand.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # where the last key of the batch begins
        if held and (cut or held[-1].column(0)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place of every run of equal keys, the end exclusive."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores added until no column of ``taken`` has it (Spark ignores case)."""
    names = {t.lower() for t in taken}
    while name.lower() in names:
        name += "_"
    return name


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def identified(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, row, text): ``row`` is a hash of the text, so rows with one id and different texts stay apart.

    Rows that agree in id and text are one document; a null text is an empty one. Other columns are left out.
    """
    text = text_or_empty(text_column)
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
