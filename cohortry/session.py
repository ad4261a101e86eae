"""Session settings, materialisation and size-checked broadcasts shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

# A side is broadcast only when both bounds have been checked against the data.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 * 1024 * 1024


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benches; on a cluster the submitter configures its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # no Python call-site capture per column expression: plans are built in half the time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else (local mode only) a temp dir.

    The cluster's setting is taken as it is: a ``file:`` folder may be a share that all
    executors mount.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
            configured = tempfile.mkdtemp(prefix="cohortry-checkpoints-")
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return (configured or current).rstrip("/")


_owners: list[list[str]] = []  # written paths of the open temporary_tables contexts, innermost last


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables written inside once the block ends.

    Results must be written or collected inside the block, as they read those tables.
    """
    written: list[str] = []
    _owners.append(written)
    try:
        yield
    finally:
        _owners.remove(written)
        delete_tables(spark, written)


def delete_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table below the shared folder, owned by the open context if any."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows once as parquet in the shared folder and read them back.

    They keep their values for every later read, survive executor loss, are read column
    by column, and their file size is known to the optimizer.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> bool:
    """Measure ``df`` and tell whether it is small enough to copy to every executor."""
    bounded = df.limit(max_rows + 1)
    sized = [f.name for f in df.schema.fields if not isinstance(f.dataType, (NumericType, BooleanType))]
    width = sum((F.octet_length(F.col(c).cast("string")) for c in sized), F.lit(16 * len(df.columns)))
    size = bounded.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce(width, F.lit(64))).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Compute an aggregate once, measure it and broadcast it when both bounds hold.

    Beyond the bounds the join stays a shuffled one, whose hot keys AQE's skew-join
    rule splits over several tasks.
    """
    kept = materialise(df)
    return F.broadcast(kept) if fits_broadcast(kept) else kept
