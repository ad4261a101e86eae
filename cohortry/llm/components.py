"""Connected components of a link table, by alternating stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stored


def _star(links: DataFrame) -> DataFrame:
    """Point every node and all its neighbours at the smallest node around it.

    The neighbours of a node are never gathered: their minimum is a combined aggregate that is joined back. When
    nothing changes any more, every node is linked to the smallest of its component and to nothing else.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    around = both.join(least, "a").select(F.col("least").alias("a"), "b")
    own = least.select(F.col("least").alias("a"), F.col("a").alias("b"))
    return around.unionByName(own).where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long, not null); root is the smallest node reachable.

    Links of a node to itself, repeated and reversed links are harmless. Each round is written to the shared folder,
    so the plan stays short. Rounds end when the links have become stars and no longer change.
    """
    ordered = links.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    links = stored(ordered.distinct(), "links")
    before = None
    while True:
        seal = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seal == before:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                links.select(F.col("a").alias("node"), F.col("a").alias("root"))
            ).distinct()
        before = seal
        links = stored(_star(links), "links")
