"""Merkle manifest of a dataset and the proof of every row, by pointer jumping.

Rows are hashed to leaves. The leaves of each group, in the order of their ids, are joined sixteen at a time into the
nodes above them until one is left, the group's subroot; the subroots, in the order of the groups, are joined likewise
into the root. A *run* is up to sixteen neighbours and the node they make. All nodes of a run share what lies above
them, so a run is the row that holds a pointer and a segment: the siblings on the way from its node to the node that
the pointer names. A round joins the runs to themselves through the pointers, concatenates the segments and doubles
the distance, so a tree of height h is done after log2(h) rounds; each leaf then adds its own siblings, which stand in
its run. Only 1/15 of the nodes are rows of these joins.

Pointers of a round at distance d only reach runs d levels up, of which there are 16**d times fewer than leaves: the
side that is looked up shrinks faster than its keys grow hot, and is broadcast once it has been measured to be small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.llm.common import stored
from cohortry.operators.joins import equi_join
from cohortry.operators.ranking import global_position, sorted_blocks
from cohortry.session import checked_broadcast

FAN_IN = 16
TOP = -1  # the tree of the subroots
RUN = ["tree", "level", "run"]


@dataclass(frozen=True)
class Manifest:
    """Tables of a manifest, written in the shared folder.

    ``leaf_runs`` (tree, run, n, children: id, leaf, seen) has the leaves of each run in order, ``n`` those of the
    tree. ``runs`` (tree, level, run, n, children) has the hashes that each run above joins, ``n`` counts the runs of
    its level. ``subroots`` (tree, grouping, subroot) names the groups; trees are numbered in the order of the groups.
    ``height`` is the number of runs on the longest way from a leaf to the root.
    """

    leaf_runs: DataFrame
    runs: DataFrame
    subroots: DataFrame
    root: str | None
    height: int


def encoded(value: Column) -> Column:
    """UTF-8 byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the encoded values, one after another."""
    return F.sha2(F.concat(*map(encoded, values)), 256)


def joined_hash(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def placed_leaves(leaves: DataFrame) -> DataFrame:
    """(tree, at, n, id, leaf, seen): tree number, place in the tree from 0 and its size, for (grouping, id, leaf, seen).

    Leaves are sorted by range, so a large group lies in many blocks; only a row per block and group is numbered in a
    window. Null groups and ids come first; rows alike in id stand in the order of their leaves.
    """
    # the last sort key only lets equal rows be split over blocks
    leaves = stored(leaves.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    blocks = sorted_blocks(leaves, [F.asc("grouping"), F.asc("id"), F.asc("leaf"), F.asc("salt")])
    parts = blocks.groupBy("__block", "grouping").agg(F.min("__row").alias("first"), F.count(F.lit(1)).alias("rows"))
    of_group = W.partitionBy("grouping")
    before = of_group.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        "__block",
        "grouping",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(of_group).alias("n"),
    )
    trees = global_position(blocks.select("grouping").distinct(), [F.asc("grouping")], "tree")
    named = equi_join(parts, trees.withColumn("tree", F.col("tree") - 1), "grouping", null_safe=True)
    every = equi_join(blocks, checked_broadcast(named), ["__block", "grouping"], null_safe=True)
    return every.select(
        "tree", (F.col("__row") + F.col("shift")).alias("at"), "n", "grouping", "id", "leaf", "seen"
    )


def above(count: Column) -> Column:
    """How many runs hold ``count`` nodes."""
    return F.floor((count + (FAN_IN - 1)) / FAN_IN)


def levels(nodes: DataFrame, level: int, most: int) -> list[DataFrame]:
    """Runs of ever higher levels over ``nodes`` (tree, at, n, hash), up to a tree of ``most`` nodes."""
    found = []
    while most > 1:
        run = F.floor(F.col("at") / FAN_IN)
        grouped = nodes.where(F.col("n") > 1).groupBy("tree", run.alias("run"), above(F.col("n")).alias("n"))
        children = F.array_sort(F.collect_list(F.struct("at", "hash")))
        runs = grouped.agg(children.alias("children"))  # sixteen at most
        runs = runs.select("tree", F.lit(level).alias("level"), "run", "n", F.col("children.hash").alias("children"))
        found.append(stored(runs, "runs"))
        nodes = found[-1].select("tree", F.col("run").alias("at"), "n", joined_hash(F.col("children")).alias("hash"))
        most, level = -(-most // FAN_IN), level + 1
    return found


def tops(runs: DataFrame) -> DataFrame:
    """(tree, hash) of the runs that are alone on their level."""
    return runs.where(F.col("n") == 1).select("tree", joined_hash(F.col("children")).alias("hash"))


def build(
    docs: DataFrame, columns: Sequence[str], id_column: str, group_column: str, found: dict[str, Column] | None = None
) -> Manifest:
    """The manifest of ``docs`` over ``columns``; written tables and the root.

    ``found`` replaces columns by what a later reader finds in them: ``seen`` is the leaf of the row as found, null
    where that is not different. Nulls are hashed as such, a null group is a group of its own and the first one.
    Repeated rows are leaves of their own. An empty table has no root. Further columns are ignored.
    """
    leaf = leaf_hash([F.col(f"`{c}`") for c in columns])
    seen = leaf_hash([found.get(c, F.col(f"`{c}`")) for c in columns]) if found else leaf
    differs = reduce(lambda a, b: a | b, [~v.eqNullSafe(F.col(f"`{c}`")) for c, v in (found or {}).items()], F.lit(False))
    leaves = docs.select(
        F.col(f"`{group_column}`").alias("grouping"),
        F.col(f"`{id_column}`").alias("id"),
        leaf.alias("leaf"),
        F.when(differs, seen).alias("seen"),
    )
    placed = placed_leaves(leaves)
    grouped = placed.groupBy("tree", F.floor(F.col("at") / FAN_IN).alias("run"), "n", "grouping")
    children = F.array_sort(F.collect_list(F.struct("at", "id", "leaf", "seen")))
    leaf_runs = stored(grouped.agg(children.alias("children")), "leaf-runs")  # sixteen at most
    # a lone leaf is its tree's subroot: it makes no node
    single = F.col("children")[0]["leaf"]
    node = F.when(F.col("n") == 1, single).otherwise(joined_hash(F.col("children.leaf")))
    nodes = leaf_runs.select("tree", F.col("run").alias("at"), above(F.col("n")).alias("n"), node.alias("hash"))
    sizes = leaf_runs.agg(F.max("n").alias("most"), F.max("tree").alias("last")).first()
    inner = levels(nodes, 1, -(-(sizes["most"] or 0) // FAN_IN))
    subroots = reduce(DataFrame.unionByName, map(tops, inner), nodes.where(F.col("n") == 1).select("tree", "hash"))
    names = leaf_runs.where(F.col("run") == 0).select("tree", "grouping")
    subroots = stored(subroots.join(names, "tree").select("tree", "grouping", F.col("hash").alias("subroot")), "subroots")
    trees = (sizes["last"] or 0) + 1
    outer = levels(
        subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees).alias("n"), F.col("subroot").alias("hash")),
        0,
        trees,
    )
    runs = reduce(DataFrame.unionByName, [*inner, *outer]) if inner or outer else empty_runs(docs)
    top = tops(outer[-1]).select("hash") if outer else subroots.select("subroot")
    root = top.first()
    return Manifest(leaf_runs.drop("grouping"), runs, subroots, root[0] if root else None, 1 + len(inner) + len(outer))


def empty_runs(docs: DataFrame) -> DataFrame:
    schema = "tree long, level int, run long, n long, children array<string>"
    return docs.sparkSession.createDataFrame([], schema)


def siblings(hashes: Column, place: Column) -> Column:
    """What stands left and right of a place (from 0) in a run."""
    right = F.slice(hashes, place + 2, F.greatest(F.size(hashes) - place - 1, F.lit(0)))
    return F.struct(
        F.array_join(F.slice(hashes, F.lit(1), place), "").alias("left"), F.array_join(right, "").alias("right")
    )


def segments(tree: Manifest) -> DataFrame:
    """(tree, run, segment) of every run of leaves: the siblings of its node and of all nodes above it, up to the root."""
    trees = tree.subroots.count()
    lowest = tree.leaf_runs.select("tree", F.lit(0).alias("level"), "run", above(F.col("n")).alias("n"))
    every = lowest.unionByName(tree.runs.drop("children"))
    # a run's node stands in the next level's run; the last of a tree stands among the subroots; the root nowhere
    inside = F.struct("tree", (F.col("level") + 1).alias("level"), F.floor(F.col("run") / FAN_IN).alias("run"))
    outside = F.struct(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.floor(F.col("tree") / FAN_IN).alias("run")
    )
    last_of_tree = (F.col("tree") != TOP) & F.lit(trees > 1)
    pointer = F.when(F.col("n") > 1, inside).when(last_of_tree, outside)
    place = F.when(F.col("n") > 1, F.col("run")).otherwise(F.col("tree")) % FAN_IN
    every = every.select(*RUN, pointer.alias("to"), place.cast("int").alias("place"))
    looked_up = tree.runs.select(F.struct(*RUN).alias("to"), "children")
    step = F.array(siblings(F.col("children"), F.col("place")))
    none = F.array().cast("array<struct<left: string, right: string>>")
    first = every.join(checked_broadcast(looked_up), "to", "left")
    first = first.select(*RUN, "to", F.when(F.col("children").isNotNull(), step).otherwise(none).alias("segment"))
    state, distance = stored(first, "segments"), 1
    while distance < tree.height - 1:
        reached = state.where((F.col("level") >= distance) | (F.col("tree") == TOP))
        reached = reached.select(F.struct(*RUN).alias("to"), F.col("to").alias("next"), F.col("segment").alias("more"))
        jumped = state.join(checked_broadcast(reached), "to", "left")
        segment = F.concat("segment", F.coalesce("more", none))
        state = stored(jumped.select(*RUN, F.col("next").alias("to"), segment.alias("segment")), "segments")
        distance *= 2
    return state.where((F.col("level") == 0) & (F.col("tree") != TOP)).select("tree", "run", "segment")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proofs(tree: Manifest) -> DataFrame:
    """(id, leaf, seen, subroot, proof) for every leaf.

    ``proof`` lists, from the leaf to the root, the text left and right of each node in its run; a run of one has
    empty texts.
    """
    runs = tree.leaf_runs.join(segments(tree), ["tree", "run"])
    runs = equi_join(runs, checked_broadcast(tree.subroots.select("tree", "subroot")), "tree")
    own = F.transform(
        "children",
        lambda c, at: F.struct(
            c["id"].alias("id"),
            c["leaf"].alias("leaf"),
            c["seen"].alias("seen"),
            F.col("subroot").alias("subroot"),
            F.when(F.col("n") == 1, F.col("segment"))
            .otherwise(F.concat(F.array(siblings(F.col("children.leaf"), at)), F.col("segment")))
            .alias("proof"),
        ),
    )
    return runs.select(F.inline(own))


def checked(tree: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every leaf.

    ``folded_root`` starts from the leaf as found (``seen``) where that differs, with the siblings of the manifest.
    """
    texts = F.transform("proof", lambda s: F.concat(s["left"], s["right"]))
    folded = proofs(tree).select(
        "id",
        "leaf",
        "subroot",
        F.lit(tree.root).cast("string").alias("root"),
        joined_hash(texts).alias("proof_sha256"),
        fold(F.coalesce("seen", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """A-Z as a-z, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def checked_documents(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_column: str = "doc_id",
    group_column: str = "source",
    text_column: str = "text",
    tampered_share: int = 5,
) -> DataFrame:
    """The manifest of ``docs`` checked against a copy in which some texts were lower-cased.

    A text is tampered with where ``tampered_share`` divides the CRC-32 of the decimal id; a null id or text stays as
    it is. A row whose text has no capital is verified although it was meant to be changed.
    """
    hit = F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % tampered_share == 0
    text = F.col(f"`{text_column}`")
    found = {text_column: F.when(hit, lowered(text)).otherwise(text)}
    return checked(build(docs, columns, id_column, group_column, found)).withColumnRenamed("id", id_column)
