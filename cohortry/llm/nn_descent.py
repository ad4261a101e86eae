"""Near-duplicate vectors by NN-descent.

Equal vectors of one label fall together into classes. Every class has a list of its nearest neighbours, first from
random-hyperplane buckets and a random group, and then refined by joining neighbours of neighbours: all classes around
one class are compared with each other in one small matrix product, and improve each other's lists. Rounds go on until
no further link of the threshold turns up; a group that has no new member is not compared again. Only vectors of one
label and dimension, a space, are compared; a space has as many hyperplanes as its own size needs, and a small one is
one bucket, so it is compared whole however large others are.

A list that is full of links is saturated and may hide further ones. Its links then become a component, and the next
round searches with lists that hold members of other components only, which enlarges the saturated lists by all that
their component already explains. Rounds end when no component grows and the recall, audited against brute force on
samples of queries, is high enough for small and large spaces, and for few and many links. Link counts come from comparing the members of each component with each other in
tiles, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import bounds, in_tasks, stored, whole_groups
from cohortry.llm.components import components
from cohortry.operators.ranking import sorted_blocks
from cohortry.session import checked_broadcast

SIMILARITY = 0.98
NEIGHBOURS = 10
TABLES = 4
GROUP_MEMBERS = 256
TILE_MEMBERS = 512
AUDIT_QUERIES = 1024  # about that many for spaces of each order of size
AUDIT_LEAST = 20  # queries with links that a stratum needs to be judged by itself
RECALL = 0.95
ANGLE_MARGIN = 1e-6  # angles of the bounds on tiles are rounded
MARGIN = 1e-4  # lists are kept in single precision; links are decided in double


def scaled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, vector) to (vec_id, label, unit)."""

    def unit(vector: list | None, label) -> np.ndarray | None:
        if label is None or not vector or None in vector:
            return None
        values = np.array(vector, dtype=np.float64)
        largest = np.abs(values).max()
        if not np.isfinite(largest) or largest == 0:
            return None
        values /= largest  # squares of very large or small numbers would overflow or vanish
        return values / np.sqrt(values @ values) + 0.0  # + 0.0 turns -0.0 into 0.0, so equal vectors group together

    for batch in batches:
        labels, vectors = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        units = [unit(v, y) for v, y in zip(vectors, labels, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(units, pa.list_(pa.float64()))], ["vec_id", "label", "unit"]
        )


def unit_vectors(embeddings: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(vec_id, label, unit): vectors of length one in double precision; unit is null where nothing can link."""
    raw = embeddings.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(label_column).alias("label"),
        F.col(vector_column).cast("array<double>").alias("v"),
    )
    label = raw.schema["label"].dataType.simpleString()
    return in_tasks(raw, scaled_rows, f"vec_id long, label {label}, unit array<double>")


def bucket_codes(batches: Iterator[pa.RecordBatch], tables: int, random_size: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(node, space, bits, size, unit) to (number, space, code, node): a row per table and one of a random group.

    A space without bits is one bucket, which one row stands for.
    """
    for batch in batches:
        nodes, space, bits, size = (batch.column(k).to_numpy() for k in range(4))
        units = batch.column(4)
        widths = np.array(units.value_lengths())
        for dim, own in set(zip(widths.tolist(), bits.tolist(), strict=True)):
            at = np.flatnonzero((widths == dim) & (bits == own))
            if own == 0:
                codes = [np.zeros(len(at), dtype=np.int64)]
            else:
                values = np.array(units.take(pa.array(at)).flatten()).reshape(len(at), dim)
                planes = np.random.default_rng([seed, dim, own]).standard_normal((tables, dim, own))
                codes = [(values @ planes[t] > 0) @ (1 << np.arange(own, dtype=np.int64)) for t in range(tables)]
                groups = np.maximum(1, size[at] // random_size).astype(np.uint64)
                mixed = (nodes[at].astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                codes.append(((mixed ^ (mixed >> np.uint64(29))) % groups).astype(np.int64))
            for number, code in enumerate(codes):
                columns = [np.full(len(at), number, dtype=np.int64), space[at], code, nodes[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["number", "space", "code", "node"])


def local_join(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """(group, node, root, worst, vector): compare the members of a group, yield (node, other, similarity).

    Only what may improve a member's list, and has another root, is given: its best ``keep`` above ``worst``.
    """
    for table in whole_groups(batches):
        node, root, worst = (table.column(k).to_numpy() for k in (1, 2, 3))
        vectors = table.column(4).combine_chunks()
        values, offsets = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
        offsets = offsets - offsets[0]
        found = []
        for start, end in bounds(table.column(0).to_numpy()):
            if end - start < 2:
                continue
            matrix = values[offsets[start] : offsets[end]].reshape(end - start, -1)
            likeness = matrix @ matrix.T
            likeness[root[start:end, None] == root[None, start:end]] = -2.0
            if end - start > keep:
                best = np.argpartition(-likeness, keep - 1, axis=1)[:, :keep]
            else:
                best = np.broadcast_to(np.arange(end - start), (end - start, end - start))
            value = np.take_along_axis(likeness, best, axis=1)
            row, column = np.nonzero((value > worst[start:end, None]) & (value > -1.5))
            found.append((node[start + row], node[start + best[row, column]], value[row, column].astype(np.float32)))
        if found:
            columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "other", "likeness"])


def best_of(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """(node, other, likeness) to the ``keep`` best different others of each node."""
    for table in whole_groups(batches):
        node, other, likeness = (table.column(k).to_numpy() for k in range(3))
        order = np.lexsort((-likeness, other, node))
        node, other, likeness = node[order], other[order], likeness[order]
        first = np.append(True, (node[1:] != node[:-1]) | (other[1:] != other[:-1]))
        node, other, likeness = node[first], other[first], likeness[first]
        order = np.lexsort((other, -likeness, node))
        node, other, likeness = node[order], other[order], likeness[order]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
        kept = rank < keep
        yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (node, other, likeness)], ["node", "other", "likeness"])


def tile_counts(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(group, node, low, high, tile, members, unit): for each node the members of classes it links to in the group."""
    for table in whole_groups(batches):
        node, low, high, tile, members = (table.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
        units = table.column(6).combine_chunks()
        values, offsets = units.flatten().to_numpy(zero_copy_only=False), units.offsets.to_numpy()
        offsets = offsets - offsets[0]
        nodes, counts = [], []
        for start, end in bounds(table.column(0).to_numpy()):
            matrix = values[offsets[start] : offsets[end]].reshape(end - start, -1)
            linked = matrix @ matrix.T >= least
            if low[start] == high[start]:
                np.fill_diagonal(linked, False)
            else:  # pairs within one tile are counted where the tile meets itself
                linked &= tile[start:end, None] != tile[None, start:end]
            nodes.append(node[start:end])
            counts.append(linked @ members[start:end])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(counts))], ["node", "n"])


def true_links(batches: Iterator[pa.RecordBatch], queries: list[tuple], least: float) -> Iterator[pa.RecordBatch]:
    """(node, space, root, unit) against the audit queries, by brute force: (query, links, links to its own root)."""
    by_space: dict[int, list] = {}
    for node, space, root, unit in queries:
        by_space.setdefault(space, []).append((node, root, unit))
    stacked = {s: tuple(np.array(c) for c in zip(*q, strict=True)) for s, q in by_space.items()}
    for batch in batches:
        order = np.argsort(batch.column(1).to_numpy(), kind="stable")
        nodes, spaces, roots = (batch.column(k).to_numpy()[order] for k in range(3))
        units = batch.column(3).take(pa.array(order))
        for start, end in bounds(spaces) if len(order) else ():
            if spaces[start] not in stacked:
                continue
            query, own, matrix = stacked[spaces[start]]
            values = np.array(units.slice(start, end - start).flatten()).reshape(end - start, -1)
            linked = (values @ matrix.T >= least) & (nodes[start:end, None] != query)
            found = (linked & (roots[start:end, None] == own)).sum(0)
            n = linked.sum(0)
            columns = [query[n > 0], n[n > 0], found[n > 0]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "n", "found"])


def in_groups(members: DataFrame, salt: int) -> DataFrame:
    """(key, node) to (group, node): keys with more than ``GROUP_MEMBERS`` are split into several groups by hash."""
    sizes = members.groupBy("key").count().where(F.col("count") > GROUP_MEMBERS)
    sizes = sizes.select("key", F.ceil(F.col("count") / GROUP_MEMBERS).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("node", F.lit(salt)), F.col("parts")), F.lit(0))
    return members.join(sizes, "key", "left").select(F.xxhash64("key", part).alias("group"), "node")


def improved(lists: DataFrame | None, members: DataFrame, nodes: DataFrame, neighbours: int, salt: int) -> DataFrame:
    """Lists after one local join over ``members`` (key, node)."""
    known = nodes.withColumn("worst", F.lit(-2.0).cast("float"))
    if lists is not None:
        worst = lists.groupBy("node").agg(F.min("likeness").alias("least"), F.count(F.lit(1)).alias("n"))
        full = worst.where(F.col("n") >= neighbours).select("node", "least")
        known = nodes.join(full, "node", "left").withColumn("worst", F.coalesce("least", F.lit(-2.0).cast("float")))
    rows = in_groups(members, salt).join(known.select("node", "root", "worst", "vector"), "node")
    rows = rows.select("group", "node", "root", "worst", "vector")
    schema = "node long, other long, likeness float"
    found = in_tasks(rows.repartition("group").sortWithinPartitions("group"), partial(local_join, keep=neighbours), schema)
    if lists is not None:
        found = found.unionByName(lists)
    return stored(
        in_tasks(found.repartition("node").sortWithinPartitions("node"), partial(best_of, keep=neighbours), schema), "lists"
    )


def around_focus(members: DataFrame, focus: DataFrame | None) -> DataFrame:
    """Of (key, node) the keys that a node of ``focus`` belongs to; all where there is no focus."""
    if focus is None:
        return members
    return members.join(members.join(focus, "node").select("key").distinct(), "key", "left_semi")


def descent(
    nodes: DataFrame, classes: DataFrame, least: float, neighbours: int, seed: int, focus: DataFrame | None = None
) -> DataFrame:
    """Neighbour lists (node, other, likeness) that leave out members of the node's own root.

    With ``focus``, only groups that one of its nodes belongs to are compared. The first groups give every node about
    twice as many of its own space as a list holds, if there are so many.
    """
    codes = in_tasks(
        classes.select("node", "space", "bits", "size", "unit"),
        partial(bucket_codes, tables=TABLES, random_size=2 * neighbours + 2, seed=seed),
        "number long, space long, code long, node long",
    )
    members = codes.select(F.xxhash64("number", "space", "code").alias("key"), "node")
    lists = improved(None, around_focus(members, focus), nodes, neighbours, seed)
    count = lambda table: table.where(F.col("likeness") >= least - MARGIN).count()
    links, known = count(lists), None
    while True:
        around = lists.select(F.col("node").alias("key"), F.col("other").alias("node"))
        back = lists.select(F.col("other").alias("key"), "node")
        seed += 1
        members = stored(around_focus(around.unionByName(back).distinct(), focus), "members")
        changed = members
        if known is not None:  # a group whose members all met before has nothing to tell
            changed = members.join(members.join(known, ["key", "node"], "left_anti").select("key").distinct(), "key", "left_semi")
        lists = improved(lists, changed, nodes, neighbours, seed)
        known = members
        before, links = links, count(lists)
        if links <= before:
            return lists


def exact_links(lists: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b) of the listed pairs whose cosine, in double precision, reaches the threshold."""
    near = lists.where(F.col("likeness") >= least - MARGIN)
    pairs = near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    unit = classes.select("node", "unit")
    pairs = pairs.join(unit.select(F.col("node").alias("a"), F.col("unit").alias("u")), "a")
    pairs = pairs.join(unit.select(F.col("node").alias("b"), F.col("unit").alias("v")), "b")
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)
    return pairs.where(dot >= least).select("a", "b")


def audited_recall(
    classes: DataFrame, groups: DataFrame, least: float, neighbours: int, queries: int = AUDIT_QUERIES
) -> float:
    """Recall against brute force, by queries, in the worst stratum; 1.0 when no query has links.

    About ``queries`` are drawn by hash from the spaces of each order of size, so the sample grows with the number of
    orders only. A query's recall is the share of its links whose ends lie in one component, and every query counts
    alike, so large groups do not outvote single pairs. Strata are the orders of size, with more links than
    ``neighbours`` or fewer; those with under ``AUDIT_LEAST`` queries that have links are judged together.
    """
    order = F.floor(F.log2("size")).cast("int")
    sized = {r.stratum: r.n for r in classes.groupBy(order.alias("stratum")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sized:
        return 1.0
    ceiling = F.create_map(*(F.lit(x) for s, n in sized.items() for x in (s, min(1.0, queries / n))))
    draw = F.pmod(F.xxhash64("node", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rooted = classes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    drawn = rooted.withColumn("stratum", order).where((F.col("size") > 1) & (draw < ceiling[F.col("stratum")]))
    drawn = drawn.select("node", "space", "root", "unit", "stratum").collect()
    if not drawn:
        return 1.0
    sample, strata = [(r.node, r.space, r.root, r.unit) for r in drawn], {r.node: r.stratum for r in drawn}
    # sums in another order may round a cosine at the threshold to its other side: such a pair is not asked for
    compare = partial(true_links, queries=sample, least=least + 1e-12)
    links = in_tasks(rooted.select("node", "space", "root", "unit"), compare, "a long, n long, found long")
    judged: dict[tuple, list[float]] = {}
    for r in links.groupBy("a").agg(F.sum("n").alias("n"), F.sum("found").alias("found")).collect():
        judged.setdefault((strata[r.a], r.n > neighbours), []).append(r.found / r.n)
    shares = [v for v in judged.values() if len(v) >= AUDIT_LEAST]
    rest = [x for v in judged.values() if len(v) < AUDIT_LEAST for x in v]
    return min((sum(v) / len(v) for v in [*shares, rest] if v), default=1.0)


def centres(members: DataFrame) -> DataFrame:
    """(root, centre): the mean direction of the ``unit`` of each root; the first axis where they cancel out."""
    values = members.select("root", F.posexplode("unit").alias("k", "x"))
    sums = values.groupBy("root", "k").agg(F.sum("x").alias("x"))
    ordered = sums.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"))
    total = ordered.select("root", F.transform("s", lambda v: v["x"]).alias("s"))
    total = total.withColumn("norm", F.sqrt(F.aggregate("s", F.lit(0.0), lambda n, x: n + x * x)))
    axis = F.transform("s", lambda x, k: F.when(k == 0, 1.0).otherwise(0.0))
    mean = F.transform("s", lambda x: x / F.col("norm"))
    return total.select("root", F.when(F.col("norm") > 1e-9, mean).otherwise(axis).alias("centre"))


def link_counts(classes: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """(node, n): for members of components, the vectors of other classes they link to, by tiles of the component.

    A component above ``TILE_MEMBERS`` is sorted by the angle to its centre and cut into tiles. By the triangle
    inequality two tiles whose largest angles add up to less than the threshold's are linked throughout, and counted by
    their sizes; tiles whose angles differ by more share no link. Only vectors of the other pairs of tiles meet.
    """
    placed = classes.select("node", "members", "unit").join(groups, "node")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = checked_broadcast(sizes.where(F.col("n") > TILE_MEMBERS).select("root"))
    one = placed.join(large, "root", "left_anti").select(F.col("root").alias("low"), F.col("root").alias("high"), "node", "members", "unit")
    meeting = one.withColumn("tile", F.col("low"))
    if large.isEmpty():
        return met_links(meeting, least).groupBy("node").agg(F.sum("n").alias("n"))

    several = placed.join(large, "root", "left_semi")
    angle = F.acos(F.least(F.lit(1.0), F.aggregate(F.zip_with("unit", "centre", lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)))
    turned = several.join(checked_broadcast(centres(several)), "root").select("node", "root", "members", angle.alias("angle"))
    blocks = sorted_blocks(turned, [F.asc("root"), F.asc("angle"), F.asc("node")])
    part = F.floor(F.col("__row") / TILE_MEMBERS)
    blocks = blocks.select("node", "root", "members", "angle", F.xxhash64("root", "__block", part).alias("tile"))
    tiles = stored(
        blocks.groupBy("root", "tile").agg(
            F.min("angle").alias("near"), F.max("angle").alias("far"), F.sum("members").alias("members")
        ),
        "tiles",
    )
    limit = math.acos(least)
    other = tiles.select("root", *(F.col(c).alias(f"other_{c}") for c in ("tile", "near", "far", "members")))
    apart = F.greatest(F.col("near") - F.col("other_far"), F.col("other_near") - F.col("far"))
    pairs = tiles.join(other, "root").where(apart <= limit + ANGLE_MARGIN)
    pairs = pairs.withColumn("whole", F.col("far") + F.col("other_far") <= limit - ANGLE_MARGIN)
    pairs = stored(pairs.select("tile", "other_tile", "other_members", "whole"), "tile-pairs")

    whole = pairs.where("whole").groupBy("tile").agg(
        F.sum("other_members").alias("n"), F.max((F.col("tile") == F.col("other_tile")).cast("long")).alias("own")
    )
    counted = blocks.join(whole, "tile").select("node", (F.col("n") - F.col("own") * F.col("members")).alias("n"))
    unequal = pairs.where(~F.col("whole"))
    unequal = unequal.select("tile", F.least("tile", "other_tile").alias("low"), F.greatest("tile", "other_tile").alias("high"))
    rows = blocks.select("node", "members", "tile").join(unequal, "tile").join(classes.select("node", "unit"), "node")
    meeting = meeting.unionByName(rows.select("low", "high", "node", "members", "unit", "tile"))
    return met_links(meeting, least).unionByName(counted).groupBy("node").agg(F.sum("n").alias("n"))


def met_links(meeting: DataFrame, least: float) -> DataFrame:
    """(node, n) of the pairs (low, high) of tiles whose vectors are compared, a row per pair and node."""
    rows = meeting.select(F.xxhash64("low", "high").alias("group"), "node", "low", "high", "tile", "members", "unit")
    rows = rows.repartition("group").sortWithinPartitions("group")
    return in_tasks(rows, partial(tile_counts, least=least), "node long, n long")


def near_vectors(
    embeddings: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    least: float = SIMILARITY,
    neighbours: int = NEIGHBOURS,
    recall: float = RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings``.

    Vectors link when their labels are equal and not null, their dimensions agree and their cosine is at least
    ``least``. Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing. ``n_links``
    counts the other rows linked directly, copies included; ``component_id`` is the smallest vec_id reachable, the
    own one included; ``kept`` tells whether that is the row's id. Repeated rows are vectors of their own, which link
    with each other. Null ids name no component unless all its ids are null, and are kept only then. No pair below
    the threshold links; links may be missed, at the audited rate. Further columns are ignored. An empty table gives
    no rows.
    """
    units = unit_vectors(embeddings, id_column, vector_column, label_column)
    usable = units.where(F.col("unit").isNotNull())
    grouped = usable.groupBy("label", "unit").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("members"))
    space = F.xxhash64("label", F.size("unit"))
    found = stored(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("space", space), "found")
    sizes = stored(found.groupBy("space").agg(F.count(F.lit(1)).alias("size")), "sizes")
    largest = sizes.agg(F.max("size")).first()[0] or 0
    bits = F.when(F.col("size") <= GROUP_MEMBERS, 0).otherwise(F.ceil(F.log2(F.col("size") / neighbours))).cast("long")
    classes = stored(found.join(sizes, "space").withColumn("bits", bits), "classes")
    vectors = classes.select("node", F.col("unit").cast("array<float>").alias("vector"))

    groups, links, focus, seed = None, None, None, 1
    while largest > 1:
        known = vectors.withColumn("root", F.col("node"))
        if groups is not None:
            known = vectors.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        lists = descent(known, classes, least, neighbours, 1000 * seed, focus)
        found = stored(exact_links(lists, classes, least), "links")
        grown = not found.isEmpty()
        if grown or links is None:
            links = found if links is None else stored(found.unionByName(links), "links")
            groups = stored(components(links), "components")
        near = lists.where(F.col("likeness") >= least - MARGIN).groupBy("node").count()
        focus = stored(near.where(F.col("count") >= neighbours).select("node"), "saturated")
        if focus.isEmpty() or not grown:
            # nothing is hidden any more; too low a recall starts again from other buckets, for all nodes
            if audited_recall(classes, groups, least, neighbours) >= recall:
                break
            focus = None
        seed += 1

    if groups is None:
        groups = classes.select("node", F.col("node").alias("root")).where(F.lit(False))
    ids = classes.select("node", "least_id").join(groups, "node")
    names = ids.groupBy("root").agg(F.min("least_id").alias("component"))
    named = groups.join(names, "root").select("node", "component")
    measured = classes.join(link_counts(classes, groups, least), "node", "left").join(named, "node", "left")
    measured = measured.select(
        F.col("label").alias("own_label"),
        F.col("unit").alias("own_unit"),
        (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"),
        F.coalesce("component", "least_id").alias("component_id"),
    )
    same = units["unit"].eqNullSafe(measured["own_unit"]) & (units["label"] == measured["own_label"])
    result = units.join(measured, same, "left")
    component = F.when(F.col("own_unit").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
