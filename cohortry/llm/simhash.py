"""SimHash near-duplicates with a Gray-order hierarchical index.

Two 64-bit fingerprints that differ in at most three bits agree on two of five fixed bit groups, so each distinct
fingerprint hangs below ten upper nodes, one for each pair of groups: the node's mask and the bits under it. Below an
upper node fingerprints are sorted by Gray rank, neighbours in that order share most bits, and runs of them are
factored into nodes that hold the bits shared by all members. A search adds up the differences on the way down and
drops a whole node once more than three are found.

Copies fall together before the search, and a node reports links that span its groups rather than all pairs, so
the links grow with the fingerprints. Nodes with very many members are split into tiles whose pairs are searched by
different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from cohortry.llm.common import bounds, fresh, in_tasks, stored, text_or_empty, whole_groups
from cohortry.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_DIFFERENCES = 3
GROUP_BITS = (13, 13, 13, 13, 12)
TILE_MEMBERS = 4096
FAN_OUT = 8
HASHES_AT_ONCE = 1 << 16
QUERIES_AT_ONCE = 256


def fingerprint(text: str) -> int:
    """64-bit SimHash: a bit is set when more than half of the shingle hashes have it; 0 without words.

    Bytes split at space and \\x09-\\x0D and lower-case A-Z only, as the definition asks.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = list(zip(*(words[k:] for k in range(SHINGLE_WORDS)), strict=False)) or [words]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), HASHES_AT_ONCE):
        part = map(b" ".join, shingles[at : at + HASHES_AT_ONCE])
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    ones = total * 2 > len(shingles)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def add_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=len(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, print) for every row, the fingerprint as a signed long."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return in_tasks(source, add_fingerprints, "doc_id long, print long")


def masks() -> list[int]:
    """The bits of each pair of groups."""
    groups, start = [], 0
    for width in GROUP_BITS:
        groups.append(((1 << width) - 1) << start)
        start += width
    return [a | b for a, b in combinations(groups, 2)]


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position in the Gray sequence: the number whose Gray code the fingerprint is."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def bit_count(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values).astype(np.int64)


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; level 0 holds the fingerprints themselves.

    ``shared[k]`` are the bits on which all members of a node agree, ``own[k]`` those of them that the node above
    does not share already, ``pattern[k]`` the values. Every level has ``FAN_OUT`` nodes below one of the next.
    """

    def __init__(self, prints: np.ndarray):
        ordered = prints[np.argsort(gray_rank(prints), kind="stable")]
        self.prints = ordered
        everything = np.full(len(ordered), np.iinfo(np.uint64).max, dtype=np.uint64)
        self.shared, self.pattern = [everything], [ordered]
        while len(self.pattern[-1]) > 1:
            starts = np.arange(0, len(self.pattern[-1]), FAN_OUT)
            shared, pattern = self.shared[-1], self.pattern[-1]
            first = np.repeat(pattern[starts], np.diff(np.append(starts, len(pattern))))
            agree = np.bitwise_and.reduceat(shared & ~(pattern ^ first), starts)
            self.shared.append(agree)
            self.pattern.append(pattern[starts] & agree)
        self.own = [
            self.shared[k] & ~self.shared[k + 1][np.arange(len(self.shared[k])) // FAN_OUT]
            for k in range(len(self.shared) - 1)
        ] + [self.shared[-1]]

    def search(self, first: int, last: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of positions (query, member after it) within ``most`` differences, for queries first..last-1."""
        query = np.arange(first, last)
        node = np.zeros(len(query), dtype=np.int64)
        found = bit_count((self.prints[query] ^ self.pattern[-1][0]) & self.own[-1][0])
        alive = found <= most
        query, node, found = query[alive], node[alive], found[alive]
        members = FAN_OUT ** (len(self.own) - 1)
        for level in range(len(self.own) - 2, -1, -1):
            members //= FAN_OUT
            below = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            query, found = np.repeat(query, FAN_OUT), np.repeat(found, FAN_OUT)
            # only members after the query: the pair is found from its other end otherwise
            real = (below < len(self.own[level])) & ((below + 1) * members > query + 1)
            query, found, node = query[real], found[real], below[real]
            found = found + bit_count((self.prints[query] ^ self.pattern[level][node]) & self.own[level][node])
            alive = found <= most
            query, node, found = query[alive], node[alive], found[alive]
        return query, node


def spanning_links(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest position of its group) that connect what lies within ``most`` differences."""
    index = GrayIndex(prints)
    label = np.arange(len(prints))
    for at in range(0, len(prints), QUERIES_AT_ONCE):
        a, b = index.search(at, min(at + QUERIES_AT_ONCE, len(prints)), most)
        while len(a):
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            open_pairs = low != high
            a, b, low, high = a[open_pairs], b[open_pairs], low[open_pairs], high[open_pairs]
            np.minimum.at(label, high, low)
            while not np.array_equal(label, jumped := label[label]):
                label = jumped
    moved = np.flatnonzero(label != np.arange(len(label)))
    return index.prints[moved], index.prints[label[moved]]


def link_nodes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Search each upper node (rows with one key, which lie together) and yield links a, b."""
    for table in whole_groups(batches):
        prints = table.column(1).to_numpy().view(np.uint64)
        found = [
            spanning_links(prints[start:end], most)
            for start, end in bounds(table.column(0).to_numpy())
            if end - start > 1
        ]
        if found:
            columns = [pa.array(np.concatenate(side).view(np.int64)) for side in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])


def upper_nodes(prints: DataFrame, tile_members: int = TILE_MEMBERS) -> DataFrame:
    """(node, print): a fingerprint below each of its upper nodes; large nodes as pairs of tiles."""

    def node(number: int, mask: int) -> Column:
        signed = mask - (1 << 64) if mask >> 63 else mask
        return F.struct(F.lit(number).alias("number"), F.col("print").bitwiseAND(F.lit(signed)).alias("bits"))

    below = prints.select("print", F.explode(F.array(*[node(k, m) for k, m in enumerate(masks())])).alias("n"))
    below = below.select("print", "n.number", "n.bits")
    large = below.groupBy("number", "bits").count().where(F.col("count") > tile_members)
    large = large.select("number", "bits", F.ceil(F.col("count") / tile_members).cast("int").alias("tiles"))
    tiled = below.join(large, ["number", "bits"], "left")
    tile = F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int")
    pairs = F.when(
        F.col("tiles").isNotNull(),
        F.transform(
            F.sequence(F.lit(0), F.col("tiles") - 1),
            lambda other: F.struct(F.least(tile, other).alias("low"), F.greatest(tile, other).alias("high")),
        ),
    ).otherwise(F.array(F.struct(F.lit(-1).alias("low"), F.lit(-1).alias("high"))))
    dealt = tiled.select("print", "number", "bits", F.explode(pairs).alias("pair"))
    return dealt.select(F.xxhash64("number", "bits", "pair.low", "pair.high").alias("node"), "print")


def near_links(prints: DataFrame, most: int = MAX_DIFFERENCES) -> DataFrame:
    """Links a, b that connect the distinct fingerprints ``print`` lying within ``most`` bits of each other.

    A node's key is a hash of mask and bits: should two nodes share a key, they are searched as one, which finds
    the same links.
    """
    if most > MAX_DIFFERENCES:
        raise ValueError(f"the upper nodes only serve distances up to {MAX_DIFFERENCES}")
    dealt = upper_nodes(prints)
    gathered = dealt.repartition("node").sortWithinPartitions("node")
    return in_tasks(gathered, partial(link_nodes, most=most), "a long, b long").distinct()


def print_components(prints: DataFrame, id_column: str, most: int) -> DataFrame:
    """(print, component_id): for each distinct fingerprint the smallest id reachable from it."""
    classes = stored(prints.groupBy("print").agg(F.min(id_column).alias("least")), "classes")
    groups = components(near_links(classes.select("print"), most))
    grouped = classes.join(groups, classes["print"] == groups["node"])
    roots = grouped.groupBy("root").agg(F.min("least").alias("component"))
    named = grouped.join(roots, "root").select("print", "component")
    every = classes.join(named, "print", "left")
    return every.select("print", F.coalesce("component", "least").alias("component_id"))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = MAX_DIFFERENCES
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest doc_id reachable over links of at
    most ``most`` differing bits. Null texts are empty; texts without words have fingerprint zero and are linked
    like any other. Repeated rows keep their count. Null ids never name a component unless all its ids are null,
    which makes it null. An empty table gives no rows. Further columns are ignored.
    """
    marked = stored(fingerprints(docs, id_column, text_column), "fingerprints")
    every = print_components(marked, "doc_id", most)
    return marked.join(every, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = MAX_DIFFERENCES
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group of near-duplicates, with all their columns.

    Of several rows with that id one stays, by a hash of all columns; of rows alike in every column one stays as
    well. Groups whose ids are all null keep one row. Fingerprints are computed once, and the rows meet them again
    by id and hash.
    """
    row, kept_id, kept_row = (fresh(docs.columns, n) for n in ("row", "kept_id", "kept_row"))
    whole = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)))
    key = F.struct(F.col(id_column).cast("long").alias("id"), whole.alias("row"))
    source = docs.select(key.alias("doc_id"), text_or_empty(text_column).alias("text"))
    schema = "doc_id struct<id: long, row: long>, print long"
    marked = stored(in_tasks(source, add_fingerprints, schema), "fingerprints").select("doc_id.*", "print")
    named = marked.join(print_components(marked, "id", most), "print")
    named = named.select("component_id", F.struct(F.col("id").isNull().alias("unnamed"), "id", "row").alias("key"))
    best = named.groupBy("component_id").agg(F.min("key").alias("key")).select("key.id", "key.row")
    best = stored(best.select(F.col("id").alias(kept_id), F.col("row").alias(kept_row)), "best")
    same = F.col(id_column).eqNullSafe(F.col(kept_id)) & (F.col(row) == F.col(kept_row))
    chosen = docs.withColumn(row, whole).join(best, same, "left_semi")
    several = named.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if not several.isEmpty():  # rows alike in every column
        chosen = chosen.dropDuplicates([id_column, row])
    return chosen.drop(row)
