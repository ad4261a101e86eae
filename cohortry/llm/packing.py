"""Packing of documents into training sequences: shortest-pack-first over the histogram of lengths.

The table is tokenised once and cut into pieces of at most one sequence. The plan only needs the histogram of piece
lengths, which has as many bins as a sequence has tokens, whatever the input; it is made on the driver and yields
packing patterns with counts. Patterns are joined back to pieces by the rank of a piece among those of its length,
so no token moves for it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import in_tasks, stored
from cohortry.llm.tokens import encoder, packed
from cohortry.session import checked_broadcast

SEQUENCE_TOKENS = 2048
END_OF_DOCUMENT = 1

PIECE_SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, ids binary, part int, place long"
)


def cut_pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Tokenise (doc_id, text) and cut each document into pieces of at most ``capacity`` ids.

    ``place`` numbers the pieces of one length within the task, ``part`` is the task's partition.
    """
    ids_of, end, width = encoder(vocabulary).ids, packed([end_id]), 4 * capacity
    met = np.zeros(capacity + 1, dtype=np.int64)
    part = TaskContext.get().partitionId()
    for batch in batches:
        doc_ids, starts, lengths, totals, ids, places = [], [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = ids_of(text.as_py()) + end
            total = len(tokens) // 4
            for at in range(0, len(tokens), width):
                piece = tokens[at : at + width]
                length = len(piece) // 4
                doc_ids.append(doc_id)
                starts.append(at // 4)
                lengths.append(length)
                totals.append(total)
                ids.append(piece)
                places.append(int(met[length]))
                met[length] += 1
        columns = [
            pa.array(doc_ids, pa.int64()),
            pa.array(starts, pa.int64()),
            pa.array(lengths, pa.int64()),
            pa.array(totals, pa.int64()),
            pa.array(ids, pa.binary()),
            pa.array([part] * len(ids), pa.int32()),
            pa.array(places, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(
            columns, ["doc_id", "start", "length", "doc_tokens", "ids", "part", "place"]
        )


@dataclass(frozen=True)
class Pattern:
    """``count`` sequences that hold the same ``lengths``, in this order."""

    count: int
    lengths: tuple[int, ...]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that place every length of the histogram.

    Lengths come longest first. A length goes to the open packs that are shortest so far, which are the ones with
    most room; where it fits none, new packs are opened and take as many of it as they hold. Packs with one content
    are one entry with a count, so the work follows the number of lengths and not of pieces.
    """
    full: list[Pattern] = []
    open_packs: list[tuple[int, int, Pattern]] = []  # heap: most room first, then oldest
    made = 0

    def keep(pattern: Pattern, room: int) -> None:
        nonlocal made
        if not pattern.count:
            return
        if room:
            made += 1
            heapq.heappush(open_packs, (-room, made, pattern))
        else:
            full.append(pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_packs and -open_packs[0][0] >= length:
            room, _, pack = heapq.heappop(open_packs)
            used = min(left, pack.count)
            keep(Pattern(used, (*pack.lengths, length)), -room - length)
            keep(Pattern(pack.count - used, pack.lengths), -room)
            left -= used
        each = capacity // length
        packs, rest = divmod(left, each)
        keep(Pattern(packs, (length,) * each), capacity - each * length)
        keep(Pattern(min(rest, 1), (length,) * rest), capacity - rest * length)
    return full + [pattern for _, _, pattern in sorted(open_packs)]


@dataclass(frozen=True)
class Runs:
    """For runs of ranks of one length: first rank, first sequence and place in the sequence, sorted for search."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, patterns: list[Pattern]) -> Runs:
        rows, taken, sequence = [], {}, 0
        for pattern in patterns:
            offset = 0
            for length in pattern.lengths:
                rank = taken.get(length, 0)
                rows.append((length, rank, sequence, offset))
                taken[length] = rank + pattern.count
                offset += length
            sequence += pattern.count
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        return cls(*table.T)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length << 48) | self.rank
        at = np.searchsorted(key, (length << 48) | rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def place_pieces(batches: Iterator[pa.RecordBatch], runs: Runs) -> Iterator[pa.RecordBatch]:
    """Add sequence_id and offset to rows with length and rank as the last two columns."""
    for batch in batches:
        length, rank = (batch.column(k).to_numpy() for k in (batch.num_columns - 2, batch.num_columns - 1))
        sequence, offset = runs.find(length, rank)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"]
        )


def by_length(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """(part, lengths, ranks) to (part, before): the rank at the place of its length, 0 where the part has none."""
    for batch in batches:
        before = np.zeros((len(batch), capacity + 1), dtype=np.int64)
        for row, lengths, ranks in zip(before, batch.column(1), batch.column(2), strict=True):
            row[lengths.values.to_numpy()] = ranks.values.to_numpy()
        arrays = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * (capacity + 1), before.ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), arrays], ["part", "before"])


def tokenised(
    docs: DataFrame, vocabulary: str, id_column: str, text_column: str, end_id: int, capacity: int
) -> DataFrame:
    """The stored pieces of all documents, with the crc32 of their ids."""
    cut = partial(cut_pieces, vocabulary=vocabulary, end_id=end_id, capacity=capacity)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    pieces = in_tasks(source, cut, PIECE_SCHEMA)
    return stored(pieces.withColumn("ids_crc32", F.crc32("ids")), "pieces")


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = END_OF_DOCUMENT,
    capacity: int = SEQUENCE_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, doc_tokens, ids, ids_crc32, length, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit integers, left out of all shuffles when ``with_ids`` is false; order
    pieces by (sequence_id, offset) to write sequences. A document's ids end with ``end_id``; a null or empty text is that id alone. Documents longer than a sequence
    are cut at multiples of its length. Rows with equal ids, null ids and repeated rows are packed each on its
    own. An empty table gives no rows. Further columns of ``docs`` are ignored.
    """
    pieces = tokenised(docs, vocabulary, id_column, text_column, end_id, capacity)
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    first = stored(first, "ranks")
    # at most one row per length of a sequence, however many pieces there are
    histogram = {r.length: r.n for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = shortest_pack_first(histogram, capacity)
    runs = Runs.of(patterns)

    # one row per part with its first rank of every length, so the side that is joined follows the parts alone
    found = first.groupBy("part").agg(F.collect_list("length").alias("lengths"), F.collect_list("before").alias("ranks"))
    ranks = in_tasks(found, partial(by_length, capacity=capacity), "part int, before array<long>")
    ranked = pieces.join(checked_broadcast(ranks), "part")
    kept = ["doc_id", "start", "doc_tokens", *["ids"] * with_ids, "ids_crc32", "length"]
    ranked = ranked.select(*kept, (F.col("before")[F.col("length")] + F.col("place")).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id long, offset long"
    return in_tasks(ranked, partial(place_pieces, runs=runs), schema).drop("rank")
