"""Hard negatives by exact scores: integer inner products in a residue number system.

Components become integers, and the scores of a block of rows against a block of anchors are matrix products modulo
several small primes in float32. A product of residues of at most (p - 1) / 2 in absolute value, summed over so many
components that the sum stays below 2**24, is exact in float32 in any order of addition; longer vectors are cut into
such stretches. The primes are as many as the largest possible score needs (Cauchy-Schwarz over all rows), and the
signed score comes back from its residues by mixed-radix digits, the constructive form of the Chinese remainder theorem.

The anchors, a stated share of the rows, meet every row in cells: rows are dealt evenly to cells that one task holds,
anchors are sent to all cells and stream past. A first round finds the positives among the rows of the same label, a
second one the rows of other labels whose scores lie between shares of a positive's score. A cell reports at most the
wanted number for each anchor or positive, and Spark ranks what the cells report.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.llm.common import bounds, in_tasks, stored

SCALE = 256
LARGEST_PRIME = 1021  # 64 products of its residues stay below 2**24
EXACT = 1 << 24
LARGEST_SCORE = 1 << 62
ROWS_PER_CELL = 1 << 16
COMPONENTS_PER_CELL = 1 << 23
ROWS_AT_ONCE = 8192  # times ANCHORS_AT_ONCE: the scores that a task holds
ANCHORS_AT_ONCE = 256


@dataclass(frozen=True)
class Selection:
    """Positives: the ``positives`` best rows of the label. Negatives of a positive with score s: the ``negatives``
    best rows of other labels with ``low * s <= 100 * score <= high * s``."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def primes_for(largest_score: int) -> list[int]:
    """Primes from ``LARGEST_PRIME`` downwards whose product exceeds all signed scores."""
    found, product, candidate = [], 1, LARGEST_PRIME
    while product <= 2 * largest_score + 1:
        if all(candidate % k for k in range(2, int(candidate**0.5) + 1)):
            found.append(candidate)
            product *= candidate
        candidate -= 1
    return found


def balanced(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues between -(p - 1) / 2 and (p - 1) / 2."""
    half = prime // 2
    return (values + half) % prime - half


class ResidueMatrix:
    """Integer vectors, one a row, as residues modulo each prime in float32."""

    def __init__(self, vectors: np.ndarray, primes: list[int]):
        self.primes = primes
        self.residues = [balanced(vectors, p).astype(np.float32) for p in primes]

    def part(self, chosen) -> ResidueMatrix:
        out = ResidueMatrix.__new__(ResidueMatrix)
        out.primes, out.residues = self.primes, [r[chosen] for r in self.residues]
        return out


def residue_product(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """``a @ b.T`` modulo the prime, exactly, from float32 residues."""
    stretch = EXACT // (prime // 2) ** 2
    total = np.zeros((len(a), len(b)), dtype=np.int64)
    for at in range(0, a.shape[1], stretch):
        part = a[:, at : at + stretch] @ b[:, at : at + stretch].T
        total += part.astype(np.int32)
        if at:
            total = balanced(total, prime)
    return balanced(total, prime)


def exact_scores(a: ResidueMatrix, b: ResidueMatrix) -> np.ndarray:
    """Signed inner products of all rows of ``a`` with all rows of ``b``.

    Balanced digits d0 + d1 p0 + d2 p0 p1 + ... represent every signed number below half the product of the primes
    once; each digit follows from the residue modulo its prime and the digits before it.
    """
    digits: list[np.ndarray] = []
    score, weight = None, 1
    for k, prime in enumerate(a.primes):
        digit = residue_product(a.residues[k], b.residues[k], prime)
        place = 1
        for earlier, earlier_prime in zip(digits, a.primes, strict=False):
            digit = digit - earlier * (place % prime)
            place *= earlier_prime
        digit = balanced(digit % prime * pow(place, -1, prime), prime)
        digits.append(digit)
        score = digit if score is None else score + digit * weight
        weight *= prime
    return score


def best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores, higher first, ties by place."""
    if len(scores) > 4 * most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")[:most]]


class Cell:
    """The rows of one cell, by label and id, against which anchors are scored."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, primes: list[int]):
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.matrix = ResidueMatrix(vectors[order], primes)

    def positives(self, ids, labels, anchors: ResidueMatrix, most: int) -> Iterator[tuple]:
        """Best rows of the same label: (anchor place, row ids, scores)."""
        order = np.argsort(labels, kind="stable")
        for start, end in bounds(labels[order]) if len(order) else ():
            label = labels[order[start]]
            first, last = np.searchsorted(self.labels, [label, label + 1])
            for at in range(start, end, ANCHORS_AT_ONCE):
                group = order[at : min(at + ANCHORS_AT_ONCE, end)]
                for low in range(first, last, ROWS_AT_ONCE):
                    rows = slice(low, min(low + ROWS_AT_ONCE, last))
                    scores = exact_scores(anchors.part(group), self.matrix.part(rows))
                    for place, own in zip(group, scores, strict=True):
                        other = self.ids[rows] != ids[place]
                        chosen = best(own[other], most)
                        yield place, self.ids[rows][other][chosen], own[other][chosen]

    def negatives(self, ids, labels, limits, anchors: ResidueMatrix, select: Selection) -> Iterator[tuple]:
        """Best rows of other labels between the limits of each positive: (anchor place, positive, row ids, scores)."""
        for at in range(0, len(labels), ANCHORS_AT_ONCE):
            group = np.arange(at, min(at + ANCHORS_AT_ONCE, len(labels)))
            for low in range(0, len(self.ids), ROWS_AT_ONCE):
                rows = slice(low, min(low + ROWS_AT_ONCE, len(self.ids)))
                scores = exact_scores(anchors.part(group), self.matrix.part(rows))
                for place, own in zip(group, scores, strict=True):
                    other = (self.labels[rows] != labels[place]) & (self.ids[rows] != ids[place])
                    yield from self._between(place, own, rows, other, limits[place], select)

    def _between(self, place, scores, rows, other, limits, select: Selection) -> Iterator[tuple]:
        lowest, highest = min(low for low, _ in limits), max(high for _, high in limits)
        near = np.flatnonzero((scores >= lowest) & (scores <= highest) & other)
        if not len(near):
            return
        found, ids = scores[near], self.ids[rows][near]
        order = np.lexsort((ids, -found))
        found, ids = found[order], ids[order]
        for k, (low, high) in enumerate(limits):
            first = int(np.searchsorted(-found, -high))
            last = min(int(np.searchsorted(-found, -low, side="right")), first + select.negatives)
            if first < last:
                yield place, k, ids[first:last], found[first:last]


def window_of(score: int, select: Selection) -> tuple[int, int]:
    """Lowest and highest integer score within the shares of a positive's score, as Python integers."""
    return -(-select.low * score // 100), select.high * score // 100


def vectors_of(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def score_cells(batches: Iterator[pa.RecordBatch], primes: list[int], select: Selection, negatives: bool):
    """Task: rows sorted by cell, rows of the cell first and the anchors after them.

    Holds one cell's rows and one batch. Yields (anchor, positive, found, score): the anchor's row number, the place of
    the positive among the anchor's (0 in the first round), the found row's id.
    """
    current, held, cell = None, [], None
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        for start, end in bounds(cells) if len(batch) else ():
            if cells[start] != current:
                current, held, cell = cells[start], [], None
            part = batch.slice(start, end - start)
            kinds = part.column("kind").to_numpy()
            split = int(np.searchsorted(kinds, 1))
            if split:
                held.append(part.slice(0, split))
            anchors = part.slice(split)
            if not len(anchors) or (cell is None and not held):
                continue
            if cell is None:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
                cell = Cell(
                    rows.column("vec_id").to_numpy(), rows.column("label").to_numpy().astype(np.int64),
                    vectors_of(rows.column("v")), primes,
                )
            yield from scored(cell, anchors, primes, select, negatives)


def scored(cell: Cell, anchors: pa.RecordBatch, primes, select: Selection, negatives: bool) -> Iterator[pa.RecordBatch]:
    numbers = anchors.column("number").to_numpy()
    ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy().astype(np.int64)
    matrix = ResidueMatrix(vectors_of(anchors.column("v")), primes)
    if negatives:
        limits = [[window_of(s, select) for s in scores] for scores in anchors.column("scores").to_pylist()]
        found = cell.negatives(ids, labels, limits, matrix, select)
    else:
        found = ((p, 0, i, s) for p, i, s in cell.positives(ids, labels, matrix, select.positives))
    parts, size = [], 0
    for place, positive, ids, scores in found:
        parts.append((np.full(len(ids), numbers[place]), np.full(len(ids), positive, dtype=np.int32), ids, scores))
        size += len(ids)
        if size >= 1 << 16:
            yield as_batch(parts)
            parts, size = [], 0
    if size:
        yield as_batch(parts)


def as_batch(parts) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "positive", "found", "score"])


def integer_rows(vectors: DataFrame, id_column: str, label: Column, vector_column: str) -> DataFrame:
    """(vec_id, label, v, size, number, spread) of the rows that take part, v = floor(256 x); written once.

    Rows alike in all three are one. ``size`` is the sum of squares, ``spread`` a hash of a row that deals it to a cell.
    """
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), label.cast("int").alias("label"), vector.alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    infinite = F.lit(float("inf"))
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite)))
    # a share above the largest square that floor can give
    size = F.aggregate("x", F.lit(0.0), lambda total, x: total + F.pow(F.abs(x) * SCALE + 1.0, F.lit(2.0)))
    floored = F.transform("x", lambda x: F.floor(x * SCALE))
    whole = rows.select("vec_id", "label", floored.alias("v"), size.alias("size")).distinct()
    numbered = whole.withColumn("number", F.monotonically_increasing_id())
    return stored(numbered.withColumn("spread", F.xxhash64("number")), "vectors")


def meet(rows: DataFrame, anchors: DataFrame, cells: dict[int, int]) -> DataFrame:
    """Rows of each cell followed by all anchors of the same vector length; (cell, kind, number, vec_id, label, v, scores)."""
    length = F.size("v")
    first, at = {}, 0
    for dimensions, count in sorted(cells.items()):
        first[dimensions], at = at, at + count
    start = F.element_at(F.create_map(*(F.lit(x) for pair in first.items() for x in pair)), length)
    count = F.element_at(F.create_map(*(F.lit(x) for pair in cells.items() for x in pair)), length)
    cell = (start + F.pmod("spread", count)).cast("int")
    dealt = rows.select(cell.alias("cell"), F.lit(0).alias("kind"), "number", "vec_id", "label", "v")
    everywhere = F.explode(F.sequence(start, start + count - 1).cast("array<int>")).alias("cell")
    scores = [c for c in anchors.columns if c == "scores"]
    asked = anchors.select(everywhere, F.lit(1).alias("kind"), "number", "vec_id", "label", "v", *scores)
    both = dealt.unionByName(asked, allowMissingColumns=True)
    return both.repartitionById(at, F.col("cell")).sortWithinPartitions("cell", "kind")


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_column: str = "vec_id",
    label: str | Column = "label",
    vector_column: str = "embedding",
    select: Selection = Selection(),
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says of a row (``vec_id``, ``label``) whether it asks. Rows with a null id, label or vector, or with a
    null or non-finite component, take no part. Rows alike in id, label and integers are one row; rows that share an
    id only stay apart and never answer each other. Vectors meet vectors of their own length; empty ones score
    zero. Equal scores stand in the order of ids. Scores that a long cannot hold raise an error before any is
    computed. An empty table gives no rows; further columns are ignored.
    """
    rows = integer_rows(vectors, id_column, F.col(label) if isinstance(label, str) else label, vector_column)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).collect()
    largest = max((r["size"] for r in sizes), default=0.0)
    if largest >= LARGEST_SCORE:
        raise ArithmeticError("scores of these vectors do not fit a long; scale the vectors down")
    primes = primes_for(int(largest) + 1)
    slots = vectors.sparkSession.sparkContext.defaultParallelism
    cells = {}
    for r in sizes:  # one row per vector length
        fits = max(1, min(rows_per_cell, COMPONENTS_PER_CELL // max(r["d"], 1)))
        cells[r["d"]] = max(-(-r["n"] // fits), min(slots, -(-r["n"] // 1024)))
    if not cells:
        cells = {0: 1}
    asked = rows.where(anchor)
    schema = "anchor long, positive int, found long, score long"

    def task(negatives: bool):
        return partial(score_cells, primes=primes, select=select, negatives=negatives)

    order = [F.desc("score"), F.asc("found")]
    near = in_tasks(meet(rows, asked, cells), task(False), schema)
    nth = F.row_number().over(W.partitionBy("anchor").orderBy(*order))
    near = near.withColumn("nth", nth).where(F.col("nth") <= select.positives)
    lists = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "found", "score"))).alias("ps"))
    lists = lists.select(F.col("anchor").alias("number"), F.col("ps.found").alias("positives"), F.col("ps.score").alias("scores"))
    asked = stored(asked.select("number", "vec_id", "label", "v").join(lists, "number"), "anchors")
    found = in_tasks(meet(rows, asked, cells), task(True), schema)
    rank = F.row_number().over(W.partitionBy("anchor", "positive").orderBy(*order))
    found = found.withColumn("rank", rank).where(F.col("rank") <= select.negatives)
    named = found.join(asked.select(F.col("number").alias("anchor"), "vec_id", "positives", "scores"), "anchor")
    return named.select(
        F.col("vec_id").alias("anchor_id"),
        F.get("positives", F.col("positive")).alias("positive_id"),
        "rank",
        F.col("found").alias("negative_id"),
        F.get("scores", F.col("positive")).alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
