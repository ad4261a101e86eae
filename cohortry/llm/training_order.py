"""Token ids in training order: sequences written to fixed-stride shards by a keyed permutation.

Documents are tokenised once, joined end to end and cut into sequences of one length. A Feistel network over the
smallest even number of bits that holds the number of sequences permutes their numbers; results outside the range
are permuted again until they fall inside (cycle-walking), which keeps it a permutation. The result is a sequence's
slot. Ranges of slots are sorted and written as shards, one record of fixed length per slot, so a trainer reads
forward from any slot by arithmetic alone and resumes where it stopped.

Ids are written as unsigned little-endian integers of 16 bits where all ids of the vocabulary fit, else of 32; the
width is taken from the vocabulary before a document is read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortry.llm.common import in_tasks, stored, text_or_empty
from cohortry.llm.tokens import encoder
from cohortry.session import checked_broadcast, scratch_path

SEQUENCE_TOKENS = 2048
SHARD_SEQUENCES = 4096
END_OF_DOCUMENT = 1
PADDING = 0
ROUNDS = 4
SEQUENCE_SCHEMA = "part int, nth long, used int, tokens binary"
SLOT_SCHEMA = "slot long, sequence long, shard long, byte_offset long, used int, crc32 long, attempt string"


def round_keys(key: str) -> list[int]:
    """A 64-bit key per round, from SHA-256 of the key text and the round's number."""
    return [int.from_bytes(hashlib.sha256(f"{key}:{n}".encode()).digest()[:8], "little") for n in range(ROUNDS)]


def _scramble(value: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function (multiply and shift), the round function of the network."""
    with np.errstate(over="ignore"):
        x = (value ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _network(value: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = value >> np.uint64(half), value & mask
    for key in keys:
        left, right = right, left ^ (_scramble(right, key) & mask)
    return (left << np.uint64(half)) | right


def permuted(numbers: np.ndarray, size: int, key: str) -> np.ndarray:
    """The slots of ``numbers`` (all below ``size``): a permutation of 0 .. size - 1 chosen by ``key``."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    keys = round_keys(key)
    slots = _network(numbers.astype(np.uint64), half, keys)
    while len(outside := np.flatnonzero(slots >= size)):
        slots[outside] = _network(slots[outside], half, keys)
    return slots.astype(np.int64)


def id_type(vocabulary: str, end_id: int = END_OF_DOCUMENT) -> str:
    """The integer type that holds every id of a vocabulary, its added tokens and the end id."""
    ids = Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values()
    return "<u2" if max(end_id, PADDING, *ids) <= 0xFFFF else "<u4"


def cut_sequences(
    batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, length: int, dtype: str
) -> Iterator[pa.RecordBatch]:
    """Texts to sequences of ``length`` ids, numbered within the task; the task's last one is filled up.

    At most one sequence and one batch of texts are held.
    """
    ids_of, end = encoder(vocabulary).ids, np.array([end_id], dtype="<u4")
    part, nth, rest = TaskContext.get().partitionId(), 0, np.empty(0, dtype=dtype)

    def rows(sequences: list[np.ndarray], used: list[int]) -> pa.RecordBatch:
        nonlocal nth
        numbers = range(nth, nth + len(sequences))
        nth += len(sequences)
        columns = [
            pa.array([part] * len(sequences), pa.int32()),
            pa.array(numbers, pa.int64()),
            pa.array(used, pa.int32()),
            pa.array([s.tobytes() for s in sequences], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["part", "nth", "used", "tokens"])

    for batch in batches:
        for at in range(0, len(batch), 1000):
            found = [rest]
            for text in batch.column(0).slice(at, 1000):
                ids = np.append(np.frombuffer(ids_of(text.as_py()), dtype="<u4"), end)
                found.append(ids.astype(dtype))
            joined = np.concatenate(found)
            whole = len(joined) // length
            if whole:
                yield rows(list(joined[: whole * length].reshape(whole, length)), [length] * whole)
            rest = joined[whole * length :].copy()
    if len(rest):
        filled = np.full(length, PADDING, dtype=dtype)
        filled[: len(rest)] = rest
        yield rows([filled], [len(rest)])


def add_slots(batches: Iterator[pa.RecordBatch], size: int, key: str) -> Iterator[pa.RecordBatch]:
    """(sequence, used, tokens) to (slot, sequence, used, tokens), the tokens compressed for the way to their shard."""
    press = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        slots = permuted(batch.column(0).to_numpy(), size, key)
        tokens = pa.array([press.compress(t.as_buffer()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(slots), *batch.columns[:2], tokens], ["slot", *batch.schema.names])


def write_shards(batches: Iterator[pa.RecordBatch], folder: str, stride: int, per_shard: int) -> Iterator[pa.RecordBatch]:
    """(shard, slot, sequence, used, tokens), sorted, to shard files and their slot rows; ``stride`` bytes a sequence.

    A shard is written under a name of its attempt; the committed slot table says which attempt counts, so lost and
    repeated attempts leave files that nobody reads.
    """
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    unpress = zstandard.ZstdDecompressor()
    shard, out, attempt = None, None, ""
    try:
        for batch in batches:
            rows = []
            for number, slot, sequence, used, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != shard:
                    if out is not None:
                        out.close()
                    shard, attempt, place = number, uuid.uuid4().hex, number * per_shard
                    out = system.open_output_stream(f"{root}/{shard_name(number, attempt)}", compression=None)
                if slot != place:
                    raise ValueError(f"slot {slot} follows slot {place - 1} in shard {shard}")
                data = unpress.decompress(tokens, max_output_size=stride)
                out.write(data)
                place += 1
                rows.append((slot, sequence, number, (slot - number * per_shard) * stride, used, zlib.crc32(data), attempt))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
            names = [c.strip().split(" ")[0] for c in SLOT_SCHEMA.split(",")]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
    finally:
        if out is not None:
            out.close()


def shard_name(number: int, attempt: str) -> str:
    return f"shard-{number:08d}-{attempt}.bin"


def materialise_order(
    docs: DataFrame,
    vocabulary: str,
    key: str,
    folder: str | None = None,
    text_column: str = "text",
    end_id: int = END_OF_DOCUMENT,
    length: int = SEQUENCE_TOKENS,
    per_shard: int = SHARD_SEQUENCES,
) -> tuple[str, DataFrame]:
    """Write the shards and return their folder with the slot table (``SLOT_SCHEMA``), one row per sequence.

    Documents follow each other in the order in which a partition is read, each closed by ``end_id``; a sequence may
    hold the end of one and the beginning of the next. The last sequence of a partition is filled up with id 0, its
    real ids are counted in ``used``. Slots are 0 .. n - 1 without gaps, the same for the same input, partitions and
    ``key``. Null and empty texts are their end id alone. Repeated rows are written as often as they occur. Other
    columns are ignored, ids are not needed. An empty table gives no shard and an empty slot table.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "order")
    dtype = id_type(vocabulary, end_id)
    stride = np.dtype(dtype).itemsize * length
    cut = partial(cut_sequences, vocabulary=vocabulary, end_id=end_id, length=length, dtype=dtype)
    sequences = stored(in_tasks(docs.select(text_or_empty(text_column).alias("text")), cut, SEQUENCE_SCHEMA), "sequences")
    # one row per partition that was read, in one running total
    counts = sequences.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    size = counts.agg(F.sum("n")).first()[0] or 0
    # one small row per partition read; a shuffled join would move every sequence once more
    numbered = sequences.join(checked_broadcast(first.drop("n")), "part").select((F.col("before") + F.col("nth")).alias("sequence"), "used", "tokens")
    slotted = in_tasks(numbered, partial(add_slots, size=max(size, 1), key=key), "slot long, sequence long, used int, tokens binary")
    dealt = slotted.select(F.floor(F.col("slot") / per_shard).alias("shard"), "slot", "sequence", "used", "tokens")
    # slots are even by construction, so ranges of whole shards need no sampling
    shards = max(1, -(-size // per_shard))
    tasks = min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    task = F.floor(F.col("shard") * tasks / shards).cast("int")
    ranged = dealt.repartitionById(tasks, task).sortWithinPartitions("shard", "slot")
    slots = in_tasks(ranged, partial(write_shards, folder=f"{folder}/shards", stride=stride, per_shard=per_shard), SLOT_SCHEMA)
    slots.write.parquet(f"{folder}/slots")
    return folder, spark.read.schema(slots.schema).parquet(f"{folder}/slots")


def read_slots(
    folder: str, slots: DataFrame, start: int, count: int, length: int = SEQUENCE_TOKENS, dtype: str = "<u2"
) -> Iterator[np.ndarray]:
    """Sequences of the slots from ``start`` on, in training order, read forward shard by shard.

    ``slots`` is the table that :func:`materialise_order` returned; one row per shard is looked up, whatever is read.
    ``dtype`` is the vocabulary's :func:`id_type`.
    """
    stride = np.dtype(dtype).itemsize * length
    names = slots.where(F.col("slot").between(start, start + count - 1)).groupBy("shard").agg(
        F.min("attempt").alias("attempt"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.min("byte_offset").alias("at")
    )
    for row in names.orderBy("shard").toLocalIterator():
        system, root = pyarrow.fs.FileSystem.from_uri(f"{folder}/shards")
        with system.open_input_file(f"{root}/{shard_name(row.shard, row.attempt)}") as file:
            file.seek(row["at"])
            for _ in range(row["first"], row["last"] + 1):
                yield np.frombuffer(file.read(stride), dtype=dtype)
