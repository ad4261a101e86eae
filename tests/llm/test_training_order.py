import zlib

import numpy as np
import pytest

from cohortry.llm import training_order as order
from cohortry.llm.queries import VOCABULARY
from cohortry.llm.tokens import encoder


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(size):
    slots = order.permuted(np.arange(size), size, "key")
    assert sorted(slots.tolist()) == list(range(size))
    if size > 100:
        assert not np.array_equal(slots, order.permuted(np.arange(size), size, "other"))
        assert abs(np.corrcoef(np.arange(size), slots)[0, 1]) < 0.2


def test_round_trip_and_resume(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder, slots = order.materialise_order(docs, VOCABULARY, "k", length=256, per_shard=50)
    table = slots.orderBy("slot").collect()
    assert [r.slot for r in table] == list(range(len(table)))
    assert all(r.shard == r.slot // 50 and r.byte_offset == (r.slot % 50) * 512 for r in table)
    read = list(order.read_slots(folder, slots, 0, len(table), length=256))
    assert [zlib.crc32(s.tobytes()) for s in read] == [r.crc32 for r in table]
    ordered = sorted(zip(table, read, strict=True), key=lambda x: x[0].sequence)
    stream = np.concatenate([s[: r.used] for r, s in ordered])
    ids_of = encoder(VOCABULARY).ids
    want = [np.append(np.frombuffer(ids_of(r.text), "<u4"), 1) for r in docs.select("text").collect()]
    assert np.array_equal(stream, np.concatenate(want))
    resumed = list(order.read_slots(folder, slots, 120, 60, length=256))
    assert all(np.array_equal(a, b) for a, b in zip(resumed, read[120:180], strict=True))


def test_edge_rows(spark, rows):
    docs = rows("text string, slot long, shard int", (None, 1, 1), ("", 1, 1), ("a b", 1, 1), ("a b", 1, 1), ("w " * 3000, 1, 1))
    folder, slots = order.materialise_order(docs.coalesce(1), VOCABULARY, "k", length=64)
    ids = sum(len(encoder(VOCABULARY).ids(r.text)) // 4 + 1 for r in docs.collect())
    assert sum(r.used for r in slots.collect()) == ids
    _, none = order.materialise_order(docs.where("false"), VOCABULARY, "k")
    assert none.count() == 0


def test_wide_ids(spark, rows):
    """An id beyond 16 bits widens the records of all shards."""
    docs = rows("text string", ("a b",), (None,), ("w " * 300,)).coalesce(1)
    assert order.id_type(VOCABULARY) == "<u2" and order.id_type(VOCABULARY, 70_000) == "<u4"
    folder, slots = order.materialise_order(docs, VOCABULARY, "k", end_id=70_000, length=64, per_shard=2)
    table = slots.orderBy("slot").collect()
    read = list(order.read_slots(folder, slots, 0, len(table), length=64, dtype="<u4"))
    assert [r.byte_offset for r in table] == [(r.slot % 2) * 256 for r in table]
    stream = np.concatenate([s[: r.used] for r, s in sorted(zip(table, read, strict=True), key=lambda x: x[0].sequence)])
    ids_of = encoder(VOCABULARY).ids
    want = [np.append(np.frombuffer(ids_of(r.text), "<u4"), 70_000) for r in docs.collect()]
    assert np.array_equal(stream, np.concatenate(want))
