import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortry.llm.packing import Runs, pack, shortest_pack_first
from cohortry.llm.queries import VOCABULARY
from cohortry.llm.tokens import encoder


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 200), max_size=20))
def test_patterns_place_every_length_once(histogram):
    patterns = shortest_pack_first(histogram, 32)
    placed = Counter()
    for pattern in patterns:
        assert pattern.count > 0 and sum(pattern.lengths) <= 32
        for length in pattern.lengths:
            placed[length] += pattern.count
    assert placed == Counter(histogram)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 30), min_size=1, max_size=10))
def test_ranks_meet_every_slot_once(histogram):
    runs = Runs.of(shortest_pack_first(histogram, 16))
    cells = set()
    for length, n in histogram.items():
        sequence, offset = runs.find(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            cell = {(s, o + k) for k in range(length)}
            assert not cell & cells
            cells |= cell
    by_sequence = defaultdict(set)
    for s, o in cells:
        by_sequence[s].add(o)
    assert set(by_sequence) == set(range(len(by_sequence)))
    assert all(v == set(range(len(v))) for v in by_sequence.values())


def test_longest_first_into_the_shortest_pack():
    assert [p.lengths for p in shortest_pack_first({7: 1, 6: 1, 2: 1}, 10)] == [(7,), (6, 2)] or [
        p.lengths for p in shortest_pack_first({7: 1, 6: 1, 2: 1}, 10)
    ] == [(6, 2), (7,)]


def test_pieces_hold_every_id_once(spark, rows):
    long_text = "word soup " * 900
    data = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (None, "", "x"), (3, long_text, "x"), (1, "other", "x")]
    docs = rows("doc_id long, text string, length string", *data)
    got = pack(docs.repartition(3), VOCABULARY, capacity=128).collect()
    ids_of = encoder(VOCABULARY).ids
    texts = Counter((r[0], ids_of(r[1]) + (1).to_bytes(4, "little")) for r in data)
    whole = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        whole[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
    for doc_id, pieces in whole.items():
        assert sum(len(p[1]) for p in pieces) == sum(len(k[1]) * n for k, n in texts.items() if k[0] == doc_id)
    long_ids = b"".join(p for _, p, _ in sorted(whole[3]))
    assert long_ids == ids_of(long_text) + (1).to_bytes(4, "little")
    cells = Counter((r.sequence_id, r.offset + k) for r in got for k in range(r.length))
    assert max(cells.values()) == 1
    assert max(o for _, o in cells) < 128


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def test_little_padding_on_the_documents(spark):
    placed = pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), VOCABULARY, with_ids=False)
    used = [r.n for r in placed.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    assert max(used) <= 2048
    assert sum(used) / (2048 * len(used)) > 0.99


def test_ranks_are_one_row_a_part(spark, rows):
    docs = rows("doc_id long, text string", *((n, "word " * (n % 7)) for n in range(400))).repartition(6)
    placed = pack(docs, VOCABULARY, capacity=16, with_ids=False)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (part" in plan and "length#" not in plan.split("Join Inner, ")[1].split("\n")[0]
    got = placed.collect()
    cells = Counter((r.sequence_id, r.offset + k) for r in got for k in range(r.length))
    assert len(got) == 400 and max(cells.values()) == 1
