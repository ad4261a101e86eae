import random

import numpy as np
import pytest
import xxhash

from cohortry.llm import simhash
from cohortry.llm.components import components


def direct(text):
    """The definition, bit by bit."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints_by_id, most=3):
    """Smallest id reachable, by comparing everything with everything."""
    ids = sorted(prints_by_id)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(prints_by_id[a] ^ prints_by_id[b]).count("1") <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", " \t\n", "one", "one two", "One TWO three", "Ä ä\x85x y", "a b c d e f g " * 50, "É" * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == direct(text)


@pytest.mark.parametrize("n, flips", [(2, 1), (60, 3), (900, 4), (3000, 2)])
def test_index_finds_exactly_the_close_pairs(n, flips):
    rng = np.random.default_rng(n)
    prints = rng.integers(0, 2**63, 6, dtype=np.uint64)[rng.integers(0, 6, n)]
    for _ in range(flips):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    index = simhash.GrayIndex(np.unique(prints))
    found = [index.search(k, min(k + 100, len(index.prints)), 3) for k in range(0, len(index.prints), 100)]
    got = {(a, b) for x, y in found for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    away = np.bitwise_count(index.prints[:, None] ^ index.prints[None])
    assert got == {(a, b) for a, b in zip(*np.nonzero(away <= 3), strict=True) if a < b}


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: direct(r.text) for r in docs.collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == grouped(prints)


def test_large_nodes_are_searched_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_MEMBERS", 8)
    random.seed(3)
    center = random.getrandbits(64)
    prints = {k: center ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for k in range(300)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    table = spark.createDataFrame([(signed(p),) for p in set(prints.values())], "print long")
    nodes = simhash.upper_nodes(table, tile_members=8)
    assert nodes.groupBy("node").count().agg({"count": "max"}).first()[0] < 60
    groups = components(simhash.near_links(table))
    roots = {r.node: r.root for r in groups.collect()}
    want = grouped({signed(p): p for p in prints.values()})
    assert {p: roots.get(p, p) for p in want} == want


def test_edge_rows(spark, rows):
    docs = rows(
        "doc_id long, text string, fingerprint int, component_id string",
        (5, None, 1, "x"), (3, "", 1, "x"), (3, " ", 1, "x"), (9, "same words here", 1, "x"), (9, "same words here", 1, "x"),
        (None, "same words here", 1, "x"), (None, "nothing like the others", 1, "x"), (11, "w " * 200_000, 1, "x"),
    )
    got = sorted(((r.doc_id, r.fingerprint == "0" * 16, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(
        [(5, True, 3), (3, True, 3), (3, True, 3), (9, False, 9), (9, False, 9), (None, False, 9), (None, False, None), (11, False, 11)],
        key=str,
    )
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 9, 11]
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.one_of_each_group(docs.where("false")).count() == 0


def test_components_of_chains_and_rings(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (101, 100), (7, 7)]
    random.seed(1)
    random.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}
