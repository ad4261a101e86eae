import math

import numpy as np

from cohortry.llm import nn_descent as nn


def brute(data, least=0.98):
    """(vec_id, n_links, component_id) by comparing all rows."""
    usable = lambda v, y: y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(data)
    near = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (_, a, x), (_, b, y) = data[i], data[j]
            if x == y and usable(a, x) and usable(b, y) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((data[i][0], len(near[i]), min((data[j][0] for j in seen if data[j][0] is not None), default=None)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, unit string, node long"


def test_equals_brute_force_with_large_and_chained_groups(rows):
    rng = np.random.default_rng(4)
    data, number = [], 0
    for label in range(3):
        for center in rng.standard_normal((60, 16)):
            for _ in range(int(rng.integers(1, 4))):
                data.append((number, (center + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
                number += 1
    dense = rng.standard_normal(16)
    for _ in range(90):  # far more than a list holds
        data.append((number, (dense + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist(), 0))
        number += 1
    for k in range(25):  # a chain: each links to its neighbours only
        angle = 0.15 * k
        data.append((number, [math.cos(angle), math.sin(angle)] + [0.0] * 14, 7))
        number += 1
    table = rows(SCHEMA, *((i, [float(x) for x in np.float32(v)], y, "x", 0) for i, v, y in data))
    data = [(i, [float(x) for x in np.float32(v)], y) for i, v, y in data]
    assert result(nn.near_vectors(table.repartition(4))) == brute(data)


def test_edge_rows(spark, rows):
    one, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    data = [
        (5, one, 1), (5, one, 1), (2, [2.0, 4.0, 6.0], 1), (None, one, 1), (7, one, 2), (8, one, None), (9, None, 1), (10, [], 1),
        (11, [0.0, 0.0, 0.0], 1), (12, [0.0, -0.0, 0.0], 1), (13, [nan, 1.0, 1.0], 1), (14, [inf, 1.0, 1.0], 1), (15, [1.0, 2.0], 1),
        (16, [None, 2.0, 3.0], 1), (17, [-1.0, -2.0, -3.0], 1), (None, [9.0, 0.0, 0.0], 3),
    ]
    table = rows(SCHEMA, *((i, v, y, "x", 0) for i, v, y in data))
    got = nn.near_vectors(table)
    want = [(i, n, c) for i, n, c in brute([d for d in data])]
    assert result(got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())
    assert nn.near_vectors(table.where("false")).count() == 0


def test_recall_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    rng = np.random.default_rng(2)  # near copies of some rows, with cosines on both sides of the threshold
    chosen = [d for d in data if d[0] % 12 == 0]
    data += [(10**6 + i, (np.array(v) + rng.uniform(0.005, 0.03) * rng.standard_normal(64)).astype(np.float32).tolist(), y) for i, v, y in chosen]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(8)
    got = {r.vec_id: r.n_links for r in nn.near_vectors(table).collect()}
    by_label = {}
    for i, v, y in data:
        by_label.setdefault(y, []).append((i, v))
    found = missed = 0
    for members in by_label.values():
        m = np.array([v for _, v in members], dtype=np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for (i, _), n in zip(members, ((m @ m.T) >= 0.98).sum(1) - 1, strict=True):
            assert got[i] <= n
            found, missed = found + got[i], missed + int(n) - got[i]
    assert found > 200 and found / (found + missed) >= 0.95


def test_small_labels_beside_a_hot_one(rows):
    """Pairs just above the threshold, each with a label of its own, are found however many vectors another label has."""
    rng = np.random.default_rng(8)
    data, number = [], 0

    def add(vector, label):
        nonlocal number
        data.append((number, [float(x) for x in np.float32(vector)], label))
        number += 1

    for vector in rng.standard_normal((6000, 32)):
        add(vector, 0)
    hot = rng.standard_normal(32)
    for _ in range(700):  # one group with far more links than all pairs
        add(hot + 0.02 * rng.standard_normal(32), 0)
    pairs = []
    for label in range(1, 501):
        u, v = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
        pairs.append((number, number + 1))
        add(u, label)
        add(0.9805 * u + math.sqrt(1 - 0.9805**2) * v, label)
    table = rows("vec_id long, embedding array<float>, label int", *data)
    got = {r.vec_id: r for r in nn.near_vectors(table.repartition(8)).collect()}
    assert all(got[a].component_id == got[b].component_id == a and got[b].n_links == 1 for a, b in pairs)
    assert all(got[k].component_id == 6000 for k in range(6000, 6700))


def test_audit_judges_by_the_worst_stratum(rows):
    """A hot group that is found whole does not hide the pairs that are not."""
    units, groups = [], []
    for k in range(400):  # one found group in a space of its own
        units.append((k, 1, 400, [1.0, 1e-6 * k]))
        groups.append((k, 0))
    for k in range(400, 600):  # pairs, none found
        units.append((k, k // 2, 2, [0.0, 1.0]))
    classes = rows("node long, space long, size long, unit array<double>", *units)
    found = rows("node long, root long", *groups)
    assert nn.audited_recall(classes, found, 0.98, 10) == 0.0
    assert nn.audited_recall(classes.where("space = 1"), found, 0.98, 10) == 1.0
    assert nn.audited_recall(classes.where("false"), found, 0.98, 10) == 1.0


def test_tiles_count_without_meeting(rows, monkeypatch):
    """Tight, loose and drawn-out components of many tiles, with copies: counts equal those of all comparisons."""
    monkeypatch.setattr(nn, "TILE_MEMBERS", 16)
    met, compared = [], nn.met_links
    monkeypatch.setattr(nn, "met_links", lambda meeting, least: met.append(meeting.count()) or compared(meeting, least))
    rng = np.random.default_rng(12)
    data = []
    for label, spread, n in ((1, 0.004, 200), (2, 0.03, 150)):
        centre = rng.standard_normal(8)
        data += [(centre + spread * rng.standard_normal(8), label) for _ in range(n)]
    data += [([math.cos(0.05 * k), math.sin(0.05 * k)] + [0.0] * 6, 3) for k in range(126)]  # once around
    data += data[:5]
    data = [(k, [float(x) for x in np.float32(v)], y) for k, (v, y) in enumerate(data)]
    table = rows("vec_id long, embedding array<float>, label int", *data)
    assert result(nn.near_vectors(table.repartition(4))) == brute(data)
    assert 0 < met[0] < (200 * 13 + 155 * 10 + 126 * 8) / 2  # of the rows when all tiles of a component meet
