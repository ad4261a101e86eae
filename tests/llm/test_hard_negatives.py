import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("width, largest", [(1, 5), (64, 510), (64, 160), (65, 3000), (700, 1 << 20), (3, 1 << 29), (0, 1)])
def test_scores_are_exact(width, largest):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-largest, largest + 1, (n, width)) for n in (7, 11))
    a[0], b[0], b[1] = largest, largest, -largest
    primes = H.primes_for(width * largest * largest)
    got = H.exact_scores(H.ResidueMatrix(a, primes), H.ResidueMatrix(b, primes))
    wanted = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert got.tolist() == wanted


def test_primes():
    assert H.primes_for(0) == [1021] and H.primes_for(510) == [1021, 1019]
    assert H.primes_for(1 << 62)[-1] > 900 and len(H.primes_for(1 << 62)) == 7


@pytest.mark.parametrize("score", [-7, -1, 0, 1, 3, 99, 100, 12345])
def test_window(score):
    low, high = H.window_of(score, H.Selection())
    inside = [n for n in range(-200, 20000) if 30 * score <= 100 * n <= 90 * score]
    assert inside == list(range(low, high + 1))


def direct(rows, anchors):
    """The definition, pair by pair."""
    usable = {
        (i, l, tuple(int(np.floor(256 * float(x))) for x in v))
        for i, v, l in rows
        if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    }
    out = []
    for i, l, v in usable:
        if not anchors(i):
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w, strict=True)), j, m) for j, m, w in usable if len(w) == len(v) and j != i
        )
        for s, j, _ in [x for x in scored if x[2] == l][:5]:
            near = [x for x in scored if x[2] != l and -30 * s <= -100 * x[0] <= -90 * s][:10]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(near)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, seed, labels=3, width=6, values=3):
    draw = random.Random(seed)
    return [(k, [draw.randint(0, values) / 8 for _ in range(width)], draw.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("n, labels, width, cell", [(300, 3, 6, 64), (200, 60, 4, 1 << 16), (150, 1, 3, 16), (80, 2, 70, 7)])
def test_ties_and_cells(rows, n, labels, width, cell):
    data = vectors(n, n, labels, width)
    df = rows(SCHEMA, *data).repartition(3)
    result = H.hard_negatives(df, F.col("vec_id") % 10 == 0, rows_per_cell=cell)
    assert got(result) == direct(data, lambda i: i % 10 == 0)


def test_edge_rows(rows, spark):
    inf, nan = float("inf"), float("nan")
    data = vectors(60, 1) + [
        (100, None, 1), (110, [], 1), (120, [], 2), (130, [0.5, None, 0.1, 0.1, 0.1, 0.1], 1), (140, [inf] * 6, 1),
        (150, [nan] + [0.0] * 5, 1), (160, [0.5] * 6, None), (None, [0.5] * 6, 1), (170, [0.5] * 5, 1), (180, [0.5] * 5, 2),
        (190, [0.0] * 6, 0), (200, [-0.0] * 6, 1), (0, [0.25] * 6, 2), (210, [-0.3] * 6, 1), (220, [0.5] * 6, -3),
    ] + vectors(3, 1)
    names = "cell kind number spread size v scores x `a.b`".split()
    wide = rows(SCHEMA + "".join(f", {c} int" for c in names), *(r + (7,) * len(names) for r in data))
    assert got(H.hard_negatives(wide, F.col("vec_id") % 10 == 0)) == direct(data, lambda i: i % 10 == 0)
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def test_large_components(rows):
    big = [(k, [float(2**18 + k), float(-(2**17) * k), 2.0**20], k % 2) for k in range(40)]
    df = rows(SCHEMA, *big)
    assert got(H.hard_negatives(df, F.col("vec_id") % 5 == 0)) == direct(
        [(i, np.float32(v).tolist(), l) for i, v, l in big], lambda i: i % 5 == 0
    )
    with pytest.raises(ArithmeticError):
        H.hard_negatives(rows(SCHEMA, (1, [3e38], 1)), F.lit(True))
