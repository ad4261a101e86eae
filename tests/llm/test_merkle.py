import hashlib
import zlib

import pytest

from cohortry.llm.merkle import build, checked, checked_documents, proofs

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def order(value):
    return (value is not None, value.encode() if isinstance(value, str) else value)


def climb(nodes):
    """Levels of runs over (key, hash) nodes; the root's hash and, per key, its siblings and place level by level."""
    ways = {k: [] for k, _ in nodes}
    level = [([k], x) for k, x in nodes]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), 16):
            run = level[at : at + 16]
            for place, (keys, _) in enumerate(run):
                for k in keys:
                    ways[k].append(([x for _, x in run[:place]], [x for _, x in run[place + 1 :]]))
            above.append(([k for keys, _ in run for k in keys], h(*(x for _, x in run))))
        level = above
    return level[0][1], ways


def direct(rows):
    sources = sorted({r[1] for r in rows}, key=order)
    trees, places = {}, {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (order(r[0]), leaf(r, r[4])))
        places[s] = own
        trees[s] = climb([(k, leaf(r, r[4])) for k, r in enumerate(own)])
    root, tops = climb([(s, trees[s][0]) for s in sources])
    out = []
    for s in sources:
        for k, r in enumerate(places[s]):
            way = trees[s][1][k] + tops[s]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if hit else r[4]
            folded = leaf(r, text)
            for left, right in way:
                folded = h(*left, folded, *right)
            proof = h(*(x for left, right in way for x in left + right))
            out.append((r[0], leaf(r, r[4]), trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def got(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def table(n, source, start=0):
    return [(k, source, "en", k % 7, f"Text Number {k}") for k in range(start, start + n)]


CASES = {
    "one row": table(1, "a"),
    "lone leaves": [(k, f"s{k}", "en", 1, "T") for k in range(40)],
    "one source": table(300, "a"),
    "sixteen": table(16, "a") + table(17, "b", 100) + table(256, "c", 200) + table(257, "d", 600),
    "nulls": table(20, None) + table(20, "", 50) + table(3, "é", 90) + [
        (None, "a", None, None, None), (None, "a", None, None, ""), (None, None, "x", -5, "İ A"), (7, "a", "en", None, "ß" * 3000),
    ],
    "repeated": [(1, "a", "en", 3, "Same")] * 40 + [(1, "a", "en", 3, "Other")] * 3 + table(5, "b"),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_the_definition(rows, name):
    docs = rows(SCHEMA, *CASES[name]).repartition(3)
    assert got(checked_documents(docs)) == direct(CASES[name])


def test_clashing_columns_and_empty_table(rows, spark):
    data = table(30, "a")
    names = "tree level run n children seen salt at `a.b` grouping".split()
    wide = rows(SCHEMA + "".join(f", {c} string" for c in names), *(r + ("x",) * len(names) for r in data))
    assert got(checked_documents(wide)) == direct(data)
    assert checked_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_tables(rows):
    """Every node is named once, and a proof changes with every row it passes."""
    data = table(100, "a") + table(40, "b", 100)
    tree = build(rows(SCHEMA, *data), COLUMNS, "doc_id", "source")
    assert tree.leaf_runs.selectExpr("sum(size(children))").first()[0] == 140
    assert tree.runs.select("tree", "level", "run").distinct().count() == tree.runs.count()
    assert tree.root == direct(data)[0][3] and tree.height == 3
    assert all(r.verified for r in checked(tree).collect())
    assert {len(r.proof) for r in proofs(tree).collect()} == {3}
    changed = build(rows(SCHEMA, *data[:-1], (139, "b", "en", 0, "else")), COLUMNS, "doc_id", "source")
    assert changed.root != tree.root
