import random
from itertools import combinations

import duckdb
import pytest

from cohortry.llm.decontaminate import SEEDS, contaminated, decontaminate, short_masks
from cohortry.llm.queries import ORACLES, QUERIES

WORDS = [f"w{k}" for k in range(4000)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("share, least_found", [(0.0, 20), (0.1, 20), (0.18, 18)])
def test_substituted_passages_are_found(rows, share, least_found):
    rng = random.Random(int(share * 100))
    items = [(k, text(rng, rng.randint(20, 60))) for k in range(20)]
    docs = []
    for k, item in items:
        words = item.split(" ")
        changed = set(rng.sample(range(len(words)), int(share * len(words))))
        passage = " ".join("SUBSTITUTE" if j in changed else w for j, w in enumerate(words))
        docs.append((k, f"{text(rng, 30)}, {passage.title()}! {text(rng, 30)}"))
    docs += [(100 + k, text(rng, 200)) for k in range(50)]
    bench = rows("item_id long, text string", *items)
    got = contaminated(rows("doc_id long, text string", *docs), bench).collect()
    assert all(r.doc_id == r.item_id for r in got)
    assert len(got) >= least_found
    assert all(r.offset == 30 for r in got)


def test_partial_passages_and_clean_texts(rows):
    rng = random.Random(5)
    item = text(rng, 60).split(" ")
    docs = [
        (1, " ".join(item[:25]) + " " + text(rng, 40)), (2, text(rng, 40) + " " + " ".join(item[30:])),
        (3, " ".join(item[:8]) + " " + text(rng, 100)), (4, " ".join(rng.sample(item, 60))),
    ]
    got = contaminated(rows("doc_id long, text string", *docs), rows("item_id long, text string", (1, " ".join(item))))
    assert sorted((r.doc_id, r.offset) for r in got.collect()) == [(1, 0), (2, 10)]


def test_edge_rows(spark, rows):
    rng = random.Random(9)
    item, short = text(rng, 30), "only five words are here"
    bench = rows("item_id long, text string, row int", (7, item, 0), (3, item, 0), (8, None, 0), (9, short, 0), (None, "", 0))
    docs = rows(
        "doc_id long, text string, row int, key int",
        (1, item, 0, 0), (1, item, 0, 0), (1, "other text", 0, 0), (None, item.upper(), 0, 0), (2, None, 0, 0), (3, short, 0, 0),
        (4, text(rng, 30_000) + " " + item, 0, 0),
    )
    got = contaminated(docs, bench)
    assert sorted(((r.doc_id or 0), r.item_id, r.matched) for r in got.collect()) == [(0, 3, 30), (1, 3, 30), (4, 3, 30)]
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, "other text"), (2, ""), (3, short)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, none).count() == 0 and decontaminate(docs, none).count() == 7
    assert contaminated(docs.where("false"), bench).count() == 0


def test_sql_counts_the_same_alignments(spark, rows, tmp_path):
    """The query's SQL on what the tables lack: regular substitutions, short items, scripts without spaces."""
    rng = random.Random(21)
    items = [(k, text(rng, n)) for k, n in enumerate([4, 5, 7, 9, 10, 15, 20, 40])]
    items += [(20, "下列哪一项不是太阳系的行星请选择正确的答案"), (21, "次の文章、を読んで・問いに答えカタカナーのデータも"), (22, items[5][1])]
    every = lambda words, k: " ".join("other" if j % 5 == k else w for j, w in enumerate(words))
    docs = [(k, f"{text(rng, 7)} {every(i.split(' '), k % 5)} {text(rng, 7)}") for k, i in items[:8]]
    docs += [(100 + k, f"Ü {i.upper()}, {text(rng, 5)} {i}") for k, i in items]
    docs += [(200, "前文下列哪一项不X太阳系的行星请选择正确的答案後文"), (201, None), (202, ""), (203, text(rng, 300))]
    tables = {"documents": ("doc_id long, text string", docs), "benchmark": ("item_id long, text string", items)}
    con = duckdb.connect()
    for name, (schema, data) in tables.items():
        rows(schema, *data).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["op3_decontamination"](spark, str(tmp_path))
    want = con.sql(ORACLES["op3_decontamination"])
    assert {tuple(r) for r in got.select(*want.columns).collect()} == set(want.fetchall())
    assert {r.doc_id for r in got.collect()} >= {100, 107, 4, 5, 6, 7, 120, 121, 200}


def test_seeds_miss_no_pattern_of_substitutions():
    for length in range(10, 21):
        fits = [[at + k for k, bit in enumerate(m) if bit == "1"] for m in SEEDS for at in range(length - len(m) + 1)]
        for changed in combinations(range(length), length // 5):
            assert any(not set(changed) & set(places) for places in fits), (length, changed)


@pytest.mark.parametrize("length", [10, 15, 20, 50, 100])
def test_every_fifth_token_substituted(rows, length):
    rng = random.Random(length)
    items = [(k, text(rng, length)) for k in range(5)]
    docs = [
        (k, f"{text(rng, 7)} {' '.join('other' if j % 5 == k else w for j, w in enumerate(item.split(' ')))} {text(rng, 7)}")
        for k, item in items
    ]
    edges = [(5 + k, " ".join(item.split(" ")[length // 5 :])) for k, item in items]  # the beginning is missing
    got = contaminated(rows("doc_id long, text string", *docs, *edges), rows("item_id long, text string", *items)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted((k + n, k) for k in range(5) for n in (0, 5))


def test_equals_a_search_without_seeds(rows):
    rng = random.Random(3)
    few = WORDS[:3]  # many chance hits
    items = [(k, [rng.choice(few) for _ in range(rng.randint(10, 26))]) for k in range(12)]
    near = lambda item: [rng.choice(few) if rng.random() < 0.3 else w for w in item]
    some = lambda: [rng.choice(few) for _ in range(rng.randint(0, 20))]
    docs = [(k, some() + near(items[k % 12][1])[rng.randint(0, 3) :] + some()) for k in range(48)]
    want = {}
    for d, words in docs:
        for i, item in items:
            width = min(len(item), 20)
            for offset in range(-len(item) + 1, len(words)):
                equal = [0 <= offset + k < len(words) and words[offset + k] == w for k, w in enumerate(item)]
                best = max(sum(equal[s : s + width]) for s in range(len(item) - width + 1))
                if best >= 0.8 * width:
                    want[d, i] = max(want.get((d, i), (0, 0, 0)), (best, sum(equal), -offset))
    as_rows = lambda name, data: rows(f"{name} long, text string", *((k, " ".join(w)) for k, w in data))
    got = contaminated(as_rows("doc_id", docs), as_rows("item_id", items)).collect()
    assert want and {(r.doc_id, r.item_id): (r.best_stretch, r.matched, -r.offset) for r in got} == want


def test_short_items(rows):
    rng = random.Random(11)
    items = [(n, " ".join(f"item{n}x{k}" for k in range(n))) for n in range(1, 10)]
    whole = [(n, f"{text(rng, 4)} {item.upper()}. {text(rng, 4)}") for n, item in items]
    changed = [(100 + 10 * n + k, " ".join("other" if j == k else w for j, w in enumerate(i.split(" ")))) for n, i in items for k in range(n)]
    cut = [(300 + n, " ".join(i.split(" ")[1:])) for n, i in items]
    docs, bench = rows("doc_id long, text string", *whole, *changed, *cut), rows("item_id long, text string", *items)
    got = contaminated(docs, bench, short_items=True).collect()
    want = [(n, n) for n in range(1, 10)] + [(100 + 10 * n + k, n) for n in range(5, 10) for k in range(n)] + [(300 + n, n) for n in range(5, 10)]
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    kept = {r.doc_id for r in decontaminate(docs, bench, short_items=True).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_short_masks_miss_no_pattern():
    for length in range(1, 10):
        fits = [[at + k for k, bit in enumerate(m) if bit == "1"] for m in short_masks(length) for at in range(length - len(m) + 1)]
        for changed in combinations(range(length), length // 5):
            assert any(not set(changed) & set(places) for places in fits), (length, changed)


@pytest.mark.parametrize(
    "item",
    ["下列哪一项不是太阳系的行星请选择正确的答案", "次の文章を読んで、問いに答えなさい。カタカナのデータも", "จงเลือกคำตอบที่ถูกต้องที่สุดเพียงข้อเดียว"],
)
def test_scripts_without_spaces(rows, item):
    changed = item[:6] + "X" + item[7:]
    docs = rows("doc_id long, text string", (1, f"前文{item}後文"), (2, f"ab{changed}cd"), (3, item[::-1]), (4, "plain words"))
    got = contaminated(docs, rows("item_id long, text string", (5, item))).collect()
    assert sorted(r.doc_id for r in got) == [1, 2]
