import zlib

import pytest

from cohortry.llm import toxicity as tox

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.toxicity(docs, labels).collect()
    return rows, {r.doc_id: r.toxic for r in labels.collect()}


def test_held_out_rows_and_range(scored):
    rows, _ = scored
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_accuracy(scored):
    rows, labels = scored
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.9
    assert sum(p for _, p, y in held if y) / len(toxic) > 0.75
    assert sum(p for _, p, y in held if not y) / len(clean) < 0.02


def test_scores_follow_the_text_alone(spark, rows):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = tox.fit(docs, labels)
    odd = rows(
        "doc_id long, text string, score string, label int, features int",
        (1, "you stupid worthless idiot", "x", 1, 1), (2, "you stupid worthless idiot", "x", 0, 1), (None, None, "x", 0, 1),
        (3, "", "x", 0, 1), (4, "calm words " * 100_000, "x", 0, 1), (4, "calm words " * 100_000, "x", 0, 1),
    )
    got = sorted(((r.doc_id or 0), r.score) for r in model.score(odd).collect())
    assert got[1][1] == got[2][1] > got[4][1] == got[5][1]
    assert got[0][1] == got[3][1] <= 1.0
    kept = tox.without_toxic(odd.drop("label"), labels.where("false"))
    assert kept.count() == 6 and kept.columns == odd.drop("label").columns


def test_extra_columns_stay(spark, rows):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS raw", "2 AS vector", "'a' AS words", "3 AS whole")
    kept = tox.without_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert kept.dtypes == docs.dtypes
    assert 0.8 * docs.count() < kept.count() < docs.count()


def test_without_usable_labels(spark, rows):
    docs = rows("doc_id long, text string", (1, "a"), (2, None))
    labels = rows("doc_id long, toxic int", (1, None), (None, 1), (3, 7))
    assert [(r.score, r.predicted) for r in tox.toxicity(docs, labels).collect()] == [(0.0, 0), (0.0, 0)]
    assert tox.toxicity(docs.where("false"), labels).count() == 0


def test_disguised_words():
    traits = tox.WordTraits(tox.Lexicon({"idiot": 5.0}, {}))
    assert traits["1d!ot"][3] and traits["idi0t"][0] == 5.0 and not traits["idiot"][3] and not traits["2024"][0]
