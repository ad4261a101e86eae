import re
from collections import defaultdict

import pytest

import corpus_pipeline
from test_line_dedup import brute as without_repeats
from test_simhash import direct, grouped

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "_"))
        stage(spark, tables[-1], FOLDER).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def test_columns_stay_until_the_last(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(t.schema == stages[0].schema for t in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    clean = [d for d, y in labels.items() if not y]
    assert sum(d in kept for d in clean) / len(clean) > 0.97
    toxic = [d for d, y in labels.items() if y]
    assert sum(d not in kept for d in toxic) / len(toxic) > 0.6


def test_repeated_lines(stages):
    before = sorted((r.doc_id, r.text) for r in stages[1].collect())
    after = sorted((r.doc_id, r.text) for r in stages[2].collect())
    assert after == [(d, t) for d, t, _ in without_repeats(before)]
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_of_each_group_of_copies(stages):
    groups = grouped({r.doc_id: direct(r.text) for r in stages[2].collect()})
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(groups.values()))


def test_benchmark_passages_are_gone(spark, stages):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    grams = {tuple(words(r.text)[k : k + 15]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() for k in range(len(words(r.text)) - 14)}
    held = lambda t: any(tuple(words(t)[k : k + 15]) in grams for k in range(len(words(t)) - 14))
    before = {r.doc_id: r.text for r in stages[3].collect()}
    kept = {r.doc_id for r in stages[4].collect()}
    assert {d for d, t in before.items() if held(t)} == set(before) - kept


def test_every_kept_document_is_packed(stages):
    pieces = defaultdict(int)
    for r in stages[5].collect():
        pieces[r.doc_id] += r.length
        assert r.offset + r.length <= 2048
    assert set(pieces) == {r.doc_id for r in stages[4].collect()}


def test_run_gives_the_same_pieces(spark, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(stages[5])
