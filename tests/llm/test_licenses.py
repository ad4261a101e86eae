import re
import time

import pyarrow as pa
import pytest

from cohortry.llm import licenses as L

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def direct(text):
    words = WORDS.findall(lowered(text or ""))
    hits = []
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        hits += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    places = [k for k, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def base(row):
    return row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]


def said(text, **more):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    return next(L.scan(iter([batch]), **more)).to_pylist()[0]


def test_base_places_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = L.license_statements(docs).collect()
    assert len(found) == len(texts) and sum(r.n_base for r in found) > 200
    assert all(base(r) == direct(texts[r.doc_id]) for r in found)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in found)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in found)


TEXTS = [
    None, "", " \n\t", "mit", "license", "MIT License", "the mit license.", "mit licenses", "xmit license", "MIT\n\nLicense mit license",
    "mit license mit license", "gnu general public\r\nLICENSE; cc.by-NC", "İMIT license É apache LICENSE", "cc\x00by cc\x7fby ccxby",
    "ccéby", "mit license é", "apache 2 license", "gnu gnu general public license",
]


@pytest.mark.parametrize("size", [1, 1 << 21])
def test_rows_do_not_touch(size):
    """``mit`` at the end of a row and ``license`` at the start of the next are no phrase."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array([t or "" for t in TEXTS])], ["doc_id", "text"])
    for part in (batch, batch.slice(3, 9)):
        rows = [r for out in L.scan(iter([part]), bytes_at_once=size) for r in out.to_pylist()]
        assert [base(r) for r in rows] == [direct(TEXTS[r["doc_id"]]) for r in rows] and len(rows) == len(part)


def test_edge_tables(rows, spark):
    names = "n_words labels score text2 `a.b`".split()
    wide = rows("doc_id long, text string" + "".join(f", {c} string" for c in names), *((k, t, *"vwxyz") for k, t in enumerate(TEXTS)), (None, "mit license", *"vwxyz"), (0, None, *"vwxyz"))
    found = L.license_statements(wide).collect()
    assert len(found) == len(TEXTS) + 2
    assert sorted(map(base, found), key=str) == sorted([*map(direct, TEXTS), direct("mit license"), direct(None)], key=str)
    assert L.license_statements(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = wide.select("n_words", "text")
    assert L.license_statements(clash, "n_words").columns[:2] == ["n_words_", "n_words"]


# expression -> labels, labels after choices, restriction
EXPRESSIONS = {
    "MIT": ("mit", "mit", 1),
    "MIT OR Apache-2.0": ("apache,mit", "mit", 1),
    "GPL-3.0-only or MIT": ("gpl,mit", "mit", 1),
    "GPL-2.0+ AND (MIT OR AGPL-3.0)": ("agpl,gpl,mit", "gpl,mit", 3),
    "MIT OR GPL-3.0 AND ISC": ("gpl,isc,mit", "mit", 1),
    "(MIT OR GPL-3.0) AND ISC": ("gpl,isc,mit", "isc,mit", 1),
    "GPL-3.0 OR AGPL-3.0 AND MIT": ("agpl,gpl,mit", "gpl", 3),
    "GPL-2.0-or-later WITH Classpath-exception-2.0": ("gpl", "gpl", 2),
    "GPL-2.0 WITH x AND LicenseRef-own": ("gpl", "gpl", 4),
    "((CC-BY-NC-SA-4.0))": ("cc-by-nc-sa", "cc-by-nc-sa", 4),
}


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_expressions(text):
    terms = L.parse(text).terms
    assert (",".join(sorted(terms.labels)), ",".join(sorted(terms.chosen)), terms.restriction) == EXPRESSIONS[text]


@pytest.mark.parametrize("text", ["", "and", "MIT and", "(MIT", "MIT)", "MIT ISC", "or MIT", "MIT WITH (x)", "(MIT) WITH x", "MIT WITH x WITH y", "()"])
def test_no_expressions(text):
    assert L.parse(text) is None


TAGGED = {
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) */\nint x;": ["(mit or apache-2.0)"],
    "SPDX-License-Identifier: LicenseRef-own\n": ["licenseref-own"],
    '{"license": "MIT OR GPL-3.0",\n "x": 1}': ["mit or gpl-3.0"],
    "license = 'ISC'": ["isc"],
    "<license>BSD-3-Clause</license>": ["bsd-3-clause"],
    "License: MIT and other things": ["mit"],
    "License-Expression: MIT. More text": ["mit"],
    "License: see below": [],
    "licensed: MIT": [],
    "SPDX-License-Identifier:\nMIT": [],
    "SPDX-License-Identifier: MIT OR SPDX-License-Identifier: ISC": ["isc", "mit"],
}


@pytest.mark.parametrize("text", TAGGED)
def test_tags(text):
    assert said(text)["expressions"] == TAGGED[text]


def test_notices_and_score():
    row = said("Permission is hereby granted, free of charge, to any person obtaining a copy of this")
    assert (row["base_labels"], row["labels"], row["score"]) == ("", "mit", 0.25)
    row = said("GNU Affero General Public License. License: AGPL-3.0 OR MIT")
    assert (row["labels"], row["chosen"], row["score"]) == ("agpl,mit", "mit", 0.25)
    assert said("no licence at all")["score"] == 0


@pytest.mark.parametrize("text", [
    "license: mit " * 50_000, "spdx-license-identifier: " + "mit or " * 100_000 + "mit", "spdx-license-identifier: " + "(" * 200_000,
    "license:" + "a" * 500_000, "license " * 50_000, "license:" + " " * 300_000 + "license:" * 30_000, "license: mit with " * 30_000,
])
def test_long_texts_in_linear_time(text):
    start = time.perf_counter()
    said(text)
    assert time.perf_counter() - start < 10
