"""The training-data operators on the test tables: one query each, with SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.catalog.registry import Tables
from cohortry.llm import (
    decontaminate,
    hard_negatives,
    html_template,
    licenses,
    line_dedup,
    merkle,
    nn_descent,
    packing,
    pii,
    simhash,
    toxicity,
    training_order,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_html_text")
def op1_html_text(t: Tables) -> DataFrame:
    return html_template.extract_text(t.pages)


LINE_DEDUP_SQL = """
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
placed AS (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS pos FROM lines),
windows AS (SELECT doc_id, pos, ls[pos + 1] AS a, ls[pos + 2] AS b, ls[pos + 3] AS c FROM placed),
numbered AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
    FROM windows WHERE trim(a || b || c) <> ''),
covered AS (
    SELECT doc_id, list(DISTINCT pos + k) AS gone
    FROM numbered, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1 GROUP BY doc_id)
SELECT l.doc_id,
       CASE WHEN gone IS NULL THEN array_to_string(ls, chr(10))
            ELSE array_to_string([ls[i + 1] FOR i IN range(len(ls)) IF NOT list_contains(gone, i)], chr(10))
       END AS text,
       len(ls) AS n_lines, coalesce(len(gone), 0) AS n_removed
FROM lines l LEFT JOIN covered USING (doc_id)
"""


@query("op2_line_dedup", LINE_DEDUP_SQL)
def op2_line_dedup(t: Tables) -> DataFrame:
    return line_dedup.remove_repeated_lines(t.documents.select("doc_id", "text"))


def _tokens(text: str) -> str:
    """The operator's tokens in DuckDB, which names scripts without ``Is``."""
    spaced = f"regexp_replace({text}, '{decontaminate.LETTERS.replace('{Is', '{')}', ' \\1 ', 'g')"
    spaced = spaced.replace(r"\u3001-\u3003\u30fb\u30fc\uff70", r"\x{3001}-\x{3003}\x{30fb}\x{30fc}\x{ff70}")
    return f"[x FOR x IN regexp_split_to_array(lower({spaced}), '{decontaminate.SEPARATORS}') IF x <> '']"


# without seeds: every alignment in which item and document share a token is counted
DECONTAMINATE_SQL = f"""
WITH docs AS (SELECT doc_id, {_tokens("coalesce(text, '')")} AS ts FROM documents),
items AS (
    SELECT min(item_id) AS item_id, ts, least(len(ts), {decontaminate.STRETCH_TOKENS}) AS width
    FROM (SELECT item_id, {_tokens("coalesce(text, '')")} AS ts FROM benchmark) GROUP BY ts),
doc_words AS (SELECT doc_id, unnest(ts) AS word, unnest(range(len(ts))) AS pos FROM docs),
item_words AS (SELECT item_id, width, unnest(ts) AS word, unnest(range(len(ts))) AS pos FROM items),
aligned AS (
    SELECT d.doc_id, i.item_id, d.pos - i.pos AS shift
    FROM doc_words d JOIN item_words i USING (word)
    GROUP BY ALL HAVING count(*) >= {decontaminate.SIMILARITY} * min(i.width)),
compared AS (
    SELECT a.doc_id, a.item_id, a.shift, len(i.ts) AS item_tokens, i.width,
           [CASE WHEN shift + k >= 0 AND d.ts[shift + k + 1] = i.ts[k + 1] THEN 1 ELSE 0 END FOR k IN range(len(i.ts))] AS eq
    FROM aligned a JOIN docs d USING (doc_id) JOIN items i USING (item_id)),
measured AS (
    SELECT *, list_sum(eq) AS matched,
           list_max([list_sum(eq[s + 1:s + width]) FOR s IN range(item_tokens - width + 1)]) AS best_stretch
    FROM compared),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best_stretch DESC, matched DESC, shift) AS nth
    FROM measured WHERE best_stretch >= {decontaminate.SIMILARITY} * width)
SELECT doc_id, item_id, item_tokens, shift AS "offset", matched, best_stretch FROM ranked WHERE nth = 1
"""


@query("op3_decontamination", DECONTAMINATE_SQL)
def op3_decontamination(t: Tables) -> DataFrame:
    return decontaminate.contaminated(t.documents, t.benchmark, short_items=True).drop("row")


WARC_SQL = """
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
sized AS (SELECT *, octet_length(encode(html)) AS n FROM pages_),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM sized)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM ranked
"""


@query("op4_warc", WARC_SQL)
def op4_warc(t: Tables) -> DataFrame:
    folder, index = warc.write_warc(t.pages)
    return warc.read_warc(folder, index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


TRAINING_KEY = "epoch-0"


@query("op5_training_order")
def op5_training_order(t: Tables) -> DataFrame:
    _, slots = training_order.materialise_order(t.documents, VOCABULARY, TRAINING_KEY)
    return slots.drop("attempt")


NEAR_VECTORS_SQL = """
WITH RECURSIVE units AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum([x * x FOR x IN embedding::DOUBLE[]]) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counted USING (vec_id)
"""


@query("op6_near_vectors", NEAR_VECTORS_SQL)
def op6_near_vectors(t: Tables) -> DataFrame:
    return nn_descent.near_vectors(t.embeddings)


@query("op7_pii")
def op7_pii(t: Tables) -> DataFrame:
    found = pii.personal_data(t.documents)
    return found.select(
        "doc_id",
        *(f"n_{k}" for k in pii.KINDS),
        F.sha2(pii.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.as_text(F.col("spans")).alias("spans"),
    )


@query("op8_simhash")
def op8_simhash(t: Tables) -> DataFrame:
    return simhash.near_duplicates(t.documents)


@query("op9_packing")
def op9_packing(t: Tables) -> DataFrame:
    placed = packing.pack(t.documents, VOCABULARY, with_ids=False)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query("op10_toxicity")
def op10_toxicity(t: Tables) -> DataFrame:
    return toxicity.toxicity(t.documents, t.labels)


HARD_NEGATIVES_SQL = """
WITH usable AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x) FOR x IN embedding::DOUBLE[]] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
positives AS (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM scored WHERE same),
ranked AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
         AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    WHERE p.nth <= 5)
SELECT * FROM ranked WHERE rank <= 10
"""


@query("op11_hard_negatives", HARD_NEGATIVES_SQL)
def op11_hard_negatives(t: Tables) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(t.embeddings, F.col("vec_id") % 100 == 0, label=label)


MERKLE_LEVELS = 8  # sixteen to the eighth leaves in a source


def _leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _tree(name: str, first: str) -> str:
    """Levels of a tree over the nodes of ``first`` (s, i, n, h), and what lies left and right of every node."""
    levels = [f"{name}0 AS ({first})"]
    for k in range(MERKLE_LEVELS):
        levels.append(
            f"{name}{k + 1} AS (SELECT s, i // 16 AS i, any_value((n + 15) // 16) AS n, sha256(string_agg(h, '' ORDER BY i)) AS h"
            f" FROM {name}{k} WHERE n > 1 GROUP BY s, i // 16)"
        )
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM {name}{k}" for k in range(MERKLE_LEVELS + 1))
    sides = (
        "SELECT a.s, a.k, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,"
        " coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r"
        f" FROM {name}_all a JOIN {name}_all b ON a.s = b.s AND a.k = b.k AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY ALL"
    )
    tops = f"SELECT s, h, k FROM {name}_all WHERE n = 1"
    return ",\n".join([*levels, f"{name}_all AS ({every})", f"{name}_sides AS ({sides})", f"{name}_top AS ({tops})"])


MERKLE_SQL = f"""
WITH RECURSIVE hit AS (
    SELECT *, list_reduce(
        [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')],
        lambda crc, b: list_reduce(
            [x::BIGINT FOR x IN range(8)],
            lambda c, bit: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)),
        4294967295::BIGINT) AS register
    FROM documents),
leaves AS (
    SELECT doc_id, {_leaf("text")} AS leaf,
           CASE WHEN xor(register, 4294967295) % 5 = 0
                THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS seen,
           dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i,
           count(*) OVER (PARTITION BY source) AS n
    FROM hit),
{_tree("low", "SELECT s, i, n, leaf AS h FROM leaves")},
{_tree("up", "SELECT 0 AS s, s AS i, count(*) OVER () AS n, h FROM low_top")},
steps AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY up, k) AS nth, l, r FROM (
        SELECT d.doc_id, 0 AS up, x.k, x.l, x.r FROM leaves d JOIN low_sides x ON x.s = d.s AND x.i = d.i // (16 ** x.k)::BIGINT
        UNION ALL
        SELECT d.doc_id, 1, x.k, x.l, x.r FROM leaves d JOIN up_sides x ON x.i = d.s // (16 ** x.k)::BIGINT)),
folded AS (
    SELECT doc_id, 0::BIGINT AS nth, seen AS h FROM leaves
    UNION ALL
    SELECT f.doc_id, x.nth, sha256(x.l || f.h || x.r) FROM folded f JOIN steps x ON x.doc_id = f.doc_id AND x.nth = f.nth + 1),
proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY nth) AS texts FROM steps GROUP BY doc_id),
ends AS (SELECT doc_id, arg_max(h, nth) AS folded_root FROM folded GROUP BY doc_id)
SELECT d.doc_id, d.leaf, t.h AS subroot, u.h AS root, sha256(coalesce(p.texts, '')) AS proof_sha256, e.folded_root,
       e.folded_root = u.h AS verified
FROM leaves d JOIN low_top t ON t.s = d.s CROSS JOIN up_top u JOIN ends e ON e.doc_id = d.doc_id
     LEFT JOIN proofs p ON p.doc_id = d.doc_id
"""


@query("op12_merkle", MERKLE_SQL)
def op12_merkle(t: Tables) -> DataFrame:
    return merkle.checked_documents(t.documents)


@query("op13_licenses")
def op13_licenses(t: Tables) -> DataFrame:
    return licenses.license_statements(t.documents)
