"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from one part of a bounded sample of labelled documents, the trees
from a second part and the calibration from a third, so no part judges its own words. Every whole text is then turned
into the same dense features in one pass and scored by the fitted model on the executors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import fresh, in_tasks, stored, text_or_empty

THRESHOLD = 0.3
SAMPLE_PER_CLASS = 6000  # labelled documents of either class that a model is fitted on, at most
BEGINNINGS = (4, 5, 6)
MIN_DOCUMENTS = 4
MIN_LOG_ODDS = 2.5
MAX_LEXICON = 6000
NEAR_WORDS = 5
TREES, DEPTH, STEP = 20, 3, 0.3

# Words of address in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos "
    "usted ustedes ti tuyo vosotros".split()
)
# Common insults in the same languages, known without labels; they weigh as much as FIXED_LOG_ODDS.
INSULTS = (
    "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown dumb bastard "
    "bitch shit fuck fucking asshole retard jerk dumm dummkopf arschloch scheisse scheiße abschaum wertlos idiotin "
    "connard connasse salaud imbécile merde pourriture débile idiota estúpido estúpida imbécil mierda basura escoria "
    "inútil gilipollas"
).split()
FIXED_LOG_ODDS = 5.0
# Signs that stand for letters in disguised words.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

FEATURES = (
    "words", "word_hits", "beginning_hits", "hit_density", "beginning_density", "strongest", "hit_kinds",
    "second_person", "near_second_person", "capitals", "exclamations", "questions", "punctuation", "disguised",
    "stretched",
)

WORD = re.compile(r"[^\W_]+(?:[*@$!'.\-][^\W_]+)*")
LETTERS_ONLY = re.compile(r"[^a-zà-öø-ÿ]+")
STRETCHED = re.compile(r"(.)\1{2,}")
PUNCTUATION = re.compile(r"[^\w\s]")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")


@dataclass(frozen=True)
class Lexicon:
    """Log odds of words and of word beginnings; both bounded by ``MAX_LEXICON``."""

    words: dict[str, float]
    beginnings: dict[str, float]

    def weight(self, word: str) -> tuple[float, float]:
        """Log odds of the word and the largest of its beginnings, 0 where unknown."""
        return self.words.get(word, 0.0), max(
            (self.beginnings.get(word[:n], 0.0) for n in BEGINNINGS if len(word) >= n), default=0.0
        )


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


PLAIN_WORD = (0.0, 0.0, False, False)
MAX_CACHED_WORDS = 150_000


class WordTraits(dict):
    """For a word: its two weights, whether it addresses the reader, whether it is a disguised lexicon word."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[float, float, bool, bool]:
        own, beginning = self.lexicon.weight(word)
        disguised = False
        if not own and not word.isalpha():
            plain = LETTERS_ONLY.sub("", word.translate(DISGUISES))
            own = self.lexicon.words.get(plain, 0.0)
            disguised = own > 0
        traits = (own, beginning, word in SECOND_PERSON, disguised)
        traits = PLAIN_WORD if traits == PLAIN_WORD else traits
        if len(self) >= MAX_CACHED_WORDS:  # bounded memory; traits do not depend on it
            self.clear()
        self[word] = traits
        return traits


def features(text: str, traits: WordTraits) -> list[float]:
    """The values of ``FEATURES``; rates are per word or per character, zero for a text without words."""
    words = words_of(text)
    found = [traits[w] for w in words]
    hits = [k for k, t in enumerate(found) if t[0] or t[1]]
    address = [k for k, t in enumerate(found) if t[2]]
    near = 0
    if hits and address:
        at = np.searchsorted(address, hits)
        spots = np.array(address)
        left = np.abs(spots[np.maximum(at - 1, 0)] - hits)
        right = np.abs(spots[np.minimum(at, len(address) - 1)] - hits)
        near = int((np.minimum(left, right) <= NEAR_WORDS).sum())
    n, chars = max(len(words), 1), max(len(text), 1)
    own = sum(1 for t in found if t[0])
    beginnings = sum(1 for t in found if t[1])
    return [
        math.log1p(len(words)),
        math.log1p(own),
        math.log1p(beginnings),
        100.0 * own / n,
        100.0 * beginnings / n,
        max((max(t[0], t[1]) for t in found), default=0.0),
        math.log1p(len({words[k] for k in hits})),
        100.0 * len(address) / n,
        100.0 * near / n,
        100.0 * len(CAPITAL.findall(text)) / chars,
        100.0 * text.count("!") / chars,
        100.0 * text.count("?") / chars,
        100.0 * len(PUNCTUATION.findall(text)) / chars,
        100.0 * sum(t[3] for t in found) / n,
        100.0 * len(STRETCHED.findall(text)) / n,
    ]


def add_features(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """(text, ...) to (features, ...): the last column is the text, the others are passed on."""
    traits = WordTraits(lexicon)
    for batch in batches:
        last = batch.num_columns - 1
        rows = [features(t.as_py(), traits) for t in batch.column(last)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:last], pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names[:last], "features"]
        )


def with_features(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``texts`` (..., text) with the text replaced by its features, one column each."""
    kept = texts.columns[:-1]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema[:-1]) + ", features array<double>"
    rows = in_tasks(texts, partial(add_features, lexicon=lexicon), schema)
    return rows.select(*kept, *(F.col("features")[k].alias(name) for k, name in enumerate(FEATURES)))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, per_class: int
) -> DataFrame:
    """(doc_id, label, third, text): labelled training rows, at most ``per_class`` of either label by hash order."""
    key = F.col(id_column).cast("long")
    usable = labels.select(key.alias("doc_id"), F.col(label_column).cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = [
        usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for label in (0, 1)
    ]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * per_class rows
    texts = docs.select(key.alias("doc_id"), text_or_empty(text_column).alias("text"))
    third = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10))
    third = F.when(third < 4, 0).when(third < 8, 1).otherwise(2)
    return texts.join(chosen, "doc_id").select("doc_id", "label", third.alias("third"), "text")


def held_out(id_column: str):
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and beginnings whose share of toxic documents is far above their share of the others."""
    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    words = sample.select("doc_id", "label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1))).alias("w"))
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("w").alias("term")),
        *(
            F.when(F.length("w") >= n, F.struct(F.lit(n).alias("kind"), F.substring("w", 1, n).alias("term")))
            for n in BEGINNINGS
        ),
    )
    terms = words.select("doc_id", "label", F.explode(F.array_compact(kinds)).alias("t")).select("doc_id", "label", "t.*")
    counted = terms.distinct().groupBy("kind", "term").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    )
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    strong = counted.where(F.col("toxic") >= MIN_DOCUMENTS).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
    rows = strong.orderBy(F.desc("odds"), "kind", "term").limit(MAX_LEXICON).collect()
    known = dict.fromkeys(INSULTS, FIXED_LOG_ODDS)
    return Lexicon(
        known | {r.term: r.odds for r in rows if r.kind == 0}, {r.term: r.odds for r in rows if r.kind > 0}
    )


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    knots: list[tuple[float, float]]
    base: float

    def score(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """(doc_id, score) for every row; the score depends on the text alone."""
        texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
        if self.trees is None:
            return texts.select("doc_id", F.lit(self.base).alias("score"))
        raw = raw_scores(with_features(texts, self.lexicon), self.trees)
        return raw.select("doc_id", calibrated(F.col("raw"), self.knots).alias("score"))


def raw_scores(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows)
    return trees.transform(vectors).withColumn("raw", vector_to_array("probability")[1])


def calibrated(raw, knots: list[tuple[float, float]]):
    """Linear interpolation between the knots of the isotonic fit, with a small share of ``raw`` to keep order."""
    value = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        slope = (y1 - y0) / (x1 - x0) if x1 > x0 else 0.0
        value = F.when(raw < x1, F.lit(y0) + (raw - x0) * slope).otherwise(value)
    value = F.when(raw <= knots[0][0], F.lit(knots[0][1])).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value * 0.999 + raw * 0.001))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    per_class: int = SAMPLE_PER_CLASS,
) -> ToxicityModel:
    """Learn lexicon, trees and calibration from at most ``2 * per_class`` labelled documents.

    Rows without a label, with another label than 0 or 1, held out, or with a null id are not used; a document with
    both labels counts as 1. When a part of the sample lacks one of the classes nothing can be learned, and every
    text scores the share of label 1 in the sample (0.0 without labels).
    """
    sample = stored(labelled_sample(docs, labels, id_column, text_column, label_column, per_class), "labelled")
    counts = {(r.third, r.label): r.n for r in sample.groupBy("third", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not counts.get((third, label)) for third in range(3) for label in (0, 1)):
        positives, rows = sum(n for (_, label), n in counts.items() if label), sum(counts.values())
        return ToxicityModel(Lexicon({}, {}), None, [], positives / rows if rows else 0.0)
    lexicon = learn_lexicon(sample.where(F.col("third") == 0))
    rows = stored(with_features(sample.where(F.col("third") > 0), lexicon), "features")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    trainer = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, minInstancesPerNode=5
    )
    trees = trainer.fit(assembler.transform(rows.where(F.col("third") == 1)).coalesce(1))
    judged = raw_scores(rows.where(F.col("third") == 2), trees).select("raw", F.col("label").cast("double").alias("label"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label").fit(judged)
    knots = list(zip(curve.boundaries.toArray().tolist(), curve.predictions.toArray().tolist(), strict=True))
    return ToxicityModel(lexicon, trees, knots, 0.0)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    The score is between 0 and 1 and follows from the whole text alone. Null and empty texts have all features zero
    and are scored as such. Repeated rows keep their count, null ids stay null and are not held out. Further columns
    are ignored. An empty table gives no rows.
    """
    scored = fit(docs, labels, id_column, text_column, label_column).score(docs, id_column, text_column)
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns as they are.

    The score is computed beside each row, so no join is needed and repeated ids cannot be confused.
    """
    model = fit(docs, labels, id_column, text_column, label_column)
    if model.trees is None:
        return docs if model.base < threshold else docs.where(F.lit(False))
    whole = fresh([*docs.columns, *FEATURES, "features", "vector", "raw", "probability", "prediction", "rawPrediction"], "whole")
    text = fresh([whole], "text")
    texts = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole), text_or_empty(text_column).alias(text))
    raw = raw_scores(with_features(texts, model.lexicon), model.trees)
    return raw.where(calibrated(F.col("raw"), model.knots) < threshold).select(f"{whole}.*")
