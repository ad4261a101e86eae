"""Benchmark decontamination with spaced seeds.

A mask selects some of the tokens in a window and ignores the others. The hash of the selected tokens is taken at
every place of every benchmark item and training text, equal hashes are joined, and each hit fixes an alignment of
the two token sequences. An alignment counts when a stretch of it agrees in most tokens, so passages with substituted
words are found as well. Hits are reduced to distinct alignments before any text is looked at again. Items too short for
these masks have masks of their own length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import fresh, identified, stored
from cohortry.session import checked_broadcast

# 1: the token is part of the seed, 0: any token may stand there. One of them fits wherever 10 tokens differ in 2 places,
# 15 in 3 or 20 in 4, so no alignment of the similarity below is missed
SEEDS = ("111111", "1101111", "11110011", "1100010111", "1110001011")
LEAST_TOKENS = 10
STRETCH_TOKENS = 20
SIMILARITY = 0.8
# after lower-casing: runs of ASCII signs other than letters and digits; all other characters belong to words
SEPARATORS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
# scripts written without spaces, whose letters are tokens; all lie from U+0E00 on
LETTERS = (
    r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsYi}\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}\p{IsTibetan}"
    r"\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}\p{IsJavanese}\p{IsBalinese}\u3001-\u3003\u30fb\u30fc\uff70])"
)
HIGH = r"[^\x00-\u0dff]"


def tokens(text: Column) -> Column:
    spaced = F.when(text.rlike(HIGH), F.regexp_replace(text, LETTERS, " $1 ")).otherwise(text)
    return F.array_remove(F.split(F.lower(spaced), SEPARATORS), "")


def short_masks(length: int) -> list[str]:
    """Masks for items below ten tokens: one fits wherever as many differ as the similarity allows, one or none."""
    if length < 5:
        return ["1" * length]
    return ["1" * (length - 1), *("1" * k + "0" + "1" * (length - 1 - k) for k in range(1, length - 1))]


def seeds(sequences: DataFrame, keys: list[str], masks: Sequence[str] = SEEDS) -> DataFrame:
    """(*keys, at, seed): a hash per mask and place of the array ``tokens`` where the whole mask fits."""
    placed = sequences.where(F.size("tokens") > 0)
    placed = placed.select(*keys, "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("at"))
    hashes = [
        F.when(
            F.col("at") + len(mask) <= F.size("tokens"),
            F.xxhash64(F.lit(mask), *(F.get("tokens", F.col("at") + k) for k, bit in enumerate(mask) if bit == "1")),
        )
        for mask in masks
    ]
    return placed.select(*keys, "at", F.explode(F.array(*hashes)).alias("seed")).where(F.col("seed").isNotNull())


def benchmark_items(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item_id, item): one row per token sequence, under the smallest id that has it."""
    source = identified(benchmark, id_column, text_column).select("id", tokens(F.col("text")).alias("item"))
    return source.groupBy("item").agg(F.min("id").alias("item_id"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    short_items: bool = False,
) -> DataFrame:
    """(doc_id, row, item_id, item_tokens, offset, matched, best_stretch): documents that hold a benchmark passage.

    One row per document and item. An alignment counts when some stretch of 20 item tokens, or the whole of a
    shorter item, has at least 80 % of them at the same place of the document; of several the one with the best
    stretch is given, then the one with most tokens in common, then the first. ``offset`` is the document's token
    that lies on the item's first one, negative when the item's beginning is missing.

    Letters of scripts without spaces are tokens. Items below ten tokens are searched with ``short_items`` only. Equal items are one, under their smallest id.
    Null texts are empty. Rows that agree in id and text are one document and give one row per item; rows with one
    id and different texts are told apart by ``row``, a hash of the text. Null ids are kept. Further columns are
    ignored. Empty tables give no rows.
    """
    items = stored(benchmark_items(benchmark, item_id_column, item_text_column), "items")
    sequences = items.select("item_id", F.col("item").alias("tokens"))
    wanted, masks = seeds(sequences.where(F.size("tokens") >= LEAST_TOKENS), ["item_id"]), set(SEEDS)
    if short_items:
        short = F.size("tokens").between(1, LEAST_TOKENS - 1)
        for (length,) in sequences.where(short).select(F.size("tokens")).distinct().collect():  # nine at most
            own = short_masks(length)
            wanted = wanted.unionByName(seeds(sequences.where(F.size("tokens") == length), ["item_id"], own))
            masks.update(own)
    wanted = checked_broadcast(wanted.withColumnRenamed("at", "item_at"))
    texts = identified(docs, id_column, text_column)
    split = texts.select("id", "row", tokens(F.col("text")).alias("tokens"))
    hits = seeds(split, ["id", "row"], sorted(masks)).join(wanted, "seed")
    alignments = hits.select("id", "row", "item_id", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    alignments = checked_broadcast(alignments.join(items, "item_id"))
    same = texts["id"].eqNullSafe(alignments["id"]) & (texts["row"] == alignments["row"])
    words = tokens(F.col("text"))
    begin = F.greatest(F.col("offset"), F.lit(0))
    part = F.slice(words, begin + 1, F.size("item") + F.least(F.col("offset"), F.lit(0)))
    # written, so that the text is split once and not again for every word that is compared
    aligned = stored(
        texts.join(alignments, same).select(texts["id"], texts["row"], "item_id", "item", "offset", part.alias("part")),
        "aligned",
    )
    length = F.size("item")
    width = F.least(length, F.lit(STRETCH_TOKENS))
    missing = F.greatest(-F.col("offset"), F.lit(0))
    equal = F.transform(
        "item", lambda word, k: F.coalesce(F.get("part", k - missing) == word, F.lit(False)).cast("int")
    )
    total = lambda values: F.aggregate(values, F.lit(0), lambda n, x: n + x)
    stretches = F.transform(F.sequence(F.lit(1), length - width + 1), lambda first: total(F.slice(equal, first, width)))
    measured = aligned.select(
        "id", "row", "item_id", "offset", length.alias("item_tokens"), width.alias("width"),
        total(equal).alias("matched"), F.array_max(stretches).alias("best_stretch"),
    )
    close = measured.where(F.col("best_stretch") >= F.col("width") * SIMILARITY)
    best = close.groupBy("id", "row", "item_id", "item_tokens").agg(
        F.max(F.struct("best_stretch", "matched", (-F.col("offset")).alias("back"))).alias("best")
    )
    return best.select(
        F.col("id").alias("doc_id"), "row", "item_id", F.col("item_tokens").cast("long").alias("item_tokens"),
        (-F.col("best.back")).cast("long").alias("offset"),
        F.col("best.matched").cast("long").alias("matched"),
        F.col("best.best_stretch").cast("long").alias("best_stretch"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", short_items: bool = False
) -> DataFrame:
    """``docs`` without the documents that :func:`contaminated` finds; columns and other rows stay as they are."""
    found = contaminated(docs, benchmark, id_column, text_column, short_items=short_items).select("doc_id", "row").distinct()
    row, key, own = (fresh(docs.columns, n) for n in ("row", "key", "own"))
    found = checked_broadcast(found.select(F.col("doc_id").alias(key), F.col("row").alias(own)))
    marked = docs.withColumn(row, F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))))
    clean = marked.join(found, F.col(id_column).eqNullSafe(F.col(key)) & (F.col(row) == F.col(own)), "left_anti")
    return clean.drop(row)
