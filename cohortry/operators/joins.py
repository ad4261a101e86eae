"""Equality, containment and first-match joins, and feature assembly.

Strategy is left to Catalyst and AQE except where one side is a per-group aggregate or
a lookup: those are broadcast only after their size has been measured.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nulls import ColumnLike, as_column
from cohortry.session import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, checked_broadcast, materialise


def _keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def equi_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Many-to-many join with one output column per key.

    ``null_safe`` lets NULL keys match each other, as data-frame joins do.
    """
    keys = _keys(on)
    if not null_safe:
        return left.join(right, keys, how)
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__right_{k}"]) for k in keys]
    )
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("right", "full", "full_outer", "outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__right_{k}")) for k in keys})
    return joined.drop(*(f"__right_{k}" for k in keys))


def inner_join(left, right, on, null_safe: bool = False) -> DataFrame:
    return equi_join(left, right, on, "inner", null_safe)


def left_join(left, right, on, defaults: Mapping[str, object] | None = None, null_safe: bool = False) -> DataFrame:
    """Keep every left row; columns in ``defaults`` get their value where nothing matched."""
    joined = equi_join(left, right, on, "left", null_safe)
    return joined.fillna(dict(defaults)) if defaults else joined


def natural_left_join(left: DataFrame, right: DataFrame, null_safe: bool = False) -> DataFrame:
    """Left join on every shared column name."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column name")
    return equi_join(left, right, shared, "left", null_safe)


def full_outer_join(left, right, on, null_safe: bool = False) -> DataFrame:
    """Full outer join with the key taken from whichever side has it."""
    return equi_join(left, right, on, "full_outer", null_safe)


def semi_join(left: DataFrame, right: DataFrame, on, null_safe: bool = False) -> DataFrame:
    """Left rows whose key exists on the right; a NULL key exists there only if ``null_safe``."""
    return equi_join(left, right.select(*_keys(on)), on, "left_semi", null_safe)


def anti_join(left: DataFrame, right: DataFrame, on, null_safe: bool = False) -> DataFrame:
    """Left rows whose key does not exist on the right.

    Rows with a NULL key stay, unless ``null_safe`` lets them match a NULL key on the right.
    """
    return equi_join(left, right.select(*_keys(on)), on, "left_anti", null_safe)


def join_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Join on differently named keys, keeping the left name only."""
    return left.join(right.withColumnRenamed(right_key, left_key), left_key, how)


def assert_unique(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise when its key repeats (runs one aggregation)."""
    keys = _keys(key)
    repeated = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"key {keys} is not unique, e.g. {repeated[0].asDict()}")
    return df


GRAM_LENGTHS = (8, 4, 2, 1)  # an id is looked for by grams of the longest of these that it holds
CHUNK_CHARS = 1 << 16


def _grams(text: Column, length: int) -> Column:
    """All overlapping substrings of one length, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def _chunks(text: Column) -> Column:
    """A long text in overlapping parts, so that the grams of one part are what a task holds."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(CHUNK_CHARS))
    return F.transform(starts, lambda at: F.substring(text, at, F.lit(CHUNK_CHARS + GRAM_LENGTHS[0] - 1)))


def _anchored(ids: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash of a text) pairs among which all containments are; to be verified against the texts."""
    text, size = F.col(text_col), F.length("__id")
    wanted = ids.select(F.col(id_col).alias("__id")).where(F.col(id_col).isNotNull()).distinct()
    own = F.array(F.lit(""))  # an empty id
    for n in GRAM_LENGTHS[::-1]:
        own = F.when(size >= n, F.array_distinct(_grams(F.col("__id"), n))).otherwise(own)
    id_grams = materialise(wanted.select("__id", F.explode(own).alias("__gram")))
    known = id_grams.select("__gram").distinct()
    bytes_of = F.sum(F.octet_length("__gram") + 32)
    sizes = known.agg(F.count(F.lit(1)).alias("n"), bytes_of.alias("b"), F.collect_set(F.length("__gram")).alias("lengths")).first()
    if sizes["n"] <= BROADCAST_MAX_ROWS and (sizes["b"] or 0) <= BROADCAST_MAX_BYTES:
        known = F.broadcast(known)

    # at most five gram lengths; the empty gram stands in every text
    held = F.concat(*(_grams(F.col("__part"), n) for n in sizes["lengths"] if n), F.array(F.lit("")))
    every = texts.select(text_col).where(text.isNotNull()).distinct()
    parts = every.select(F.xxhash64(text).alias("__text"), F.explode(_chunks(text)).alias("__part"))
    text_grams = parts.select("__text", F.explode(F.array_distinct(held)).alias("__gram"))
    index = text_grams.join(known, "__gram", "left_semi").distinct()
    frequency = index.groupBy("__gram").agg(F.count(F.lit(1)).alias("__texts"))
    ranked = id_grams.join(frequency, "__gram", "left")
    rarest = F.min(F.struct(F.coalesce("__texts", F.lit(0)).alias("texts"), F.col("__gram").alias("gram")))
    anchors = ranked.groupBy("__id").agg(rarest.alias("__anchor")).where(F.col("__anchor.texts") > 0)
    return index.join(anchors.select("__id", F.col("__anchor.gram").alias("__gram")), "__gram").select("__id", "__text")


def _verified(texts: DataFrame, candidates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``texts`` with every id that their text contains; equal hashes only add comparisons."""
    marked = texts.withColumn("__text", F.xxhash64(F.col(text_col))).where(F.col(text_col).isNotNull())
    met = marked.join(candidates, "__text").where(F.col(text_col).contains(F.col("__id")))
    return met.drop("__text").withColumnRenamed("__id", id_col)


def contained_pairs(ids: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (id, text) pairs where the text contains the id.

    Every id is represented by one anchor, the gram of it that the fewest texts hold. Texts are cut into grams of at
    most four lengths, whatever lengths ids have, and only grams that some id has are kept; their counts over the
    texts are the index that chooses the anchors. An id with a gram that no text holds is left out. Texts that hold an
    anchor are compared with its ids. The rows grow with the characters of the distinct texts, and the comparisons
    with the texts per rarest gram. NULL ids and texts match nothing; an empty id is contained in every text.
    """
    candidates = _anchored(ids, texts, id_col, text_col)
    return _verified(texts.select(text_col).distinct(), candidates, id_col, text_col).select(id_col, text_col)


def contains_join(
    ids: DataFrame, events: DataFrame, id_col: str, text_col: str, match: str = "contains"
) -> DataFrame:
    """For every distinct id, the event rows whose text contains (or equals) the id.

    With ``contains`` the event rows are written once, as both the index of their texts and the join read them; a
    filter or join behind ``events`` then runs once.
    """
    if match == "exact":
        wanted = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()
        return events.join(wanted.withColumn(text_col, F.col(id_col)), text_col)
    if match != "contains":
        raise ValueError("match must be 'contains' or 'exact'")
    events = materialise(events)
    return _verified(events, _anchored(ids, events, id_col, text_col), id_col, text_col)


def first_match(dim: DataFrame, key: str, order: ColumnLike | Sequence[ColumnLike], values: Sequence[str]) -> DataFrame:
    """One row per key: the values of its first row in the given order.

    A map-side combined minimum over (order, values), so a key with very many rows
    never sits in one task.
    """
    orders = list(order) if isinstance(order, (list, tuple)) else [order]
    fields = []
    for i, c in enumerate(orders):
        fields += [as_column(c).isNull().alias(f"n{i}"), as_column(c).alias(f"o{i}")]
    fields += [F.col(v).alias(f"v{i}") for i, v in enumerate(values)]
    sort_key = F.struct(*fields)
    return (
        dim.groupBy(key)
        .agg(F.min(sort_key).alias("__first"))
        .select(key, *(F.col(f"__first.v{i}").alias(v) for i, v in enumerate(values)))
    )


def first_match_lookup(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    order: ColumnLike | Sequence[ColumnLike],
    values: Sequence[str],
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Attach the values of the first dimension row with the same key, else NULL or a default."""
    return left_join(df, first_match(dim, key, order, values), key, defaults)


def map_ids(
    df: DataFrame,
    mapping: DataFrame,
    id_col: str,
    source_col: str,
    target_col: str,
    out: str,
    rewrite: tuple[str, str] | None = None,
    drop_unmatched: bool = True,
) -> DataFrame:
    """Replace ids through a mapping whose source id contains ours.

    The first mapped id in (source, target) order is taken and a text rewrite applied.
    """
    pairs = contained_pairs(df, mapping, id_col, source_col)
    candidates = mapping.select(source_col, target_col).join(pairs, source_col)
    chosen = first_match(candidates, id_col, [F.col(source_col), F.col(target_col)], [target_col])
    target = F.col(target_col)
    if rewrite:
        target = F.replace(target, F.lit(rewrite[0]), F.lit(rewrite[1]))
    chosen = chosen.select(id_col, target.alias(out))
    if drop_unmatched:
        return df.join(chosen.where(F.col(out).isNotNull()), id_col)
    return df.join(chosen, id_col, "left")


def convert_ids(
    df: DataFrame,
    mapping: DataFrame,
    id_col: str,
    source_col: str,
    target_col: str,
    out: str,
    order: Sequence[ColumnLike],
    suffix_rewrite: tuple[str, str],
    mapped_marker: str,
) -> DataFrame:
    """Two id forms: one is rewritten in place, the other looked up; anything else gives NULL."""
    dim = mapping.select(F.col(source_col).alias(id_col), F.col(target_col).alias("__mapped"), *order)
    looked_up = first_match_lookup(df, dim, id_col, order, ["__mapped"])
    old, new = suffix_rewrite
    converted = F.when(
        F.col(id_col).contains(old), F.replace(F.col(id_col), F.lit(old), F.lit(new))
    ).when(F.col(id_col).contains(mapped_marker), F.col("__mapped"))
    return looked_up.withColumn(out, converted).drop("__mapped")


def assemble_features(base: DataFrame, tables: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Fold of inner joins: keeps the entities that have every feature.

    All joins share one key, so the running result is shuffled once.
    """
    return reduce(lambda left, right: left.join(right, _keys(on), "inner"), tables, base)


def assembly_report(base: DataFrame, tables: Mapping[str, DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Entities kept after each step of ``assemble_features`` (one row per step)."""
    keys = _keys(on)
    marked = base.select(*keys).distinct()
    for name, table in tables.items():
        present = table.select(*keys).distinct().withColumn(f"__has_{name}", F.lit(True))
        marked = marked.join(present, keys, "left")
    kept = F.lit(True)
    counts = [F.count(F.lit(1)).alias("base")]
    for name in tables:
        kept = kept & F.coalesce(F.col(f"__has_{name}"), F.lit(False))
        counts.append(F.count_if(kept).alias(name))
    steps = ["base", *tables]
    return marked.agg(*counts).unpivot([], steps, "step", "entities")


def score_lookup(df: DataFrame, scores: DataFrame, on: str) -> DataFrame:
    """Attach per-entity scores; entities without a row get NULL and keep their place."""
    return df.join(scores, on, "left")


def attach_aggregate(
    df: DataFrame, aggregate: DataFrame, on: str | Sequence[str], null_safe: bool = True
) -> DataFrame:
    """Attach a per-group aggregate to every row of its group (size-checked broadcast)."""
    return equi_join(df, checked_broadcast(aggregate), on, "left", null_safe)
