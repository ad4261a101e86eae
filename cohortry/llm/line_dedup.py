"""Removal of repeated passages: overlapping windows of three lines, compared over the whole corpus.

Every three consecutive lines are a window. Windows are compared by a 128-bit hash; all but the first occurrence of
a window, in order of id and place, mark their lines, and marked stretches are merged before they are cut out. Only
hashes and places are shuffled for the search; texts move at most once, to meet their cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import fresh, identified, stored
from cohortry.session import checked_broadcast

WINDOW_LINES = 3


def windows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, row, at, w1, w2): each window with its first line's number and its hash; blank windows are left out."""
    lines = identified(docs, id_column, text_column).select("id", "row", F.split("text", "\n").alias("lines"))
    lines = lines.where(F.size("lines") >= WINDOW_LINES)
    placed = lines.select(
        "id", "row", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - WINDOW_LINES)).alias("at")
    )
    three = [F.get("lines", F.col("at") + k) for k in range(WINDOW_LINES)]
    placed = placed.where(F.trim(F.concat(*three)) != "")
    return placed.select(
        "id", "row", "at", F.xxhash64(*three).alias("w1"), F.xxhash64(F.lit(1), *three).alias("w2")
    )


def cuts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, row, cuts): for documents that lose lines, the merged stretches of line numbers, both ends included."""
    found = stored(windows(docs, id_column, text_column), "windows")
    place = F.struct("id", "row", "at")
    repeated = found.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = repeated.where(F.col("n") > 1).drop("n")
    later = found.join(repeated, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
    later = later.select("id", "row", "at").distinct()
    # one document's lines at a time: a stretch begins where the window before does not reach
    order = Window.partitionBy("id", "row").orderBy("at")
    begins = F.coalesce(F.col("at") > F.lag("at").over(order) + WINDOW_LINES, F.lit(True)).cast("int")
    numbered = later.withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(order))
    merged = numbered.groupBy("id", "row", "stretch").agg(
        F.min("at").alias("first"), (F.max("at") + WINDOW_LINES - 1).alias("last")
    )
    return merged.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts"))


def remove_repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    total: str = "n_lines",
    removed: str = "n_removed",
) -> DataFrame:
    """``docs`` with later occurrences of three-line passages cut from the text, and two counts of lines added.

    Lines end at \\n and are compared as they are. Shorter texts have no window and stay as they are; windows of
    blank lines are never repeats. A null text is empty and stays null. Rows that agree in id and text are one
    document and get the same result; rows with one id and different texts are ordered by a hash of the text, a null
    id comes first. A window that overlaps its own repeat (a line four times over) loses the lines of the later one,
    like any other. Nothing is kept back: a text may become empty. ``docs`` may have further columns, also of the
    names used here: they are kept, and a taken name for a count gets an underscore. An empty table stays empty.
    """
    names = list(docs.columns)
    row, key, own, stretches = (fresh([*names, total, removed], n) for n in ("row", "key", "own", "cuts"))
    found = checked_broadcast(cuts(docs, id_column, text_column))
    found = found.select(F.col("id").alias(key), F.col("row").alias(own), F.col("cuts").alias(stretches))
    marked = docs.withColumn(row, F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))))
    joined = marked.join(found, F.col(id_column).eqNullSafe(F.col(key)) & (F.col(row) == F.col(own)), "left")
    lines = F.split(text_column, "\n")
    cut, size = F.col(stretches), F.size(lines)

    def between(k):
        """The lines after cut k - 1 and before cut k, cuts counted from 0."""
        start = F.when(k > 0, F.get(cut, k - 1)["last"] + 1).otherwise(0)
        end = F.when(k < F.size(cut), F.get(cut, k)["first"]).otherwise(size)
        return F.slice(lines, start + 1, end - start)

    lost = F.aggregate(stretches, F.lit(0), lambda n, c: n + c["last"] - c["first"] + 1)
    text = F.when(F.col(stretches).isNull(), F.col(text_column)).otherwise(
        F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), between)), "\n")
    )
    total_name = fresh(names, total)
    counts = {
        total_name: F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        fresh([*names, total_name], removed): F.coalesce(lost, F.lit(0)).cast("long"),
    }
    kept = [text.alias(c) if c == text_column else F.col(f"`{c}`") for c in names]
    return joined.select(*kept, *(v.alias(k) for k, v in counts.items()))


def with_lines_removed(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n_chars: str | None = None
) -> DataFrame:
    """``docs`` with the cut texts and its own columns only; the column ``n_chars``, if named, counts the new text."""
    cut = remove_repeated_lines(docs, id_column, text_column)
    kept = [F.length(text_column).cast(docs.schema[c].dataType).alias(c) if c == n_chars else F.col(f"`{c}`") for c in docs.columns]
    return cut.select(*kept)
