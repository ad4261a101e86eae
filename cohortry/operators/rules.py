"""Ordered rule cascades.  Rules are data: a list of (condition, value) pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.nulls import ColumnLike, as_column, as_value, matches

Rule = tuple[Column, object]


def cascade(rules: Sequence[Rule], default) -> Column:
    """The last rule that is not false decides; a NULL condition there gives NULL.

    Applying rules one after another, each overwriting the earlier result, is the same
    as testing them from the last to the first, so one ``CASE`` is enough.
    """
    if not rules:
        return as_value(default)
    result = None
    for condition, value in reversed(list(rules)):
        unknown = condition.isNull()
        result = F.when(unknown, F.lit(None)) if result is None else result.when(unknown, F.lit(None))
        result = result.when(condition, as_value(value))
    return result.otherwise(as_value(default))


def rule_cascade(df: DataFrame, out: str, rules: Sequence[Rule], default) -> DataFrame:
    """Add the class given by an ordered cascade."""
    return df.withColumn(out, cascade(rules, default))


_BITS = 63  # rules in one mask: the bits of a long without its sign


def rule_coverage(df: DataFrame, rules: Sequence[Rule], default, line: str = "rule") -> DataFrame:
    """What each rule of a cascade does: (rule, value, hits, unknown, decided, erased, shadowed), rules from 1.

    ``hits`` and ``unknown`` count the rows whose condition is true or NULL. The last rule that is not false decides a
    row: it gives its value (``decided``) or erases the class (``erased``). ``shadowed`` are hits that a later rule
    overwrites. Rule 0 is the default; it decides the rows on which all rules are false. Decided and erased rows add
    up to the table.

    One projection turns the conditions of a row into masks of true and of unknown rules. Rows are counted by mask,
    combined on the map side, so what is expanded to one row per rule are the distinct situations, not the rows.
    """
    rules = list(rules)
    words = [rules[at : at + _BITS] for at in range(0, len(rules), _BITS)]
    masks = {}
    for w, word in enumerate(words):
        bits = [(F.lit(1 << k).cast("long"), condition) for k, (condition, _) in enumerate(word)]
        zero = F.lit(0).cast("long")
        masks[f"__true{w}"] = reduce(Column.bitwiseOR, (F.when(c, bit).otherwise(zero) for bit, c in bits), zero)
        masks[f"__unknown{w}"] = reduce(Column.bitwiseOR, (F.when(c.isNull(), bit).otherwise(zero) for bit, c in bits), zero)
    situations = df.select(*(m.alias(n) for n, m in masks.items())).groupBy(*masks).agg(F.count(F.lit(1)).alias("__n"))

    not_false = [F.col(f"__true{w}").bitwiseOR(F.col(f"__unknown{w}")) for w in range(len(words))]
    entries = []
    for number in range(len(rules) + 1):
        w, k = divmod(number - 1, _BITS) if number else (0, -1)
        # nothing above this rule's bit, in its word and in those after it
        later = [F.shiftright(not_false[w], k + 1) != 0] if words else []
        later += [m != 0 for m in not_false[w + 1 :]]
        last = ~reduce(Column.__or__, later, F.lit(False))
        if number:
            holds, missing = (F.shiftright(F.col(f"__{m}{w}"), k).bitwiseAND(F.lit(1)) == 1 for m in ("true", "unknown"))
        else:
            holds, missing = F.lit(True), F.lit(False)
        flags = {"hits": holds, "unknown": missing, "decided": holds & last, "erased": missing & last}
        entries.append(F.struct(F.lit(number).alias(line), *(f.alias(n) for n, f in flags.items())))
    counts = ("hits", "unknown", "decided", "erased")
    per_rule = situations.select("__n", F.explode(F.array(*entries)).alias("__r")).select("__n", "__r.*")
    summed = per_rule.groupBy(line).agg(*(F.sum(F.when(F.col(c), F.col("__n")).otherwise(0)).alias(c) for c in counts))
    names = [(0, None if default is None else str(default)), *((k, str(v)) for k, (_, v) in enumerate(rules, 1))]
    listed = df.sparkSession.createDataFrame(names, f"{line} int, value string")
    covered = listed.join(F.broadcast(summed), line, "left").fillna(0, list(counts))  # one row per rule on both sides
    return covered.withColumn("shadowed", F.col("hits") - F.col("decided")).orderBy(line)


def refine_class(
    df: DataFrame, class_col: str, broad: str, detail: ColumnLike, parts: Mapping[str, str], out: str
) -> DataFrame:
    """Split one broad class by words in a detail text; all other rows keep their class.

    ``parts`` maps a word to the refined class.  The first listed word found decides.
    """
    text = as_column(detail)
    current = F.col(class_col)
    refined = F.when(current.isNull(), current)
    for word, name in parts.items():
        refined = refined.when((current == broad) & matches(text, word), F.lit(name))
    return df.withColumn(out, refined.otherwise(current))


def propose_mechanism(
    df: DataFrame,
    out: str,
    instability: ColumnLike,
    instability_cutoff: ColumnLike | float,
    repair_share: ColumnLike,
    editing_share: ColumnLike,
    polymerase_share: ColumnLike,
    share_cutoff: float = 0.5,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Explain outlier rows by their dominant process; the last rule that holds wins."""
    names = labels or MECHANISMS
    rules = mechanism_rules(
        instability, instability_cutoff, repair_share, editing_share, polymerase_share, share_cutoff, names
    )
    return rule_cascade(df, out, rules, names["unknown"])


def mechanism_rules(
    instability: ColumnLike,
    instability_cutoff: ColumnLike | float,
    repair_share: ColumnLike,
    editing_share: ColumnLike,
    polymerase_share: ColumnLike,
    share_cutoff: float = 0.5,
    labels: Mapping[str, str] | None = None,
) -> list[Rule]:
    """The rules of ``propose_mechanism``, in order."""
    names = labels or MECHANISMS
    cutoff = as_value(instability_cutoff)
    return [
        (
            (as_column(instability) >= cutoff) & (as_column(repair_share) >= share_cutoff),
            names["instability"],
        ),
        (as_column(editing_share) >= share_cutoff, names["editing"]),
        (as_column(polymerase_share) >= share_cutoff, names["polymerase"]),
    ]


# Names of the proposed mechanisms.
MECHANISMS = {
    "instability": "MSI High",
    "editing": "APOBEC Mutation",
    "polymerase": "POLE Mutation",
    "unknown": "Unknown Significance",
    "not_outlier": "nonhypermutated tumor",
}
