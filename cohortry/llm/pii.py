"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds select.

For each kind a strict pattern with a validator gives the base spans, which always stay. Wider patterns propose
further, overlapping candidates (disguised addresses, local phone numbers, IPv6, unusual grouping). Candidates are
described by their format and their context. Trees learn from weak labels: base spans are personal data; strict
matches that fail their validator, and digits inside longer codes, are not. All labelled candidates count, as weights
of their distinct descriptions, in the trees, the calibration and the threshold. A candidate is added when its
calibrated probability reaches the threshold and it overlaps no base span.

Everything is built from Spark SQL functions and Spark ML; texts stay in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import identified, stored
from cohortry.session import checked_broadcast

KINDS = ("email", "ip", "card", "phone")

# Matches only begin at the start of a run, or where the last match ended, as leftmost matches do anyway; this and
# the possessive quantifiers keep long runs of one sign from being scanned again at every place.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./-]{1,2}[0-9]{3,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9(])\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{3,5}[\x20./-]{1,2}[0-9]{3,5}(?![0-9])",
}
CONTEXT = 24
# Words that announce a kind.
ANNOUNCE = {
    "email": "mail|write|contact|schreib|écri|correo",
    "ip": r"\bip\b|server|host|address|adresse|dirección",
    "card": "card|visa|master|amex|karte|carte|tarjeta|credit",
    "phone": r"phone|\btel|call|fax|mobil|handy|appel|llam",
}
KIND_WEIGHT = 5_000  # the candidates of a kind weigh this much together, at most
DESCRIPTIONS_A_TASK = 100_000
THRESHOLD = 0.95
TREES, DEPTH = 10, 3
FEATURES = (
    *(f"is_{k}" for k in KINDS), "length", "digits", "letters", "separators", "dots", "ats", "plus", "groups",
    "longest_group", "luhn", "octets", "before_word", "after_word", "before_quote", "after_quote", "announced",
)


def bound_to(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is evaluated once; a column named inside a lambda is evaluated for every element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def running_starts(lengths: Column) -> Column:
    """For each number of an array the sum of those before it, in blocks of the square root of its size.

    An array that grows by one element at a time is copied each time, so it is only ever grown to a block's length.
    """
    none = F.array().cast("array<int>")

    def starts(numbers: Column, first: Column) -> Column:
        return F.aggregate(
            numbers,
            F.struct(first.alias("at"), none.alias("starts")),
            lambda state, n: F.struct(
                (state["at"] + n).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts")
            ),
            lambda state: state["starts"],
        )

    def by_blocks(numbers: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(numbers))).cast("int")
        places = F.sequence(F.lit(0), F.ceil(F.size(numbers) / width).cast("int") - 1)
        blocks = F.transform(places, lambda k: F.slice(numbers, k * width + 1, width))
        return bound_to(
            blocks,
            lambda parts: F.flatten(
                F.zip_with(
                    parts,
                    starts(F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x)), F.lit(0)),
                    starts,
                )
            ),
        )

    return bound_to(lengths, lambda numbers: F.when(F.size(numbers) > 0, by_blocks(numbers)).otherwise(none))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match, before, after): all matches from the left, in characters, end exclusive.

    ``before`` is the end of what stands since the match before the last began, at most ``CONTEXT`` characters, and
    ``after`` the character that follows, or empty. Long arrays of matches take time in proportion to their size to
    the power of 1.5.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    whole = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def located(parts: Column) -> Column:
        # a step is a gap and the match behind it
        steps = F.transform(parts["found"], lambda m, k: F.length(F.get(parts["gaps"], k)) + F.length(m))
        ends = F.zip_with(running_starts(steps), steps, lambda start, length: start + length)

        def span(match: Column, k: Column, end: Column) -> Column:
            gap = F.get(parts["gaps"], k)
            last = F.when(k > 0, F.get(parts["found"], k - 1)).otherwise("")
            after = F.concat(F.get(parts["gaps"], k + 1), F.coalesce(F.get(parts["found"], k + 1), F.lit("")))
            return F.struct(
                (end - F.length(match)).alias("start"),
                end.alias("end"),
                match.alias("match"),
                F.right(F.concat(F.right(last, F.lit(CONTEXT)), F.right(gap, F.lit(CONTEXT))), F.lit(CONTEXT)).alias("before"),
                F.substring(after, 1, 1).alias("after"),
            )

        return bound_to(ends, lambda e: F.transform(parts["found"], lambda match, k: span(match, k, F.get(e, k))))

    return bound_to(whole, located)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The checksum rule: every second digit from the right doubled, the sum of digits divisible by ten."""
    places = F.sequence(F.lit(1), F.length(digits))
    digit = lambda place: F.substring(F.reverse(digits), place, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(
        places, F.lit(0), lambda n, place: n + F.when(place % 2 == 0, doubled(digit(place))).otherwise(digit(place))
    )
    return total % 10 == 0


def octets(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", ""))
    return F.forall(parts, lambda part: (F.length(part) <= 3) & (part.try_cast("int") <= 255))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda match: F.lit(True),
    "ip": octets,
    "card": lambda match: F.when(
        F.length(digits_of(match)).between(16, 19), luhn(digits_of(match))
    ).otherwise(False),
    "phone": lambda match: F.length(digits_of(match)).between(8, 15),
}


def strict_matches(text: Column, kind: str) -> Column:
    sign = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")
    return F.when(sign, matches(text, STRICT[kind])).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the strict matches that pass their validator, as (start, end, match)."""
    return {k: F.filter(strict_matches(text, k), lambda s: VALID[k](s["match"])) for k in KINDS}


def as_text(spans: Column) -> Column:
    """Comma-joined kind:start:end of an array of (kind number, start, end), which gives the order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )


def candidates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, row, kind, start, end, wide, label, features...): all proposed spans; label 1, 0 or null where unknown."""
    texts = identified(docs, id_column, text_column).where(F.col("text").rlike(r"[0-9@]|\[at\]|\(at\)"))
    proposed = []
    for number, kind in enumerate(KINDS):
        strict = strict_matches(F.col("text"), kind)
        for source, spans in (("strict", strict), ("wide", matches(F.col("text"), WIDE[kind]))):
            proposed.append(
                F.transform(
                    spans,
                    lambda s: F.struct(
                        F.lit(number).alias("kind"),
                        s["start"].alias("start"),
                        s["end"].alias("end"),
                        s["match"].alias("match"),
                        s["before"].alias("before"),
                        s["after"].alias("after"),
                        (VALID[kind](s["match"]) if source == "strict" else F.lit(None).cast("boolean")).alias("valid"),
                    ),
                )
            )
    # texts stay behind: only spans with their surroundings become rows
    rows = texts.select("id", "row", F.explode(F.concat(*proposed)).alias("c")).select("id", "row", "c.*")
    plain = F.regexp_replace(F.regexp_replace("match", r"[\[(]at[\])]", "@"), r"[\[(]dot[\])]", ".")
    digits = digits_of(F.col("match"))
    count = lambda pattern: F.regexp_count(plain, F.lit(pattern))
    last = F.substring("before", -1, 1)
    values = {
        **{f"is_{k}": F.col("kind") == number for number, k in enumerate(KINDS)},
        "length": F.length("match"),
        "digits": F.length(digits),
        "letters": count("[A-Za-z]"),
        "separators": count(r"[\x20()/-]"),
        "dots": count(r"\."),
        "ats": count("@"),
        "plus": F.startswith("match", F.lit("+")),
        "groups": count("[0-9]+"),
        "longest_group": F.coalesce(
            F.array_max(F.transform(F.regexp_extract_all(plain, F.lit("[0-9]+"), F.lit(0)), F.length)), F.lit(0)
        ),
        "luhn": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False),
        "octets": F.when(F.col("match").rlike(r"^[0-9]+(\.[0-9]+){3}$"), octets(F.col("match"))).otherwise(False),
        "before_word": last.rlike(r"[\p{L}\p{N}_]"),
        "after_word": F.col("after").rlike(r"[\p{L}\p{N}_]"),
        "before_quote": last.rlike("[\"'=/]"),
        "after_quote": F.col("after").rlike("[\"'=/@]"),
        "announced": F.coalesce(
            *(F.when(F.col("kind") == n, F.lower("before").rlike(ANNOUNCE[k])) for n, k in enumerate(KINDS))
        ),
    }
    described = rows.select("*", *(values[f].cast("double").alias(f) for f in FEATURES))
    inside = (F.col("before_word") + F.col("after_word") + F.col("before_quote") + F.col("after_quote")) > 0
    label = F.when(F.col("valid").isNotNull(), F.col("valid").cast("double")).when(inside, F.lit(0.0))
    wide = F.col("valid").isNull().alias("wide")
    return described.select("id", "row", "kind", "start", "end", wide, label.alias("label"), *FEATURES)


@dataclass
class SpanModel:
    """Trees and the raw probability from which the calibrated one reaches the threshold; none: nothing is added."""

    trees: object = None
    least_raw: float = 1.0

    def select(self, proposed: DataFrame) -> DataFrame:
        """(id, row, kind, start, end) of the wide candidates that the trees accept, whatever stands next to them."""
        free = proposed.where("wide")
        if self.trees is None:
            return free.where(F.lit(False)).select("id", "row", "kind", "start", "end")
        scored = self.trees.transform(_vectors(free)).withColumn("raw", vector_to_array("probability")[1])
        return scored.where(F.col("raw") >= self.least_raw).select("id", "row", "kind", "start", "end")


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows)


def counted(proposed: DataFrame) -> DataFrame:
    """(kind, label, features..., learn, judge): the distinct descriptions of all labelled candidates and their numbers.

    A third of the candidates, by a hash of their place, is for judging. Features are flags and small numbers, so
    there are far fewer descriptions than candidates.
    """
    order = F.xxhash64("id", "row", "kind", "start", "end")
    judging = F.pmod(F.xxhash64(order), F.lit(3)) == 0
    labelled = proposed.where(F.col("label").isNotNull())
    numbers = F.count_if(~judging).alias("learn"), F.count_if(judging).alias("judge")
    return labelled.groupBy("kind", "label", *FEATURES).agg(*numbers)


def kind_scales(numbers: list[int]) -> list[float]:
    """For each kind the weight of a candidate: frequent kinds are halved until they weigh ``KIND_WEIGHT`` at most.

    So frequent numbers do not crowd out the rest. Powers of two keep sums of weights exact.
    """
    return [2.0 ** -max(0, math.ceil(math.log2(max(n, 1) / KIND_WEIGHT))) for n in numbers]


def fit(proposed: DataFrame, threshold: float = THRESHOLD) -> SpanModel:
    """Trees on two thirds of the labelled candidates, isotonic calibration on the rest; all of them count.

    Without candidates of both labels in both parts, or where no probability reaches the threshold, nothing is added.
    """
    rows = stored(counted(proposed), "candidates")
    sums = F.sum("learn").alias("learn"), F.sum("judge").alias("judge"), F.count(F.lit(1)).alias("rows")
    found = rows.groupBy("kind", "label").agg(*sums).collect()
    if len({(part, r["label"]) for r in found for part in ("learn", "judge") if r[part]}) < 4:
        return SpanModel()
    scales = kind_scales([sum(r["learn"] for r in found if r["kind"] == number) for number in range(len(KINDS))])
    scale = F.get(F.array(*map(F.lit, scales)), F.col("kind"))
    size = sum(r["rows"] for r in found)
    rows = rows.coalesce(1 + size // DESCRIPTIONS_A_TASK).sortWithinPartitions("label", *FEATURES)
    learn, judge = (_vectors(rows.where(F.col(n) > 0).withColumn("weight", F.col(n) * scale)) for n in ("learn", "judge"))
    # beyond 10,000 rows and the square of its bins Spark would draw rows for the places of the splits
    bins = max(32, math.isqrt(size) + 1)
    trainer = GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", maxBins=bins,
        maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7,
    )
    trees = trainer.fit(learn)
    judged = trees.transform(judge).select(vector_to_array("probability")[1].alias("raw"), "label", "weight")
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(judged)
    reached = [x for x, y in zip(curve.boundaries.toArray(), curve.predictions.toArray(), strict=True) if y >= threshold]
    return SpanModel(trees, float(min(reached))) if reached else SpanModel()


def apart(added: DataFrame, base: DataFrame) -> DataFrame:
    """The spans (id, row, kind, start, end) of ``added`` that overlap none of ``base``, nor an earlier one of their kind.

    Of overlapping additions of one kind the first and then the longest stays. Spans are sorted, and running bounds
    over the spans of one text tell what overlaps.
    """
    cols = ["id", "row", "kind", "start", "end"]
    fixed = base.select(*cols, F.lit(True).alias("fixed")).join(added.select("row").distinct(), "row", "left_semi").select(*cols, "fixed")
    spans = added.select(*cols, F.lit(False).alias("fixed")).unionByName(fixed)
    text = Window.partitionBy("id", "row")
    reached = F.max(F.when(F.col("fixed"), F.col("end"))).over(text.orderBy("start"))
    following = F.min(F.when(F.col("fixed"), F.col("start"))).over(text.orderBy(F.desc("start")))
    clear = spans.withColumn("reached", reached).withColumn("following", following).where(~F.col("fixed"))
    clear = clear.where(
        (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("following", F.col("end")) >= F.col("end"))
    )
    earlier = Window.partitionBy("id", "row", "kind").orderBy("start", F.desc("end"))
    taken = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    return clear.withColumn("taken", taken).where(F.coalesce("taken", F.lit(0)) <= F.col("start")).select(*cols)


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, row, text, base, spans, n_email, n_ip, n_card, n_phone) for every row of ``docs``.

    ``base`` and ``spans`` are arrays of (kind, start, end): kinds count from 0 in the order of ``KINDS``, places are
    code points, the end is exclusive; ``spans`` holds the base and what the trees add. The counts are of base spans.
    Null texts are empty and have none. Repeated rows keep their count; rows with one id and different texts are
    told apart by ``row``, a hash of the text. Null ids are kept. Further columns are ignored. An empty table gives
    no rows, and without labelled candidates of both kinds nothing is added to the base.
    """
    proposed = stored(candidates(docs, id_column, text_column), "candidates")
    added = fit(proposed).select(proposed).distinct()
    added = apart(added, proposed.where(~F.col("wide") & (F.col("label") == 1)))
    added = added.groupBy("id", "row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    added = checked_broadcast(added)
    texts = identified(docs, id_column, text_column)
    found = texts.select("id", "row", "text", *(v.alias(f"n_{k}") for k, v in base_spans(F.col("text")).items()))
    numbered = F.concat(
        *(
            F.transform(f"n_{k}", lambda s: F.struct(F.lit(n).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
            for n, k in enumerate(KINDS)
        )
    )
    found = found.select(
        "id", "row", "text", numbered.alias("base"), *(F.size(f"n_{k}").cast("long").alias(f"n_{k}") for k in KINDS)
    )
    same = found["id"].eqNullSafe(added["id"]) & (found["row"] == added["row"])
    joined = found.join(added, same, "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    spans = F.concat("base", F.coalesce("added", none))
    return joined.select(found["id"].alias("doc_id"), found["row"], "text", "base", spans.alias("spans"), *(f"n_{k}" for k in KINDS))


def redacted(found: DataFrame) -> DataFrame:
    """(doc_id, row, text) with every span of :func:`personal_data` replaced by its kind in brackets."""
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    pieces = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda state, s: F.when(
            s["start"] >= state["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    state["done"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"])
                ).alias("done"),
            ),
        ).otherwise(F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["done"].alias("done"))),
        lambda state: F.concat(state["done"], F.substring(F.col("text"), state["at"] + 1, F.length("text"))),
    )
    return found.select("doc_id", "row", F.when(F.size("spans") > 0, pieces).otherwise(F.col("text")).alias("text"))
