import hashlib
import random
import re
import time

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortry.llm import pii

# the definition of the base, as Python patterns
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    doubled = [int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(digits))]
    return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def spans(row):
    return {(pii.KINDS[s.kind], s.start, s.end) for s in row}


def test_base_equals_the_definition(rows):
    texts = [
        "a.b@c.d_x@e.fr, x@y, @a.b a@b.c@d.e", "1.2.3.4 1.2.3.4.5 256.1.1.1 000255.0.0.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (255) 555-8013 +12 34 +1 (2) 3 +49 30 901820 x +1 1 +1", "ü𝄞 4111111111111111 é a@b.co", "", None, "no data",
        "+" * 50 + "1" * 30, "a" * 100_000 + "@b.cc", "1 " * 40_000 + "12.13.14.15", ("4111111111111111" + " x ") * 800,
        "a@" + "b." * 30_000 + "c",
    ]
    docs = rows("doc_id long, text string, row int, base string", *((k, t, 0, "x") for k, t in enumerate(texts)))
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for k, text in enumerate(texts):
        assert spans(got[k].base) == set(base(text)), text and text[:60]
        assert spans(got[k].spans) >= spans(got[k].base)
        assert got[k].n_card == sum(s[0] == "card" for s in base(text))


def test_base_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.personal_data(docs).withColumn("digest", F.sha2(pii.as_text(F.col("base")).cast("binary"), 256))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found.collect():
        listed = ",".join(f"{k}:{a}:{z}" for k, a, z in base(texts[r.doc_id]))
        assert hashlib.sha256(listed.encode()).hexdigest() == r.digest


def test_trees_add_disguised_spans_and_leave_codes(rows):
    data = []
    for k in range(240):
        data.append((k, f"write to user{k}@mail{k % 9}.example.com or call +1 (2{k % 90:02d}) 555-{1000 + k} today"))
        data.append((1000 + k, f'token = "{k}a4059f{k}77 {300 + k}.1.2.{k}" version 9{k}.300.{k}.2 code{k}12 3{k}x'))
        data.append((2000 + k, f"card 4111 1111 1111 1111, order 4111 1111 1111 1{112 + k % 3}"))
    data.append((5000, "contact me: some.name [at] mail.example [dot] com please"))
    found = {r.doc_id: r for r in pii.personal_data(rows("doc_id long, text string", *data)).collect()}
    texts = dict(data)
    assert all(spans(found[k].base) == set(base(texts[k])) for k in texts)
    assert any(s[0] == "email" for s in spans(found[5000].spans))
    assert all(found[1000 + k].spans == found[1000 + k].base for k in range(240))
    clean = {r.doc_id: r.text for r in pii.redacted(pii.personal_data(rows("doc_id long, text string", *data))).collect()}
    assert clean[3] == "write to [email] or call [phone] today"
    assert "@" not in clean[3] and "[card]" in clean[2003]


def test_long_lists_of_matches(rows):
    """100,000 addresses in one text, with other kinds between them."""
    parts = [f"u{k}@m{k % 9}.example.org, 10.{k % 256}.0.{k % 300} é" for k in range(100_000)]
    text = " ".join(parts)
    begin = time.perf_counter()
    (got,) = pii.personal_data(rows("doc_id long, text string", (1, text))).collect()
    assert time.perf_counter() - begin < 60
    assert spans(got.base) == set(base(text)) and got.n_email == 100_000


def test_places_and_surroundings(rows):
    texts = ["", "x", "a1b22c", "1", "12 3", "ü𝄞1é2𝄞" * 40, "9" * 3 + " y" * 50 + "8"]
    found = rows("k int, text string", *enumerate(texts)).select("k", pii.matches(F.col("text"), "[0-9]+").alias("m")).collect()
    for r in found:
        text, want, last = texts[r.k], [], 0
        for m in re.finditer("[0-9]+", text):
            want.append((m.start(), m.end(), m.group(), text[max(last, m.start() - pii.CONTEXT) : m.start()], text[m.end() : m.end() + 1]))
            last = m.start()
        assert [tuple(x) for x in r.m] == want


def test_overlaps_equal_all_comparisons(rows):
    rng = random.Random(5)
    draw = lambda n: {(rng.randrange(3), 0, rng.randrange(4), a := rng.randrange(60), a + rng.randint(1, 6)) for _ in range(n)}
    fixed, added = draw(12), draw(60)
    meet = lambda s, o: s[0] == o[0] and s[3] < o[4] and o[3] < s[4]
    clear = [s for s in added if not any(meet(s, o) for o in fixed)]
    first = lambda o, s: (o[3], -o[4]) < (s[3], -s[4])
    want = {s for s in clear if not any(o[2] == s[2] and meet(s, o) and first(o, s) for o in clear)}
    schema = "id long, row long, kind int, start int, end int"
    assert {tuple(r) for r in pii.apart(rows(schema, *added), rows(schema, *fixed)).collect()} == want
    assert len(want) > 5


def test_wide_candidates_beside_quotes_are_judged(rows):
    texts = [(1, 'mail "jo.doe [at] mail.example [dot] com" x'), (2, "tel=030 1234 5678"), (3, "+49 30 1234567")]
    proposed = pii.candidates(rows("doc_id long, text string", *texts), "doc_id", "text")
    wide = {(r.id, pii.KINDS[r.kind]): r.label for r in proposed.where("wide").collect()}
    assert wide[(1, "email")] == 0.0 and wide[(2, "phone")] == 0.0  # labels for learning only


def drawn_apart(spark, n, late):
    """``n`` labelled phone candidates; those named by ``late`` come last in the order of a hash, behind 25,000 others.

    Early ones are personal data if a plus sign begins them. Late ones have it too, stand before a quote and are not.
    """
    place = F.xxhash64("id", "row", "kind", "start", "end")
    plain = spark.range(n).select(
        "id", F.lit(0).alias("row"), F.lit(3).alias("kind"), F.lit(0).alias("start"), F.lit(12).alias("end"), F.lit(False).alias("wide")
    )
    ranked = plain.withColumn("rank", F.row_number().over(Window.orderBy(place)))
    late = (F.col("rank") > 25_000) & late
    plus = late | (F.col("id") % 2 == 0)
    label = (plus & ~late).cast("double").alias("label")
    values = {"is_phone": F.lit(True), "plus": plus, "after_quote": late, "length": F.lit(12)}
    return ranked.select(*plain.columns, label, *(values.get(f, F.lit(0)).cast("double").alias(f) for f in pii.FEATURES))


def test_all_labelled_candidates_count(spark):
    proposed = drawn_apart(spark, 40_000, F.lit(True)).cache()
    wide = proposed.where("label = 0 and plus = 1").limit(1).unionByName(proposed.where("label = 1").limit(1))
    wide = wide.withColumn("wide", F.lit(True)).withColumn("label", F.lit(None).cast("double")).localCheckpoint()
    quoted = {r.id for r in wide.where("after_quote = 1").collect()}
    accepted = {r.id for r in pii.fit(proposed).select(wide).collect()}
    assert len(quoted) == 1 and accepted == {r.id for r in wide.collect()} - quoted


def test_counts_weigh_as_rows(spark):
    """Trees and threshold from counts are those from one row for each candidate, compared without counts."""
    proposed = drawn_apart(spark, 6_000, F.lit(False))
    noisy = F.when(F.col("id") % 50 == 0, 1 - F.col("label")).otherwise(F.col("label"))
    proposed = proposed.withColumn("digits", (F.col("id") % 7).cast("double")).withColumn("label", noisy).cache()
    counts = pii.counted(proposed)
    total = counts.agg(F.sum("learn"), F.sum("judge"), F.count(F.lit(1))).first()
    assert total[0] + total[1] == 6_000 and 1_800 < total[1] < 2_200 and total[2] < 60
    model = pii.fit(proposed)
    part = F.pmod(F.xxhash64(F.xxhash64("id", "row", "kind", "start", "end")), F.lit(3))
    vectors = VectorAssembler(inputCols=list(pii.FEATURES), outputCol="vector").transform(proposed.withColumn("part", part))
    trainer = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=pii.TREES, maxDepth=pii.DEPTH, stepSize=0.3, seed=7)
    raw = vector_to_array("probability")[1].alias("raw")
    judged = vectors.where("part = 0")
    want = trainer.fit(vectors.where("part > 0").coalesce(1)).transform(judged).select("id", "label", raw).orderBy("id").collect()
    got = model.trees.transform(judged).select("id", raw).orderBy("id").collect()
    assert len(want) == total[1] and all(abs(a.raw - b.raw) < 1e-9 for a, b in zip(want, got, strict=True))
    # pooled shares of label 1 by raw probability: the first that reaches the threshold
    pools = []
    for value in sorted({r.raw for r in want}):
        labels = [r.label for r in want if r.raw == value]
        pools.append([value, sum(labels), len(labels)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, ones, size = pools.pop()
            pools[-1][1:] = [pools[-1][1] + ones, pools[-1][2] + size]
    least = min(value for value, ones, size in pools if ones / size >= pii.THRESHOLD)
    assert abs(model.least_raw - least) < 1e-9


def test_weights_of_kinds(spark):
    assert pii.kind_scales([0, 1, 5_000, 5_001]) == [1.0, 1.0, 1.0, 0.5]
    for n in (7_777, 10_000, 10_001, 3 * 10**9):
        (scale,) = pii.kind_scales([n])
        assert pii.KIND_WEIGHT / 2 < n * scale <= pii.KIND_WEIGHT


def test_rare_description_among_many(spark):
    """One description decides, amid 40,000 others: Spark's trees draw no rows for the places of their splits."""
    place = [F.lit(0).alias("row"), F.lit(3).alias("kind"), F.lit(0).alias("start"), F.col("id").cast("int").alias("end")]
    rare = F.col("id") >= 40_000  # thirty candidates with one description, whose length and digits others have too
    length, digits = (F.when(rare, 100).otherwise(v) for v in (F.col("id") % 200, F.floor(F.col("id") / 200)))
    values = {"is_phone": F.lit(True), "length": length, "digits": digits, "plus": rare}
    proposed = spark.range(40_030).select(
        "id", *place, F.lit(False).alias("wide"), rare.cast("double").alias("label"),
        *(values.get(f, F.lit(0)).cast("double").alias(f) for f in pii.FEATURES),
    ).cache()
    wide = proposed.where("id in (5, 20100, 40007)").withColumn("wide", F.lit(True))
    assert pii.counted(proposed).count() == 40_001
    assert [r.id for r in pii.fit(proposed).select(wide).collect()] == [40_007]


def test_edge_rows(rows):
    docs = rows("doc_id long, text string", (1, "a@b.cc"), (1, "a@b.cc"), (1, "x a@b.cc"), (None, None), (None, "+49 30 901820"))
    got = sorted((str(r.doc_id), r.n_email, r.n_phone, len(r.spans)) for r in pii.personal_data(docs).collect())
    assert got == [("1", 1, 0, 1)] * 3 + [("None", 0, 0, 0), ("None", 0, 1, 1)]
    assert pii.personal_data(docs.where("false")).count() == 0
