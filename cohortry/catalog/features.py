"""Aggregates, group sizes, orders, ranks, sampling and the classifier."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortry.catalog.registry import query
from cohortry.catalog.relational import SEGMENTS
from cohortry.functions import nulls as N
from cohortry.operators import aggregates as A
from cohortry.operators import categories as G
from cohortry.operators import columns as C
from cohortry.operators import joins as J
from cohortry.operators import model as M
from cohortry.operators import ranking as K
from cohortry.operators import rules as R
from cohortry.operators import scaling as S
from cohortry.session import materialise

EVENT_GROUPS = {"browse": ["click", "view"], "buy": ["purchase"], "fail": ["error"]}

CATEGORY_SCORES_SQL = """
    SELECT user_id,
           round(sum(value) FILTER (event_type IN ('click', 'view')), 6) AS browse,
           round(sum(value) FILTER (event_type = 'purchase'), 6) AS buy,
           round(sum(value) FILTER (event_type = 'error'), 6) AS fail
    FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error') GROUP BY user_id
"""


@query(
    "count_by",
    "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey",
)
def count_by(t):
    return A.count_by(t.lineitem, "l_orderkey", F.col("l_returnflag") == "R")


@query(
    "sum_by",
    """
    SELECT user_id, CASE WHEN count(v) = count(*) THEN round(sum(v), 6) END AS total,
           round(sum(v), 6) AS total_known
    FROM (SELECT user_id, CASE WHEN value >= 0.5 THEN value END AS v FROM events WHERE event_type <> 'signup')
    GROUP BY user_id
    """,
)
def sum_by(t):
    values = t.events.select("user_id", "event_type", F.when(F.col("value") >= 0.5, F.col("value")).alias("v"))
    wanted = F.col("event_type") != "signup"
    strict = A.sum_by(values, "user_id", "v", wanted)
    known = A.sum_by(values, "user_id", "v", wanted, out="total_known", na_strict=False)
    return strict.join(known, "user_id").select(
        "user_id", F.round("total", 6).alias("total"), F.round("total_known", 6).alias("total_known")
    )


def user_scores(t):
    scores = A.category_scores(t.events, "user_id", "event_type", "value", EVENT_GROUPS)
    return scores.select("user_id", *(F.round(c, 6).alias(c) for c in EVENT_GROUPS))


@query("category_scores", CATEGORY_SCORES_SQL)
def category_scores(t):
    return user_scores(t)


@query(
    "category_scores_strict",
    f"""
    SELECT user_id, {", ".join(
        f"CASE WHEN count(*) FILTER (event_type IN ({', '.join(repr(m) for m in members)}) AND v IS NULL) = 0 "
        f"THEN round(sum(v) FILTER (event_type IN ({', '.join(repr(m) for m in members)})), 6) END AS {name}"
        for name, members in EVENT_GROUPS.items())}
    FROM (SELECT *, CASE WHEN value >= 2 THEN value END AS v FROM events)
    WHERE event_type IN ({", ".join(repr(m) for members in EVENT_GROUPS.values() for m in members)}) GROUP BY user_id
    """,
)
def category_scores_strict(t):
    events = t.events.withColumn("value", F.when(F.col("value") >= 2, F.col("value")))
    scores = A.category_scores(events, "user_id", "event_type", "value", EVENT_GROUPS, na_strict=True)
    return scores.select("user_id", *(F.round(c, 6).alias(c) for c in EVENT_GROUPS))


@query(
    "category_score_lookup",
    f"""
    SELECT c_custkey AS user_id, browse, buy, fail
    FROM customer LEFT JOIN ({CATEGORY_SCORES_SQL}) ON c_custkey = user_id
    """,
)
def category_score_lookup(t):
    return J.score_lookup(t.customer.select(F.col("c_custkey").alias("user_id")), user_scores(t), "user_id")


@query(
    "mechanism_cascade",
    """
    WITH u AS (
        SELECT user_id, count(*) FILTER (event_type = 'signup') AS signups, sum(value) AS total,
               sum(value) FILTER (event_type IN ('click', 'view')) / sum(value) AS browse,
               sum(value) FILTER (event_type = 'purchase') / sum(value) AS buy,
               sum(value) FILTER (event_type = 'error') / sum(value) AS fail
        FROM events GROUP BY user_id
    ), outliers AS (
        SELECT user_id,
               CASE WHEN fail IS NULL THEN NULL WHEN fail >= 0.25 THEN 'POLE Mutation'
                    WHEN buy IS NULL THEN NULL WHEN buy >= 0.25 THEN 'APOBEC Mutation'
                    WHEN (signups >= 12 AND browse >= 0.25) IS NULL THEN NULL
                    WHEN signups >= 12 AND browse >= 0.25 THEN 'MSI High'
                    ELSE 'Unknown Significance' END AS mechanism
        FROM u WHERE total >= (SELECT median(total) FROM u)
    )
    SELECT u.user_id, coalesce(mechanism, 'nonhypermutated tumor') AS mechanism
    FROM u LEFT JOIN outliers ON u.user_id = outliers.user_id
    """,
)
def mechanism_cascade(t):
    sums = (
        t.events.groupBy("user_id")
        .agg(F.count_if(F.col("event_type") == "signup").alias("signups"), F.sum("value").alias("total"))
        .join(A.category_scores(t.events, "user_id", "event_type", "value", EVENT_GROUPS), "user_id", "left")
    )
    shares = sums.select("user_id", "signups", "total", *(N.safe_ratio(c, "total").alias(c) for c in EVENT_GROUPS))
    flagged = K.flag_outliers(shares, "total", k=0.0)
    explained = R.propose_mechanism(
        flagged.where("is_outlier"), "mechanism", "signups", 12, "browse", "buy", "fail", share_cutoff=0.25
    )
    return J.left_join(
        shares.select("user_id"),
        explained.select("user_id", "mechanism"),
        "user_id",
        {"mechanism": R.MECHANISMS["not_outlier"]},
    )


@query(
    "concat_by",
    """
    SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first) AS priorities
    FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1, 2)
    GROUP BY o_custkey
    """,
)
def concat_by(t):
    return A.concat_by(t.orders, "o_custkey", "o_orderpriority", "o_orderkey", "priorities")


@query(
    "row_total",
    """
    SELECT l_orderkey, l_linenumber, round(l_quantity + l_extendedprice + l_discount + l_tax, 4) AS total
    FROM lineitem
    """,
)
def row_total(t):
    numbers = C.select_matching(t.lineitem, "quantity|price|discount|tax", keep=["l_orderkey", "l_linenumber"])
    return C.row_total(numbers, numbers.columns[2:]).select("l_orderkey", "l_linenumber", F.round("total", 4).alias("total"))


@query(
    "median_iqr",
    """
    SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 6) AS q1,
           round(quantile_cont(o_totalprice, 0.5), 6) AS median,
           round(quantile_cont(o_totalprice, 0.75), 6) AS q3,
           round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 6) AS iqr
    FROM orders GROUP BY o_orderpriority
    """,
)
def median_iqr(t):
    return K.median_iqr(t.orders, "o_totalprice", "o_orderpriority").select(
        "o_orderpriority", "n", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "iqr"))
    )


_STRICT_KEY = "o_orderpriority || '/' || (o_custkey % 20)"


@query(
    "median_iqr_strict",
    f"""
    SELECT k, n, CASE WHEN known THEN round(q1, 6) END AS q1, CASE WHEN known THEN round(median, 6) END AS median,
           CASE WHEN known THEN round(q3, 6) END AS q3, CASE WHEN known THEN round(q3 - q1, 6) END AS iqr
    FROM (SELECT k, nullif(count(v), 0) AS n, count(v) = count(*) AS known, quantile_cont(v, 0.25) AS q1,
                 quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
          FROM (SELECT {_STRICT_KEY} AS k, CASE WHEN o_orderkey % 50 <> 1 OR o_custkey % 2 = 0 THEN o_totalprice END AS v FROM orders)
          GROUP BY k)
    """,
)
def median_iqr_strict(t):
    known = (F.col("o_orderkey") % 50 != 1) | (F.col("o_custkey") % 2 == 0)
    values = t.orders.select(F.expr(_STRICT_KEY).alias("k"), F.when(known, F.col("o_totalprice")).alias("v"))
    found = K.median_iqr(values, "v", "k", na_strict=True)
    return found.select("k", "n", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "iqr")))


@query(
    "flag_outliers",
    """
    WITH c AS (SELECT median(l_quantity * l_extendedprice) + 1.5 * (quantile_cont(l_quantity * l_extendedprice, 0.75)
                    - quantile_cont(l_quantity * l_extendedprice, 0.25)) AS cutoff FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(cutoff, 4) AS cutoff,
           l_quantity * l_extendedprice >= cutoff AS is_outlier
    FROM lineitem, c
    """,
)
def flag_outliers(t):
    value = t.lineitem.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("l_extendedprice")).alias("value")
    )
    return K.flag_outliers(value, "value").select(
        "l_orderkey", "l_linenumber", F.round("cutoff", 4).alias("cutoff"), "is_outlier"
    )


@query(
    "indel_fraction",
    """
    SELECT k AS l_orderkey, round(CAST(hits AS DOUBLE) / n, 6) AS fraction
    FROM (SELECT l_orderkey AS k, count(*) AS hits FROM lineitem WHERE l_quantity > 10 AND l_returnflag <> 'N' GROUP BY 1)
    JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1) ON k = l_orderkey
    """,
)
def indel_fraction(t):
    lines = t.lineitem.where(F.col("l_returnflag").isin("A", "R"))
    hits = A.count_by(lines, "l_orderkey", F.col("l_quantity") > 10, "hits")
    totals = A.count_by(lines.withColumnRenamed("l_orderkey", "orderkey"), "orderkey")
    return A.fraction_by(hits, totals, "l_orderkey", "orderkey", "hits", "n").withColumn(
        "fraction", F.round("fraction", 6)
    )


@query(
    "category_counts",
    """
    SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment, count(*) AS n,
           CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2
                             WHEN 'HOUSEHOLD' THEN 3 WHEN 'FURNITURE' THEN 4 END AS INTEGER) AS level
    FROM customer GROUP BY ALL
    """,
)
def category_counts(t):
    return A.category_counts(t.customer, "c_mktsegment", SEGMENTS)


@query(
    "log_burden",
    """
    SELECT l_orderkey, n_returned, CASE WHEN n_returned = 0 THEN '-Infinity'::DOUBLE
                                        ELSE round(log2(n_returned), 6) END AS log2_total
    FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY l_orderkey)
    """,
)
def log_burden(t):
    totals = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    logs = A.log_burden(totals, "n_returned")
    return logs.withColumn(
        "log2_total", F.when(N.finite("log2_total"), F.round("log2_total", 6)).otherwise(F.col("log2_total"))
    )


@query(
    "group_size",
    "SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS cases FROM part",
)
def group_size(t):
    return G.group_size(t.part.select("p_partkey", "p_brand"), "p_brand")


@query(
    "lump_rare",
    """
    SELECT p_partkey, CASE WHEN brand IS NULL AND n >= 80 THEN NULL WHEN n < 80 THEN 'Rare Brand' ELSE brand END AS brand
    FROM (SELECT p_partkey, brand, count(*) OVER (PARTITION BY brand) AS n
          FROM (SELECT p_partkey, nullif(p_brand, 'Brand#4') AS brand FROM part))
    """,
)
def lump_rare(t):
    brands = t.part.select("p_partkey", F.nullif(F.col("p_brand"), F.lit("Brand#4")).alias("brand"))
    return G.lump_rare(brands, "brand", 80, "Rare Brand").select("p_partkey", "brand")


@query(
    "zscore",
    """
    SELECT p_partkey,
           round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice,
           round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS p_size
    FROM part
    """,
)
def zscore(t):
    scaled = S.zscore(t.part.select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"])
    return scaled.select("p_partkey", *(F.round(c, 6).alias(c) for c in ("p_retailprice", "p_size")))


@query(
    "zscore_by_group",
    """
    SELECT c_custkey, c_mktsegment,
           round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) AS c_acctbal
    FROM customer WINDOW w AS (PARTITION BY c_mktsegment)
    """,
)
def zscore_by_group(t):
    scaled = S.zscore(t.customer, ["c_acctbal"], by="c_mktsegment")
    return scaled.select("c_custkey", "c_mktsegment", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(
    "level_index",
    """
    WITH firsts AS (SELECT p_brand, min(struct_pack(s := p_retailprice, k := p_partkey)) AS f FROM part GROUP BY p_brand)
    SELECT p_partkey, part.p_brand, level
    FROM part JOIN (SELECT p_brand, row_number() OVER (ORDER BY f) AS level FROM firsts) l ON part.p_brand = l.p_brand
    """,
)
def level_index(t):
    return G.level_index(t.part, "p_brand", ["p_retailprice", "p_partkey"]).select("p_partkey", "p_brand", "level")


@query(
    "average_rank",
    """
    SELECT l_orderkey, l_linenumber, l_quantity,
           rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity)
           + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2 AS rank
    FROM lineitem
    """,
)
def average_rank(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return K.average_rank(lines, "l_quantity", "l_orderkey")


@query(
    "average_rank_overall",
    """
    SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity)
           + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rank
    FROM lineitem
    """,
)
def average_rank_overall(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return K.average_rank(lines, "l_quantity").drop("l_quantity")


@query(
    "sort_nulls_last",
    "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS priority, o_totalprice FROM orders",
)
def sort_nulls_last(t):
    orders = t.orders.select(
        "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("priority"), "o_totalprice"
    )
    return K.sort_nulls_last(orders, "priority", "o_totalprice")


@query(
    "sort_position",
    """
    SELECT o_orderkey, priority, row_number() OVER (ORDER BY priority NULLS LAST, o_totalprice NULLS LAST, o_orderkey) AS position
    FROM (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS priority, o_totalprice FROM orders)
    """,
)
def sort_position(t):
    orders = t.orders.select(
        "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("priority"), "o_totalprice"
    )
    keys = [F.asc_nulls_last(c) for c in ("priority", "o_totalprice", "o_orderkey")]
    return K.global_position(orders, keys).select("o_orderkey", "priority", "position")


@query(
    "sort_by_levels",
    """
    SELECT c_custkey, CASE WHEN level IS NOT NULL THEN c_mktsegment END AS c_mktsegment, level, 5 - level AS reversed
    FROM (SELECT c_custkey, c_mktsegment, CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2
                 WHEN 'HOUSEHOLD' THEN 3 WHEN 'FURNITURE' THEN 4 END AS INTEGER) AS level FROM customer)
    """,
)
def sort_by_levels(t):
    from cohortry.functions.labels import reversed_position

    segments = t.customer.select("c_custkey", "c_mktsegment").withColumn(
        "reversed", reversed_position("c_mktsegment", SEGMENTS)
    )
    return G.sort_by_levels(segments, "c_mktsegment", SEGMENTS)


@query(
    "sample_n",
    """
    SELECT c_custkey, c_name FROM customer ORDER BY md5('12345|' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 100
    """,
)
def sample_n(t):
    return K.sample_n(t.customer.select("c_custkey", "c_name"), 100, 12345, "c_custkey", strict=True)


@query(
    "score_ranking",
    """
    SELECT o_custkey, score, row_number() OVER (ORDER BY score, o_custkey) AS position
    FROM (SELECT o_custkey, round(avg(o_totalprice), 6) AS score FROM orders GROUP BY o_custkey)
    """,
)
def score_ranking(t):
    scores = t.orders.groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 6).alias("score"))
    return K.score_ranking(scores, "score", "o_custkey")


FEATURES_SQL = """
    SELECT c.c_custkey, n_orders, mean_price, n_urgent, n_lines, mean_quantity
    FROM customer c
    JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) f1 ON f1.o_custkey = c.c_custkey
    JOIN (SELECT o_custkey, round(avg(o_totalprice), 6) AS mean_price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f2
         ON f2.o_custkey = c.c_custkey
    JOIN (SELECT o_custkey, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) f3
         ON f3.o_custkey = c.c_custkey
    JOIN (SELECT o_custkey, count(*) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) f4
         ON f4.o_custkey = c.c_custkey
    JOIN (SELECT o_custkey, round(avg(l_quantity), 6) AS mean_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
          WHERE l_returnflag = 'R' GROUP BY 1) f5 ON f5.o_custkey = c.c_custkey
"""


def customer_feature_tables(t):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    lines = orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    mean = lambda df, c, out: df.groupBy("c_custkey").agg(F.round(F.avg(c), 6).alias(out))
    return {
        "n_orders": A.count_by(orders, "c_custkey", out="n_orders"),
        "mean_price": mean(orders.where(F.col("o_orderstatus") == "F"), "o_totalprice", "mean_price"),
        "n_urgent": A.count_by(orders, "c_custkey", F.col("o_orderpriority") == "1-URGENT", "n_urgent"),
        "n_lines": A.count_by(lines, "c_custkey", out="n_lines"),
        "mean_quantity": mean(lines.where(F.col("l_returnflag") == "R"), "l_quantity", "mean_quantity"),
    }


@query("assemble_features", FEATURES_SQL)
def assemble_features(t):
    return J.assemble_features(t.customer.select("c_custkey"), list(customer_feature_tables(t).values()), "c_custkey")


@query(
    "assembly_report",
    """
    WITH f1 AS (SELECT DISTINCT o_custkey AS k FROM orders),
         f2 AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
         f3 AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
         f4 AS (SELECT DISTINCT o_custkey AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
         f5 AS (SELECT DISTINCT o_custkey AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
         s1 AS (SELECT c_custkey AS k FROM customer SEMI JOIN f1 ON k = c_custkey),
         s2 AS (SELECT k FROM s1 WHERE k IN (SELECT k FROM f2)),
         s3 AS (SELECT k FROM s2 WHERE k IN (SELECT k FROM f3)),
         s4 AS (SELECT k FROM s3 WHERE k IN (SELECT k FROM f4)),
         s5 AS (SELECT k FROM s4 WHERE k IN (SELECT k FROM f5))
    SELECT 'base' AS step, count(*) AS entities FROM customer
    UNION ALL SELECT 'n_orders', count(*) FROM s1 UNION ALL SELECT 'mean_price', count(*) FROM s2
    UNION ALL SELECT 'n_urgent', count(*) FROM s3 UNION ALL SELECT 'n_lines', count(*) FROM s4
    UNION ALL SELECT 'mean_quantity', count(*) FROM s5
    """,
)
def assembly_report(t):
    return J.assembly_report(t.customer.select("c_custkey"), customer_feature_tables(t), "c_custkey")


DOCUMENT_FEATURES = ["n_chars", "n_blanks", "n_lines", "n_digits", "n_capitals"]

DOCUMENT_FEATURES_SQL = """
    SELECT doc_id, CAST(quality AS VARCHAR) AS quality, n_chars,
           length(text) - length(replace(text, ' ', '')) AS n_blanks,
           length(text) - length(replace(text, chr(10), '')) AS n_lines,
           length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
    FROM documents LEFT JOIN labels USING (doc_id)
"""


def document_features(t):
    def occurrences(pattern: str):
        rest = F.regexp_replace("text", pattern, "") if len(pattern) > 1 else F.replace("text", F.lit(pattern), F.lit(""))
        return (F.length("text") - F.length(rest)).cast("bigint")

    return t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id",
        F.col("quality").cast("string").alias("quality"),
        "n_chars",
        occurrences(" ").alias("n_blanks"),
        occurrences("\n").alias("n_lines"),
        occurrences("[0-9]+").alias("n_digits"),
        occurrences("[A-Z]+").alias("n_capitals"),
    )


@query("document_features", DOCUMENT_FEATURES_SQL)
def document_features_query(t):
    return document_features(t)


def _scaled_sql(columns, source):
    scaled = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in columns)
    return f"SELECT doc_id, label, {scaled} FROM ({source})"


@query(
    "labelled_sample",
    _scaled_sql(
        DOCUMENT_FEATURES,
        f"""
        WITH f AS ({DOCUMENT_FEATURES_SQL}),
             drawn AS (
                SELECT * FROM (SELECT doc_id, 1 AS label FROM f WHERE quality = '0'
                               ORDER BY md5('12345|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 22)
                UNION ALL
                SELECT * FROM (SELECT doc_id, 0 AS label FROM f WHERE quality = '1'
                               ORDER BY md5('12345|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100))
        SELECT * FROM drawn JOIN f USING (doc_id)
        """,
    ),
)
def labelled_sample(t):
    sample = M.labelled_sample(document_features(t), "doc_id", "quality", "0", "1", DOCUMENT_FEATURES)
    return sample.select("doc_id", "label", *(F.round(c, 6).alias(c) for c in DOCUMENT_FEATURES))


@query("lasso_score")
def lasso_score(t):
    documents = materialise(document_features(t))  # read by the draw, the scaler and the scoring
    train = M.labelled_sample(documents, "doc_id", "quality", "0", "1", DOCUMENT_FEATURES)
    fit = M.fit_lasso_cv(train, DOCUMENT_FEATURES, key="doc_id")
    scored = M.score(fit, documents, "doc_id", exclude=train)
    return M.ranked_scores(scored, "doc_id").select("doc_id", "score", "position")


# --- the classifier at fixed coefficients, which SQL can follow step by step

@query(
    "feature_vector",
    "SELECT doc_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(DOCUMENT_FEATURES))
    + f" FROM ({DOCUMENT_FEATURES_SQL})",
)
def feature_vector(t):
    vectors = M.feature_vector(document_features(t), DOCUMENT_FEATURES)
    return vectors.select("doc_id", *(vector_to_array("features")[i].alias(f"x{i}") for i in range(len(DOCUMENT_FEATURES))))


_FOLDS = 5
_BETA = (0.2, 0.4, -0.3, 0.1, -0.2)  # per standardised feature

_STANDARD_SQL = f"""
    WITH f AS ({DOCUMENT_FEATURES_SQL}),
    known AS (SELECT doc_id, 1 - CAST(quality AS INT) AS label, {", ".join(DOCUMENT_FEATURES)} FROM f WHERE quality IS NOT NULL),
    moments AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in DOCUMENT_FEATURES)} FROM known)
    SELECT doc_id, label, CAST(('0x' || md5('12345|' || CAST(doc_id AS VARCHAR))[1:8]) AS BIGINT) % {_FOLDS} AS fold,
           {", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in DOCUMENT_FEATURES)}
    FROM known, moments
"""


def _known_documents(t):
    known = document_features(t).where(F.col("quality").isNotNull())
    return known.withColumn("label", 1 - F.col("quality").cast("int"))


@query(
    "lasso_path",
    f"""
    SELECT CAST(step AS INT) AS step, round(top * exp(ln(0.0001) * step / 19.0), 9) AS penalty
    FROM (SELECT greatest({", ".join(f"abs(covar_pop({c}, label)) / stddev_pop({c})" for c in DOCUMENT_FEATURES)}) AS top
          FROM (SELECT *, 1 - CAST(quality AS INT) AS label FROM ({DOCUMENT_FEATURES_SQL}) WHERE quality IS NOT NULL)),
         (SELECT unnest(range(20)) AS step)
    """,
)
def lasso_path(t):
    path = M.lambda_path(_known_documents(t), DOCUMENT_FEATURES, "label", 20)
    return t.spark.createDataFrame(list(enumerate(path)), "step int, penalty double").withColumn("penalty", F.round("penalty", 9))


@query(
    "lasso_sums",
    f"""
    WITH s AS (SELECT *, {" + ".join(f"{b} * {c}" for b, c in zip(_BETA, DOCUMENT_FEATURES))} AS margin FROM ({_STANDARD_SQL})),
    p AS (SELECT *, 1 / (1 + exp(-margin)) AS p FROM s),
    problems AS (SELECT unnest(range(-1, {_FOLDS})) AS held_out)
    SELECT CAST(held_out AS INT) AS held_out, count(*) FILTER (fold <> held_out) AS n,
           {", ".join(f"round(sum((label - p) * {c}) FILTER (fold <> held_out) / 1000, 6) AS gradient_{c}" for c in DOCUMENT_FEATURES)},
           {", ".join(f"round(sum((1 - p) * {c}) FILTER (fold <> held_out AND label = 1) / 1000, 6) AS positive_{c}" for c in DOCUMENT_FEATURES)},
           round(2 * sum(greatest(margin, 0) + ln(1 + exp(-abs(margin))) - label * margin) FILTER (fold <> held_out) / 1000, 6) AS deviance,
           round(coalesce(2 * sum(greatest(margin, 0) + ln(1 + exp(-abs(margin))) - label * margin) FILTER (fold = held_out), 0) / 1000, 6)
           AS held_deviance
    FROM p, problems GROUP BY held_out
    """,
)
def lasso_sums(t):
    known = _known_documents(t).withColumn("fold", M.fold_of("doc_id", 12345, _FOLDS).cast("int"))
    scaled = known.agg(*(g(c).alias(f"{n}_{c}") for c in DOCUMENT_FEATURES for n, g in (("m", F.avg), ("s", F.stddev_pop)))).first()
    table = known.select(
        F.col("label").cast("double").alias("label"),
        "fold",
        *(((F.col(c) - scaled[f"m_{c}"]) / F.lit(scaled[f"s_{c}"])).alias(c) for c in DOCUMENT_FEATURES),
    )
    sums = M.problem_sums(table, [(0.0, *_BETA)] * (_FOLDS + 1), list(range(-1, _FOLDS)))
    thousandth = lambda name: F.round(F.col(name) / 1000, 6).alias(name)
    renamed = sums.select(
        "held_out", F.col("n").cast("bigint").alias("n"),
        *(F.col("gradient")[i + 1].alias(f"gradient_{c}") for i, c in enumerate(DOCUMENT_FEATURES)),
        *(F.col("positive_gradient")[i + 1].alias(f"positive_{c}") for i, c in enumerate(DOCUMENT_FEATURES)),
        "deviance", "held_deviance",
    )
    return renamed.select("held_out", "n", *(thousandth(c) for c in renamed.columns[2:]))


@query(
    "balanced_folds",
    f"""
    SELECT doc_id, CAST((row_number() OVER (ORDER BY quality DESC, md5('12345|' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % {_FOLDS} AS INT)
           AS fold
    FROM ({DOCUMENT_FEATURES_SQL}) WHERE quality IS NOT NULL
    """,
)
def balanced_folds(t):
    known = _known_documents(t).select("doc_id", "label")
    return M.balanced_folds(known, "label", _FOLDS, key="doc_id").select("doc_id", "fold")


_PENALTY = 0.02
_GRADIENT_STEPS = 4000


def _one_penalty_sql() -> str:
    """Proximal gradient steps from zero, each one row of a recursion that sums over the standardised table."""
    n = len(DOCUMENT_FEATURES)
    margin = " + ".join(["b0", *(f"b{i + 1} * {c}" for i, c in enumerate(DOCUMENT_FEATURES))])
    columns = ", ".join(f"b{i}" for i in range(n + 1))
    sums = ", ".join(["avg(label - p) AS g0", *(f"avg((label - p) * {c}) AS g{i + 1}" for i, c in enumerate(DOCUMENT_FEATURES))])
    moved = [f"b{i} + g{i} * width AS m{i}" for i in range(n + 1)]
    shrunk = ["m0", *(f"sign(m{i + 1}) * greatest(abs(m{i + 1}) - {_PENALTY} * width, 0)" for i in range(n))]
    return f"""
    WITH RECURSIVE s AS MATERIALIZED ({_STANDARD_SQL}),
    size AS (SELECT 4.0 / {n + 1} AS width),
    fit AS (
        SELECT 0 AS step, {", ".join(f"CAST(0 AS DOUBLE) AS b{i}" for i in range(n + 1))}
        UNION ALL
        SELECT step + 1, {", ".join(shrunk)}
        FROM (SELECT step, width, {", ".join(moved)}
              FROM (SELECT step, {columns}, {sums}
                    FROM (SELECT fit.*, label, {", ".join(DOCUMENT_FEATURES)}, 1 / (1 + exp(-({margin}))) AS p FROM fit, s)
                    GROUP BY step, {columns}), size)
        WHERE step < {_GRADIENT_STEPS})
    SELECT name, round(b, 4) + 0.0 AS coefficient
    FROM (SELECT unnest(['intercept', {", ".join(f"'{c}'" for c in DOCUMENT_FEATURES)}]) AS name, unnest([{columns}]) AS b
          FROM fit WHERE step = {_GRADIENT_STEPS})
    """


@query("lasso_one_penalty", _one_penalty_sql())
def lasso_one_penalty(t):
    """The fit at one penalty, coefficients on the standardised scale."""
    known = _known_documents(t)
    moments = known.agg(*(g(c).alias(f"{n}_{c}") for c in DOCUMENT_FEATURES for n, g in (("m", F.avg), ("s", F.stddev_pop)))).first()
    fit = M.fit_lasso(known, DOCUMENT_FEATURES, _PENALTY, tolerance=1e-7)
    scaled = [b * moments[f"s_{c}"] for b, c in zip(fit.coefficients, DOCUMENT_FEATURES, strict=True)]
    centre = fit.intercept + sum(b * moments[f"m_{c}"] for b, c in zip(fit.coefficients, DOCUMENT_FEATURES, strict=True))
    rows = list(zip(["intercept", *DOCUMENT_FEATURES], [centre, *scaled], strict=True))
    return t.spark.createDataFrame(rows, "name string, coefficient double").select("name", (F.round("coefficient", 4) + 0.0).alias("coefficient"))


_GAP = 1e-5  # of the objective


@query(
    "lasso_certificate",
    f"""
    SELECT CAST(held_out AS INT) AS held_out, round(top * exp(ln(0.0001) * step / 99.0), 9) AS penalty, true AS certified
    FROM (SELECT greatest({", ".join(f"abs(covar_pop({c}, label)) / stddev_pop({c})" for c in DOCUMENT_FEATURES)}) AS top
          FROM (SELECT *, 1 - CAST(quality AS INT) AS label FROM ({DOCUMENT_FEATURES_SQL}) WHERE quality IS NOT NULL)),
         (SELECT unnest(range(100)) AS step), (SELECT unnest(range(-1, 10)) AS held_out)
    """,
)
def lasso_certificate(t):
    """Every problem of a cross-validated path, and whether its duality gap shows it to be solved."""
    fit = M.fit_lasso_cv(_known_documents(t), DOCUMENT_FEATURES, key="doc_id")
    rows = [(c.held_out, c.penalty, 0 <= c.gap + 1e-12 and c.gap <= _GAP * c.objective) for c in fit.certificates]
    found = t.spark.createDataFrame(rows, "held_out int, penalty double, certified boolean")
    return found.withColumn("penalty", F.round("penalty", 9))


@query(
    "score_fixed",
    f"""
    WITH f AS ({DOCUMENT_FEATURES_SQL}), rest AS (SELECT * FROM f WHERE doc_id % 7 <> 0),
    scored AS (
        SELECT doc_id, round(1 / (1 + exp(-(0.5 + {" + ".join(
            f"{b} * ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()" for b, c in zip(_BETA, DOCUMENT_FEATURES))}))), 9) AS score
        FROM rest)
    SELECT doc_id, score, row_number() OVER (ORDER BY score, doc_id) AS position FROM scored
    """,
)
def score_fixed(t):
    documents = materialise(document_features(t))
    fit = M.LassoFit(tuple(DOCUMENT_FEATURES), (), (), 0.0, 0.5, _BETA)
    scored = M.score(fit, documents, "doc_id", exclude=documents.where("doc_id % 7 = 0"))
    return M.ranked_scores(scored.withColumn("score", F.round("score", 9)), "doc_id").select("doc_id", "score", "position")
