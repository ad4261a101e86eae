"""Sources, projections, predicates, joins, set operations and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from cohortry.catalog.registry import query
from cohortry.functions import labels as L
from cohortry.functions import nulls as N
from cohortry.operators import aggregates as A
from cohortry.operators import columns as C
from cohortry.operators import joins as J
from cohortry.operators import rules as R
from cohortry.operators import sets as U
from cohortry.session import scratch_path
from cohortry.sources.delimited import read_delimited, write_delimited, write_report

SEGMENTS = ["MACHINERY", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE"]


@query(
    "delimited_roundtrip",
    r"""
    SELECT c_custkey, replace(c_name, '#', chr(10)) || chr(9) || '\n"' || chr(13) AS label,
           CASE c_mktsegment WHEN 'MACHINERY' THEN 'NA' WHEN 'FURNITURE' THEN '' WHEN 'HOUSEHOLD' THEN ' \e '
                             WHEN 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_acctbal
    FROM customer
    """,
)
def delimited_roundtrip(t):
    """Line breaks, separators, quotes, escapes, blanks and the marker for missing values, as values."""
    segment = F.col("c_mktsegment")
    table = t.customer.select(
        "c_custkey",
        F.concat(F.replace("c_name", F.lit("#"), F.lit("\n")), F.lit('\t\\n"\r')).alias("label"),
        F.when(segment == "MACHINERY", "NA").when(segment == "FURNITURE", "").when(segment == "HOUSEHOLD", " \\e ")
        .when(segment != "BUILDING", segment).alias("c_mktsegment"),
        "c_acctbal",
    )
    path = scratch_path(t.spark, "delimited")
    write_delimited(table, path, escapes=True)
    return read_delimited(t.spark, path, schema=table.schema, escapes=True)


@query(
    "project_rename",
    "SELECT c_custkey AS entity, c_name AS label, 'case' AS cohort FROM customer",
)
def project_rename(t):
    return C.select_renamed(t.customer, {"c_custkey": "entity", "c_name": "label"}, cohort="case")


@query(
    "rename_by_position",
    "SELECT s_name, s_nationkey, s_acctbal AS balance FROM supplier",
)
def rename_by_position(t):
    return C.drop_at(C.rename_at(t.supplier, 3, "balance"), 0)


@query(
    "regex_columns",
    """
    SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity, l_extendedprice + 1 AS l_extendedprice,
           l_discount + 1 AS l_discount, l_tax + 1 AS l_tax
    FROM lineitem
    """,
)
def regex_columns(t):
    pattern = "quantity|price|discount|tax"
    chosen = C.select_matching(t.lineitem, pattern, keep=["l_orderkey", "l_linenumber"])
    return C.mutate_matching(chosen, pattern, lambda c: c + 1)


@query(
    "cast_by_type",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
           CAST(p_size AS VARCHAR) AS p_size, p_retailprice
    FROM part
    """,
)
def cast_by_type(t):
    return C.mutate_by_type(t.part, (IntegerType, LongType), lambda c: c.cast("string"))


@query(
    "filter_conjunction",
    """
    SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_totalprice FROM orders
    WHERE nullif(o_orderstatus, 'P') <> 'O' AND o_totalprice >= 100000 AND o_totalprice < 300000
    """,
)
def filter_conjunction(t):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return t.orders.select("o_orderkey", status.alias("status"), "o_totalprice").where(
        (F.col("status") != "O") & (F.col("o_totalprice") >= 100000) & (F.col("o_totalprice") < 300000)
    )


@query(
    "filter_in_list",
    """
    SELECT c_custkey, segment, coalesce(segment IN ('AUTOMOBILE', 'FURNITURE'), false) AS listed
    FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer)
    WHERE NOT coalesce(segment IN ('MACHINERY'), false)
    """,
)
def filter_in_list(t):
    segments = t.customer.select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    return segments.where(N.not_in_list("segment", ["MACHINERY"])).withColumn(
        "listed", N.in_list("segment", ["AUTOMOBILE", "FURNITURE"])
    )


@query(
    "cohort_scope",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING', 'FURNITURE')",
)
def cohort_scope(t):
    scoped = C.cohort_scope(t.customer, "c_mktsegment", ["MACHINERY", "BUILDING", "FURNITURE"])
    return scoped.select("c_custkey", "c_mktsegment")


@query(
    "pattern_predicate",
    """
    SELECT p_partkey, name, coalesce(contains(name, 'ring'), false) AS has_ring,
           coalesce(regexp_matches(name, '^(red|blue) '), false) AS red_or_blue
    FROM (SELECT p_partkey, nullif(p_name, 'small ring') AS name FROM part)
    """,
)
def pattern_predicate(t):
    return t.part.select("p_partkey", F.nullif(F.col("p_name"), F.lit("small ring")).alias("name")).withColumns(
        {"has_ring": N.matches("name", "ring"), "red_or_blue": N.matches("name", "^(red|blue) ", regex=True)}
    )


@query(
    "na_ifelse",
    """
    SELECT c_custkey,
           CASE WHEN c_mktsegment = 'BUILDING' THEN NULL
                WHEN c_mktsegment = 'MACHINERY' THEN 'machine' ELSE 'other' END AS kind
    FROM customer
    """,
)
def na_ifelse(t):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t.customer.select("c_custkey", N.na_ifelse(segment == "MACHINERY", "machine", "other").alias("kind"))


EVENT_COUNTS_SQL = """
    SELECT c_custkey, c_nationkey,
           CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance,
           nullif(c_mktsegment, 'BUILDING') AS segment,
           coalesce(n_finished, 0) AS n_finished, coalesce(n_open, 0) AS n_open
    FROM customer LEFT JOIN (
        SELECT o_custkey,
               count(*) FILTER (contains(o_orderstatus, 'F')) AS n_finished,
               count(*) FILTER (contains(o_orderstatus, 'O')) AS n_open
        FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_custkey
    ) ON c_custkey = o_custkey
"""


def customer_event_counts(t):
    entities = t.customer.select(
        "c_custkey",
        "c_nationkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
    )
    events = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return A.event_counts(
        entities,
        events,
        "c_custkey",
        "o_orderpriority",
        ["1-URGENT", "2-HIGH"],
        "o_orderstatus",
        {"n_finished": "F", "n_open": "O"},
    )


@query("event_counts", EVENT_COUNTS_SQL)
def event_counts(t):
    return customer_event_counts(t)


# Each step rewrites the class; a NULL condition erases it.
_RULE_STEPS = [
    ("n_finished = 0 AND n_open = 0", "Inactive"),
    ("segment = 'MACHINERY' AND n_finished >= 1", "Industrial"),
    ("n_open > n_finished", "Pending"),
    ("balance >= 5000 AND n_finished >= 2", "Valued"),
    ("segment = 'FURNITURE' AND balance < 1000", "Watched"),
    ("n_finished >= 3 AND NOT (segment = 'AUTOMOBILE')", "Frequent"),
    ("n_finished = 1 AND n_open = 1", "Even"),
]


def _sequential_sql(base: str, out: str, steps, default: str) -> str:
    """Oracle form of a cascade: one nested SELECT per rule, in order."""
    sql = f"SELECT *, '{default}' AS {out} FROM ({base})"
    for condition, value in steps:
        sql = (
            f"SELECT * REPLACE (CASE WHEN ({condition}) IS NULL THEN NULL WHEN {condition} "
            f"THEN '{value}' ELSE {out} END AS {out}) FROM ({sql})"
        )
    return sql


RULE_CASCADE_SQL = _sequential_sql(EVENT_COUNTS_SQL, "pattern", _RULE_STEPS, "Others")


def customer_patterns(t):
    rules = [(F.expr(condition), value) for condition, value in _RULE_STEPS]
    return R.rule_cascade(customer_event_counts(t), "pattern", rules, "Others")


@query("rule_cascade", RULE_CASCADE_SQL)
def rule_cascade(t):
    return customer_patterns(t)


def coverage_sql(cascade: str, source: str, steps, default: str) -> str:
    """Every rule's condition on every row, as a list; a rule is last when no later one is true or unknown."""
    conditions, values = ", ".join(f"({c})" for c, _ in steps), ", ".join(f"'{v}'" for v in (default, *(v for _, v in steps)))
    return f"""
        SELECT '{cascade}' AS cascade, CAST(k AS INTEGER) AS rule, [{values}][k + 1] AS value,
               count(*) FILTER (this) AS hits, count(*) FILTER (this IS NULL) AS unknown,
               count(*) FILTER (this AND NOT later) AS decided, count(*) FILTER (this IS NULL AND NOT later) AS erased,
               count(*) FILTER (this AND later) AS shadowed
        FROM (SELECT k, CASE WHEN k = 0 THEN true ELSE found[k] END AS this,
                     len([f FOR f IN found[k + 1:] IF coalesce(f, true)]) > 0 AS later
              FROM (SELECT [{conditions}] AS found FROM {source}), (SELECT unnest(range({len(steps) + 1})) AS k))
        GROUP BY k
    """


@query("rule_coverage", coverage_sql("customers", f"({EVENT_COUNTS_SQL})", _RULE_STEPS, "Others"))
def rule_coverage(t):
    rules = [(F.expr(condition), value) for condition, value in _RULE_STEPS]
    return R.rule_coverage(customer_event_counts(t), rules, "Others").withColumn("cascade", F.lit("customers"))


@query(
    "refine_class",
    f"""
    SELECT c_custkey, r_name,
           CASE WHEN pattern = 'Valued' AND contains(r_name, 'AMERICA') THEN 'Valued West'
                WHEN pattern = 'Valued' AND contains(r_name, 'ASIA') THEN 'Valued East'
                WHEN pattern = 'Valued' AND contains(r_name, 'E') THEN 'Valued Centre'
                ELSE pattern END AS refined
    FROM ({RULE_CASCADE_SQL}) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """,
)
def refine_class(t):
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), "r_name"
    )
    placed = J.inner_join(customer_patterns(t), place, "c_nationkey")
    parts = {"AMERICA": "Valued West", "ASIA": "Valued East", "E": "Valued Centre"}
    return R.refine_class(placed, "pattern", "Valued", "r_name", parts, "refined").select(
        "c_custkey", "r_name", "refined"
    )


@query(
    "range_guard",
    """
    SELECT l_orderkey, l_linenumber, round(log2(l_discount * 100), 6) AS log2_percent FROM lineitem
    WHERE l_discount > 0 AND log2(l_discount * 100) BETWEEN 0.5 AND 2.9
    """,
)
def range_guard(t):
    logs = t.lineitem.select(
        "l_orderkey", "l_linenumber", N.log2_inf(F.col("l_discount") * 100).alias("log2_percent")
    )
    return C.range_guard(logs, "log2_percent", 0.5, 2.9).withColumn("log2_percent", F.round("log2_percent", 6))


@query(
    "inner_join",
    """
    SELECT o_orderkey, o_custkey, l_linenumber, l_quantity
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    """,
)
def inner_join(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return J.inner_join(t.orders.select("o_orderkey", "o_custkey"), lines, "o_orderkey")


@query(
    "inner_join_null_keys",
    """
    WITH o AS (SELECT o_custkey, nullif(o_orderpriority, '5-LOW') AS priority, count(*) AS n
               FROM orders GROUP BY 1, 2),
         w AS (SELECT nullif(o_orderpriority, '5-LOW') AS priority, count(*) AS total FROM orders GROUP BY 1)
    SELECT o.o_custkey, o.priority, o.n, w.total FROM o JOIN w ON o.priority IS NOT DISTINCT FROM w.priority
    """,
)
def inner_join_null_keys(t):
    orders = t.orders.select("o_custkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"))
    per_customer = A.count_by(orders, ["o_custkey", "priority"])
    totals = A.count_by(orders, "priority", out="total")
    return J.inner_join(per_customer, totals, "priority", null_safe=True)


@query(
    "left_join_default",
    """
    SELECT o_orderkey, coalesce(n_returned, 0) AS n_returned, coalesce(status, 'nothing returned') AS status
    FROM orders LEFT JOIN (
        SELECT l_orderkey, count(*) AS n_returned, 'returned' AS status
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
    ) ON o_orderkey = l_orderkey
    """,
)
def left_join_default(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    returned = A.count_by(lines, "o_orderkey", F.col("l_returnflag") == "R", "n_returned").withColumn(
        "status", F.lit("returned")
    )
    return J.left_join(
        t.orders.select("o_orderkey"), returned, "o_orderkey", {"n_returned": 0, "status": "nothing returned"}
    )


@query(
    "natural_left_join",
    "SELECT doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def natural_left_join(t):
    return J.natural_left_join(t.documents.select("doc_id", "lang", "source"), t.labels)


@query(
    "full_outer_join",
    """
    SELECT coalesce(u.o_custkey, b.o_custkey) AS o_custkey, n_urgent, n_large
    FROM (SELECT o_custkey, count(*) AS n_urgent FROM orders
          WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1) u
    FULL OUTER JOIN
         (SELECT o_custkey, count(*) AS n_large FROM orders WHERE o_totalprice > 450000 GROUP BY 1) b
    ON u.o_custkey = b.o_custkey
    """,
)
def full_outer_join(t):
    urgent = A.count_by(
        t.orders, "o_custkey", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), "n_urgent"
    )
    large = A.count_by(t.orders, "o_custkey", F.col("o_totalprice") > 450000, "n_large")
    return J.full_outer_join(urgent, large, "o_custkey").orderBy("o_custkey")


@query(
    "semi_join",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
)
def semi_join(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return J.semi_join(t.orders.select("o_orderkey", "o_orderstatus"), lines, "o_orderkey")


@query(
    "anti_join",
    """
    SELECT o_orderkey, o_orderstatus FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
)
def anti_join(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return J.anti_join(t.orders.select("o_orderkey", "o_orderstatus"), lines, "o_orderkey")


_WITH_NULL_KEYS = "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders"
_STATUSES = "SELECT DISTINCT nullif(l_linestatus, 'O') AS status FROM lineitem"


def _null_key_tables(t):
    orders = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return orders, t.lineitem.select(F.nullif("l_linestatus", F.lit("O")).alias("status"))


@query(
    "semi_join_null_keys",
    f"SELECT * FROM ({_WITH_NULL_KEYS}) o WHERE EXISTS (SELECT 1 FROM ({_STATUSES}) l WHERE l.status IS NOT DISTINCT FROM o.status)",
)
def semi_join_null_keys(t):
    return J.semi_join(*_null_key_tables(t), "status", null_safe=True)


@query(
    "anti_join_null_keys",
    f"SELECT * FROM ({_WITH_NULL_KEYS}) o WHERE NOT EXISTS (SELECT 1 FROM ({_STATUSES}) l WHERE l.status IS NOT DISTINCT FROM o.status)",
)
def anti_join_null_keys(t):
    return J.anti_join(*_null_key_tables(t), "status", null_safe=True)


@query(
    "report_roundtrip",
    """
    SELECT c_mktsegment AS metric, c_nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS mean
    FROM customer GROUP BY ALL
    """,
)
def report_roundtrip(t):
    table = t.customer.groupBy(F.col("c_mktsegment").alias("metric"), "c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean")
    )
    path = scratch_path(t.spark, "report")
    write_report(table, path)
    return t.spark.read.parquet(path).select("metric", "c_nationkey", "n", "mean")


@query(
    "contains_join",
    """
    SELECT id, o_orderkey, c_name
    FROM (SELECT DISTINCT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS id FROM supplier)
    JOIN (SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey) ON contains(c_name, id)
    """,
)
def contains_join(t):
    ids = t.supplier.select(F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("id"))
    events = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    return J.contains_join(ids, events, "id", "c_name").select("id", "o_orderkey", "c_name")


@query(
    "id_map",
    """
    SELECT c_custkey, id, replace(min(struct_pack(s := s_name, t := target)).t, 'IM6', 'WES') AS mapped
    FROM (SELECT c_custkey, substr(c_name, 12) AS id FROM customer)
    JOIN (SELECT s_name, 'M' || s_suppkey || '-IM6' AS target FROM supplier) ON contains(s_name, id)
    GROUP BY c_custkey, id
    """,
)
def id_map(t):
    ids = t.customer.select("c_custkey", F.substr("c_name", F.lit(12)).alias("id"))
    mapping = t.supplier.select(
        "s_name", F.concat(F.lit("M"), F.col("s_suppkey").cast("string"), F.lit("-IM6")).alias("target")
    )
    return J.map_ids(ids, mapping, "id", "s_name", "target", "mapped", rewrite=("IM6", "WES")).select(
        "c_custkey", "id", "mapped"
    )


@query(
    "id_convert",
    """
    WITH ids AS (
        SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'P-' || c_custkey || '-WES'
                                            WHEN 'MACHINERY' THEN 's_C_' || c_custkey
                                            ELSE CAST(c_custkey AS VARCHAR) END AS id FROM customer
    ), mapping AS (
        SELECT 's_C_' || o_custkey AS source, min(o_orderkey) AS first_order FROM orders
        WHERE o_orderstatus = 'F' GROUP BY 1
    )
    SELECT c_custkey, id,
           CASE WHEN contains(id, 'WES') THEN replace(id, 'WES', 'IM6')
                WHEN contains(id, 's_C_') THEN 'D-' || first_order END AS converted
    FROM ids LEFT JOIN mapping ON id = source
    """,
)
def id_convert(t):
    key = F.col("c_custkey").cast("string")
    ids = t.customer.select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("P-"), key, F.lit("-WES")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("s_C_"), key))
        .otherwise(key)
        .alias("id"),
    )
    mapping = t.orders.where(F.col("o_orderstatus") == "F").select(
        F.concat(F.lit("s_C_"), F.col("o_custkey").cast("string")).alias("source"),
        F.concat(F.lit("D-"), F.col("o_orderkey").cast("string")).alias("target"),
        "o_orderkey",
    )
    return J.convert_ids(
        ids, mapping, "id", "source", "target", "converted", ["o_orderkey"], ("WES", "IM6"), "s_C_"
    ).select("c_custkey", "id", "converted")


@query(
    "first_match_lookup",
    """
    SELECT c_custkey, coalesce(p, 'no pressing order') AS first_priority, o AS first_order
    FROM customer LEFT JOIN (
        SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p, min(o_orderkey) AS o FROM orders
        WHERE (contains(o_orderpriority, 'URGENT') OR contains(o_orderpriority, 'HIGH')) AND o_orderstatus = 'P'
        GROUP BY o_custkey
    ) ON c_custkey = o_custkey
    """,
)
def first_match_lookup(t):
    pressing = N.matches("o_orderpriority", "URGENT") | N.matches("o_orderpriority", "HIGH")
    dim = t.orders.where(pressing & (F.col("o_orderstatus") == "P")).select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderpriority").alias("first_priority"),
        F.col("o_orderkey").alias("first_order"),
    )
    return J.first_match_lookup(
        t.customer.select("c_custkey"),
        dim,
        "c_custkey",
        F.col("first_order"),
        ["first_priority", "first_order"],
        {"first_priority": "no pressing order"},
    )


@query(
    "union_by_name",
    """
    SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier
    """,
)
def union_by_name(t):
    customers = C.select_renamed(t.customer, {"c_name": "name", "c_nationkey": "nation", "c_acctbal": "balance"})
    suppliers = C.select_renamed(t.supplier, {"s_acctbal": "balance", "s_name": "name", "s_nationkey": "nation"})
    return U.union_by_name(customers, suppliers)


@query(
    "union_fill",
    """
    SELECT c_name AS name, c_acctbal AS balance, c_mktsegment FROM customer
    UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier
    """,
)
def union_fill(t):
    customers = C.select_renamed(
        t.customer, {"c_name": "name", "c_acctbal": "balance", "c_mktsegment": "c_mktsegment"}
    )
    suppliers = C.select_renamed(t.supplier, {"s_name": "name", "s_acctbal": "balance"})
    return U.union_fill(customers, suppliers)


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def distinct_rows(t):
    return U.distinct_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"))


@query("distinct_entities", "SELECT DISTINCT user_id FROM events")
def distinct_entities(t):
    return U.distinct_entities(t.events, "user_id")


@query(
    "two_cohort_union",
    """
    SELECT cohort, nation, count(*) AS n, round(avg(balance), 6) AS mean_balance
    FROM (SELECT 'case' AS cohort, c_nationkey AS nation, c_acctbal AS balance FROM customer
          UNION ALL SELECT 'control', s_nationkey, s_acctbal FROM supplier)
    GROUP BY cohort, nation
    """,
)
def two_cohort_union(t):
    return U.two_cohort_union(
        C.select_renamed(t.customer, {"c_nationkey": "nation", "c_acctbal": "balance"}),
        C.select_renamed(t.supplier, {"s_nationkey": "nation", "s_acctbal": "balance"}),
        lambda df: df.groupBy("cohort", "nation").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.avg("balance"), 6).alias("mean_balance")
        ),
    )


@query(
    "paste_na",
    """
    SELECT p_partkey, coalesce(nullif(p_name, 'small ring'), 'NA') || ' ' || p_type AS text FROM part
    """,
)
def paste_na(t):
    return t.part.select("p_partkey", N.paste_na(F.nullif(F.col("p_name"), F.lit("small ring")), "p_type").alias("text"))


@query(
    "replace_text",
    """
    SELECT p_partkey, regexp_replace(p_name, 'ring|bolt', 'item', 'g') AS name,
           replace(p_name, ' ', chr(10)) AS lines, replace('BRAND ' || p_type, 'BRAND ', '') AS kind
    FROM part
    """,
)
def replace_text(t):
    return t.part.select(
        "p_partkey",
        L.replace_text("p_name", "ring|bolt", "item").alias("name"),
        L.multiline("p_name").alias("lines"),
        L.without_word(F.concat(F.lit("BRAND "), F.col("p_type")), "BRAND").alias("kind"),
    )


@query(
    "relabel",
    """
    SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'BASIC' WHEN 'PROMO' THEN 'OFFER' ELSE p_type END AS kind
    FROM part
    """,
)
def relabel(t):
    return t.part.select("p_partkey", L.relabel("p_type", {"ECONOMY": "BASIC", "PROMO": "OFFER"}).alias("kind"))


@query(
    "significance_label",
    """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN p IS NULL THEN NULL WHEN p <= 0.0001 THEN '****' WHEN p <= 0.001 THEN '***'
                WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS label,
           CASE WHEN p IS NULL THEN NULL WHEN p <= 0.001 THEN '***'
                WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS short_label
    FROM (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.02) * l_tax * l_quantity / 50 AS p FROM lineitem)
    """,
)
def significance_label(t):
    p = F.nullif(F.col("l_discount"), F.lit(0.02)) * F.col("l_tax") * F.col("l_quantity") / 50
    return t.lineitem.select("l_orderkey", "l_linenumber", p.alias("p")).select(
        "l_orderkey",
        "l_linenumber",
        L.significance_label("p").alias("label"),
        L.significance_label("p", L.SHORT_CUTPOINTS).alias("short_label"),
    )


@query(
    "activity_product",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS activity FROM lineitem",
)
def activity_product(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("activity")
    )
