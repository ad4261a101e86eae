"""Rank tests, correlation, regression, box and density summaries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortry.catalog.registry import query
from cohortry.functions.distributions import ERF_A, ERF_P, Z_975
from cohortry.functions.labels import SHORT_CUTPOINTS
from cohortry.functions.nulls import in_list
from cohortry.operators import comparisons as T


def upper_tail_sql(z: str) -> str:
    """Oracle form of the normal upper tail."""
    x = f"(abs({z}) / sqrt(2.0))"
    k = f"(1.0 / (1.0 + {ERF_P} * {x}))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {a!r}) * {k})"
    tail = f"(0.5 * {poly} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1.0 - {tail} END)"


def label_sql(p: str, cuts=((0.0001, "****"), (0.001, "***"), (0.01, "**"), (0.05, "*"))) -> str:
    whens = " ".join(f"WHEN {p} <= {c} THEN '{s}'" for c, s in sorted(cuts))
    return f"CASE WHEN {p} IS NULL THEN NULL {whens} ELSE 'ns' END"


def rank_sum_sql(source: str, ref: str, alternative: str = "greater", keep: str = "cls") -> str:
    """Oracle by explicit mid-ranks of every class pooled with the reference.

    ``source`` yields (cls, v).
    """
    sign = {"greater": "- 0.5", "less": "+ 0.5"}[alternative]
    tail = upper_tail_sql("z") if alternative == "greater" else upper_tail_sql("(-z)")
    return f"""
        SELECT {keep}, n, n_ref, u, round(z, 6) AS z, round(p, 6) AS p_value, {label_sql('p')} AS label
        FROM (
            SELECT *, {tail} AS p FROM (
                SELECT cls, n, n_ref, u,
                       (u - n * n_ref / 2.0 {sign})
                       / sqrt(n * n_ref / 12.0 * (n + n_ref + 1 - ties / ((n + n_ref) * (n + n_ref - 1.0)))) AS z
                FROM (
                    SELECT cls, count(*) FILTER (own) AS n, count(*) FILTER (NOT own) AS n_ref,
                           sum(r) FILTER (own) - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2.0 AS u,
                           sum(CAST(t AS DOUBLE) * t - 1) AS ties
                    FROM (
                        SELECT cls, own, count(*) OVER (PARTITION BY cls, v) AS t,
                               rank() OVER (PARTITION BY cls ORDER BY v)
                               + (count(*) OVER (PARTITION BY cls, v) - 1) / 2.0 AS r
                        FROM (
                            SELECT cls, v, true AS own FROM ({source}) WHERE cls <> '{ref}'
                            UNION ALL
                            SELECT c.cls, s.v, false FROM ({source}) s
                            JOIN (SELECT DISTINCT cls FROM ({source}) WHERE cls <> '{ref}') c ON s.cls = '{ref}'
                        )
                    )
                    GROUP BY cls
                )
            )
        )
    """


def _rounded_tests(tests, group: str):
    return tests.select(
        group, "n", "n_ref", "u", F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"), "label"
    )


@query(
    "rank_sum_vs_ref",
    rank_sum_sql(
        "SELECT o_orderpriority AS cls, o_totalprice AS v FROM orders", "5-LOW", keep="cls AS o_orderpriority"
    ),
)
def rank_sum_vs_ref(t):
    tests = T.rank_sum_vs_ref(t.orders, "o_orderpriority", "o_totalprice", "5-LOW", method="normal")
    return _rounded_tests(tests, "o_orderpriority")


@query(
    "rank_sum_ties",
    rank_sum_sql(
        "SELECT l_returnflag AS cls, l_quantity AS v FROM lineitem", "N", "less", keep="cls AS l_returnflag"
    ),
)
def rank_sum_ties(t):
    tests = T.rank_sum_vs_ref(t.lineitem, "l_returnflag", "l_quantity", "N", "less", method="normal")
    return _rounded_tests(tests, "l_returnflag")


# all ways to choose the class's ranks among the pooled ones, by a recursive count of rank sums
_EXACT_SQL = """
    WITH RECURSIVE source AS (
        SELECT n_regionkey AS cls, ((n_nationkey * 7919) % 1009) * 1.0 AS v FROM nation),
    pairs AS (
        SELECT a.cls, count(*) FILTER (a.v > b.v) AS u FROM source a JOIN source b ON a.cls <> 0 AND b.cls = 0 GROUP BY 1),
    sizes AS (
        SELECT cls, count(*) AS n, (SELECT count(*) FROM source WHERE cls = 0) AS n_ref FROM source WHERE cls <> 0 GROUP BY 1),
    ways(cls, place, chosen, below, w) AS (
        SELECT cls, 0, 0, 0, 1::DOUBLE FROM sizes
        UNION ALL
        SELECT cls, place, chosen, below, sum(w) FROM (
            SELECT w.cls, place + 1 AS place, chosen + pick AS chosen,
                   below + CASE WHEN pick = 1 THEN place - chosen ELSE 0 END AS below, w
            FROM ways w JOIN sizes USING (cls), (SELECT unnest([0, 1]) AS pick)
            WHERE place < n + n_ref AND chosen + pick <= n AND place + 1 - chosen - pick <= n_ref)
        GROUP BY ALL)
    SELECT s.cls AS n_regionkey, s.n, s.n_ref, CAST(p.u AS DOUBLE) AS u,
           round(sum(w) FILTER (below >= p.u) / sum(w), 9) AS p_value
    FROM ways JOIN sizes s USING (cls) JOIN pairs p USING (cls)
    WHERE place = s.n + s.n_ref AND chosen = s.n GROUP BY ALL
"""


@query("rank_sum_exact", _EXACT_SQL)
def rank_sum_exact(t):
    spread = (F.col("n_nationkey") * 7919 % 1009).cast("double")  # tie-free
    tests = T.rank_sum_vs_ref(t.nation.withColumn("v", spread), "n_regionkey", "v", 0, method="exact")
    return tests.select("n_regionkey", "n", "n_ref", "u", F.round("p_value", 9).alias("p_value"))


_T_TAIL_SQL = f"""
    2.0 * {upper_tail_sql('dev')}
"""


@query(
    "spearman",
    f"""
    WITH ranked AS (
        SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
               rank() OVER (ORDER BY l_extendedprice)
               + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry
        FROM lineitem
    ), r AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM ranked),
    s AS (SELECT n, rho, rho * sqrt(n - 2) / sqrt(1 - rho * rho) AS t, n - 2.5 AS a FROM r),
    y AS (SELECT *, a * ln(1 + t * t / (n - 2)) AS y, 48 * a * a AS b FROM s),
    d AS (SELECT *, (((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b + 1.0)
                    * sqrt(y) AS dev FROM y)
    SELECT n, round(rho, 6) AS rho, round(t, 6) AS t, round({_T_TAIL_SQL}, 6) AS p_value FROM d
    """,
)
def spearman(t):
    result = T.spearman(t.lineitem, "l_quantity", "l_extendedprice")
    return result.select("n", *(F.round(c, 6).alias(c) for c in ("rho", "t", "p_value")))


LINEAR_FIT_SQL = """
    SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n,
           regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
           regr_r2(l_extendedprice, l_quantity) AS r2, regr_avgx(l_extendedprice, l_quantity) AS mean_x,
           regr_sxx(l_extendedprice, l_quantity) AS sxx,
           min(l_quantity) AS min_x, max(l_quantity) AS max_x,
           sqrt((regr_syy(l_extendedprice, l_quantity)
                 - pow(regr_slope(l_extendedprice, l_quantity), 2) * regr_sxx(l_extendedprice, l_quantity))
                / (regr_count(l_extendedprice, l_quantity) - 2)) AS sigma
    FROM lineitem GROUP BY l_returnflag
"""


@query(
    "linear_fit",
    f"""
    SELECT l_returnflag, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2,
           round(mean_x, 6) AS mean_x, round(sigma, 4) AS sigma FROM ({LINEAR_FIT_SQL})
    """,
)
def linear_fit(t):
    fit = T.linear_fit(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")
    digits = {"slope": 6, "intercept": 4, "r2": 6, "mean_x": 6, "sigma": 4}
    return fit.select("l_returnflag", "n", *(F.round(c, d).alias(c) for c, d in digits.items()))


def t975_sql(v: str) -> str:
    z = Z_975
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    return f"({z!r}" + "".join(f" + {g!r} / pow({v}, {i + 1})" for i, g in enumerate(terms)) + ")"


@query(
    "linear_fit_band",
    f"""
    SELECT l_returnflag, point, round(x, 6) AS x, round(y, 3) AS fit, round(y - half, 3) AS lower, round(y + half, 3) AS upper
    FROM (SELECT *, intercept + slope * x AS y,
                 {t975_sql('(n - 2)')} * sigma * sqrt(1.0 / n + (x - mean_x) * (x - mean_x) / sxx) AS half
          FROM (SELECT *, min_x + point * (max_x - min_x) / 79.0 AS x
                FROM ({LINEAR_FIT_SQL}), (SELECT CAST(unnest(range(80)) AS INTEGER) AS point)))
    """,
)
def linear_fit_band(t):
    band = T.linear_fit_band(t.lineitem, "l_quantity", "l_extendedprice", by="l_returnflag")
    return band.select(
        "l_returnflag", "point", F.round("x", 6).alias("x"), *(F.round(c, 3).alias(c) for c in ("fit", "lower", "upper"))
    )


def box_sql(source: str, keys: str) -> str:
    """Oracle of the box numbers; ``source`` yields the key columns and v."""
    return f"""
        SELECT {keys}, n, q1, median, q3,
               least(q1, (SELECT min(v) FROM ({source}) r WHERE {_same(keys, 'r', 'q')}
                          AND v >= q1 - 1.5 * (q3 - q1))) AS whisker_low,
               greatest(q3, (SELECT max(v) FROM ({source}) r WHERE {_same(keys, 'r', 'q')}
                             AND v <= q3 + 1.5 * (q3 - q1))) AS whisker_high
        FROM (SELECT {keys}, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
                     quantile_cont(v, 0.75) AS q3 FROM ({source}) GROUP BY {keys}) q
    """


def _same(keys: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} IS NOT DISTINCT FROM {b}.{k.strip()}" for k in keys.split(","))


BOX_COLUMNS = ("q1", "median", "q3", "whisker_low", "whisker_high")


def _rounded_box_sql(sql: str, keys: str) -> str:
    return f"SELECT {keys}, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in BOX_COLUMNS) + f" FROM ({sql})"


@query(
    "box_summary",
    _rounded_box_sql(
        box_sql(
            "SELECT c_mktsegment, CASE WHEN c_custkey < 5 THEN c_acctbal * 10 ELSE c_acctbal END AS v FROM customer",
            "c_mktsegment",
        ),
        "c_mktsegment",
    ),
)
def box_summary(t):
    # a few stretched balances give the boxes outliers to leave out
    stretched = t.customer.select(
        "c_mktsegment", F.when(F.col("c_custkey") < 5, F.col("c_acctbal") * 10).otherwise(F.col("c_acctbal")).alias("v")
    )
    box = T.box_summary(stretched, "c_mktsegment", "v")
    return box.select("c_mktsegment", "n", *(F.round(c, 6).alias(c) for c in BOX_COLUMNS))


_DENSITY_SQL = f"""
    WITH rows_ AS (SELECT p_type, p_retailprice AS v FROM part),
    s AS (SELECT p_type, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd,
                 quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM rows_ GROUP BY 1),
    b AS (SELECT *, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS bw, (hi - lo) / 511.0 AS w, (hi - lo) / 511.0 AS g FROM s),
    placed AS (SELECT p_type, (v - lo) / w AS place, least(floor((v - lo) / w), 510) AS node FROM rows_ JOIN b USING (p_type)),
    halves AS (SELECT p_type, node, 1 - (place - node) AS weight FROM placed
               UNION ALL SELECT p_type, node + 1, place - node FROM placed),
    nodes AS (SELECT p_type, node, sum(weight) AS weight FROM halves GROUP BY 1, 2),
    grid AS (SELECT unnest(range(512)) AS point)
    SELECT p_type, point, round(any_value(lo + point * g), 6) AS x,
           round(1000 * sum(weight * exp(-pow((lo + point * g - (lo + node * w)) / bw, 2) / 2)
                            / (n * bw * {math.sqrt(2 * math.pi)!r})), 6) AS density_per_mille
    FROM nodes JOIN b USING (p_type), grid GROUP BY p_type, point
"""


@query("density_profile", _DENSITY_SQL)
def density_profile(t):
    profile = T.density_profile(t.part, "p_type", "p_retailprice")
    return profile.select(
        "p_type", "point", F.round("x", 6).alias("x"), F.round(F.col("density") * 1000, 6).alias("density_per_mille")
    )


def order_measures(t):
    """One row per order: two classes, a scope flag and three measures."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("mean_discount")
    )
    return t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice").join(lines, "o_orderkey")


_MEASURES_SQL = """
    SELECT o_orderpriority, o_orderstatus, o_totalprice, quantity, mean_discount
    FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity, avg(l_discount) AS mean_discount
                      FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
"""

REPORT_SCOPE = ["F", "O"]


def report_comparisons():
    finished = in_list("o_orderstatus", REPORT_SCOPE)
    return [
        T.Comparison("price", "o_totalprice", "o_orderpriority", "5-LOW", 50000, 450000),
        T.Comparison("quantity", "quantity", "o_orderpriority", "5-LOW", 1, 200, cutpoints=SHORT_CUTPOINTS),
        T.Comparison("price", "o_totalprice", "o_orderpriority", "5-LOW", 50000, 450000, scope="settled", scope_filter=finished),
        T.Comparison("quantity", "quantity", "o_orderstatus", "F", 1, 200, "less", scope="status"),
    ]


def _report_sql() -> str:
    parts = []
    for value, cls, where, metric, scope, ref, alternative, cuts in [
        ("o_totalprice", "o_orderpriority", "o_totalprice BETWEEN 50000 AND 450000", "price", "all", "5-LOW", "greater", None),
        ("quantity", "o_orderpriority", "quantity BETWEEN 1 AND 200", "quantity", "all", "5-LOW", "greater", SHORT_CUTPOINTS),
        ("o_totalprice", "o_orderpriority", "o_totalprice BETWEEN 50000 AND 450000 AND o_orderstatus IN ('F', 'O')",
         "price", "settled", "5-LOW", "greater", None),
        ("quantity", "o_orderstatus", "quantity BETWEEN 1 AND 200", "quantity", "status", "F", "less", None),
    ]:
        source = f"SELECT {cls} AS cls, {value} AS v FROM ({_MEASURES_SQL}) WHERE {where}"
        label = label_sql("p_value", cuts) if cuts else "label"
        parts.append(
            f"""
            SELECT '{metric}' AS metric, '{scope}' AS scope, b.cls AS class, b.n, q1, median, q3, whisker_low, whisker_high,
                   n_ref, u, z, p_value, {label} AS label
            FROM ({_rounded_box_sql(box_sql(source, 'cls'), 'cls')}) b
            LEFT JOIN ({rank_sum_sql(source, ref, alternative)}) r ON b.cls = r.cls
            """
        )
    return " UNION ALL ".join(parts)


@query("association_report", _report_sql())
def association_report(t):
    report = T.association_report(order_measures(t), report_comparisons(), method="normal")
    return report.select(
        "metric",
        "scope",
        "class",
        "n",
        *(F.round(c, 6).alias(c) for c in BOX_COLUMNS),
        "n_ref",
        "u",
        F.round("z", 6).alias("z"),
        F.round("p_value", 6).alias("p_value"),
        "label",
    )
