"""Physical plans: what the queries must not contain, and what reaches the scan."""

import contextlib
import io

import pytest

from cohortry.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


CHECKED = [
    "event_counts", "rule_cascade", "refine_class", "inner_join", "inner_join_null_keys", "left_join_default", "natural_left_join",
    "full_outer_join", "semi_join", "anti_join", "contains_join", "id_map", "id_convert", "first_match_lookup",
    "assemble_features", "assembly_report", "category_score_lookup", "mechanism_cascade", "concat_by", "median_iqr",
    "flag_outliers", "indel_fraction", "group_size", "lump_rare", "zscore", "zscore_by_group", "average_rank",
    "rank_sum_ties", "spearman", "linear_fit", "box_summary", "density_profile", "association_report", "two_cohort_union",
]


@pytest.mark.parametrize("name", CHECKED)
def test_no_pair_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert node not in text, text


@pytest.mark.parametrize("name", ["count_by", "group_size", "lump_rare", "zscore", "first_match_lookup", "category_scores"])
def test_groups_are_combined_without_windows(spark, name):
    assert "Window" not in plan(QUERIES[name](spark, FOLDER))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["count_by"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in text
    text = plan(QUERIES["event_counts"](spark, FOLDER))
    assert "In(o_orderpriority, [1-URGENT,2-HIGH])" in text
    assert "StringContains(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_orderpriority:string>" in text


def test_cascade_is_one_projection(spark):
    text = plan(QUERIES["rule_cascade"](spark, FOLDER))
    assert text.count("CASE WHEN") <= 4
