"""Plans: what is read, what is pushed to the scan, and what is not shuffled."""

import os

import pytest

from tidepool.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_split_reads_two_columns_without_a_shuffle(spark):
    text = plan(catalogue.queries()["p6_found"](spark, DATA))
    assert "ReadSchema: struct<id:bigint,tags:string>" in text and "Exchange" not in text


def test_filters_reach_the_scan(spark):
    text = plan(catalogue.queries()["read_active"](spark, DATA))
    assert "EqualTo(owner,qiaoyun)" in text and "EqualTo(status,active)" in text and "heat" not in text.split("ReadSchema")[1]


def test_decay_is_one_projection(spark):
    text = plan(catalogue.queries()["heat_decay"](spark, DATA))
    assert "GreaterThan(heat,0.0)" in text and "Exchange" not in text


@pytest.mark.parametrize("name", ["read_recent", "read_recent_all_status"])
def test_limits_of_groups_apply_before_the_shuffle(spark, name):
    text = plan(catalogue.queries()[name](spark, DATA))
    assert text.rindex("WindowGroupLimit") > text.rindex("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["selector_predict", "bm25_scores", "graph_sense"])
def test_pairs_are_not_made_by_cross_joins(spark, name):
    assert "CartesianProduct" not in plan(catalogue.queries()[name](spark, DATA))
