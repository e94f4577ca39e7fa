"""Registered queries beside their SQL, here with several ranges per key; RECORDQC_ALL=1 runs all of them."""

import os

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SHORT = ["a3_load_index", "f5_missing_sequences", "f14_duplicate_files", "f16_identical_parents", "f31_restore_plan", "p7_estimate", "p5_rank_similar", "s3_out_of_sequence",
         "s5_physical_position", "i7_issue_view", "i12_unique_headers", "i13_split_blocks", "i4_duplicate_issues", "p11_consultant_summary", "s11_duplicate_keynotes", "t2_scan_progress"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("RECORDQC_ALL") else SHORT


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    got = check.spark_rows(entry.queries()[name](spark, SF))
    want = check.duck_rows(check.connect(SF), entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert check.rows(got) == check.rows(want)


@pytest.mark.parametrize("name", ["f14_duplicate_files", "f20_match_backups", "p5_rank_similar", "p6_comparable_set", "s2_compare_presence", "s12_keynote_compliance", "i4_duplicate_issues"])
def test_plans_have_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
