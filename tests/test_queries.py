"""A cross-section of registered queries against their SQL twins; tools/check.py runs all of them."""
import os

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
CHOSEN = ["c02_signals_history", "c01_signals_on_day", "c05_fundamental_candidates", "c07_quality_targets_value", "c10_barrier_outcomes",
          "c11_non_overlapping", "c13_rebalance_periods", "c18_rebalance_orders", "c22_setting_effects", "c31_decision_features", "w12_percentile_rank",
          "a22_performance_report", "s20_incremental_ingest", "s21_sliding_alerts", "j01_next_bar"]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 190


@needs_data
def test_entry(spark):
    assert "heat_score" in entry.entry(spark).columns


@needs_data
@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, name):
    error, _ = check.compare(entry.queries()[name](spark, SF), check.connect(SF), entry.oracle_sql()[name])
    assert not error
