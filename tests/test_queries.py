"""Registered queries against their SQL. CROSSPANEL_ALL=1 runs every one (sf0.001)."""

import os

import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

ROOT = "/root/testdata/sf0.001"
CORE = ["bars", "labelled_features", "ticker_features", "relative_strength", "cross_percentile_rank", "relevance_grades", "triple_barrier", "sample_weights", "purged_folds",
        "daily_ic", "return_summary", "period_returns", "select_horizon", "running_balance", "trade_kpis", "resolve_outcomes", "ks_statistic", "cusum", "next_trading_day", "promotion_gate"]


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "fwd_ret" in df.columns


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("CROSSPANEL_ALL") else CORE)
def test_query_matches_sql(spark, con, name):
    msg, _ = compare(queries()[name](spark, ROOT), con, oracle_sql()[name])
    assert not msg, msg
