"""Registered queries next to their SQL in DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from barlattice import catalog
from tools.check_queries import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"
ALL = catalog.oracle_sql()
# One or two per family keep the run short; BARLATTICE_ALL=1 runs every query.
SOME = ["v6_quality_score", "b2_heikin_ashi", "b10_fill_forward", "i3_atr", "i19_compression", "g4_bollinger_squeeze",
        "g8_zone_entries", "x7_resting_order_fill", "x9_finer_bar_resolution", "x10_fifo_round_trips", "x12_portfolio_totals",
        "k13_signal_sweep", "m12_performance", "l9_pnl_histogram", "r2_drawdown_episodes", "r13_stress_metrics",
        "c1_strategy_correlation_1d", "a1_decomposition", "a5_alpha_beta", "e4_enriched_trades", "k9_walk_forward_report",
        "p6_rebalance_marks", "s14_run_completeness", "s9_missing_ranges"]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables not present")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ALL) if os.environ.get("BARLATTICE_ALL") else SOME)
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ALL[name])
    cols = [d[0] for d in cur.description]
    assert compare(got, df.columns, cur.fetchall(), cols) is None


def test_flagship_entry(spark):
    import __spark_entry__ as entry_point

    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables not present")
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
