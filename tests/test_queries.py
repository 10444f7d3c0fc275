"""Named queries against their oracle SQL on the small tables."""

import math

import pytest
from market_fixtures import SF_DIR

from barloom.plans import all_queries

duckdb = pytest.importorskip("duckdb")
TABLES = ("events", "orders", "documents", "labels")
NAMES = [
    "entry_first_break_outcome", "session_quality_report", "zone_opening", "candidate_canonical", "universe_summary", "label_triple_barrier",
    "feature_context", "feature_market_raw", "indicator_rolling", "policy_tail_cleanup", "backtest_executed_trades", "backtest_stitched_performance",
    "split_walk_forward", "split_combinatorial_per_group", "metric_auc_documents", "calibration_review", "market_state_assignment",
    "residual_clusters", "diagnostic_failure_clusters", "market_gate_leakage", "market_leakage_audit", "market_reliability_warnings", "trial_state_cycle", "cpcv_given_probabilities",
    "indicator_snapshot", "indicator_recursive", "match_bar_alignment", "exit_policy_evaluation", "source_bar_cache", "source_path_rows", "source_ledger_cache", "source_report",
    "source_manual_examples", "source_registry", "attribution_dominant_axes", "ledger_branch_status", "gate_promotion_decision", "replay_report",
]


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    queries, oracles = all_queries()
    df = queries[name](spark, SF_DIR)
    cur = con.execute(oracles[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    got, want = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(cols, cur.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and abs(x - y) <= 1e-5 * max(1.0, abs(x)))


def test_every_oracle_has_a_query():
    queries, oracles = all_queries()
    assert set(oracles) <= set(queries) and len(queries) > 200
