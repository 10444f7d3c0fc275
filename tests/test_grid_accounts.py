"""A translation grid chooses its trades once per account, with the results of one backtest per trial."""

import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import fan_out
from barloom.operators import backtest
from barloom.operators import trials as T
from barloom.plans.tables import setups

SPACE = {"decision_threshold": [0.45, 0.55], "sizing_policy": ["binary_threshold_v1", "fractional_kelly_proxy_v1"],
         "regime_throttle_policy": ["none", "trending_only_v1"], "regime_size_policy": ["none", "high_vol_haircut_v1"]}
NAMES = ["trial", "signal_count", "throttled_signals", "trade_count", "total_pnl_r", "avg_size_multiplier", "max_drawdown_r", "session_count", "positive_sessions", "overlap_skips"]


def test_trades_are_chosen_per_account(spark, monkeypatch):
    preds = setups(spark, "/root/testdata/sf0.001").withColumns({
        "policy_size_multiplier": F.when(F.col("trade_no") % 5 == 0, 0.0).when(F.col("trade_no") % 7 == 0, 0.5),
        "probability": F.when(F.col("trade_no") % 11 == 0, float("nan")).otherwise(F.col("probability")),
        "entry_time": F.expr("entry_time - make_dt_interval(0, 0, 0, 30 * (trade_no % 3))")})
    runs, choose = [], backtest.non_overlapping
    monkeypatch.setattr(backtest, "non_overlapping", lambda rows, *, run, **k: runs.append(rows.select(run).distinct().count()) or choose(rows, run=run, **k))
    grid = T.trial_grid(spark, "translation_policy", SPACE)
    got = T.grid_backtest(preds, grid)
    assert got.columns[: len(grid.columns)] == grid.columns
    got = [tuple(r) for r in got.select(NAMES).orderBy("trial").collect()]
    assert runs == [4]
    s = backtest.sized_signals(fan_out(backtest.lean(preds), grid), threshold="decision_threshold", sizing=F.col("sizing_policy"),
                               throttle=F.col("regime_throttle_policy"), regime_size=F.col("regime_size_policy"))
    want = [tuple(r) for r in backtest.run_backtest(s, ["trial"])[1].select(NAMES).orderBy("trial").collect()]
    assert len(got) == 16 and got == [pytest.approx(w, abs=1e-9) for w in want]


def test_a_trial_without_signals_has_a_row(spark):
    grid = T.trial_grid(spark, "translation_policy", {"decision_threshold": [0.5, 2.0], "sizing_policy": ["binary_threshold_v1"]})
    rows = T.grid_backtest(setups(spark, "/root/testdata/sf0.001"), grid).orderBy("trial").collect()
    assert rows[0]["trade_count"] > 0 and rows[1]["trade_count"] is None and rows[1]["utility_score"] is None
