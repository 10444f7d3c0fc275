"""Grids and controls choose trades from rows stored once; only texts with a label are scored for the threshold."""

import pytest
from pyspark.sql import functions as F

from barloom.llm import likelihood
from barloom.operators import backtest as B
from barloom.operators import splits as S
from barloom.plans.tables import setups, thresholds

SF = "/root/testdata/sf0.001"


def test_a_translation_grid_repeats_no_signal(spark, monkeypatch):
    counts, choose = [], B.non_overlapping_lists
    monkeypatch.setattr(B, "non_overlapping_lists", lambda rows, **k: counts.append(rows.count()) or choose(rows, **k))
    rows = setups(spark, SF)
    got = {r["threshold"]: r for r in B.translation_grid(rows, thresholds(spark), sizing="confidence_tiered_v1", throttle="trending_only_v1").collect()}
    assert len(got) == 5 and counts and max(counts) <= rows.count()
    s = B.sized_signals(rows, threshold=0.55, sizing="confidence_tiered_v1", throttle="trending_only_v1").withColumn("run", F.lit("x"))
    want = B.run_backtest(s, ["run"])[1].first()
    assert got[0.55]["trade_count"] == want["trade_count"] > 0 and got[0.55]["throttled_signals"] == want["throttled_signals"]
    assert [got[0.55][c] for c in ("total_pnl_r", "avg_size_multiplier")] == [pytest.approx(want[c], abs=1e-9) for c in ("total_pnl_r", "avg_size_multiplier")]


def test_actual_and_random_runs_equal_two_backtests(spark):
    rows = B.lean(setups(spark, SF))
    both = S.shuffle_probabilities(rows.withColumn("__own", F.col("probability"))).withColumnsRenamed({"probability": "__random", "__own": "probability"})
    got = {r["run"]: (r["trade_count"], r["total_pnl_r"], r["max_drawdown_r"]) for r in B.control_runs(both, "__random", threshold=0.6).collect()}
    for run, preds in (("actual", rows), ("random", S.shuffle_probabilities(rows))):
        w = B.run_backtest(B.sized_signals(preds, threshold=0.6).withColumn("run", F.lit(run)), ["run"])[1].first()
        assert got[run] == (w["trade_count"], pytest.approx(w["total_pnl_r"], abs=1e-9), pytest.approx(w["max_drawdown_r"], abs=1e-9))
    assert B.control_runs(both, "__random", threshold=2.0).count() == 0


def test_texts_without_a_label_are_not_scored_for_the_threshold(spark, monkeypatch):
    counts, score = [], likelihood.scored
    monkeypatch.setattr(likelihood, "scored", lambda rows, *a: counts.append(rows.count()) or score(rows, *a))
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('w', id % 7, ' w', id % 5) AS text")
    labels = spark.range(0, 500, 10).selectExpr("id AS doc_id", "cast(id % 20 = 0 AS int) AS quality", "0 AS toxic")
    assert likelihood.quality_rules(docs, labels).count() == 500
    assert counts[0] < 100 and counts[-1] == 500
