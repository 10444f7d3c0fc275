"""Views of a report compute their own profile, and residual losses store what their clusters read."""

from barloom.operators import market_state as MS
from barloom.operators import replay as R
from barloom.plans import evaluation_queries as EQ
from barloom.plans import trade_queries as TQ
from barloom.plans.tables import path_rows, setups

SMALL = "/root/testdata/sf0.001"


def test_stress_view_replays_one_profile_on_lean_rows(spark, monkeypatch):
    seen, real = [], R.replayed
    monkeypatch.setattr(R, "replayed", lambda t, **k: seen.append((t.columns, k["fill"].profile)) or real(t, **k))
    TQ.replay_stress_view(spark, SMALL)
    assert [p for _, p in seen] == ["stressed"]
    assert "impulse_speed_score" not in seen[0][0]


def test_coherence_stores_lean_survivors(spark, monkeypatch):
    stored, real = [], EQ.cut
    monkeypatch.setattr(EQ, "cut", lambda df: stored.append(df.columns) or real(df))
    got = EQ.residual_coherence(spark, SMALL).collect()
    s = setups(spark, SMALL)
    worst = MS.worst_path(path_rows(s))
    want = EQ._out(MS.structural_coherence(MS.residual_clusters(MS.residual_losses(path_rows(s), s, worst)), MS.residual_support(path_rows(s), s, worst))).collect()
    assert got == want
    assert len(stored) == 1 and "entry_time" not in stored[0]
