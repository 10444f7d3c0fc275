"""Small hand-made inputs with hand-derived expectations."""

from dataclasses import replace

import pytest
from market_fixtures import SPEC, bars_frame
from pyspark.sql import functions as F

from barloom.operators import candidates as C
from barloom.operators import diagnostics as D
from barloom.operators import features as X
from barloom.operators import labels as L
from barloom.operators import market_state as MS
from barloom.operators import matching as M
from barloom.operators import sessions as S
from barloom.operators import sharpe as SH
from barloom.operators import calibration as K
from barloom.operators import trials as T
from barloom.operators.attempts import event_driven_candidates
from barloom.operators.zones import opening_zones

OHLC = [(100, 102, 99, 101), (101, 103, 100, 102), (102, 104, 101, 103), (103, 105, 102, 104), (104, 106, 102, 103), (103, 104, 101, 102),
        (102, 105, 101, 104), (104, 106, 103, 105), (105, 107, 104, 106), (106, 109, 105, 108), (108, 111, 107, 110), (109, 112, 108, 111)]


def _bars(spark, rows, start=34200):
    return bars_frame(spark, [dict(symbol="A", day="2026-01-02", sod=start + 30 * i, open=float(o), high=float(h), low=float(lo), close=float(c), volume=1000.0)
                              for i, (o, h, lo, c) in enumerate(rows)])


def test_zone_candidate_label_and_features(spark):
    spec = replace(SPEC, earliest=SPEC.decision)
    b = _bars(spark, OHLC)
    z = opening_zones(b, spec).collect()
    assert len(z) == 1 and (z[0].zone_high, z[0].zone_low, z[0].decision_sod) == (103.0, 99.0, 34260)
    c = C.canonical(b, spec).cache()
    assert c.count() >= 1 and c.filter(F.col("decision_sod") < 34260).count() == 0
    lab = L.triple_barrier(b, c, spec, horizon=4, target_multiple=1.0).collect()
    assert len(lab) == c.select("candidate_id").distinct().count()
    a = X.feature_audit(b, c, spec)
    assert a.filter("status = 'fail'").count() == 0
    f = X.feature_matrix(b, c, spec)
    assert f.count() == len(lab) and set(X.FAMILY_COLUMNS["regime_features"]) <= set(f.columns)


def test_no_pullback_no_candidate(spark):
    rising = [(100 + i, 102 + i, 99 + i, 101 + i) for i in range(8)]
    assert C.canonical(_bars(spark, rising), SPEC).count() == 0


def test_event_engine_emits_two_attempts(spark):
    rows = [(100, 102, 99, 101), (101, 103, 100, 102), (103, 105, 103, 104), (104, 106, 103, 105), (105, 105, 102, 103), (103, 104, 102, 102.5),
            (102.5, 105, 102, 104.5), (104.5, 106, 104, 105), (105, 105, 102, 102.5), (102.5, 105, 102, 104), (104, 106, 103.5, 105)]
    b = _bars(spark, rows)
    got = event_driven_candidates(b, opening_zones(b, SPEC), replace(SPEC, latest=37800), cap=3).collect()
    assert len(got) >= 2 and {r.candidate_engine for r in got} == {"event_driven_v1"}


def test_attempt_classes_and_clusters(spark):
    f = spark.createDataFrame(
        [("c1", "long", "clean", 120, 0.8, 0.8, 0, 0.1, 0.7, 1, 1), ("c2", "long", "deep", 600, 0.4, 0.5, 1, 0.9, 0.4, 0, 1),
         ("c3", "short", "weak", 1200, 0.2, 0.2, 1, 0.3, 0.1, 1, 0), ("c4", "short", "weak", 1300, 0.2, 0.2, 1, 0.3, 0.1, 1, 0)],
        "candidate_id string, direction string, setup_subtype string, trigger_seconds_after_open int, break_efficiency_ratio double, reclaim_close_location double, "
        "reclaim_failure_count int, deepest_zone_retrace_fraction double, post_reclaim_close_strength double, reg_high_vol_state int, reg_trending_state int",
    )
    lab = spark.createDataFrame([("c1", 1, "target", 1.5, 4), ("c2", 0, "stop", -1.0, 3), ("c3", 0, "stop", -1.0, 5), ("c4", 0, "stop", -0.8, 6)],
                                "candidate_id string, label int, outcome string, pnl_r double, bars_held int")
    p = spark.createDataFrame([(f"c{i}", "2026-01-02", 0.7, 1) for i in range(1, 5)], "candidate_id string, session_date string, probability double, prediction int")
    a = D.build_attempts(p, lab, f).cache()
    r = {x.candidate_id: x for x in a.collect()}
    assert (r["c1"].time_bucket, r["c1"].path_class, r["c1"].setup_state, r["c1"].environment_state) == ("early_open", "runner", "continuation", "trend_expansion")
    assert (r["c2"].failure_reason, r["c2"].setup_state) == ("deep_retrace_failure", "repair")
    assert (r["c3"].environment_state, r["c3"].setup_state) == ("volatile_chop", "weak_confirmation")
    cl = D.failure_clusters(a).collect()
    assert [c.family for c in cl] == ["weak_continuation"] and cl[0].rows == 2 and cl[0].recommended_family == "feature"


def test_market_state_tolerates_missing_columns(spark):
    df = spark.createDataFrame([("a", 2.0, 0.9, 0.8, 1.5, 1.0, 0.2, 0.9, 1, 0.1, 1, 1.5), ("b", 0.3, 0.1, 0.2, -0.5, 9.0, 0.9, 0.1, 3, 0.9, 0, -1.0)],
                               "candidate_id string, break_range_expansion double, break_efficiency_ratio double, break_body_fraction double, reg_trend_strength_30 double, "
                               "reg_chop_30 double, pivot_symmetry double, post_reclaim_close_strength double, reclaim_count int, deepest_zone_retrace_fraction double, label int, pnl_r double")
    s = MS.assign_states(MS.market_features(df)).cache()
    got = {r.candidate_id: r.market_state for r in s.collect()}
    assert set(got.values()) <= set(MS.MARKET_STATES) and got["a"] != got["b"]
    sim = MS.policy_simulation(s).filter("market_state = 'all'")
    assert sim.count() == 7
    assert MS.forbidden_features([c for cs in MS.FEATURE_GROUPS.values() for c in cs]) == []


def test_score_buckets_monotone(spark):
    df = spark.createDataFrame([("a", 0.1, 0, -1.0), ("b", 0.2, 0, -0.5), ("c", 0.7, 1, 1.0), ("d", 0.9, 1, 1.5)], "candidate_id string, probability double, label int, pnl_r double")
    b = K.score_buckets(df)
    assert [r.positive_rate for r in b.orderBy("bucket").collect()] == [0.0, 1.0]
    assert K.bucket_monotonicity(b).first().monotonic


def test_deflated_sharpe_punishes_trials(spark):
    t = spark.createDataFrame([("a", 60, 1.4), ("b", 60, 0.6)], "trial string, n_obs bigint, observed_sharpe double")
    few = {r.trial: r.dsr_probability for r in SH.attach_dsr(t, n_trials=2).collect()}
    many = {r.trial: r.dsr_probability for r in SH.attach_dsr(t, n_trials=200).collect()}
    assert many["a"] < few["a"]
    r = SH.sharpe_table(spark.createDataFrame([("g", 1.0), ("g", 2.0)], "k string, p double"), ["k"], "p").first()
    assert r.observed_sharpe > 0 and r.skew == 0.0 and r.kurtosis == 3.0


def test_session_slice_and_quality(spark):
    rows = [dict(symbol="A", day=d, sod=34200 + 30 * i, open=1.0, high=1.0, low=1.0, close=1.0, volume=1.0) for d in ("2024-01-02", "2024-01-03", "2024-01-04") for i in range(3)]
    b = bars_frame(spark, rows + rows[:1])
    assert {str(r.session_date) for r in S.slice_sessions(b, 2).select("session_date").distinct().collect()} == {"2024-01-03", "2024-01-04"}
    q = S.quality_report(b, SPEC).first()
    assert (q.rows, q.sessions, q.duplicate_timestamps, q.opening_zone_sessions) == (10, 3, 1, 3)
    assert q.missing_regular_session_bars == 3 * (780 - 3) and "duplicate_timestamps" in q.quality_flags


def test_tags_and_words(spark):
    df = spark.createDataFrame([("A b, ,Great structure strength!", None, ""), (None, "x--y", "No"), ("z", None, "odd")], "valid_reason string, invalid_reason string, setup_valid string")
    r = M.normalize_examples(df).collect()
    assert (r[0].valid_reason_tags, r[0].setup_valid_normalized, r[0].quality_bucket) == ("a_b|great_structure_strength", "yes", "high_quality")
    assert (r[1].invalid_reason_tags, r[1].quality_bucket, r[1].primary_valid_reason) == ("x_y", "avoid", "")
    assert (r[2].setup_valid_normalized, r[2].quality_bucket) == ("odd", "valid")


def test_grid_is_bounded_and_ordered(spark):
    g = T.trial_grid(spark, "translation_policy").collect()
    assert len(g) == 108 and len(T.trial_grid(spark, "translation_policy", cap=12).collect()) == 12 and g[0].decision_threshold == 0.45 and g[0].sizing_policy == "binary_threshold_v1"
    with pytest.raises(ValueError):
        T.trial_grid(spark, "nothing")


def test_promotion_ladder(spark):
    base = dict(blocking=False, frozen_spec_approval=True, leakage="pass", purging="pass", robustness="pending", walk_forward="pass", cpcv="pass", deflated_sharpe="pass",
                overfitting="pass", multiple_testing="pass", promotable_method=True, random_signal="pass", calibration="pass", translation="pass", net_avg_pnl_r=0.1, auto_accept=False)
    cases = [({}, "advance_to_validation"), ({"auto_accept": True}, "accept"), ({"leakage": "fail"}, "reject"), ({"cpcv": "fail"}, "freeze"),
             ({"translation": "fail"}, "reject"), ({"blocking": True}, "revise"), ({"net_avg_pnl_r": -1.0}, "reject")]
    df = spark.createDataFrame([{**base, **c} for c, _ in cases])
    assert [r[0] for r in df.select(T.promotion_decision()).collect()] == [w for _, w in cases]
