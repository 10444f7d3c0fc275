"""Queries that chain several operators: cycles, validations, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import at, round_doubles
from barloom.functions.stats import exact_quantiles
from barloom.operators import backtest as B
from barloom.operators import candidates as C
from barloom.operators import cpcv as CV
from barloom.operators import exits as E
from barloom.operators import market_state as MS
from barloom.operators import models as ML
from barloom.operators import sharpe as SH
from barloom.operators import splits as S
from barloom.operators import trials as T
from barloom.operators.features import feature_audit, numeric_feature_columns
from barloom.plans import oracle_sql as O
from barloom.plans.evaluation_queries import _CP, FEATURES, W0, _out, _pairs, _timed, _walk
from barloom.plans.feature_queries import _entries, _labelled, _replay
from barloom.plans.registry import query
from barloom.plans.tables import STUDY, path_rows, setups, study_bars, thresholds
from barloom.plans.trade_queries import REC, book
from barloom.session import cut, packed
from barloom.sources.bars import opening_window
from barloom.sources.manifest import boundary_role
from barloom.sources.records import from_ledger, to_ledger


@query("source_opening_window", f"WITH {O.BARS} SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, count(*) AS bars, {O.r6('sum(volume)', 'volume')} FROM bars WHERE sod BETWEEN 0 AND 39600 GROUP BY symbol, session_date")
def source_opening_window(spark, d):
    """Bars of the opening window."""
    b = opening_window(study_bars(spark, d), STUDY, 39600)
    return _out(b.groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume")))


@query("source_boundary_lookup", f"WITH {O.BARS} SELECT symbol AS source_path, CASE symbol WHEN 'error' THEN 'holdout' WHEN 'view' THEN 'validation' END AS boundary_role, count(*) AS bars FROM bars GROUP BY 1")
def source_boundary_lookup(spark, d):
    """Boundary role of each source; unlisted sources have none."""
    m = spark.createDataFrame([("error", "holdout"), ("view", "validation")], "source_path string, boundary_role string")
    n = study_bars(spark, d).groupBy(F.col("symbol").alias("source_path")).agg(F.count(F.lit(1)).alias("bars"))
    return boundary_role(n, m).select("source_path", "boundary_role", "bars")


@query("ledger_round_trip", f"WITH {O.canonical()} SELECT candidate_id, break_sod, {O.r6('entry_price')}, {O.r6('pivot_price')}, direction FROM cands")
def ledger_round_trip(spark, d):
    """Candidates written as ledger records and read back."""
    c = C.canonical(study_bars(spark, d), STUDY).withColumn("variant", F.lit("base"))
    back = from_ledger(to_ledger(c), c.drop("variant").schema)
    return _out(back.select("candidate_id", "break_sod", "entry_price", "pivot_price", "direction"))


@query("feature_numeric_columns", f"{W0} SELECT * FROM (VALUES ('pnl_r'), ('break_efficiency_ratio'), ('reg_vol_10')) v(feature) WHERE (SELECT count(reg_vol_10) FROM setups) > 0")
def feature_numeric_columns(spark, d):
    """Numeric columns with any value, minus the excluded ones."""
    s = setups(spark, d).select("candidate_id", "pnl_r", "label", "break_efficiency_ratio", "reg_vol_10", F.lit(None).cast("double").alias("empty"))
    return spark.createDataFrame([(c,) for c in numeric_feature_columns(s, {"label"})], "feature string")


@query("exit_session_drawdown_stop", f"{W0}, c AS (SELECT *, sum(pnl_r) OVER (PARTITION BY session_date ORDER BY entry_time, candidate_id) AS cum FROM setups), h AS (SELECT *, coalesce(max(CASE WHEN cum <= -1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_date ORDER BY entry_time, candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM c) SELECT candidate_id, cum <= -1 AS session_drawdown_stop_triggered FROM h WHERE st = 0")
def exit_session_drawdown_stop(spark, d):
    """Trades kept by the session drawdown stop."""
    return E.session_drawdown_stop(setups(spark, d), [], limit=-1.0, time="entry_time").select("candidate_id", "session_drawdown_stop_triggered")


@query("exit_right_tail", f"{W0} SELECT setup_subtype, {O.r6('list(pnl_r ORDER BY pnl_r)[CAST(round_even(0.9 * (count(*) - 1), 0) AS INT) + 1]', 'right_tail_p90_r')} FROM setups GROUP BY 1")
def exit_right_tail(spark, d):
    """Nearest-rank 90th percentile of R."""
    return _out(exact_quantiles(setups(spark, d), ["setup_subtype"], "pnl_r", {"right_tail_p90_r": 0.9}, mode="nearest"))


def _cycle(spark, d):
    """Exit policies with their path replay, Sharpes and gates."""
    r = cut(E.with_drawdown_stop(_replay(spark, d)))
    trades = r.filter(F.col("policy") == "fixed_1_5r_tp_sl_baseline").select("candidate_id", "session_date", at("session_date", "decision_sod").alias("entry_time"))
    test = S.cpcv_rows(trades, S.cpcv_paths(spark, 6), 6).filter("role = 'test'").select("path_id", "candidate_id")
    paths = test.join(r.select("policy", "candidate_id", "pnl_r"), "candidate_id").groupBy("policy", "path_id").agg(F.sum("pnl_r").alias("total_pnl_r"))
    roll = S.path_rollup(paths, ["policy"], upper_median=False).withColumnRenamed("status", "cpcv_status")
    dsr = SH.attach_dsr(SH.sharpe_table(r, ["policy"], "pnl_r"), n_trials=len(E.POLICIES))
    # replayed entries whose features reach into the decision
    late = feature_audit(study_bars(spark, d), _entries(spark, d), STUDY).agg((F.count(F.when(F.col("status") != "pass", 1)) == 0).alias("point_in_time"))
    return cut(E.evaluate_policies(r).join(roll, "policy").join(dsr, "policy").crossJoin(F.broadcast(late)))


@query("exit_cycle")
def exit_cycle(spark, d):
    """All exit policies evaluated, replayed on paths, gated and ranked."""
    rows = _cycle(spark, d)
    base = rows.filter("policy = 'fixed_1_5r_tp_sl_baseline'")
    out = E.replay_decision(E.exit_gates(rows), base).join(E.structure_gates(rows, base), "policy")
    order = [(F.col("decision") == "advance_candidate").desc(), F.col("mean_total_pnl_r").desc(), F.col("total_pnl_r").desc(), F.col("policy")]
    return _out(T.rank_trials(out.withColumn("exit_family", E.variant_family()), order).select(
        "rank", "policy", "exit_family", "trade_count", "total_pnl_r", "mean_total_pnl_r", "pbo", "dsr_probability", "decision", "governance_decision",
        "lower_drawdown", "better_right_tail", "worst_path_gt_minus_5r",
    ))


@query("exit_leakage_rollup", f"WITH {O.SETUPS} SELECT 'fail' AS status, 'deep_retrace_repair' AS issues FROM (SELECT count(*) AS n FROM setups) WHERE n > 0")
def exit_leakage_rollup(spark, d):
    """Roll-up of per-policy audits: any failure fails the batch."""
    r = setups(spark, d).groupBy(F.col("setup_subtype").alias("policy")).agg((F.max("setup_subtype") != "deep_retrace_repair").alias("point_in_time"))
    return E.leakage_rollup(r).withColumn("issues", F.array_join("issues", "|"))


@query("validation_v1_gates")
def validation_v1_gates(spark, d):
    """Frozen policy: gate, execute, translate, replay on paths, Sharpe, eight gates."""
    s = setups(spark, d)
    gated = packed(B.lean(MS.apply_gates(s, MS.followthrough_table(spark).filter("gate = 'breakout_quality'")).filter("policy_weight > 0"), "label"))
    sig = B.sized_signals(gated, threshold=0.45).withColumn("run", F.lit("v1"))
    ex = cut(B.executed_trades(sig.select("run", *B.SIGNAL_COLUMNS), ["run"]))
    summary = B.signal_counts(sig, ["run"]).join(B.trade_totals(ex, ["run"]), "run", "left").fillna(0, ["trade_count"])
    paths = S.cpcv_paths(spark, 8)
    lists = CV.given_lists(S.cpcv_spans(B.lean(gated, "label"), paths, 8, embargo_bars=2))
    roll = S.path_rollup(cut(CV.path_backtests(lists, CV.path_names(paths))[1])).withColumnRenamed("status", "cpcv_status").select("cpcv_status", "min_path_pnl_r")
    dsr = SH.attach_dsr(SH.sharpe_table(ex, ["run"], "executed_pnl_r"), n_trials=len(MS.FOLLOWTHROUGH) + len(MS.TRIAL_POLICIES)).select("dsr_status")
    best = B.best_threshold(B.translation_grid(gated, thresholds(spark))).select(F.col("status").alias("translation_status"))
    walk = ML.walk_forward_check(_walk(spark, d)).select(F.col("status").alias("walk_forward_status"))
    leaks = MS.leakage_audit(MS.entry_audit(_timed(spark, d)), FEATURES).select(F.col("status").alias("leakage_status"))
    row = summary.crossJoin(roll).crossJoin(dsr).crossJoin(best).crossJoin(walk).crossJoin(leaks)
    out = row.select("trade_count", "total_pnl_r", "max_drawdown_r", *[v.alias(k) for k, v in T.v1_gates().items()])
    return _out(out)


@query("model_holdout_gbm")
def model_holdout_gbm(spark, d):
    """Boosted trees on the time-ordered split."""
    s = packed(S.holdout_roles(setups(spark, d).select("candidate_id", "session_date", "label", *FEATURES)).select("role", "label", *FEATURES))
    m = ML.fit_classifier(s.filter("role = 'train'"), FEATURES, "gbm")
    return _out(ML.split_metrics(packed(ML.score(m, s.filter("role = 'test'"), FEATURES).select("label", "probability"))))


@query("model_worst_trades")
def model_worst_trades(spark, d):
    """Strongest contributors of the five worst trades."""
    s = cut(S.holdout_split(setups(spark, d)).drop("probability", "prediction"))
    m = ML.fit_classifier(s.filter("role = 'train'"), FEATURES)
    test = s.filter("role = 'test'")
    return _out(ML.worst_trade_explanations(ML.linear_attribution(m, test, FEATURES), test))


@query("model_validity_prior")
def model_validity_prior(spark, d):
    """Validity probabilities from matched examples; defaults elsewhere."""
    s = setups(spark, d).select("candidate_id", *FEATURES)
    marks = setups(spark, d).filter("setup_quality = 'high_quality'").select(
        "candidate_id", F.col("label").alias("manual_validity_label"), (F.col("pnl_r") > 1.2).cast("int").alias("manual_high_quality_label")
    )
    p = ML.validity_prior(s, marks, FEATURES)
    return _out(p.groupBy("manual_example_matched").agg(F.count(F.lit(1)).alias("rows"), F.avg("manual_validity_probability").alias("validity"), F.avg("manual_high_quality_probability").alias("quality")))


@query("labelled_inventory", f"WITH {O.canonical()}, {O.UNIQUE}, {O.labels()} SELECT symbol, setup_subtype, count(*) AS setups, {O.r6('avg(label)', 'positive_rate')}, {O.r6('sum(pnl_r)', 'total_pnl_r')} FROM labelled GROUP BY 1, 2")
def labelled_inventory(spark, d):
    """Labelled candidates per symbol and subtype, end to end from ticks."""
    return round_doubles(_labelled(spark, d).groupBy("symbol", "setup_subtype").agg(
        F.count(F.lit(1)).alias("setups"), F.avg("label").alias("positive_rate"), F.sum("pnl_r").alias("total_pnl_r")
    ))


# ------------------------------------------------------------------ combinatorial paths

_TEST = f"""{_CP}, tr AS (SELECT rn.*, pt.path_id FROM rn JOIN {_pairs()} ON rn.session_group IN (ga, gb)),
dv AS (SELECT path_id FROM tr GROUP BY 1 HAVING count(DISTINCT label) > 1), tt AS (SELECT tr.* FROM tr JOIN dv USING (path_id)),
rk AS (SELECT path_id, label, avg(r) OVER (PARTITION BY path_id, probability) AS r FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY probability) AS r FROM tt)),
au AS (SELECT path_id, (sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS roc_auc FROM rk GROUP BY 1),
pr AS (SELECT path_id, count(*) AS test_rows, CASE WHEN count(*) FILTER (WHERE probability >= 0.5) = 0 THEN 0 ELSE count(*) FILTER (WHERE probability >= 0.5 AND label = 1) / count(*) FILTER (WHERE probability >= 0.5) END AS precision FROM tt GROUP BY 1),
{book("SELECT tt.*, path_id AS run, 0.45e0 AS threshold, 'binary_threshold_v1' AS sizing, 'none' AS throttle, 'none' AS regime_size FROM tt WHERE probability >= 0.45")},
pt2 AS (SELECT run, count(*) AS trade_count, sum(executed_pnl_r) AS total_pnl_r, avg(executed_pnl_r) AS avg_trade_r, avg(CASE WHEN executed_pnl_r > 0 THEN 1 ELSE 0 END) AS win_rate, min(drawdown_r) AS max_drawdown_r, avg(executed_pnl_r) / nullif(stddev_samp(executed_pnl_r), 0) * sqrt(count(*)) AS sharpe_r FROM eq GROUP BY 1),
lg AS (SELECT run, least(min(l), 0) AS largest_loss_cluster_r FROM (SELECT run, w, sum(CASE WHEN executed_pnl_r < 0 THEN executed_pnl_r ELSE 0 END) AS l FROM (SELECT *, sum(CASE WHEN executed_pnl_r < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY entry_time, candidate_id) AS w FROM ex) GROUP BY 1, 2) GROUP BY 1),
pb AS (SELECT pr.path_id, test_rows, roc_auc, precision, coalesce(trade_count, 0) AS trade_count, coalesce(total_pnl_r, 0) AS total_pnl_r, coalesce(avg_trade_r, 0) AS avg_trade_r, coalesce(win_rate, 0) AS win_rate, coalesce(max_drawdown_r, 0) AS max_drawdown_r, sharpe_r, coalesce(largest_loss_cluster_r, 0) AS largest_loss_cluster_r FROM pr JOIN au USING (path_id) LEFT JOIN pt2 ON pt2.run = path_id LEFT JOIN lg ON lg.run = path_id)"""
_PATH_COLUMNS = ["roc_auc", "precision", "total_pnl_r", "avg_trade_r", "win_rate", "max_drawdown_r", "sharpe_r", "largest_loss_cluster_r"]


def _given_paths(spark, d):
    paths = S.cpcv_paths(spark, 8)
    lists = CV.given_lists(S.cpcv_spans(B.lean(setups(spark, d), "label"), paths, 8, embargo_bars=2))
    return CV.path_backtests(lists, CV.path_names(paths))[1]


@query("cpcv_given_probabilities", f"{REC}, {_TEST} SELECT path_id, test_rows, trade_count, {', '.join(O.r6(c) for c in _PATH_COLUMNS)} FROM pb")
def cpcv_given_probabilities(spark, d):
    """Every path's metrics and backtest on the probabilities the records hold."""
    return _out(_given_paths(spark, d).select("path_id", "test_rows", "trade_count", *_PATH_COLUMNS))


def _fitted_paths(spark, d):
    rows = B.lean(setups(spark, d), "label", *FEATURES)
    return CV.path_backtests(*CV.cpcv_lists(rows, FEATURES, n_groups=8, embargo_bars=2))


@query("cpcv_path_backtest")
def cpcv_path_backtest(spark, d):
    """A fit and a backtest per path, all fits in one job."""
    return _out(_fitted_paths(spark, d)[1].select("path_id", "test_rows", "trade_count", *_PATH_COLUMNS))


@query("cpcv_path_audit")
def cpcv_path_audit(spark, d):
    """Roll-up over the fitted paths."""
    return _out(CV.cpcv_audit(cut(_fitted_paths(spark, d)[1])))
