"""Studies from ticks to trades: candidates, labels, features, fits out of sample, backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import fan_out
from barloom.operators import labels as L
from barloom.operators import studies as ST
from barloom.operators import trials as T
from barloom.operators import universe as U
from barloom.operators.backtest import executed_trades, sized_signals
from barloom.operators.candidates import first_per_id
from barloom.operators.features import FAMILY_COLUMNS, FAMILY_PARTS, feature_matrix, numeric_feature_columns
from barloom.operators.models import NOT_FEATURES
from barloom.plans.evaluation_queries import _out
from barloom.plans.registry import query
from barloom.plans.study_queries import _cands, _universe
from barloom.plans.tables import STUDY, study_bars, thresholds
from barloom.session import cut


def _features(bars, cands, key=None):
    """Features of every candidate and the names of the numeric ones."""
    m = cut(feature_matrix(bars, cands, STUDY, key))
    return m, numeric_feature_columns(m, NOT_FEATURES)


def _labelled_features(spark, d, policies=None):
    """(one row per candidate and label setting with its features, feature names)."""
    bars = cut(study_bars(spark, d))
    cands = cut(first_per_id(_cands(spark, d)))
    m, cols = _features(bars, cands)
    lab = L.triple_barrier(bars, cands, STUDY, policies=policies, max_horizon=30 if policies is not None else None)
    lab = lab.select("candidate_id", "session_date", "direction", *(["label_policy"] if policies is not None else []), "entry_time", "exit_time", "entry_price", "exit_price", "stop_price", "label", "pnl_r")
    taken = set(lab.columns) | {"setup_subtype"}
    subtype = cands.select("candidate_id", "setup_subtype")
    cols = [c for c in cols if c not in taken]
    # a backtest reads the regime, known or not
    regime = [c for c in ("reg_high_vol_state", "reg_trending_state") if c not in cols]
    return lab.join(subtype, "candidate_id").join(m.select("candidate_id", *cols, *regime), "candidate_id"), cols


def _report(rows, cols, th, uses=None):
    rows = cut(rows)
    return _out(ST.refit_study(rows, ST.walk_forward_study(rows, cols, uses=uses), th))


@query("study_label_refits")
def study_label_refits(spark, d):
    """Every label setting labelled, refitted fold by fold and backtested at every threshold."""
    space = T.SEARCH_SPACES["label"][1]
    grid = T.trial_grid(spark, "label", space).withColumn("label_policy", F.format_string("h%d_s%.2f_t%.2f", "horizon_bars", "stop_multiple", "target_multiple"))
    rows, cols = _labelled_features(spark, d, grid.select("label_policy", "horizon_bars", "stop_multiple", "target_multiple"))
    return _report(rows.withColumn("variant", F.col("label_policy")), cols, thresholds(spark))


@query("study_feature_refits")
def study_feature_refits(spark, d):
    """Every feature family refitted on its own columns and backtested at every threshold."""
    rows, cols = _labelled_features(spark, d)
    families = T.SEARCH_SPACES["feature"][1]["feature_family"]
    uses = {f: {c for part in FAMILY_PARTS[f] for c in FAMILY_COLUMNS.get(part, [])} & set(cols) for f in families}
    each = fan_out(rows, spark.createDataFrame([(f,) for f in families], "variant string"))
    return _report(each, cols, thresholds(spark), uses)


@query("study_subtype_refits")
def study_subtype_refits(spark, d):
    """Every subtype, and all of them, as a study of its own at threshold 0.45."""
    rows, cols = _labelled_features(spark, d)
    each = rows.withColumn("variant", F.explode(F.array(F.lit("all_subtypes"), F.col("setup_subtype"))))
    return _report(each, cols, spark.createDataFrame([(0.45,)], "threshold double"))


@query("study_walk_forward_trades")
def study_walk_forward_trades(spark, d):
    """Ticks to candidates, features, out-of-sample predictions and the trades one account takes."""
    rows, cols = _labelled_features(spark, d)
    preds = ST.walk_forward_study(cut(rows.withColumn("variant", F.lit("all"))), cols)
    trades = executed_trades(sized_signals(preds, threshold=0.45), ["variant"])
    return _out(trades.select("candidate_id", "fold", "setup_subtype", "probability", "executed_pnl_r", "cum_pnl_r", "drawdown_r"))


@query("universe_model_diagnostic")
def universe_model_diagnostic(spark, d):
    """Every universe labelled, featured and fitted on its first 70 %, ranked by holdout AUC."""
    bars = cut(study_bars(spark, d))
    cands = cut(_universe(spark, d))
    key = ["candidate_id", "zone_mode"]
    todo, _ = U.delta_vs_baseline(cands)
    todo = cut(todo)
    m, cols = _features(bars, todo, key)
    lab = L.triple_barrier(bars, todo, STUDY, key=key).select(*key, "label", "pnl_r", "entry_time", "exit_time")
    cols = [c for c in cols if c not in lab.columns]
    rows = cands.select("variant", "session_date", *key).join(lab, key).join(m.select(*key, *cols), key)
    rows = cut(rows)
    return _out(ST.variant_metrics(rows, ST.holdout_study(rows, cols)))
