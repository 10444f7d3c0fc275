"""Trial grids, rankings, decisions and the trial ledger as tables.

Thresholds, policies and label settings are columns, so a whole grid is one
job keyed by trial; only model refits loop.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.columns import fan_out, ladder, num0
from barloom.functions.scan import running
from barloom.operators.backtest import (
    SIGNAL_COLUMNS, Fill, equity_curve, lean, overlap_skips, run_backtest, session_counts, signal_counts, sized_signals, taken_signals, trade_totals, utility,
    with_parts,
)
from barloom.operators.policies import break_quality, position_size, reclaim_meta, regime_multiplier
from barloom.session import cut

# fixed values: configured search spaces: family -> (trial cap, ordered axes)
SEARCH_SPACES = {
    "setup": (6, {"horizon_bars": [20, 30], "break_buffer_points": [0.0, 1.0]}),
    "model": (2, {"model_family": ["linear_baseline", "gbm"]}),
    "feature": (
        6,
        {"feature_family": ["bnr_plus_context", "bnr_plus_engineer", "context_plus_reclaim", "context_plus_geometry",
                            "context_plus_regime", "reclaim_plus_regime"]},
    ),
    "feature_threshold": (
        15,
        {"feature_family": ["context_plus_reclaim", "context_plus_geometry", "context_plus_regime"],
         "decision_threshold": [0.45, 0.50, 0.55, 0.60, 0.65]},
    ),
    "threshold": (5, {"decision_threshold": [0.45, 0.50, 0.55, 0.60, 0.65]}),
    "translation_policy": (
        12,
        {"decision_threshold": [0.45, 0.50, 0.55],
         "sizing_policy": ["binary_threshold_v1", "confidence_tiered_v1", "fractional_kelly_proxy_v1"],
         "regime_throttle_policy": ["none", "suppress_high_vol_v1", "trending_only_v1", "high_vol_or_non_trending_off_v1"],
         "regime_size_policy": ["none", "trend_vol_scale_v1", "high_vol_haircut_v1"]},
    ),
    "label": (8, {"horizon_bars": [20, 30], "stop_multiple": [1.0, 1.25], "target_multiple": [1.5, 2.0]}),
    "sample_expansion": (4, {"latest_trigger_time": ["11:00:00", "16:00:00"], "break_buffer_points": [0.0]}),
    "subtype": (
        5,
        {"setup_subtype": ["all_subtypes", "clean_break_continuation", "balanced_reclaim_continuation", "deep_retrace_repair",
                           "wick_reclaim_repair"]},
    ),
}
# fixed values: subtype policies (name, excluded subtypes, threshold overrides)
SUBTYPE_POLICIES = [
    ("baseline_all", [], {}),
    ("exclude_weak_follow_through", ["weak_follow_through"], {}),
    ("exclude_deep_and_weak", ["weak_follow_through", "deep_retrace_repair"], {}),
    ("prefer_clean_strict_weak", [], {"weak_follow_through": 0.60, "deep_retrace_repair": 0.55}),
]


def trial_grid(spark: SparkSession, family: str, space: dict | None = None, cap: int | None = None) -> DataFrame:
    """Ordered cartesian product of a search space; ``cap`` keeps the first so many trials.

    Configuration, not data: a few dozen rows at most.
    """
    if space is None:
        if family not in SEARCH_SPACES:
            raise ValueError(f"unsupported search family: {family}")
        space = SEARCH_SPACES[family][1]
    names = list(space)
    rows = list(product(*space.values()))[:cap]
    kinds = {str: "string", float: "double", int: "int"}
    ddl = "trial int, " + ", ".join(f"{n} {kinds[type(space[n][0])]}" for n in names)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, start=1)], ddl)


def grid_backtest(preds: DataFrame, grid: DataFrame, *, run: str = "trial", fill: Fill = Fill()) -> DataFrame:
    """Backtest every trial of a translation grid in one job, with utility.

    Sizes are above 0 under every sizing rule or under none, so which trades an
    account takes follows from threshold and throttle.  They are chosen once per
    pair of these, and only the trades taken are repeated per trial.
    """
    cols = set(grid.columns)
    pick = lambda name, default: F.col(name) if name in cols else default
    account = ["decision_threshold", *[c for c in ("regime_throttle_policy",) if c in cols]]
    each = fan_out(lean(preds), grid.select(*account).distinct())
    s = sized_signals(each, threshold="decision_threshold", throttle=pick("regime_throttle_policy", "none"), fill=fill)
    s = s.select(*account, *SIGNAL_COLUMNS, "probability", "reg_high_vol_state", "reg_trending_state")
    taken = cut(taken_signals(s, account))
    sized = taken.join(F.broadcast(grid), account).withColumns({
        "base_size_multiplier": position_size("decision_threshold", pick("sizing_policy", "binary_threshold_v1")),
        "regime_size_multiplier": regime_multiplier(pick("regime_size_policy", "none")),
    }).withColumn("size_multiplier", F.col("base_size_multiplier") * F.col("regime_size_multiplier") * F.col("policy_multiplier"))
    sized = sized.select(run, "candidate_id", "session_date", "entry_time", "size_multiplier", "base_size_multiplier", "regime_size_multiplier", "policy_multiplier",
                         (F.col("gross_executed_pnl_r") * F.col("size_multiplier")).alias("executed_pnl_r"))
    executed = equity_curve(sized, [run], "executed_pnl_r", ["entry_time", "candidate_id"])
    head = grid.select(run, *account).join(signal_counts(s, account), account)
    skips = grid.select(run, *account).join(overlap_skips(s, taken, account), account).drop(*account)
    out = with_parts(head.drop(*account), [trade_totals(executed, [run]), session_counts(sized, [run]), skips], [run])
    return grid.join(out, run, "left").withColumn("utility_score", F.when(F.coalesce("trade_count", F.lit(0)) > 0, utility()))


def gate_cycle(preds: DataFrame, threshold: float, *, regime_size: str = "none", fill: Fill = Fill()) -> DataFrame:
    """Every breakout-quality gate backtested, keyed by gate."""
    s = sized_signals(lean(break_quality(preds, threshold), "gate"), threshold=threshold, regime_size=regime_size, fill=fill)
    return _policy_rows(s, "gate")


def meta_cycle(preds: DataFrame, threshold: float, *, regime_size: str = "none", fill: Fill = Fill()) -> DataFrame:
    """Every reclaim gate backtested, keyed by meta."""
    s = sized_signals(lean(reclaim_meta(preds), "meta"), threshold=threshold, regime_size=regime_size, fill=fill)
    return _policy_rows(s, "meta")


def _policy_rows(s: DataFrame, run: str) -> DataFrame:
    out = run_backtest(s, [run])[1]
    return out.select(
        run, "trade_count", "total_pnl_r", "avg_trade_r", "max_drawdown_r", F.when(F.col("trade_count") > 0, utility()).alias("utility_score")
    )


def benchmark_contract(preds: DataFrame, features: DataFrame, *, threshold: float, gate: str | None, meta: str | None) -> DataFrame:
    """Predictions joined to features, then gate, meta and threshold.

    Feature columns win when both sides have a column.
    """
    own = [c for c in preds.columns if c not in features.columns or c == "candidate_id"]
    j = preds.select(*own).join(features, "candidate_id", "left")
    if gate:
        j = break_quality(j, threshold).filter(F.col("gate") == gate).drop("gate")
    if meta:
        j = reclaim_meta(j).filter(F.col("meta") == meta).drop("meta")
    return j if gate else j.filter(num0("probability") >= threshold)


def rank_trials(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rank trials of a batch (a handful of rows)."""
    return rows.withColumn(name, F.row_number().over(W.orderBy(*order)))


def policy_ranking(rows: DataFrame, run: str) -> DataFrame:
    return rank_trials(rows, [F.col("utility_score").desc_nulls_last(), F.coalesce("total_pnl_r", F.lit(0.0)).desc(), F.col(run)])


def net_average(rows: DataFrame, by: list[str], threshold=None, fill: Fill = Fill()) -> DataFrame:
    """Mean R after the round-trip cost, over selected predictions."""
    chosen = F.lit(True) if threshold is None else F.col("probability") >= threshold
    risk = F.avg(F.abs(F.col("entry_price") - F.col("stop_price")))
    cost = F.lit(2.0 * fill.tick_size * fill.per_side)
    if fill.model != "ticks":
        cost = F.avg("entry_price") * F.lit(2.0 * fill.per_side / 10_000.0)
    return rows.groupBy(*by).agg(
        F.count(F.when(chosen, 1)).alias("selected"),
        risk.alias("avg_risk_points"),
        F.when(F.count(F.when(chosen, 1)) == 0, 0.0)
        .otherwise(F.avg(F.when(chosen, num0("pnl_r"))) - F.coalesce(cost / F.nullif(risk, F.lit(0.0)), F.lit(0.0))).alias("net_avg_pnl_r"),
    )


def decide_trials(trials: DataFrame, baseline: DataFrame, *, min_ratio: float = 0.7, positive_delta: bool = True, min_auc_delta: float = 0.0) -> DataFrame:
    """Deltas against the one-row baseline and the accept / reject rule."""
    b = baseline.select(F.col("candidate_count").alias("b_n"), F.col("net_avg_pnl_r").alias("b_r"), F.col("roc_auc").alias("b_auc"))
    j = trials.crossJoin(F.broadcast(b)).withColumns(
        {"net_delta_vs_baseline": F.col("net_avg_pnl_r") - F.col("b_r"), "roc_auc_delta_vs_baseline": F.col("roc_auc") - F.col("b_auc")}
    )
    rules = [
        (F.col("status") != "fit", "reject"),
        ((F.col("b_n") > 0) & (F.col("candidate_count") / F.nullif(F.col("b_n"), F.lit(0)) < min_ratio), "reject"),
        (F.lit(positive_delta) & (F.col("net_delta_vs_baseline") <= 0), "reject"),
        (F.coalesce(F.col("roc_auc_delta_vs_baseline") < min_auc_delta, F.lit(False)), "reject"),
    ]
    return j.withColumn("decision", ladder(rules, "accept")).drop("b_n", "b_r", "b_auc")


def row_fingerprint(cols: list[str]) -> Column:
    """SHA-256 of the named columns of a row, as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def table_fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Order-free fingerprint of a table: row count, xor and sum of row hashes."""
    by = by or []
    cols = [c for c in sorted(df.columns) if c not in by]
    h = F.xxhash64(*[F.col(c) for c in cols])
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum")
    )


def confirmation_status() -> Column:
    """Status rule of a boundary confirmation run."""
    bad = lambda c: F.coalesce(c, F.lit(True))
    return ladder(
        [
            (bad(F.col("walk_forward_status") != "pass"), "freeze"), (bad(F.col("purging_status") != "pass"), "freeze"),
            (bad(F.col("threshold_trade_count") <= 0), "freeze"), (bad(F.col("threshold_avg_pnl_r") <= 0), "freeze"),
            (bad(F.col("execution_trade_count") <= 0), "freeze"), (bad(F.col("execution_total_pnl_r") <= 0), "freeze"),
        ],
        "confirmed",
    )


def dedupe_ledger(rows: DataFrame, keys: list[str], arrival: str, keep: int | None = None) -> DataFrame:
    """First row per signature; with ``keep`` the last so many of those by arrival.

    The first row is an aggregate per signature, so repeated signatures are
    combined map-side.
    """
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), arrival).alias("__r"))
    out = first.select("__r.*")
    return out if keep is None else out.orderBy(F.col(arrival).desc()).limit(keep)


def trailing_family_streaks(rows: DataFrame, order: str, family: str = "family") -> DataFrame:
    """For every family: how many of the latest rows in a row belong to it.

    Two small aggregates: the last row overall and per family the last row of
    another family.
    """
    per = rows.groupBy(family).agg(F.max(order).alias("last_no"))
    last = per.agg(F.max("last_no").alias("__end"))
    ranked = per.withColumn("__o", F.row_number().over(W.orderBy(F.col("last_no").desc())))
    second = ranked.filter(F.col("__o") == 2).select(F.col("last_no").alias("__other"))
    tail = rows.crossJoin(F.broadcast(last)).join(F.broadcast(second), F.lit(True), "left").filter(
        F.col("__other").isNull() | (F.col(order) > F.col("__other"))
    )
    n = tail.groupBy(family).agg(F.count(F.lit(1)).alias("consecutive_cycles"))
    return per.join(n, family, "left").select(family, F.coalesce("consecutive_cycles", F.lit(0)).alias("consecutive_cycles"))


def branch_status(rows: DataFrame, order: str, *, max_cycles: int = 2, max_plain: int = 2) -> DataFrame:
    """Exhaustion of each family: trailing streak and accepted runs without a robustness gain.

    ``rows``: family, batch_decision, robust (bool), order column.
    """
    accepted = rows.filter(F.col("batch_decision") == "accept")
    lately = _last_k(accepted, "family", order, max_plain)
    plain = lately.groupBy("family").agg(F.count(F.when(~F.col("robust"), 1)).alias("accepted_without_robustness"))
    j = trailing_family_streaks(rows, order).join(plain, "family", "left").fillna(0, ["accepted_without_robustness"])
    reason = ladder(
        [
            (F.col("consecutive_cycles") >= max_cycles, "same_family_cycle_limit_reached"),
            (F.col("accepted_without_robustness") >= max_plain, "accepted_without_robustness_limit_reached"),
        ],
        "",
    )
    return j.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") != "", "exhausted").otherwise("open"))


def _last_k(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """Last ``k`` rows per group by a running count from the end."""
    r = running(rows, [by], [order], {"__n": ("count", F.lit(1))}, reverse=True)
    return r.filter(F.col("__n") <= k).drop("__n")


def repeated_signatures(runs: DataFrame, minimum: int = 2) -> DataFrame:
    """Worst-path signatures seen in at least ``minimum`` families.

    ``runs``: run_id, family, batch_decision, path_ids (array of three).
    """
    s = runs.withColumn("signature", F.array_join("path_ids", "|")).filter(F.size("path_ids") > 0)
    fine = s.groupBy("signature", "family").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("batch_decision") != "accept", 1)).alias("bad")
    )
    g = fine.groupBy("signature").agg(
        F.array_sort(F.collect_list("family")).alias("families"), F.sum("n").alias("run_count"),
        F.coalesce(F.bool_or((F.col("family") == "tail_path_cleanup") & (F.col("bad") > 0)), F.lit(False)).alias("tail_cleanup_failed"),
        F.bool_or(F.col("family") == "label").alias("label_geometry_failed"),
        F.bool_or(F.col("family") == "sample_expansion").alias("sample_expansion_failed"),
    )
    return g.filter(F.size("families") >= minimum)


def promotion_decision() -> Column:
    """Ordered decision over the gate columns of one run."""
    no = lambda c: F.coalesce(F.col(c) != "pass", F.lit(True))
    return ladder(
        [
            (F.col("blocking"), "revise"), (~F.col("frozen_spec_approval"), "freeze"), (no("leakage"), "reject"), (no("purging"), "reject"),
            (F.col("robustness").startswith("blocked"), "freeze"), (no("walk_forward"), "freeze"), (no("cpcv"), "freeze"),
            (no("deflated_sharpe"), "freeze"), (F.col("overfitting").isin("pending", "fail"), "freeze"), (no("multiple_testing"), "freeze"),
            (~F.col("promotable_method"), "freeze"), (no("random_signal"), "freeze"), (no("calibration"), "freeze"),
            (F.col("translation") == "fail", "reject"), (no("translation"), "freeze"),
            (F.coalesce(F.col("net_avg_pnl_r") <= 0, F.lit(False)), "reject"),
            (F.col("auto_accept") & F.col("robustness").startswith("pending") & (F.col("net_avg_pnl_r") > 0), "accept"),
        ],
        "advance_to_validation",
    )


def failure_evidence_type() -> Column:
    """Kind of failure from the gate statuses of a run (null: none)."""
    return ladder(
        [
            (F.col("cpcv") == "fail", "cpcv_tail_path_fragility"), (F.col("walk_forward") == "fail", "walk_forward_failure"),
            (F.col("translation") == "fail", "translation_failure"), (F.col("promotion_decision") == "reject", "validation_failed"),
            (F.col("blocking"), "blocking_issue"),
        ],
        F.lit(None).cast("string"),
    )


def validation_failure_rows(runs: DataFrame, axes: DataFrame) -> DataFrame:
    """Statuses of failed runs with the dominant loss subtype and next actions."""
    sub = axes.filter(F.col("axis") == "subtype").select(F.col("key").alias("dominant_subtype")).limit(1)
    r = runs.withColumn("failure_type", failure_evidence_type()).filter(F.col("failure_type").isNotNull())
    j = r.join(F.broadcast(sub), F.lit(True), "left")
    acts = F.array_compact(
        F.array(
            F.when(F.col("failure_type") == "cpcv_tail_path_fragility", F.lit("candidate_universe_expansion")),
            F.when(F.col("failure_type") == "cpcv_tail_path_fragility", F.lit("exit_behavior_research")),
            F.when(F.col("dominant_subtype").isNotNull(), F.lit("setup_redesign")),
        )
    )
    return j.withColumn("recommended_next_actions", F.when(F.size(acts) == 0, F.array(F.lit("domain_prior_ingestion"))).otherwise(acts))


def state_trial_gates(rows: DataFrame, baseline_rate: DataFrame, *, min_trades: int = 350, min_retained: float = 0.70, worst: float = -5.0) -> DataFrame:
    """Strict gates of each market-state policy; every one must hold.

    ``rows``: variant summaries joined to their path roll-up and DSR columns.
    """
    j = rows.crossJoin(F.broadcast(baseline_rate.select(F.col("path_positive_rate").alias("b_rate"))))
    retained = F.col("trade_count") / F.greatest(F.col("candidate_count"), F.lit(1))
    gates = {
        "cpcv_pass": F.col("status") == "pass", "dsr_pass": F.col("dsr_probability") >= 0.95,
        "psr_pass": (F.col("psr_probability") >= 0.95) & (F.coalesce("observed_sharpe", F.lit(0.0)) > 0),
        "worst_path_above_threshold": F.col("min_path_pnl_r") > worst, "mean_path_positive": F.col("mean_total_pnl_r") > 0,
        "median_path_positive": F.col("median_total_pnl_r") > 0, "positive_rate_holds": F.col("path_positive_rate") >= F.col("b_rate"),
        "trade_count_acceptable": F.col("trade_count") >= min_trades, "not_deleting_too_many_trades": retained >= min_retained,
    }
    out = j.withColumn("retained_fraction", retained).withColumns({k: F.coalesce(v, F.lit(False)) for k, v in gates.items()})
    every = F.lit(True)
    for k in gates:
        every = every & F.col(k)
    return out.withColumn("decision", F.when(every, "accept").otherwise("reject")).drop("b_rate")


def tail_trial_decision() -> Column:
    """Eight ordered rules of a tail clean-up trial."""
    bad = lambda c: F.coalesce(c, F.lit(True))
    return ladder(
        [
            (bad(F.col("walk_forward_status") != "pass"), "reject"), (bad(F.col("cpcv_status") != "pass"), "reject"),
            (bad(F.col("translation_status") != "pass"), "reject"), (bad(~F.col("no_holdout_access")), "reject"),
            (bad(F.col("dsr_status") != "pass"), "reject"), (bad(F.col("utility_gap_vs_binary") > 0.50), "reject"),
            (bad(~F.col("deep_retrace_improved")), "reject"), (bad(F.col("dominant_loss_bucket") == "[0.65,1.00]") & F.col("dominant_loss_bucket").isNotNull(), "reject"),
        ],
        "accept",
    )


def dominant_loss_bucket(worst_rows: DataFrame, by: list[str]) -> DataFrame:
    """Probability bucket with the largest loss on the worst path."""
    neg = worst_rows.filter((F.col("axis") == "probability_bin") & (F.col("total_pnl_r") < 0))
    return neg.groupBy(*by).agg(F.min(F.struct("total_pnl_r", "key"))["key"].alias("dominant_loss_bucket"))


def robust_rescore(state_rows: DataFrame, gate_rows: DataFrame) -> DataFrame:
    """Variants of both kinds ranked by total + worst path + 5 x positive rate."""
    pick = lambda d, kind: d.select(
        F.col("variant").alias("name"), F.lit(kind).alias("kind"), "total_pnl_r", "path_positive_rate", "min_path_pnl_r"
    )
    both = pick(state_rows, "state_gate").unionByName(pick(gate_rows, "continuation_gate"))
    score = num0("total_pnl_r") + num0("min_path_pnl_r") + 5.0 * num0("path_positive_rate")
    return rank_trials(both.withColumn("robust_score", score), [F.col("robust_score").desc(), F.col("kind"), F.col("name")])


def ablation_pack(state_rows: DataFrame, gate_rows: DataFrame) -> DataFrame:
    """Best variant per component by (worst path, total) and their distance."""
    r = robust_rescore(state_rows, gate_rows)
    w = W.partitionBy("kind").orderBy(F.col("min_path_pnl_r").desc(), F.col("total_pnl_r").desc(), "name")
    best = r.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") == 1)
    spread = F.max("total_pnl_r").over(W.partitionBy(F.lit(0))) - F.min("total_pnl_r").over(W.partitionBy(F.lit(0)))
    return best.select("kind", "name", "total_pnl_r", "min_path_pnl_r", spread.alias("ablation_dependence_score"))


def v1_gates() -> dict[str, Column]:
    """Pass / fail gates of the frozen-policy validation."""
    return {
        "walk_forward_pass": F.col("walk_forward_status") == "pass", "cpcv_pass": F.col("cpcv_status") == "pass",
        "worst_path_gt_minus_5r": F.col("min_path_pnl_r") > -5.0, "dsr_psr_pass": F.col("dsr_status") == "pass",
        "trade_count_acceptable": F.col("trade_count") >= 100, "translation_pass": F.col("translation_status") == "pass",
        "drawdown_tolerable": F.col("max_drawdown_r") > -12.0, "no_leakage": F.col("leakage_status") == "pass",
    }
