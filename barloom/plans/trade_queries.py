"""Queries over trade records: policies, backtests, performance, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import fan_out, round_doubles
from barloom.operators import backtest as B
from barloom.operators import policies as P
from barloom.operators import replay as R
from barloom.operators import sharpe as SH
from barloom.operators import trials as T
from barloom.plans import oracle_sql as O
from barloom.plans.registry import query
from barloom.plans.tables import setups, thresholds

W0 = f"WITH {O.SETUPS}"
REC = f"WITH RECURSIVE {O.SETUPS}"


def _out(df):
    if "session_date" in df.columns:
        df = df.withColumn("session_date", F.col("session_date").cast("string"))
    return round_doubles(df)


# ---------------------------------------------------------------- policies


@query("policy_subtype", f"{W0}, t AS (SELECT *, CASE setup_subtype WHEN 'weak_follow_through' THEN 0.6e0 WHEN 'deep_retrace_repair' THEN 0.55e0 ELSE 0.45e0 END AS applied_threshold FROM setups) SELECT candidate_id, applied_threshold FROM t WHERE setup_subtype <> 'wick_reclaim_repair' AND probability >= applied_threshold")
def policy_subtype(spark, d):
    """Subtype exclusion with per-subtype thresholds."""
    out = P.subtype_policy(setups(spark, d), exclude=["wick_reclaim_repair"], overrides={"weak_follow_through": 0.60, "deep_retrace_repair": 0.55})
    return out.select("candidate_id", "applied_threshold")


_SP = " UNION ALL ".join(
    f"SELECT '{n}' AS policy, setup_subtype FROM setups WHERE setup_subtype NOT IN ({', '.join(repr(x) for x in ex) or repr('-')}) AND probability >= "
    + ("CASE setup_subtype " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ov.items()) + " ELSE 0.45 END" if ov else "0.45")
    for n, ex, ov in T.SUBTYPE_POLICIES
)


@query("policy_subtype_counts", f"{W0}, a AS ({_SP}) SELECT policy, setup_subtype, count(*) AS records FROM a GROUP BY 1, 2")
def policy_subtype_counts(spark, d):
    """Record counts of the configured subtype policies."""
    s, out = setups(spark, d), None
    for name, ex, ov in T.SUBTYPE_POLICIES:
        part = P.subtype_policy(s, exclude=ex, overrides=ov).withColumn("policy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return P.policy_record_counts(out, ["policy"])


_BQ = "bq AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {1 if s is None else 0}, {'NULL' if e is None else e}, {'NULL' if b is None else b})" for n, s, e, b in P.BREAK_QUALITY
) + ") v(gate, everyone, min_eff, min_body))"
_BQ_OK = "(NOT (everyone = 1 OR setup_subtype IN ('balanced_reclaim_continuation', 'deep_retrace_repair')) OR (coalesce(coalesce(break_efficiency_ratio, 0) >= min_eff, true) AND coalesce(coalesce(break_body_fraction, 0) >= min_body, true)))"
_RM = "rm AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {1 if s is None else 0}, " + ", ".join("NULL" if x is None else str(x) for x in (c, p, b)) + ")" for n, s, c, p, b in P.RECLAIM_META
) + ") v(meta, everyone2, min_close, min_post, min_body2))"
_RM_OK = "(NOT (everyone2 = 1 OR setup_subtype IN ('balanced_reclaim_continuation', 'clean_break_continuation')) OR (coalesce(coalesce(reclaim_close_location, 0) >= min_close, true) AND coalesce(coalesce(post_reclaim_close_strength, 0) >= min_post, true) AND coalesce(coalesce(reclaim_body_strength, 0) >= min_body2, true)))"


@query("policy_break_quality", f"{W0}, {_BQ} SELECT gate, count(*) AS kept, {O.r6('sum(pnl_r)', 'total_pnl_r')} FROM setups, bq WHERE probability >= 0.45 AND {_BQ_OK} GROUP BY 1")
def policy_break_quality(spark, d):
    """All breakout-quality gates in one job."""
    g = P.break_quality(setups(spark, d), 0.45)
    return _out(g.groupBy("gate").agg(F.count(F.lit(1)).alias("kept"), F.sum("pnl_r").alias("total_pnl_r")))


@query("policy_reclaim_meta", f"{W0}, {_RM} SELECT meta, count(*) AS kept, {O.r6('sum(pnl_r)', 'total_pnl_r')} FROM setups, rm WHERE {_RM_OK} GROUP BY 1")
def policy_reclaim_meta(spark, d):
    """All reclaim gates in one job."""
    g = P.reclaim_meta(setups(spark, d))
    return _out(g.groupBy("meta").agg(F.count(F.lit(1)).alias("kept"), F.sum("pnl_r").alias("total_pnl_r")))


_DEEP = "setup_subtype = 'deep_retrace_repair'"


@query(
    "policy_tail_cleanup",
    f"""{W0}, a AS (SELECT 'exclude_deep_retrace' AS cleanup, probability AS p, 1e0 AS size FROM setups WHERE NOT {_DEEP} UNION ALL SELECT 'deep_retrace_threshold_070', probability, 1 FROM setups WHERE NOT {_DEEP} OR probability >= 0.7
    UNION ALL SELECT 'deep_retrace_size_half', probability, CASE WHEN {_DEEP} THEN 0.5 ELSE 1 END FROM setups UNION ALL SELECT 'deep_retrace_high_conf_cap', CASE WHEN {_DEEP} AND probability >= 0.65 THEN least(probability, 0.64) ELSE probability END, 1 FROM setups
    UNION ALL SELECT 'deep_retrace_regime_confirmed_only', probability, 1 FROM setups WHERE NOT {_DEEP} OR (reg_high_vol_state < 1 AND reg_trending_state >= 1))
    SELECT cleanup, count(*) AS kept, {O.r6('sum(p)', 'probability_sum')}, {O.r6('sum(size)', 'size_sum')} FROM a GROUP BY 1""",
)
def policy_tail_cleanup(spark, d):
    """Every executable tail clean-up policy; the clock-bucket ones are refused."""
    t = P.tail_cleanup_all(setups(spark, d))
    return _out(t.groupBy("cleanup").agg(F.count(F.lit(1)).alias("kept"), F.sum("probability").alias("probability_sum"), F.sum("policy_size_multiplier").alias("size_sum")))


_SIZE = """CASE WHEN probability < threshold THEN 0e0 ELSE CASE sizing WHEN 'confidence_linear_v1' THEN 0.5e0 + greatest(0e0, least(1e0, (probability - threshold) / greatest(1 - threshold, 1e-9)))
 WHEN 'confidence_tiered_v1' THEN CASE WHEN probability >= least(1e0, threshold + 0.2e0) THEN 1.5e0 WHEN probability >= least(1e0, threshold + 0.2e0 / 2) THEN 1e0 ELSE 0.5e0 END
 WHEN 'fractional_kelly_proxy_v1' THEN least(greatest(1.25e0 * 0.5e0 * greatest(0e0, least(1e0, (probability - threshold) / greatest(1 - threshold, 1e-9))), 0.25e0), 1.25e0) ELSE 1e0 END END"""
_ALLOW = "CASE throttle WHEN 'suppress_high_vol_v1' THEN reg_high_vol_state <= 0 WHEN 'trending_only_v1' THEN reg_trending_state >= 1 WHEN 'high_vol_or_non_trending_off_v1' THEN reg_high_vol_state <= 0 AND reg_trending_state >= 1 ELSE true END"
_REGIME = """CASE regime_size WHEN 'trend_vol_scale_v1' THEN CASE WHEN reg_trending_state >= 1 AND reg_high_vol_state < 1 THEN 1e0 WHEN reg_trending_state >= 1 OR reg_high_vol_state < 1 THEN 0.75e0 ELSE 0.35e0 END
 WHEN 'high_vol_haircut_v1' THEN CASE WHEN reg_trending_state >= 1 AND reg_high_vol_state < 1 THEN 1e0 WHEN reg_trending_state >= 1 OR reg_high_vol_state < 1 THEN 0.8e0 ELSE 0.5e0 END ELSE 1e0 END"""


def _names(xs):
    return "(VALUES " + ", ".join(f"('{x}')" for x in xs) + ")"


@query("policy_position_size", f"{W0}, a AS (SELECT s.*, 0.45e0 AS threshold, z.sizing FROM setups s, {_names(P.SIZING)} z(sizing)) SELECT sizing, count(*) FILTER (WHERE {_SIZE} > 0) AS sized, {O.r6(f'sum({_SIZE})', 'size_sum')} FROM a GROUP BY 1")
def policy_position_size(spark, d):
    """Four sizing policies over all signals."""
    z = spark.createDataFrame([(x,) for x in P.SIZING], "sizing string")
    s = fan_out(setups(spark, d), z).withColumn("size", P.position_size(0.45, F.col("sizing")))
    return _out(s.groupBy("sizing").agg(F.count(F.when(F.col("size") > 0, 1)).alias("sized"), F.sum("size").alias("size_sum")))


@query("policy_regime_throttle", f"{W0} SELECT throttle, count(*) FILTER (WHERE {_ALLOW}) AS allowed, count(*) AS signals FROM setups, {_names(P.THROTTLE)} z(throttle) GROUP BY 1")
def policy_regime_throttle(spark, d):
    """Regime throttles."""
    z = spark.createDataFrame([(x,) for x in P.THROTTLE], "throttle string")
    s = fan_out(setups(spark, d), z)
    return s.groupBy("throttle").agg(F.count(F.when(P.allow_signal(F.col("throttle")), 1)).alias("allowed"), F.count(F.lit(1)).alias("signals"))


@query("policy_regime_size", f"{W0} SELECT regime_size, {O.r6(f'sum({_REGIME})', 'size_sum')} FROM setups, {_names(P.REGIME_SIZE)} z(regime_size) GROUP BY 1")
def policy_regime_size(spark, d):
    """Regime size multipliers."""
    z = spark.createDataFrame([(x,) for x in P.REGIME_SIZE], "regime_size string")
    return _out(fan_out(setups(spark, d), z).groupBy("regime_size").agg(F.sum(P.regime_multiplier(F.col("regime_size"))).alias("size_sum")))


@query("policy_missing_inputs", f"{W0} SELECT * FROM (SELECT 'break_efficiency_ratio' AS input, count(*) FILTER (WHERE break_efficiency_ratio IS NULL) AS missing FROM setups UNION ALL SELECT 'reclaim_close_location', count(*) FILTER (WHERE reclaim_close_location IS NULL) FROM setups)")
def policy_missing_inputs(spark, d):
    """Records that a gate rejects only because an input is missing."""
    return P.missing_policy_inputs(setups(spark, d), ["break_efficiency_ratio", "reclaim_close_location"])


_FEATURES = ["candidate_id", "setup_subtype", "break_efficiency_ratio", "break_body_fraction", "reclaim_close_location", "post_reclaim_close_strength",
             "reclaim_body_strength", "reg_high_vol_state", "reg_trending_state"]


@query("policy_benchmark_contract", f"{W0}, {_BQ}, {_RM} SELECT candidate_id, {O.r6('probability')}, {O.r6('pnl_r')} FROM setups, bq, rm WHERE gate = 'balanced_deep_eff_ge_0.20' AND meta = 'balanced_clean_post_reclaim_ge_0.30' AND probability >= 0.45 AND {_BQ_OK} AND {_RM_OK}")
def policy_benchmark_contract(spark, d):
    """Predictions joined to features, then gate, meta and threshold."""
    s = setups(spark, d)
    out = T.benchmark_contract(s.select("candidate_id", "probability", "pnl_r"), s.select(*_FEATURES), threshold=0.45,
                               gate="balanced_deep_eff_ge_0.20", meta="balanced_clean_post_reclaim_ge_0.30")
    return _out(out.select("candidate_id", "probability", "pnl_r"))


@query("fill_slippage", f"{W0} SELECT candidate_id, entry_price + sg * 0.75 AS base_entry, exit_price - sg * 0.75 AS base_exit, {O.r6('sg * ((exit_price - sg * 1.5) - (entry_price + sg * 1.5))', 'stressed_points')}, {O.r6('entry_price + sg * entry_price * 3 / 10000', 'bps_entry')} FROM (SELECT *, CASE WHEN direction = 'long' THEN 1e0 ELSE -1e0 END AS sg FROM setups)".replace("entry_price + sg * 0.75 AS base_entry", O.r6("entry_price + sg * 0.75", "base_entry")).replace("exit_price - sg * 0.75 AS base_exit", O.r6("exit_price - sg * 0.75", "base_exit")))
def fill_slippage(spark, d):
    """Fills under base and stressed ticks and in basis points."""
    s = setups(spark, d)
    a, b, _ = B.filled("entry_price", "exit_price", "direction", B.Fill())
    _, _, stressed = B.filled("entry_price", "exit_price", "direction", B.Fill(profile="stressed"))
    bps, _, _ = B.filled("entry_price", "exit_price", "direction", B.Fill(model="bps"))
    return _out(s.select("candidate_id", a.alias("base_entry"), b.alias("base_exit"), stressed.alias("stressed_points"), bps.alias("bps_entry")))


@query("cost_net_average", f"{W0} SELECT setup_subtype, count(*) FILTER (WHERE probability >= 0.5) AS selected, {O.r6('avg(abs(entry_price - stop_price))', 'avg_risk_points')}, {O.r6('avg(pnl_r) FILTER (WHERE probability >= 0.5) - 1.5 / avg(abs(entry_price - stop_price))', 'net_avg_pnl_r')} FROM setups GROUP BY 1")
def cost_net_average(spark, d):
    """Mean R of selected signals after the round-trip cost."""
    return _out(T.net_average(setups(spark, d), ["setup_subtype"], 0.5))


@query("cost_round_trip", f"{W0} SELECT direction, {O.r6('avg(abs(entry_price - stop_price))', 'avg_risk_points')}, {O.r6('1.5 / avg(abs(entry_price - stop_price))', 'round_trip_cost_r')} FROM setups GROUP BY 1")
def cost_round_trip(spark, d):
    """Round-trip cost in R."""
    return _out(B.round_trip_cost_r(setups(spark, d), ["direction"]))


# ---------------------------------------------------------------- backtest


def book(signals: str, side_cost: float = 0.75) -> str:
    """CTEs that execute ``signals`` (setups plus run, threshold, sizing, throttle, regime_size)."""
    return f"""sig AS ({signals}),
sz AS (SELECT *, {_SIZE} AS base_size, {_REGIME} AS reg_size, coalesce({_ALLOW}, true) AS allowed, CASE WHEN direction = 'long' THEN 1e0 ELSE -1e0 END AS sg FROM sig),
can AS (SELECT *, row_number() OVER (PARTITION BY run, session_date ORDER BY entry_time, candidate_id) AS rn, (sg * (exit_price - entry_price) - 2 * {side_cost}) / abs(entry_price - stop_price) AS gross FROM sz WHERE allowed AND base_size * reg_size > 0),
nxt AS (SELECT a.run, a.session_date, a.rn, min(b.rn) AS nx FROM can a JOIN can b ON a.run = b.run AND a.session_date = b.session_date AND b.rn > a.rn AND b.entry_time >= a.exit_time GROUP BY ALL),
reach AS (SELECT DISTINCT run, session_date, CAST(1 AS BIGINT) AS rn FROM can UNION ALL SELECT n.run, n.session_date, n.nx FROM reach r JOIN nxt n ON r.run = n.run AND r.session_date = n.session_date AND r.rn = n.rn),
ex AS (SELECT can.*, gross * base_size * reg_size AS executed_pnl_r FROM can JOIN reach USING (run, session_date, rn)),
cu AS (SELECT *, sum(executed_pnl_r) OVER w AS cum_pnl_r FROM ex WINDOW w AS (PARTITION BY run ORDER BY entry_time, candidate_id)),
eq AS (SELECT *, cum_pnl_r - greatest(max(cum_pnl_r) OVER (PARTITION BY run ORDER BY entry_time, candidate_id), 0) AS drawdown_r FROM cu)"""


_ONE = book("SELECT s.*, 'base' AS run, 0.45e0 AS threshold, 'confidence_linear_v1' AS sizing, 'suppress_high_vol_v1' AS throttle, 'trend_vol_scale_v1' AS regime_size FROM setups s WHERE probability >= 0.45")


def _one(spark, d):
    s = B.sized_signals(setups(spark, d).withColumn("run", F.lit("base")), threshold=0.45, sizing="confidence_linear_v1",
                        throttle="suppress_high_vol_v1", regime_size="trend_vol_scale_v1")
    return s, B.executed_trades(s, ["run"])


@query("backtest_executed_trades", f"{REC}, {_ONE} SELECT candidate_id, {O.r6('base_size', 'base_size_multiplier')}, {O.r6('reg_size', 'regime_size_multiplier')}, {O.r6('executed_pnl_r')}, {O.r6('cum_pnl_r')}, {O.r6('drawdown_r')} FROM eq")
def backtest_executed_trades(spark, d):
    """Single-position execution with the equity curve."""
    return _out(_one(spark, d)[1].select("candidate_id", "base_size_multiplier", "regime_size_multiplier", "executed_pnl_r", "cum_pnl_r", "drawdown_r"))


_STAT = f"""st AS (SELECT run, count(*) AS trade_count, sum(executed_pnl_r) AS total_pnl_r, avg(executed_pnl_r) AS avg_trade_r, avg(base_size * reg_size) AS avg_size_multiplier, avg(CASE WHEN executed_pnl_r > 0 THEN 1 ELSE 0 END) AS win_rate, min(drawdown_r) AS max_drawdown_r FROM eq GROUP BY 1),
ss AS (SELECT run, count(*) AS session_count, count(*) FILTER (WHERE p > 0) AS positive_sessions, count(*) FILTER (WHERE p < 0) AS negative_sessions FROM (SELECT run, session_date, sum(executed_pnl_r) AS p FROM ex GROUP BY 1, 2) GROUP BY 1),
hd AS (SELECT run, count(*) AS signal_count, count(*) FILTER (WHERE NOT allowed) AS throttled_signals FROM sz GROUP BY 1), ov AS (SELECT can.run, count(*) AS n FROM can ANTI JOIN ex ON can.run = ex.run AND can.candidate_id = ex.candidate_id GROUP BY 1)"""
_UTIL = "total_pnl_r + 0.5 * avg_trade_r - 0.75 * abs(max_drawdown_r) + 0.05 * least(trade_count, 4)"


@query("backtest_summary", f"{REC}, {_ONE}, {_STAT} SELECT signal_count, throttled_signals, trade_count, coalesce(ov.n, 0) AS overlap_skips, {O.r6('total_pnl_r')}, {O.r6('avg_trade_r')}, {O.r6('avg_size_multiplier')}, {O.r6('win_rate')}, {O.r6('max_drawdown_r')}, session_count, positive_sessions, negative_sessions, {O.r6(_UTIL, 'utility_score')} FROM st JOIN ss USING (run) JOIN hd USING (run) LEFT JOIN ov USING (run)")
def backtest_summary(spark, d):
    """One-row backtest report with its utility."""
    b = B.run_backtest(_one(spark, d)[0], ["run"])[1].withColumn("utility_score", B.utility())
    return _out(b.drop("run", "avg_base_size_multiplier", "avg_regime_size_multiplier", "avg_policy_size_multiplier"))


@query("backtest_session_rollup", f"{REC}, {_ONE} SELECT CAST(session_date AS VARCHAR) AS session_date, count(*) AS trade_count, {O.r6('sum(executed_pnl_r)', 'session_pnl_r')}, {O.r6('avg(executed_pnl_r)', 'avg_trade_r')} FROM ex GROUP BY 1")
def backtest_session_rollup(spark, d):
    return _out(B.session_rollup(_one(spark, d)[1], []))


_TH = "(VALUES (0.45e0), (0.5e0), (0.55e0), (0.6e0), (0.65e0)) th(threshold)"


@query(
    "backtest_stitched_performance",
    f"""{W0}, t AS (SELECT s.*, th.threshold FROM setups s, {_TH} WHERE probability >= th.threshold), c AS (SELECT *, sum(pnl_r) OVER (PARTITION BY threshold ORDER BY entry_time, candidate_id) AS cum FROM t), e AS (SELECT *, cum - max(cum) OVER (PARTITION BY threshold ORDER BY entry_time, candidate_id) AS dd FROM c),
    s2 AS (SELECT threshold, count(*) AS session_count, count(*) FILTER (WHERE p > 0) AS positive_sessions, count(*) FILTER (WHERE p < 0) AS negative_sessions FROM (SELECT threshold, session_date, sum(pnl_r) AS p FROM t GROUP BY 1, 2) GROUP BY 1)
    SELECT threshold, count(*) AS trade_count, {O.r6('sum(pnl_r)', 'total_pnl_r')}, {O.r6('avg(pnl_r)', 'avg_trade_r')}, {O.r6('avg(CASE WHEN label = 1 THEN 1 ELSE 0 END)', 'win_rate')}, {O.r6('min(dd)', 'max_drawdown_r')}, any_value(session_count) AS session_count, any_value(positive_sessions) AS positive_sessions, any_value(negative_sessions) AS negative_sessions FROM e JOIN s2 USING (threshold) GROUP BY 1""",
)
def backtest_stitched_performance(spark, d):
    """All signals per threshold, without overlap rule or slippage."""
    return _out(B.stitched_summary(setups(spark, d), thresholds(spark)))


_GRID = book(
    f"SELECT s.*, CAST(th.threshold AS VARCHAR) || m.mode AS run, th.threshold, m.mode, m.sizing, m.throttle, m.regime_size FROM setups s, {_TH}, (VALUES ('sized', 'confidence_tiered_v1', 'trending_only_v1', 'high_vol_haircut_v1'), ('binary', 'binary_threshold_v1', 'none', 'none')) m(mode, sizing, throttle, regime_size) WHERE probability >= th.threshold"
)
_WIDE = f"""{_STAT}, a AS (SELECT DISTINCT run, threshold, mode FROM sig), u AS (SELECT a.*, st.*, {_UTIL} AS util, hd.throttled_signals FROM a JOIN st USING (run) JOIN hd USING (run)),
g AS (SELECT x.threshold, x.trade_count, x.avg_trade_r AS avg_pnl_r, x.win_rate, x.total_pnl_r, x.avg_size_multiplier, x.throttled_signals, x.util AS utility_score, y.trade_count AS binary_trade_count, y.total_pnl_r AS binary_total_pnl_r, y.util AS binary_utility_score FROM (SELECT * FROM u WHERE mode = 'sized') x JOIN (SELECT * FROM u WHERE mode = 'binary') y USING (threshold))"""
_WCOLS = f"threshold, trade_count, {O.r6('avg_pnl_r')}, {O.r6('win_rate')}, {O.r6('total_pnl_r')}, {O.r6('avg_size_multiplier')}, throttled_signals, {O.r6('utility_score')}, binary_trade_count, {O.r6('binary_total_pnl_r')}, {O.r6('binary_utility_score')}, {O.r6('utility_score - binary_utility_score', 'utility_gap_vs_binary')}"


def _grid(spark, d):
    return B.translation_grid(setups(spark, d), thresholds(spark), sizing="confidence_tiered_v1", throttle="trending_only_v1", regime_size="high_vol_haircut_v1")


@query("backtest_translation_grid", f"{REC}, {_GRID}, {_WIDE} SELECT {_WCOLS} FROM g")
def backtest_translation_grid(spark, d):
    """Sized and binary execution per threshold, in one job."""
    return _out(_grid(spark, d))


@query("backtest_best_threshold", f"{REC}, {_GRID}, {_WIDE} SELECT {_WCOLS}, CASE WHEN trade_count > 0 AND total_pnl_r > 0 THEN 'pass' ELSE 'fail' END AS status FROM g ORDER BY utility_score DESC, total_pnl_r DESC, trade_count DESC, threshold LIMIT 1".replace("ORDER BY utility_score", "ORDER BY g.utility_score").replace(", total_pnl_r DESC, trade_count", ", g.total_pnl_r DESC, g.trade_count"))
def backtest_best_threshold(spark, d):
    return _out(B.best_threshold(_grid(spark, d)))


@query("trial_gate_cycle", f"{REC}, {_BQ}, {book('SELECT s.*, gate AS run, 0.45e0 AS threshold, ' + repr('binary_threshold_v1') + ' AS sizing, ' + repr('none') + ' AS throttle, ' + repr('trend_vol_scale_v1') + ' AS regime_size FROM setups s, bq WHERE probability >= 0.45 AND ' + _BQ_OK)}, {_STAT} SELECT run AS gate, trade_count, {O.r6('total_pnl_r')}, {O.r6('avg_trade_r')}, {O.r6('max_drawdown_r')}, {O.r6(_UTIL, 'utility_score')}, CAST(row_number() OVER (ORDER BY {_UTIL} DESC, total_pnl_r DESC, run) AS INT) AS rank FROM st")
def trial_gate_cycle(spark, d):
    """Breakout-quality gates backtested and ranked."""
    return _out(T.policy_ranking(T.gate_cycle(setups(spark, d), 0.45, regime_size="trend_vol_scale_v1"), "gate"))


@query("trial_meta_cycle", f"{REC}, {_RM}, {book('SELECT s.*, meta AS run, 0.45e0 AS threshold, ' + repr('binary_threshold_v1') + ' AS sizing, ' + repr('none') + ' AS throttle, ' + repr('trend_vol_scale_v1') + ' AS regime_size FROM setups s, rm WHERE probability >= 0.45 AND ' + _RM_OK)}, {_STAT} SELECT run AS meta, trade_count, {O.r6('total_pnl_r')}, {O.r6('avg_trade_r')}, {O.r6('max_drawdown_r')}, {O.r6(_UTIL, 'utility_score')}, CAST(row_number() OVER (ORDER BY {_UTIL} DESC, total_pnl_r DESC, run) AS INT) AS rank FROM st")
def trial_meta_cycle(spark, d):
    """Reclaim gates backtested and ranked."""
    return _out(T.policy_ranking(T.meta_cycle(setups(spark, d), 0.45, regime_size="trend_vol_scale_v1"), "meta"))


def _grid_values():
    from itertools import product

    space = T.SEARCH_SPACES["translation_policy"][1]
    rows = list(product(*space.values()))
    return "(VALUES " + ", ".join(f"({i}, {r[0]}e0, '{r[1]}', '{r[2]}', '{r[3]}')" for i, r in enumerate(rows, 1)) + ") g(trial, threshold, sizing, throttle, regime_size)"


@query("trial_translation_cycle", f"{REC}, {book('SELECT s.*, CAST(g.trial AS VARCHAR) AS run, g.* FROM setups s, ' + _grid_values() + ' WHERE probability >= g.threshold')}, {_STAT} SELECT CAST(run AS INT) AS trial, trade_count, {O.r6('total_pnl_r')}, {O.r6('max_drawdown_r')}, {O.r6(_UTIL, 'utility_score')} FROM st")
def trial_translation_cycle(spark, d):
    """All trials of the translation grid in one job keyed by trial."""
    g = T.grid_backtest(setups(spark, d), T.trial_grid(spark, "translation_policy"))
    return _out(g.select("trial", "trade_count", "total_pnl_r", "max_drawdown_r", "utility_score"))


_LOSS = "ls AS (SELECT *, sum(CASE WHEN pnl_r < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY setup_subtype ORDER BY entry_time, candidate_id) AS g FROM setups)"


@query("loss_largest_cluster", f"{W0}, {_LOSS} SELECT setup_subtype, {O.r6('least(min(l), 0)', 'largest_loss_cluster_r')} FROM (SELECT setup_subtype, g, sum(CASE WHEN pnl_r < 0 THEN pnl_r ELSE 0 END) AS l FROM ls GROUP BY 1, 2) GROUP BY 1")
def loss_largest_cluster(spark, d):
    """Most negative run of consecutive losses per subtype."""
    return _out(B.largest_loss_cluster(setups(spark, d), ["setup_subtype"], "pnl_r", ["entry_time", "candidate_id"]))


@query("loss_run_lengths", f"{W0}, {_LOSS} SELECT setup_subtype, length, count(*) AS runs, {O.r6('sum(loss_r)', 'loss_r')} FROM (SELECT setup_subtype, g, count(*) AS length, sum(pnl_r) AS loss_r FROM ls WHERE pnl_r < 0 GROUP BY 1, 2) GROUP BY 1, 2")
def loss_run_lengths(spark, d):
    """Distribution of consecutive-loss runs."""
    from barloom.operators.diagnostics import loss_runs

    r = loss_runs(setups(spark, d), ["setup_subtype"], ["entry_time", "candidate_id"], "pnl_r")
    return _out(r.groupBy("setup_subtype", "length").agg(F.count(F.lit(1)).alias("runs"), F.sum("loss_r").alias("loss_r")))


# ------------------------------------------------------------------ sharpe

_SHARPE = """sh AS (SELECT setup_subtype, count(*) AS n_obs, avg(pnl_r) AS m, stddev_samp(pnl_r) AS sd FROM setups GROUP BY 1),
sk AS (SELECT s.setup_subtype, any_value(n_obs) AS n_obs, any_value(m) / any_value(sd) * sqrt(any_value(n_obs)) AS sr, sum(power((pnl_r - m) / sd, 3)) / count(*) AS skew, sum(power((pnl_r - m) / sd, 4)) / count(*) AS kurt FROM setups s JOIN sh USING (setup_subtype) GROUP BY 1)"""


@query("sharpe_moments", f"{W0}, {_SHARPE} SELECT setup_subtype, n_obs, {O.r6('sr', 'observed_sharpe')}, {O.r6('skew')}, {O.r6('kurt', 'kurtosis')} FROM sk")
def sharpe_moments(spark, d):
    """Sharpe, skew and kurtosis with the sample deviation."""
    return _out(SH.sharpe_table(setups(spark, d), ["setup_subtype"], "pnl_r"))


@query("sharpe_dispersion", f"{W0}, {_SHARPE} SELECT setup_subtype, {O.r6('sr', 'observed_sharpe')}, {O.r6('stddev_samp(sr) OVER ()', 'sr_std')} FROM sk")
def sharpe_dispersion(spark, d):
    """Dispersion of the Sharpes of a batch."""
    t = SH.attach_dsr(SH.sharpe_table(setups(spark, d), ["setup_subtype"], "pnl_r"), n_trials=5)
    return _out(t.select("setup_subtype", "observed_sharpe", "sr_std"))


@query("sharpe_deflated_trials")
def sharpe_deflated_trials(spark, d):
    """Deflated and probabilistic Sharpe of each trial (no normal CDF in SQL)."""
    return _out(SH.attach_dsr(SH.sharpe_table(setups(spark, d), ["setup_subtype"], "pnl_r"), n_trials=5))


@query("sharpe_deflated_audit")
def sharpe_deflated_audit(spark, d):
    """Audit of all trades against the dispersion of path Sharpes."""
    from barloom.plans.tables import path_rows

    s = setups(spark, d)
    paths = SH.sharpe_table(path_rows(s), ["path_id"], "executed_pnl_r").withColumnRenamed("observed_sharpe", "sharpe_r")
    return _out(SH.deflated_audit(s, paths, pnl="pnl_r", n_trials=12))


# ------------------------------------------------------------------ replay


@query("replay_entry_collisions", f"{W0} SELECT CAST(sum(n) AS BIGINT) AS planned, CAST(sum(n - 1) AS BIGINT) AS same_timestamp_entry_collisions FROM (SELECT entry_time, count(*) AS n FROM setups GROUP BY 1)")
def replay_entry_collisions(spark, d):
    return R.entry_collisions(setups(spark, d))


@query("replay_planned_entries", f"{W0} SELECT candidate_id FROM (SELECT candidate_id, row_number() OVER (PARTITION BY entry_time ORDER BY probability DESC, candidate_id) AS r FROM setups) WHERE r = 1")
def replay_planned_entries(spark, d):
    """One entry per timestamp."""
    return R.planned_trades(setups(spark, d)).select("candidate_id")


@query("replay_event_table", f"{W0}, e AS (SELECT entry_time AS t, 1 AS a, 0 AS b FROM setups UNION ALL SELECT exit_time, 0, 1 FROM setups) SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(sum(a) AS BIGINT) AS entries, CAST(sum(b) AS BIGINT) AS exits FROM e GROUP BY 1")
def replay_event_table(spark, d):
    """Entry and exit actions per timestamp."""
    e = R.event_table(setups(spark, d))
    return e.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "entries", "exits")


def _replay_sql(cost, name):
    return f"""f{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_time ORDER BY probability DESC, candidate_id) AS er FROM setups) WHERE er = 1),
c{name} AS (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY entry_time, candidate_id) AS rn, CASE WHEN direction = 'long' THEN 1e0 ELSE -1e0 END AS sg FROM f{name}),
n{name} AS (SELECT a.session_date, a.rn, min(b.rn) AS nx FROM c{name} a JOIN c{name} b ON a.session_date = b.session_date AND b.rn > a.rn AND b.entry_time >= a.exit_time GROUP BY ALL),
r{name} AS (SELECT DISTINCT session_date, CAST(1 AS BIGINT) AS rn FROM c{name} UNION ALL SELECT n.session_date, n.nx FROM r{name} r JOIN n{name} n USING (session_date, rn)),
k{name} AS (SELECT *, sg * (exit_price - entry_price) * 2 AS gross, (sg * (exit_price - entry_price) - {2 * cost}) * 2 AS net FROM c{name} JOIN r{name} USING (session_date, rn)),
q{name} AS (SELECT *, 100000 + sum(net) OVER (ORDER BY entry_time, candidate_id) AS eqy FROM k{name}), d{name} AS (SELECT *, greatest(max(eqy) OVER (ORDER BY entry_time, candidate_id), 100000) AS pk FROM q{name}),
o{name} AS (SELECT '{name}' AS profile, count(*) AS num_trades, avg(CASE WHEN net > 0 THEN 1 ELSE 0 END) AS win_rate, sum(net) / 100000 * 100 AS total_return_pct, min((eqy - pk) / pk * 100) AS max_drawdown_pct, sum(gross) AS total_gross_pnl, sum(gross - net) AS total_costs, avg(net) / stddev_samp(net) * sqrt(count(*)) AS sharpe, avg(net) / sqrt(avg(CASE WHEN net < 0 THEN net * net ELSE 0 END)) * sqrt(count(*)) AS sortino, sum(CASE WHEN net > 0 THEN net ELSE 0 END) / sum(CASE WHEN net < 0 THEN -net ELSE 0 END) AS profit_factor, avg(net) AS avg_trade, max(net) AS largest_win, min(net) AS largest_loss FROM d{name})"""


_RCOLS = "profile, num_trades, " + ", ".join(O.r6(x) for x in ("win_rate", "total_return_pct", "max_drawdown_pct", "total_gross_pnl", "total_costs", "sharpe", "sortino", "profit_factor", "avg_trade", "largest_win", "largest_loss"))


def _reports(spark, d, profiles=("base", "stressed")):
    s, out = B.lean(setups(spark, d)), None
    for profile in profiles:
        r = R.replay_report(R.replayed(s, fill=B.Fill(profile=profile))).withColumn("profile", F.lit(profile))
        out = r if out is None else out.unionByName(r)
    return out


@query("replay_report", f"{REC}, {_replay_sql(0.75, 'base')}, {_replay_sql(1.5, 'stressed')} SELECT {_RCOLS} FROM obase UNION ALL SELECT {_RCOLS} FROM ostressed")
def replay_report(spark, d):
    """Account metrics under base and stressed costs."""
    return _out(_reports(spark, d))


@query("replay_stress_view", f"{REC}, {_replay_sql(1.5, 'stressed')} SELECT profile, {O.r6('sharpe')}, {O.r6('max_drawdown_pct')}, {O.r6('total_costs')}, {O.r6('profit_factor')} FROM ostressed")
def replay_stress_view(spark, d):
    return _out(R.stress_view(_reports(spark, d, ["stressed"])))
