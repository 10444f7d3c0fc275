"""Exit policies replayed on the bars after each entry.

The path of a trade is at most one horizon of bars, collected once per trade
into an ordered array with everything that does not depend on the policy
(running excursion, trailing extremes, candle signs).  Policies are a small
table; the part that does feed back (the moving stop, the partial) is folded
over the array by ``aggregate`` inside the JVM.  Prices are mirrored for short
trades, so one set of rules serves both directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.asof import forward_window
from barloom.functions.columns import fan_out, iso, ladder, num0
from barloom.functions.scan import running
from barloom.functions.stats import exact_quantiles, payoff_ratio
from barloom.operators.backtest import Fill, equity_curve
from barloom.operators.labels import entry_numbers
from barloom.operators.sessions import number_bars
from barloom.schemas import SESSION_KEY, SessionSpec
from barloom.session import cut

# fixed values: exit policies
# target_r: R multiple of the target (null: the trade's own target, 0: recent high/low, 999: none)
POLICIES = [
    # name, target_r, breakeven_at, trail, partial, mae_cut, scratch_bar, time_bar, tempo
    ("fixed_1_5r_tp_sl_baseline", None, None, None, False, None, None, None, False),
    ("scratch_no_followthrough_after_2_bars", None, None, None, False, None, 2, None, False),
    ("scratch_no_followthrough_after_3_bars", None, None, None, False, None, 3, None, False),
    ("scratch_no_followthrough_after_4_bars", None, None, None, False, None, 4, None, False),
    ("scratch_3_bars_plus_breakeven_after_0_75r_mfe", None, 0.75, None, False, None, 3, None, False),
    ("scratch_3_bars_plus_mae_cut_0_65r", None, None, None, False, 0.65, 3, None, False),
    ("scratch_3_bars_plus_session_drawdown_stop_3r", None, None, None, False, None, 3, None, False),
    ("time_stop_10_bars", None, None, None, False, None, None, 10, False),
    ("breakeven_after_0_75r_mfe", None, 0.75, None, False, None, None, None, False),
    ("structure_trailing_stop", None, None, "half_r", False, None, None, None, False),
    ("structure_trail_after_1r", None, None, "one_r", False, None, None, None, False),
    ("structure_trail_after_breakout_continuation", None, None, "continuation", False, None, None, None, False),
    ("partial_1r_runner", None, None, None, True, None, None, None, False),
    ("partial_1r_runner_structure_trail", 999.0, None, "partial", True, None, None, None, False),
    ("partial_1r_runner_fixed_2r", 2.0, None, None, True, None, None, None, False),
    ("partial_1r_runner_fixed_3r", 3.0, None, None, True, None, None, None, False),
    ("tempo_deterioration_exit", None, None, None, False, None, None, None, True),
    ("opposing_recent_high_low_target_or_exit", 0.0, None, None, False, None, None, None, False),
]
# fixed values: the three replay batches
EXIT_BATCH = [
    "fixed_1_5r_tp_sl_baseline", "scratch_no_followthrough_after_3_bars", "time_stop_10_bars", "breakeven_after_0_75r_mfe",
    "structure_trailing_stop", "partial_1r_runner", "tempo_deterioration_exit", "opposing_recent_high_low_target_or_exit",
]
SCRATCH_BATCH = [
    "scratch_no_followthrough_after_2_bars", "scratch_no_followthrough_after_3_bars", "scratch_no_followthrough_after_4_bars",
    "scratch_3_bars_plus_breakeven_after_0_75r_mfe", "scratch_3_bars_plus_mae_cut_0_65r",
    "scratch_3_bars_plus_session_drawdown_stop_3r",
]
STRUCTURE_BATCH = [
    "partial_1r_runner_structure_trail", "partial_1r_runner_fixed_2r", "partial_1r_runner_fixed_3r", "structure_trail_after_1r",
    "structure_trail_after_breakout_continuation", "fixed_1_5r_tp_sl_baseline",
]
DRAWDOWN_STOP = "scratch_3_bars_plus_session_drawdown_stop_3r"


def policy_table(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    rows = [p for p in POLICIES if names is None or p[0] in names]
    return spark.createDataFrame(
        rows,
        "policy string, target_r double, breakeven_at double, trail string, partial boolean, mae_cut double, "
        "scratch_bar int, time_bar int, tempo boolean",
    )


def trade_paths(bars: DataFrame, entries: DataFrame, spec: SessionSpec, horizon: int = 20, key: str = "candidate_id") -> DataFrame:
    """Bars after each entry as rows ``k = 1..horizon`` with path features.

    ``entries`` carry symbol, session_date, decision_sod, direction and prices.
    """
    ev = entries.select(key, *SESSION_KEY, "decision_sod", "direction", "entry_price", "stop_price", "target_price").dropDuplicates([key])
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    risk = F.greatest(F.abs(F.col("entry_price") - F.col("stop_price")), F.lit(spec.min_points))
    ev = ev.withColumns({"event_key": F.col(key).cast("string"), "sign": sign, "risk": risk, "horizon": F.lit(horizon)})
    numbered = number_bars(bars)
    rows = forward_window(
        entry_numbers(ev, numbered), numbered, start="start_no", length="horizon", max_length=horizon,
        carry=[key, "sign", "risk", "entry_price", "session_last_no"], bar_cols=["sod", "open", "high", "low", "close"],
    )
    up = F.col("sign") > 0
    w = W.partitionBy(key).orderBy("k")
    sofar = w.rowsBetween(W.unboundedPreceding, 0)
    s = F.col("sign")
    rows = rows.withColumns(
        {
            "x": s * F.col("close"),
            "fav": s * F.when(up, F.col("high")).otherwise(F.col("low")),
            "adv": s * F.when(up, F.col("low")).otherwise(F.col("high")),
            "body": F.abs(F.col("close") - F.col("open")),
            "side": F.signum(F.col("close") - F.col("open")).cast("int"),
            "e": s * F.col("entry_price"),
        }
    )
    last4 = F.array(*[F.lag("side", i).over(w) for i in (3, 2, 1)], F.col("side"))
    turns = sum(
        F.when((last4[i] != 0) & (last4[i + 1] != 0) & (last4[i] != last4[i + 1]), 1).otherwise(0) for i in range(3)
    )
    squeeze = F.col("body") <= F.greatest(F.lag("body", 3).over(w), F.lit(1e-9)) * 0.5
    three = w.rowsBetween(-2, 0)
    want, moved = F.sum(F.when(F.col("side") == s, 1).otherwise(0)).over(three), F.sum(F.abs(F.col("side"))).over(three)
    return rows.withColumns(
        {
            "mfe_r": F.greatest(F.max((F.col("fav") - F.col("e")) / F.col("risk")).over(sofar), F.lit(0.0)),
            "adv3": F.min("adv").over(three),
            "going": (F.col("k") >= 3) & (moved >= 2) & (want >= 2),
            "fading": (F.col("k") >= 4) & ((turns >= 2) | squeeze),
        }
    )


def _fold(path: Column) -> Column:
    """Exit of one trade under one policy, as a struct over the path array."""
    no = F.lit(None).cast("double")
    start = F.struct(
        F.col("stop").alias("stop"), F.lit(False).alias("taken"), F.lit(None).cast("string").alias("outcome"),
        no.alias("px"), F.lit(None).cast("int").alias("k"),
    )

    def step(a, b):
        stop = F.when((F.col("breakeven_at").isNotNull()) & (b["mfe_r"] >= F.col("breakeven_at")), F.greatest(a["stop"], F.col("e"))).otherwise(a["stop"])
        trail = (b["k"] >= 3) & F.coalesce(
            F.when(F.col("trail") == "half_r", b["mfe_r"] >= 0.50)
            .when(F.col("trail") == "one_r", b["mfe_r"] >= 1.0)
            .when(F.col("trail") == "continuation", (b["mfe_r"] >= 0.50) & b["going"])
            .when(F.col("trail") == "partial", a["taken"]),
            F.lit(False),
        )
        stop = F.when(trail, F.greatest(stop, b["adv3"])).otherwise(stop)
        now = F.col("partial") & ~a["taken"] & (b["fav"] >= F.col("e") + F.col("risk"))
        stop = F.when(now, F.col("e")).otherwise(stop)
        hit_stop, hit_target = b["adv"] <= stop, b["fav"] >= F.col("target")
        how = ladder(
            [
                (hit_stop & hit_target, "ambiguous_stop_first"),
                (hit_stop, "stop"),
                (hit_target, "target"),
                (F.coalesce((F.col("e") - b["adv"]) / F.col("risk") >= F.col("mae_cut"), F.lit(False)), "mae_cut"),
                (F.coalesce((b["k"] == F.col("scratch_bar")) & (b["mfe_r"] < 0.25), F.lit(False)), "scratch_no_followthrough"),
                (F.coalesce(b["k"] == F.col("time_bar"), F.lit(False)), "time_stop"),
                (F.col("tempo") & b["fading"], "tempo_deterioration"),
            ],
            F.lit(None).cast("string"),
        )
        px = F.when(hit_stop, stop).when(hit_target, F.col("target")).otherwise(b["x"])
        nxt = F.struct(
            stop.alias("stop"), (a["taken"] | now).alias("taken"), how.alias("outcome"),
            F.when(how.isNotNull(), px).alias("px"), b["k"].alias("k"),
        )
        return F.when(a["outcome"].isNotNull(), a).otherwise(nxt)

    return F.aggregate(path, start, step)


def replay_exits(
    bars: DataFrame, entries: DataFrame, spec: SessionSpec, *, policies: DataFrame | None = None, horizon: int = 20,
    fill: Fill = Fill(), key: str = "candidate_id",
) -> DataFrame:
    """Every entry under every policy: outcome, bars held, net R."""
    entries = cut(entries)  # one row per trade, read by several branches
    rows = trade_paths(bars, entries, spec, horizon, key)
    bar = F.struct("k", "fav", "adv", "x", "mfe_r", "adv3", "going", "fading", "session_date", "sod")
    paths = rows.groupBy(key).agg(F.array_sort(F.collect_list(bar)).alias("path"))
    cols = [c for c in ("market_state", "setup_quality", "distance_to_recent_high_low", "pnl_r") if c in entries.columns]
    ev = entries.select(key, *SESSION_KEY, "decision_sod", "direction", "entry_price", "stop_price", "target_price", *cols).dropDuplicates([key])
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    recent = num0("distance_to_recent_high_low") if "distance_to_recent_high_low" in cols else F.lit(0.0)
    recent = F.greatest(F.lit(0.5), F.least(F.when(recent == 0, 1.5).otherwise(recent), F.lit(1.5)))
    table = policy_table(bars.sparkSession) if policies is None else policies
    j = ev.join(paths, key, "left").withColumns(
        {
            "path": F.coalesce("path", F.array().cast(paths.schema["path"].dataType)),
            "e": sign * F.col("entry_price"),
            "stop": sign * F.col("stop_price"),
            "risk": F.greatest(F.abs(F.col("entry_price") - F.col("stop_price")), F.lit(spec.min_points)),
            "own_target": sign * F.col("target_price"),
            "recent_r": recent,
        }
    )
    j = fan_out(j, table).withColumn(
        "target",
        F.when(F.col("target_r").isNull(), F.col("own_target"))
        .when(F.col("target_r") == 0.0, F.col("e") + F.col("recent_r") * F.col("risk"))
        .otherwise(F.col("e") + F.col("target_r") * F.col("risk")),
    )
    j = j.withColumn("out", _fold(F.col("path")))
    n = F.size("path")
    last = F.try_element_at("path", F.greatest(n, F.lit(1)))
    px = F.coalesce(F.col("out.px"), last["x"], F.col("e"))
    held = F.coalesce(F.col("out.k"), F.lit(0))
    at_exit = F.try_element_at("path", F.greatest(held, F.lit(1)))
    net = (px - F.col("e") - 2.0 * F.lit(fill.tick_size * fill.per_side)) / F.col("risk")
    pnl = F.when(F.col("partial") & F.col("out.taken"), 0.5 + 0.5 * net).otherwise(net)
    return j.select(
        key, *SESSION_KEY, "policy", *[c for c in ("market_state", "setup_quality") if c in cols], "direction",
        F.coalesce("out.outcome", F.lit("timeout")).alias("outcome"),
        iso("session_date", "decision_sod").alias("entry_time"),
        F.coalesce(iso(at_exit["session_date"], at_exit["sod"]), iso("session_date", "decision_sod")).alias("exit_time"),
        "decision_sod",
        held.alias("bars_held"),
        pnl.alias("pnl_r"),
        (num0("pnl_r") if "pnl_r" in cols else F.lit(0.0)).alias("baseline_pnl_r"),
    )


def session_drawdown_stop(trades: DataFrame, by: list[str], *, limit: float = -3.0, key: str = "candidate_id", time: str = "decision_sod") -> DataFrame:
    """Drop trades after the session's cumulative R has reached the limit.

    A dropped trade comes after every kept one, so the running sum over all
    trades is the sum over kept ones until the stop.
    """
    g = [*by, "session_date"]
    cum = running(trades, g, [time, key], {"__cum": ("sum", "pnl_r")})
    hit = running(cum, g, [time, key], {"__hit": ("max", F.when(F.col("__cum") <= limit, 1).otherwise(0))}, inclusive=False)
    return hit.filter(F.coalesce("__hit", F.lit(0)) == 0).withColumn(
        "session_drawdown_stop_triggered", F.col("__cum") <= limit
    ).drop("__cum", "__hit")


def with_drawdown_stop(results: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Apply the session stop to the one policy that has it."""
    plain = results.filter(F.col("policy") != DRAWDOWN_STOP)
    stopped = session_drawdown_stop(results.filter(F.col("policy") == DRAWDOWN_STOP), ["policy"], key=key)
    return plain.unionByName(stopped.drop("session_drawdown_stop_triggered"))


def evaluate_policies(results: DataFrame, key: str = "candidate_id", policy: str = "policy") -> DataFrame:
    """Per policy: count, totals, median, win rate, payoff, drawdown, right tail."""
    curve = equity_curve(results, [policy], "pnl_r", ["session_date", "decision_sod", key])
    body = curve.groupBy(policy).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("pnl_r").alias("total_pnl_r"),
        F.avg("pnl_r").alias("avg_trade_r"),
        F.avg(F.when(F.col("pnl_r") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        payoff_ratio("pnl_r").alias("payoff_ratio"),
        F.least(F.min("drawdown_r"), F.lit(0.0)).alias("max_drawdown_r"),
    )
    med = exact_quantiles(results, [policy], "pnl_r", {"median_trade_r": 0.5})
    tail = exact_quantiles(results, [policy], "pnl_r", {"right_tail_p90_r": 0.9}, mode="nearest")
    return body.join(med, policy).join(tail, policy)


def improvement_attribution(results: DataFrame, baseline: str, key: str = "candidate_id", policies: DataFrame | None = None) -> DataFrame:
    """Where a policy's change against the baseline comes from.

    Policies of the configured table ``policies`` without a trade have zeros.
    """
    base = results.filter(F.col("policy") == baseline).select(key, F.col("pnl_r").alias("base_r"))
    d = F.col("pnl_r") - F.col("base_r")
    s = lambda cond: F.sum(F.when(cond, d).otherwise(0.0))
    g = results.join(base, key).groupBy("policy").agg(
        s((F.col("base_r") < 0) & (d > 0)).alias("cutting_losers_r"),
        s((F.col("base_r") > 0) & (d > 0)).alias("expanding_winners_r"),
        s((F.col("base_r") > 0) & (d < 0)).alias("winner_giveback_r"),
        s((F.col("base_r") < 0) & (d < 0)).alias("worsened_losers_r"),
    )
    if policies is not None:
        g = policies.select("policy").join(g, "policy", "left").fillna(0.0)
    top = F.greatest("expanding_winners_r", F.abs("winner_giveback_r"), F.abs("worsened_losers_r"))
    return g.withColumn(
        "primary_source",
        ladder([(F.col("cutting_losers_r") >= top, "cutting_losers"), (F.col("expanding_winners_r") > 0, "expanding_winners")], "mixed_or_negative"),
    )


def exit_gates(rows: DataFrame, *, min_trades: int = 100, max_dd: float = -12.0) -> DataFrame:
    """Advance a policy only when every gate holds."""
    ok = (
        (F.col("cpcv_status") == "pass") & (F.col("dsr_status") == "pass") & (F.col("trade_count") >= min_trades)
        & (F.col("max_drawdown_r") > max_dd) & F.col("point_in_time")
    )
    return rows.withColumn("decision", F.when(F.coalesce(ok, F.lit(False)), "advance_candidate").otherwise("reject"))


def replay_decision(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Shortlist policies that beat the baseline's tail; baseline is one row."""
    b = baseline.select(F.col("pbo").alias("b_pbo"), F.col("max_drawdown_r").alias("b_dd"))
    j = rows.crossJoin(F.broadcast(b))
    ok = (
        (F.col("dsr_status") == "pass") & (F.col("pbo") <= F.least(F.lit(0.25), F.col("b_pbo")))
        & (F.col("max_drawdown_r") > F.col("b_dd")) & (F.col("mean_total_pnl_r") > 0) & (F.col("min_path_pnl_r") > -5.0)
    )
    return j.withColumn(
        "governance_decision", F.when(F.coalesce(ok, F.lit(False)), "shortlist_for_full_validation").otherwise("reject_or_diagnostic_only")
    ).drop("b_pbo", "b_dd")


def structure_gates(rows: DataFrame, baseline: DataFrame, *, expected_trades: int | None = None) -> DataFrame:
    """The replay gates of the structure / partial batch, one column each.

    A policy has to take as many trades as expected, those of the baseline if not told.
    """
    b = baseline.select(F.col("max_drawdown_r").alias("b_dd"), F.col("right_tail_p90_r").alias("b_tail"), F.col("trade_count").alias("b_trades"))
    return rows.crossJoin(F.broadcast(b)).select(
        "policy",
        (F.col("max_drawdown_r") > F.col("b_dd")).alias("lower_drawdown"),
        (F.col("right_tail_p90_r") > F.col("b_tail")).alias("better_right_tail"),
        (F.coalesce("pbo", F.lit(1.0)) <= 0.25).alias("cpcv_pbo_lte_0_25"),
        (F.coalesce("min_path_pnl_r", F.lit(0.0)) > -5.0).alias("worst_path_gt_minus_5r"),
        (F.col("dsr_status") == "pass").alias("dsr_psr_pass"),
        (F.col("trade_count") == (F.col("b_trades") if expected_trades is None else F.lit(expected_trades))).alias("trade_count_as_expected"),
    )


def variant_family(policy="policy") -> Column:
    """Family of an exit policy from its name."""
    p = F.col(policy) if isinstance(policy, str) else policy
    has = lambda *xs: F.lit(False) if not xs else sum((p.contains(x).cast("int") for x in xs), F.lit(0)) > 0
    return ladder(
        [
            (has("scratch"), "scratch_exits"),
            (has("partial", "runner"), "partial_profit_runner"),
            (has("trailing", "structure_trail"), "structure_trailing"),
            (has("time_stop"), "time_stop"),
            (has("breakeven"), "break_even_policy"),
            (has("tempo"), "volatility_based_exit"),
            (has("recent_high_low"), "liquidity_rejection_exit"),
        ],
        "fixed_tp_sl_baseline",
    )


def leakage_rollup(rows: DataFrame, ok: str = "point_in_time", name: str = "policy") -> DataFrame:
    """Pass only when every policy passes; list the ones that do not."""
    return rows.agg(
        F.when(F.bool_and(ok), "pass").otherwise("fail").alias("status"),
        F.array_sort(F.collect_set(F.when(~F.col(ok), F.col(name)))).alias("issues"),
    )
