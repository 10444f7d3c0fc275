"""Single-position backtest, equity curves and performance roll-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import c, fan_out, num0, ratio
from barloom.functions.intervals import non_overlapping, non_overlapping_lists
from barloom.functions.scan import running, running_drawdown
from barloom.operators.policies import allow_signal, position_size, regime_multiplier
from barloom.schemas import TRADE_REQUIRED, require_columns
from barloom.session import cut


@dataclass(frozen=True)
class Fill:
    """Slippage: ticks per side or basis points of the price."""

    model: str = "ticks"
    tick_size: float = 0.25
    base_ticks: float = 3.0
    stressed_ticks: float = 6.0
    profile: str = "base"

    @property
    def per_side(self) -> float:
        return self.stressed_ticks if self.profile == "stressed" else self.base_ticks

    def slip(self, price) -> Column:
        if self.model == "ticks":
            return F.lit(self.tick_size * self.per_side)
        return c(price) * F.lit(self.per_side / 10_000.0)


def filled(entry, exit_, direction, fill: Fill) -> tuple[Column, Column, Column]:
    """Filled entry, filled exit and the points gained, by direction."""
    sign = F.when(c(direction) == "long", 1.0).otherwise(-1.0)
    a, b = c(entry) + sign * fill.slip(entry), c(exit_) - sign * fill.slip(exit_)
    return a, b, sign * (b - a)


def sized_signals(
    preds: DataFrame, *, threshold="threshold", sizing="binary_threshold_v1", throttle="none", regime_size="none",
    fill: Fill = Fill(),
) -> DataFrame:
    """Signals at or above the threshold with size, fills and R result.

    ``threshold``, ``sizing``, ``throttle`` and ``regime_size`` may be column
    objects, so a grid of policies runs in one job.
    """
    require_columns(preds, TRADE_REQUIRED, "prediction records")
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else c(threshold)
    a, b, points = filled("entry_price", "exit_price", "direction", fill)
    risk = F.abs(F.col("entry_price") - F.col("stop_price"))
    policy = F.coalesce(F.col("policy_size_multiplier"), F.lit(1.0)) if "policy_size_multiplier" in preds.columns else F.lit(1.0)
    s = preds.dropna(subset=["entry_time", "exit_time", "entry_price", "exit_price", "stop_price"]).filter(F.col("probability") >= t)
    return s.withColumns(
        {
            "risk_points": risk,
            "allowed": allow_signal(throttle),
            "base_size_multiplier": position_size(t, sizing),
            "regime_size_multiplier": regime_multiplier(regime_size),
            "policy_multiplier": policy,
            "filled_entry_price": a,
            "filled_exit_price": b,
            "gross_executed_pnl_r": points / F.nullif(risk, F.lit(0.0)),
        }
    ).withColumn(
        "size_multiplier", F.col("base_size_multiplier") * F.col("regime_size_multiplier") * F.col("policy_multiplier")
    )


#: What a summary of a backtest reads of a prediction.
SUMMARY_COLUMNS = ["candidate_id", "session_date", "direction", "entry_time", "exit_time", "entry_price", "exit_price", "stop_price", "probability", "pnl_r",
                   "reg_high_vol_state", "reg_trending_state", "policy_size_multiplier"]


def lean(preds: DataFrame, *more: str) -> DataFrame:
    """The columns a summary reads, before rows are repeated per policy."""
    return preds.select(*[c for c in preds.columns if c in SUMMARY_COLUMNS or c in TRADE_REQUIRED or c in more])


def taken_signals(signals: DataFrame, run: list[str], key: str = "candidate_id") -> DataFrame:
    """Signals the single-position account takes, per ``run``."""
    can = signals.filter(F.col("allowed") & (F.col("risk_points") > 0) & (F.col("size_multiplier") > 0))
    return non_overlapping(can, run=run, entry="entry_time", exit_="exit_time", key=key)


def executed_trades(signals: DataFrame, run: list[str], key: str = "candidate_id") -> DataFrame:
    """Trades the single-position account takes, with the equity curve.

    Rows that can never hold a position are removed first; the rest is chosen
    by the non-overlap rule per ``run``.
    """
    kept = taken_signals(signals, run, key).withColumn("executed_pnl_r", F.col("gross_executed_pnl_r") * F.col("size_multiplier"))
    return equity_curve(kept, run, "executed_pnl_r", ["entry_time", key])


def equity_curve(trades: DataFrame, run: list[str], pnl: str, order: list[str], *, floor_zero: bool = True) -> DataFrame:
    """Cumulative result and drawdown; the peak starts at 0 unless told not to."""
    return running_drawdown(trades, run, order, pnl, floor_zero=floor_zero)


def session_rollup(trades: DataFrame, run: list[str], pnl: str = "executed_pnl_r") -> DataFrame:
    return trades.groupBy(*run, "session_date").agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum(pnl).alias("session_pnl_r"), F.avg(pnl).alias("avg_trade_r")
    )


def session_counts(trades: DataFrame, run: list[str], pnl: str = "executed_pnl_r") -> DataFrame:
    return session_rollup(trades, run, pnl).groupBy(*run).agg(
        F.count(F.lit(1)).alias("session_count"),
        F.count(F.when(F.col("session_pnl_r") > 0, 1)).alias("positive_sessions"),
        F.count(F.when(F.col("session_pnl_r") < 0, 1)).alias("negative_sessions"),
    )


def overlap_skips(signals: DataFrame, executed: DataFrame, run: list[str], key: str = "candidate_id") -> DataFrame:
    """Signals refused because a position was open at their entry."""
    took = executed.select(*run, key, F.lit(1).alias("__took"))
    s = signals.filter("allowed").join(took, [*run, key], "left")
    s = running(
        s, run, ["entry_time", key], {"__busy": ("last", F.when(F.col("__took") == 1, F.col("exit_time")))}, inclusive=False
    )
    busy = F.col("__took").isNull() & (F.col("entry_time") < F.col("__busy"))
    return s.groupBy(*run).agg(F.count(F.when(busy, 1)).alias("overlap_skips"))


def backtest_summary(signals: DataFrame, executed: DataFrame, run: list[str]) -> DataFrame:
    """One row per run: counts, totals, sizes, drawdown, sessions."""
    parts = [trade_totals(executed, run), session_counts(executed, run), overlap_skips(signals, executed, run)]
    return with_parts(signal_counts(signals, run), parts, run)


def signal_counts(signals: DataFrame, run: list[str]) -> DataFrame:
    return signals.groupBy(*run).agg(
        F.count(F.lit(1)).alias("signal_count"), F.count(F.when(~F.col("allowed"), 1)).alias("throttled_signals")
    )


def results() -> list[Column]:
    """Count, total, average, share of wins and drawdown of executed trades, as aggregates."""
    pnl = F.col("executed_pnl_r")
    return [F.count(F.lit(1)).alias("trade_count"), F.sum(pnl).alias("total_pnl_r"), F.avg(pnl).alias("avg_trade_r"),
            F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.min("drawdown_r").alias("max_drawdown_r")]


def control_runs(preds: DataFrame, control: str, *, threshold: float, key: str = "candidate_id") -> DataFrame:
    """Results per ``run``, ``actual`` by the probability and ``random`` by the column ``control``, in one pass over rows stored once.

    A run without signals has no row.
    """
    runs = {"actual": F.col("probability") >= threshold, "random": F.col(control) >= threshold}
    s = preds.withColumn("__runs", F.filter(F.array(*[F.when(rule, i) for i, rule in enumerate(runs.values())]), lambda i: i.isNotNull()))
    # the binary size is the same for every signal
    s = sized_signals(s.withColumn("probability", F.lit(float(threshold))), threshold=threshold)
    head = s.select(F.explode("__runs").alias("__run")).groupBy("__run").agg(F.count(F.lit(1)).alias("signal_count"))
    can = s.filter((F.col("risk_points") > 0) & (F.col("size_multiplier") > 0))
    can = can.select(key, "entry_time", "exit_time", (F.col("gross_executed_pnl_r") * F.col("size_multiplier")).alias("executed_pnl_r"), "__runs")
    took = non_overlapping_lists(can, runs="__runs", name="__run", entry="entry_time", exit_="exit_time", key=key)
    trades = equity_curve(took, ["__run"], "executed_pnl_r", ["entry_time", key]).groupBy("__run").agg(*results())
    out = head.join(trades, "__run", "left").fillna(0, ["trade_count"])
    return out.withColumn("run", F.get(F.array(*[F.lit(n) for n in runs]), F.col("__run"))).drop("__run")


def trade_totals(executed: DataFrame, run: list[str]) -> DataFrame:
    return executed.groupBy(*run).agg(
        *results(),
        F.avg("size_multiplier").alias("avg_size_multiplier"),
        F.avg("base_size_multiplier").alias("avg_base_size_multiplier"),
        F.avg("regime_size_multiplier").alias("avg_regime_size_multiplier"),
        F.avg("policy_multiplier").alias("avg_policy_size_multiplier"),
    )


def with_parts(head: DataFrame, parts: list[DataFrame], run: list[str]) -> DataFrame:
    """A summary from its parts; what a run without trades lacks counts as 0."""
    out = head
    for p in parts:
        out = out.join(p, run, "left") if run else out.crossJoin(F.broadcast(p))
    return out.fillna(0, ["trade_count", "overlap_skips", "session_count", "positive_sessions", "negative_sessions"])


#: What a summary reads of a signal, besides the run.
SIGNAL_COLUMNS = ["candidate_id", "session_date", "entry_time", "exit_time", "allowed", "risk_points", "gross_executed_pnl_r", "size_multiplier",
                  "base_size_multiplier", "regime_size_multiplier", "policy_multiplier"]


def run_backtest(signals: DataFrame, run: list[str]) -> tuple[DataFrame, DataFrame]:
    """(executed trades, summary); the trade list is stored once, four aggregates read it.

    Trades have the run, ``SIGNAL_COLUMNS``, their result and the equity curve.
    """
    signals = signals.select(*run, *[c for c in SIGNAL_COLUMNS if c not in run])
    executed = cut(executed_trades(signals, run))
    return executed, backtest_summary(signals, executed, run)


def stitched_summary(preds: DataFrame, thresholds: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Performance of all signals per threshold: no overlap rule, no slippage.

    The running peak starts at the first cumulative value, not at 0.
    """
    t = fan_out(preds.filter(F.col("entry_time").isNotNull()), thresholds).filter(
        F.col("probability") >= F.col("threshold")
    )
    curve = equity_curve(t, ["threshold"], "pnl_r", ["entry_time", key], floor_zero=False)
    body = curve.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("pnl_r").alias("total_pnl_r"),
        F.avg("pnl_r").alias("avg_trade_r"),
        F.avg(F.when(F.col("label") == 1, 1.0).otherwise(0.0)).alias("win_rate"),
        F.min("drawdown_r").alias("max_drawdown_r"),
    )
    return body.join(session_counts(t, ["threshold"], "pnl_r"), "threshold")


def utility(total="total_pnl_r", avg="avg_trade_r", drawdown="max_drawdown_r", trades="trade_count", *,
            w_total: float = 1.0, w_avg: float = 0.5, w_dd: float = 0.75, w_count: float = 0.05, min_trades: int = 4) -> Column:
    """Execution utility: reward total and average, punish drawdown, credit support."""
    return (
        w_total * num0(total) + w_avg * num0(avg) - w_dd * F.abs(num0(drawdown))
        + w_count * F.least(F.coalesce(c(trades), F.lit(0)), F.lit(min_trades))
    )


def translation_grid(
    preds: DataFrame, thresholds: DataFrame, *, sizing: str = "binary_threshold_v1", throttle: str = "none",
    regime_size: str = "none", fill: Fill = Fill(),
) -> DataFrame:
    """Backtest per threshold, sized and binary side by side, in one job; signals are not repeated per threshold and mode."""
    modes = {"sized": (sizing, throttle, regime_size), "binary": ("binary_threshold_v1", "none", "none")}
    cuts = [r["threshold"] for r in thresholds.select("threshold").distinct().collect()]  # configuration
    grid = [(float(t), mode, F.col("probability") >= t, *modes[mode]) for t in cuts for mode in modes]
    s = sized_signals(lean(preds), threshold=float(min(cuts)), fill=fill)
    sizes = [position_size(t, size) * regime_multiplier(regime) * F.col("policy_multiplier") for t, _, _, size, _, regime in grid]
    number = lambda col: F.count(F.when(col, 1))
    heads = [F.struct(F.lit(i).alias("__run"), F.lit(t).alias("threshold"), F.lit(mode).alias("mode"), number(signal).alias("signal_count"), number(signal & ~allow_signal(rule)).alias("throttled_signals"))
             for i, (t, mode, signal, _, rule, _) in enumerate(grid)]
    head = s.agg(F.array(*heads).alias("g")).select(F.inline("g")).filter("signal_count > 0")
    can = [F.when(signal & allow_signal(rule) & (F.col("risk_points") > 0) & (size > 0), i) for i, ((_, _, signal, _, rule, _), size) in enumerate(zip(grid, sizes))]
    s = s.select("candidate_id", "entry_time", "exit_time", "probability", "reg_high_vol_state", "reg_trending_state", "policy_multiplier", "gross_executed_pnl_r",
                 F.filter(F.array(*can), lambda i: i.isNotNull()).alias("__runs"))
    took = non_overlapping_lists(s, runs="__runs", name="__run", entry="entry_time", exit_="exit_time", key="candidate_id")
    took = took.withColumn("size_multiplier", F.coalesce(*[F.when(F.col("__run") == i, size) for i, size in enumerate(sizes)]))
    took = took.select("__run", "candidate_id", "entry_time", "size_multiplier", (F.col("gross_executed_pnl_r") * F.col("size_multiplier")).alias("executed_pnl_r"))
    trades = equity_curve(took, ["__run"], "executed_pnl_r", ["entry_time", "candidate_id"]).groupBy("__run").agg(*results(), F.avg("size_multiplier").alias("avg_size_multiplier"))
    summary = head.join(trades, "__run", "left").fillna(0, ["trade_count"]).withColumn("utility_score", F.when(F.col("trade_count") > 0, utility()))
    z = lambda name, col, mode: F.max(F.when(F.col("mode") == mode, F.col(col))).alias(name)
    wide = summary.groupBy("threshold").agg(
        z("trade_count", "trade_count", "sized"), z("avg_pnl_r", "avg_trade_r", "sized"), z("win_rate", "win_rate", "sized"),
        z("total_pnl_r", "total_pnl_r", "sized"), z("avg_size_multiplier", "avg_size_multiplier", "sized"),
        z("throttled_signals", "throttled_signals", "sized"), z("utility_score", "utility_score", "sized"),
        z("binary_trade_count", "trade_count", "binary"), z("binary_total_pnl_r", "total_pnl_r", "binary"),
        z("binary_utility_score", "utility_score", "binary"),
    )
    return wide.withColumn("utility_gap_vs_binary", F.col("utility_score") - F.col("binary_utility_score"))


def best_threshold(grid: DataFrame) -> DataFrame:
    """Best grid row by (utility, total, trades); pass when it made money."""
    best = grid.orderBy(
        F.col("utility_score").desc_nulls_last(), F.coalesce("total_pnl_r", F.lit(0.0)).desc(),
        F.col("trade_count").desc(), F.col("threshold")
    ).limit(1)
    return best.withColumn(
        "status", F.when((F.col("trade_count") > 0) & (F.col("total_pnl_r") > 0), "pass").otherwise("fail")
    )


def largest_loss_cluster(trades: DataFrame, run: list[str], pnl: str, order: list[str]) -> DataFrame:
    """Most negative sum over consecutive losing trades.

    The run of losses is identified by the number of non-losing trades before
    it, which is a running count; no group is sorted in one task.
    """
    n = running(trades, run, order, {"__wins": ("sum", F.when(F.col(pnl) < 0, 0).otherwise(1))})
    loss = F.sum(F.when(F.col(pnl) < 0, F.col(pnl)).otherwise(0.0))
    per = n.groupBy(*run, "__wins").agg(loss.alias("loss"))
    return per.groupBy(*run).agg(F.least(F.min("loss"), F.lit(0.0)).alias("largest_loss_cluster_r"))


def round_trip_cost_r(labels: DataFrame, by: list[str], fill: Fill = Fill(), fees_points: float = 0.0) -> DataFrame:
    """Cost of a round trip in R from the average risk of the labels."""
    risk = F.avg(F.abs(F.col("entry_price") - F.col("stop_price")))
    cost = 2.0 * fill.tick_size * fill.per_side + fees_points
    return labels.groupBy(*by).agg(risk.alias("avg_risk_points"), ratio(F.lit(cost), risk).alias("round_trip_cost_r"))
