"""Planned-trade stream and its account-level report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.functions.intervals import non_overlapping
from barloom.functions.scan import running
from barloom.functions.stats import sharpe
from barloom.operators.backtest import Fill, filled

# fixed value: dollars per point of the replayed contract
MULTIPLIER = 2.0


def planned_trades(trades: DataFrame, key: str = "candidate_id", by: list[str] | None = None) -> DataFrame:
    """One entry per timestamp of a run: the highest probability, then the smallest id.

    ``trades``: entry_time, exit_time, probability, direction, prices.
    """
    best = F.min_by(F.struct(*trades.columns), F.struct(-F.col("probability"), F.col(key)))
    return trades.groupBy(*(by or []), "entry_time").agg(best.alias("__r")).select("__r.*")


def entry_collisions(trades: DataFrame) -> DataFrame:
    """Planned entries and how many share a timestamp with a better one."""
    n = trades.groupBy("entry_time").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("planned"), F.sum(F.col("n") - 1).alias("same_timestamp_entry_collisions"))


def event_table(trades: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Entry and exit actions per timestamp, as JSON arrays."""
    entry = trades.select(F.col("entry_time").alias("timestamp"), F.struct(F.col(key).alias("candidate_id"), "direction", "probability").alias("a"), F.lit("entry").alias("kind"))
    exit_ = trades.select(F.col("exit_time").alias("timestamp"), F.struct(F.col(key).alias("candidate_id"), "direction", "probability").alias("a"), F.lit("exit").alias("kind"))
    both = entry.unionByName(exit_)
    pick = lambda k: F.to_json(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("a")))))
    return both.groupBy("timestamp").agg(
        pick("entry").alias("entry_actions"), pick("exit").alias("exit_actions"),
        F.count(F.when(F.col("kind") == "entry", 1)).alias("entries"), F.count(F.when(F.col("kind") == "exit", 1)).alias("exits"),
    )


def replayed(trades: DataFrame, *, by: list[str] | None = None, fill: Fill = Fill(), key: str = "candidate_id", capital: float = 100_000.0) -> DataFrame:
    """Trades an account with one position takes, in dollars."""
    by = by or []
    first = planned_trades(trades, key, by)
    kept = non_overlapping(first, run=by, entry="entry_time", exit_="exit_time", key=key)
    _, _, points = filled("entry_price", "exit_price", "direction", fill)
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    gross = sign * (F.col("exit_price") - F.col("entry_price")) * MULTIPLIER
    t = kept.withColumns({"gross_pnl": gross, "net_pnl": points * MULTIPLIER}).withColumn("cost", F.col("gross_pnl") - F.col("net_pnl"))
    cum = running(t, by, ["entry_time", key], {"__cum": ("sum", "net_pnl")})
    eq = cum.withColumn("equity", F.lit(capital) + F.col("__cum")).drop("__cum")
    top = running(eq, by, ["entry_time", key], {"__peak": ("max", "equity")})
    peak = F.greatest(F.col("__peak"), F.lit(capital))
    return top.withColumn("drawdown_pct", (F.col("equity") - peak) / peak * 100.0).drop("__peak")


def replay_report(trades: DataFrame, by: list[str] | None = None, capital: float = 100_000.0) -> DataFrame:
    """Account metrics of a replayed trade list."""
    p = F.col("net_pnl")
    win, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, -p).otherwise(0.0))
    down = F.sqrt(F.avg(F.when(p < 0, p * p).otherwise(0.0)))
    n = F.count(F.lit(1))
    return trades.groupBy(*(by or [])).agg(
        n.alias("num_trades"),
        F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        (F.sum("net_pnl") / capital * 100.0).alias("total_return_pct"),
        F.min("drawdown_pct").alias("max_drawdown_pct"),
        F.sum("gross_pnl").alias("total_gross_pnl"),
        F.sum("cost").alias("total_costs"),
        sharpe("net_pnl").alias("sharpe"),
        F.when(down > 0, F.avg(p) / down * F.sqrt(n.cast("double"))).alias("sortino"),
        ratio(win, loss, None).alias("profit_factor"),
        F.avg(p).alias("avg_trade"),
        F.max(p).alias("largest_win"),
        F.min(p).alias("largest_loss"),
    )


def stress_view(report: DataFrame) -> DataFrame:
    return report.select(*[c for c in ("profile",) if c in report.columns], "sharpe", "max_drawdown_pct", "total_costs", "profit_factor")
