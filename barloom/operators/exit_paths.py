"""Shape of the path after entry: excursions, persistence, archetypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.columns import clip, ladder, num0
from barloom.functions.stats import exact_quantiles
from barloom.operators.exits import trade_paths
from barloom.schemas import SessionSpec
from barloom.session import cut

# fixed values: exit families and the archetypes that support them
FAMILY_SUPPORT = [
    ("scratch_exits", ["fast_failure", "fake_breakout"]),
    ("structure_trailing", ["late_reversal", "runner"]),
    ("partial_profit_runner", ["runner", "late_reversal"]),
    ("time_stop", ["slow_bleed", "chop_decay"]),
    ("break_even_policy", ["late_reversal"]),
    ("volatility_based_exit", ["chop_decay", "slow_bleed"]),
    ("liquidity_rejection_exit", ["fake_breakout"]),
]
# fixed values: archetypes inside each focus on a path class
FOCUS = {
    "runner": ["runner", "strong_continuation"],
    "delayed_runner": ["runner", "strong_continuation", "slow_bleed"],
    "chop": ["chop_decay", "slow_bleed"],
    "failure": ["fast_failure", "late_reversal", "fake_breakout", "slow_bleed"],
}


def outcome_taxonomy() -> Column:
    """Seven-way ordered archetype of a trade path."""
    mfe, mae, pnl = F.col("mfe_r"), F.col("mae_r"), F.col("pnl_r")
    return ladder(
        [
            ((mae <= -0.75) & (F.col("time_to_mae_bars") <= 3) & (mfe < 0.35), "fast_failure"),
            ((mfe >= 1.5) & (pnl > 0.5), "runner"),
            ((mfe >= 1.0) & (F.col("follow_through_persistence") >= 0.55) & (pnl > 0), "strong_continuation"),
            ((mfe >= 0.75) & (pnl <= 0) & (F.col("reversal_behavior") >= 0.70), "late_reversal"),
            ((mfe < 0.45) & (mae <= -0.50) & F.col("liquidity_rejection"), "fake_breakout"),
            ((pnl < 0) & (F.abs(mae) < 0.75) & (F.col("time_to_mae_bars") > 3), "slow_bleed"),
            (
                (F.col("alternating_bar_ratio_path") >= 0.45) | (F.col("tempo_decay") >= 0.55) | (F.col("volatility_collapse") >= 0.55),
                "chop_decay",
            ),
            (pnl > 0, "strong_continuation"),
        ],
        "slow_bleed",
    )


def path_diagnostics(bars: DataFrame, entries: DataFrame, spec: SessionSpec, horizon: int = 20, key: str = "candidate_id") -> DataFrame:
    """One row per trade: excursions in R, timing, persistence, archetype.

    ``entries`` are labelled entries; market-state columns are optional.
    """
    entries = cut(entries)  # one row per trade, read by several branches
    rows = trade_paths(bars, entries, spec, horizon, key)
    w = W.partitionBy(key)
    prev = F.lag("side").over(w.orderBy("k"))
    fav, adv = (F.col("fav") - F.col("e")) / F.col("risk"), (F.col("adv") - F.col("e")) / F.col("risk")
    rows = rows.withColumns(
        {
            "n": F.max("k").over(w),
            "rng": F.greatest(F.col("high") - F.col("low"), F.lit(0.0)),
            "turned": (prev != 0) & (F.col("side") != 0) & (prev != F.col("side")),
            "fav_r": fav,
            "adv_r": adv,
        }
    )
    early = (F.col("k") <= 3) | (F.col("n") < 3)
    late = (F.col("k") > F.col("n") - 3) & (F.col("n") >= 3)
    mean_if = lambda cond, x: F.avg(F.when(cond, F.col(x)))
    g = rows.groupBy(key).agg(
        F.max("n").alias("n"),
        F.max(F.struct(F.col("fav_r").alias("v"), (-F.col("k")).alias("k"))).alias("best"),
        F.min(F.struct(F.col("adv_r").alias("v"), F.col("k").alias("k"))).alias("worst"),
        F.sum(F.when((F.col("k") <= 6) & (F.col("x") > F.col("e")), 1.0).otherwise(0.0)).alias("good"),
        mean_if(early, "body").alias("body1"), mean_if(late, "body").alias("body2"),
        mean_if(early, "rng").alias("rng1"), mean_if(late, "rng").alias("rng2"),
        F.sum(F.when(F.col("turned"), 1.0).otherwise(0.0)).alias("turns"),
    )
    cols = [c for c in ("market_state", "setup_quality", "distance_to_recent_high_low", "wick_rejection_ratio_recent") if c in entries.columns]
    e = entries.select(key, "symbol", "session_date", "direction", "pnl_r", *cols).dropDuplicates([key])
    j = e.join(g, key, "left")
    decay = lambda a, b: F.coalesce(1.0 - F.least(F.coalesce(b, a) / F.greatest(a, F.lit(1e-9)), F.lit(1.0)), F.lit(0.0))
    mfe = F.coalesce(F.col("best.v"), F.lit(0.0))
    reversal = F.when(mfe > 0, F.greatest(mfe - F.col("pnl_r"), F.lit(0.0)) / F.greatest(mfe, F.lit(1e-9))).otherwise(0.0)
    dist = num0("distance_to_recent_high_low") if "distance_to_recent_high_low" in cols else F.lit(0.0)
    wick = num0("wick_rejection_ratio_recent") if "wick_rejection_ratio_recent" in cols else F.lit(0.0)
    follow = F.coalesce(F.col("good") / F.greatest(F.lit(1), F.least(F.lit(6), F.col("n"))), F.lit(0.0))
    out = j.select(
        key, "symbol", "session_date", "direction", *[c for c in ("market_state", "setup_quality") if c in cols], "pnl_r",
        mfe.alias("mfe_r"),
        F.coalesce(F.col("worst.v"), F.lit(0.0)).alias("mae_r"),
        F.coalesce(-F.col("best.k"), F.lit(0)).alias("time_to_mfe_bars"),
        F.coalesce(F.col("worst.k"), F.lit(0)).alias("time_to_mae_bars"),
        follow.alias("follow_through_persistence"),
        decay(F.col("body1"), F.col("body2")).alias("tempo_decay"),
        decay(F.col("rng1"), F.col("rng2")).alias("volatility_collapse"),
        reversal.alias("reversal_behavior"),
        ((F.when(dist == 0, 1.0).otherwise(dist) <= 0.25) & (wick >= 0.55)).alias("liquidity_rejection"),
        clip((follow + F.greatest(mfe, F.lit(0.0)) / 1.5 + (1.0 - reversal)) / 3.0, 0.0, 1.0).alias("continuation_quality_after_entry"),
        F.coalesce(F.col("turns") / F.greatest(F.col("n") - 1, F.lit(1)), F.lit(0.0)).alias("alternating_bar_ratio_path"),
    )
    return out.withColumn("trade_outcome_taxonomy", outcome_taxonomy())


def archetype_summary(paths: DataFrame) -> DataFrame:
    """Per archetype: support, totals, means, median."""
    sessions = paths.select("trade_outcome_taxonomy", "session_date").distinct().groupBy("trade_outcome_taxonomy").agg(
        F.count(F.lit(1)).alias("session_count")
    )
    g = paths.groupBy("trade_outcome_taxonomy").agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("pnl_r").alias("total_pnl_r"),
        F.avg("pnl_r").alias("avg_pnl_r"),
        F.avg("mfe_r").alias("avg_mfe_r"),
        F.avg("mae_r").alias("avg_mae_r"),
        F.avg("follow_through_persistence").alias("avg_follow_through_persistence"),
        F.avg("tempo_decay").alias("avg_tempo_decay"),
        F.avg("volatility_collapse").alias("avg_volatility_collapse"),
        F.sum(F.when(F.col("liquidity_rejection"), 1).otherwise(0)).alias("liquidity_rejection_count"),
    )
    med = exact_quantiles(paths, ["trade_outcome_taxonomy"], "pnl_r", {"median_pnl_r": 0.5})
    return g.join(sessions, "trade_outcome_taxonomy").join(med, "trade_outcome_taxonomy").withColumnRenamed(
        "trade_outcome_taxonomy", "archetype"
    )


def path_summary(paths: DataFrame, focus: str | None = None) -> DataFrame:
    """One-row means over all paths, or over the archetypes of a focus; null without any."""
    p = paths if focus is None else paths.filter(F.col("trade_outcome_taxonomy").isin(FOCUS.get(focus, [])))
    sess = p.select("session_date").distinct().agg(F.count(F.lit(1)).alias("session_count"))
    body = p.agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("pnl_r").alias("total_pnl_r"),
        *[
            F.avg(x).alias(f"avg_{x}")
            for x in ("mfe_r", "mae_r", "time_to_mfe_bars", "time_to_mae_bars", "follow_through_persistence", "tempo_decay", "volatility_collapse")
        ],
    )
    return body.crossJoin(F.broadcast(sess))


def family_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAMILY_SUPPORT, "family string, archetypes array<string>")


def candidate_exit_families(archetypes: DataFrame, minimum: int = 10) -> DataFrame:
    """Support of each exit family over the archetypes it targets."""
    f = family_table(archetypes.sparkSession)
    mapped = f.select("family", F.explode("archetypes").alias("archetype"))
    g = mapped.join(archetypes.select("archetype", "trade_count", "total_pnl_r"), "archetype", "left").groupBy("family").agg(
        F.coalesce(F.sum("trade_count"), F.lit(0)).alias("diagnostic_support_trades"),
        F.coalesce(F.sum("total_pnl_r"), F.lit(0.0)).alias("supported_archetype_pnl_r"),
    )
    return g.withColumn(
        "initial_status",
        F.when(F.col("diagnostic_support_trades") >= minimum, "eligible_for_bounded_replay").otherwise("diagnostic_only_low_support"),
    )


def losing_archetypes(paths: DataFrame, k: int = 5) -> DataFrame:
    return (
        paths.filter(F.col("pnl_r") <= 0).groupBy("trade_outcome_taxonomy").agg(F.count(F.lit(1)).alias("losses"))
        .orderBy(F.col("losses").desc(), "trade_outcome_taxonomy").limit(k)
    )


