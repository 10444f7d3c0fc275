"""Grouped diagnostics: attempts, failure clusters, state tables, attribution.

Repeated group-bys over one table are written as grouping sets on a table that
is pre-aggregated to the finest combination, so a hot group is combined
map-side and the sets only touch the small result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.columns import hhmm, ladder, num0, ratio
from barloom.functions.scan import running
from barloom.functions.stats import exact_quantiles

# fixed values: recommendation per failure reason (family, focus)
RECOMMENDATIONS = {
    "no_follow_through": ("exit_behavior_research", ["post_reclaim_displacement", "runner_vs_chop_path", "scratch_timing"]),
    "weak_continuation": ("feature", ["confirmation_strength", "followthrough_efficiency", "auction_clarity"]),
    "deep_retrace_failure": ("setup", ["retrace_depth_tolerance", "reclaim_quality", "environment_eligibility"]),
    "no_reclaim_edge": ("candidate_universe_expansion", ["attempt_definition", "reclaim_timing", "candidate_deduplication"]),
}
DEFAULT_RECOMMENDATION = ("feature", ["attempt_state_classification", "confirmation_quality"])


def time_bucket(seconds="trigger_seconds_after_open") -> Column:
    s = F.col(seconds)
    return ladder([(s.isNull(), "unknown"), (s <= 300, "early_open"), (s <= 900, "mid_open")], "late_open")


def probability_bucket(p="probability") -> Column:
    x = F.col(p)
    return ladder([(x.isNull(), "unknown"), (x < 0.4, "low_confidence"), (x < 0.6, "mid_confidence")], "high_confidence")


def path_class() -> Column:
    o = F.coalesce("outcome", F.lit("unknown"))
    held = F.col("bars_held")
    return ladder(
        [
            ((o == "target") & (held.isNull() | (held <= 6)), "runner"),
            (o == "target", "delayed_runner"),
            (o == "timeout", "chop"),
            (F.coalesce(F.col("pnl_r") <= 0, F.lit(False)), "failure"),
        ],
        "unclear",
    )


def setup_state() -> Column:
    retrace, cont = num0("deepest_zone_retrace_fraction"), num0("post_reclaim_close_strength")
    eff, close, fails = num0("break_efficiency_ratio"), num0("reclaim_close_location"), num0("reclaim_failure_count")
    return ladder(
        [
            ((F.col("outcome") == "timeout") & (cont < 0.25), "chop"),
            (retrace >= 0.75, "repair"),
            (fails >= 2, "failed_reclaim"),
            ((eff >= 0.55) & (close >= 0.65) & (cont >= 0.45) & (fails <= 1), "continuation"),
            ((cont >= 0.3) | (close >= 0.45), "late_followthrough"),
        ],
        "weak_confirmation",
    )


def environment_state() -> Column:
    vol, trend = F.col("reg_high_vol_state").cast("int"), F.col("reg_trending_state").cast("int")
    cont, eff = num0("post_reclaim_close_strength"), num0("break_efficiency_ratio")
    return ladder(
        [
            ((trend == 1) & (vol == 1), "trend_expansion"),
            (trend == 1, "trend_day"),
            ((vol == 1) & (cont < 0.25), "volatile_chop"),
            ((eff < 0.3) & (cont < 0.2), "balance_chop"),
        ],
        "mixed_auction",
    )


def failure_reason(reclaims="reclaim_failure_count") -> Column:
    """Ordered failure reason; the reclaim counter differs by caller."""
    retrace, cont = num0("deepest_zone_retrace_fraction"), num0("post_reclaim_close_strength")
    return ladder(
        [
            (F.col("outcome") == "timeout", "no_follow_through"),
            (F.col("outcome") == "ambiguous_stop_first", "same_bar_conflict"),
            (retrace > 0.75, "deep_retrace_failure"),
            (cont < 0.2, "weak_continuation"),
            (num0(reclaims) == 0, "no_reclaim_edge"),
        ],
        "stop_before_target",
    )


ATTEMPT_FEATURES = [
    "direction", "setup_subtype", "trigger_seconds_after_open", "break_efficiency_ratio", "reclaim_close_location",
    "reclaim_failure_count", "deepest_zone_retrace_fraction", "post_reclaim_close_strength", "reg_high_vol_state", "reg_trending_state",
]


def build_attempts(preds: DataFrame, labels: DataFrame, features: DataFrame) -> DataFrame:
    """Predictions with their labels and features, classified seven ways.

    ``preds``: candidate_id, session_date, probability, prediction.
    """
    f = features.select("candidate_id", *[x for x in ATTEMPT_FEATURES if x in features.columns])
    for x in ATTEMPT_FEATURES:
        if x not in f.columns:
            f = f.withColumn(x, F.lit("unknown") if x in ("direction", "setup_subtype") else F.lit(None).cast("double"))
    j = (
        preds.select("candidate_id", "session_date", "probability", "prediction")
        .join(labels.select("candidate_id", "label", "outcome", "pnl_r", "bars_held"), "candidate_id", "left")
        .join(f, "candidate_id", "left")
        .withColumns({"outcome": F.coalesce("outcome", F.lit("unknown")), "setup_subtype": F.coalesce("setup_subtype", F.lit("unknown"))})
    )
    return j.select(
        F.concat(F.lit("ATT-"), "candidate_id").alias("attempt_id"), "candidate_id", "session_date",
        F.coalesce("direction", F.lit("unknown")).alias("direction"), "setup_subtype",
        setup_state().alias("setup_state"), environment_state().alias("environment_state"), time_bucket().alias("time_bucket"),
        probability_bucket().alias("probability_bucket"), (F.col("prediction") == 1).alias("executed"), "label", "prediction",
        "probability", "pnl_r", "bars_held", "outcome", failure_reason().alias("failure_reason"), path_class().alias("path_class"),
        *[F.col(x) for x in ATTEMPT_FEATURES[2:]],
    )


def _modes(base: DataFrame, by: list[str], cols: list[str], n: str) -> DataFrame:
    """Most frequent value of several columns per group (ties: the smallest).

    Works on counts, so the group itself is never collected.
    """
    out = None
    for col in cols:
        c = base.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.sum(n).alias("__n"))
        # largest count first, then the smallest value
        m = c.groupBy(*by).agg(F.min(F.struct((-F.col("__n")).alias("a"), F.col(col).alias("v")))["v"].alias(f"{col}_mode"))
        out = m if out is None else out.join(m, by, "full")
    return out


def failure_clusters(attempts: DataFrame, limit: int = 5, minimum: int = 2) -> DataFrame:
    """Largest clusters of failed attempts, with modes and a recommendation."""
    key = ["failure_reason", "setup_state", "environment_state", "time_bucket"]
    failed = attempts.filter((F.col("label") == 0) | (F.coalesce("pnl_r", F.lit(0.0)) <= 0))
    fine = failed.groupBy(*key, "setup_subtype", "probability_bucket", "path_class").agg(F.count(F.lit(1)).alias("n"))
    modes = _modes(fine, key, ["setup_subtype", "probability_bucket", "path_class"], "n")
    g = failed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("pnl_r").alias("avg_pnl_r"), F.avg("probability").alias("avg_probability"),
        *[F.avg(x).alias(f"avg_{x}") for x in ("break_efficiency_ratio", "reclaim_close_location", "deepest_zone_retrace_fraction", "post_reclaim_close_strength")],
    ).filter(F.col("rows") >= minimum)
    rec = recommendation_table(attempts.sparkSession)
    return (
        g.join(modes, key)
        .join(F.broadcast(rec), "failure_reason", "left")
        .select(
            F.concat_ws("-", F.lit("FC"), *key).alias("cluster_id"), F.col("failure_reason").alias("family"), "rows", "avg_pnl_r",
            "avg_probability", F.col("setup_subtype_mode").alias("dominant_subtype"), "setup_state", "environment_state", "time_bucket",
            F.coalesce("recommended_family", F.lit(DEFAULT_RECOMMENDATION[0])).alias("recommended_family"),
            F.coalesce("recommended_focus", F.array(*[F.lit(x) for x in DEFAULT_RECOMMENDATION[1]])).alias("recommended_focus"),
            "avg_break_efficiency_ratio", "avg_reclaim_close_location", "avg_deepest_zone_retrace_fraction",
            "avg_post_reclaim_close_strength", "probability_bucket_mode", "path_class_mode",
        )
        .orderBy(F.col("rows").desc(), "avg_pnl_r", "cluster_id")
        .limit(limit)
    )


def recommendation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(k, v[0], v[1]) for k, v in RECOMMENDATIONS.items()],
        "failure_reason string, recommended_family string, recommended_focus array<string>",
    )


def failure_map(base: DataFrame) -> DataFrame:
    """Rows by month, subtype and regime in one grouping-sets pass.

    ``base``: predictions with label, pnl_r, features and boolean ``executed``.
    """
    regime = F.concat(F.lit("hv"), num0("reg_high_vol_state").cast("int").cast("string"), F.lit("_tr"), num0("reg_trending_state").cast("int").cast("string"))
    b = base.select(
        F.date_format("session_date", "yyyy-MM").alias("session_month"), F.coalesce("setup_subtype", F.lit("unknown")).alias("setup_subtype"),
        regime.alias("regime_bucket"), "label", "pnl_r", "probability", F.col("executed").cast("int").alias("x"),
    )
    fine = b.groupBy("session_month", "setup_subtype", "regime_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"), F.count("label").alias("ny"), F.sum("pnl_r").alias("p"), F.count("pnl_r").alias("np"),
        F.sum("probability").alias("q"), F.count("probability").alias("nq"), F.sum("x").alias("x"),
    )
    g = fine.groupingSets(
        [["session_month"], ["setup_subtype"], ["regime_bucket"]], "session_month", "setup_subtype", "regime_bucket"
    ).agg(
        F.sum("n").alias("rows"), ratio(F.sum("y").cast("double"), F.sum("ny").cast("double")).alias("positive_rate"),
        ratio(F.sum("p"), F.sum("np").cast("double")).alias("avg_pnl_r"), ratio(F.sum("q"), F.sum("nq").cast("double")).alias("avg_probability"),
        (F.sum("x") / F.sum("n")).alias("executed_share"), F.grouping_id().alias("gid"),
    )
    axis = F.when(F.col("gid") == 3, "session_month").when(F.col("gid") == 5, "setup_subtype").otherwise("regime_bucket")
    return g.select(axis.alias("axis"), F.coalesce("session_month", "setup_subtype", "regime_bucket").alias("key"),
                    "rows", "positive_rate", "avg_pnl_r", "avg_probability", "executed_share")


def mark_executed(rows: DataFrame, executed: DataFrame, key: str = "candidate_id") -> DataFrame:
    ids = executed.select(key).distinct().withColumn("__x", F.lit(True))
    return rows.join(ids, key, "left").withColumn("executed", F.coalesce("__x", F.lit(False))).drop("__x")


def executed_failures(base: DataFrame) -> DataFrame:
    """Losing executed trades by subtype with feature means."""
    return base.filter(F.col("executed") & (F.col("pnl_r") <= 0)).groupBy(
        F.coalesce("setup_subtype", F.lit("unknown")).alias("setup_subtype")
    ).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("pnl_r").alias("avg_pnl_r"),
        *[F.avg(x).alias(f"avg_{x}") for x in ("break_efficiency_ratio", "reclaim_close_location", "reclaim_failure_count")],
    )


def structure_family() -> Column:
    """Four-part family key: break, retrace, reclaim, continuation quality."""
    return F.concat_ws(
        ":",
        F.when(num0("first_break_close_confirmed") > 0, "close_break").otherwise("wick_break"),
        F.when(num0("deepest_zone_retrace_fraction") <= 0.35, "shallow").otherwise("deep"),
        F.when(num0("reclaim_count") >= 2, "multi_reclaim").otherwise("single_reclaim"),
        F.when(num0("post_reclaim_close_strength") >= 0.5, "strong_cont").otherwise("weak_cont"),
    )


def structure_families(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Result and shape means per structure family."""
    return rows.groupBy(*(by or []), structure_family().alias("family")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("label").alias("positive_rate"), F.avg("pnl_r").alias("avg_pnl_r"),
        F.avg("reclaim_count").alias("reclaim_mean"), F.avg("deepest_zone_retrace_fraction").alias("retrace_mean"),
        F.avg("post_reclaim_close_strength").alias("continuation_strength_mean"),
    )


def failure_taxonomy(rows: DataFrame, k: int = 8) -> DataFrame:
    """Failed setups by reason with the most common family."""
    f = rows.filter(F.col("label") == 0).select(
        failure_reason("reclaim_count").alias("failure_reason"), structure_family().alias("family"), "pnl_r"
    )
    fine = f.groupBy("failure_reason", "family").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl_r").alias("p"), F.count("pnl_r").alias("np"))
    g = fine.groupBy("failure_reason").agg(
        F.sum("n").alias("count"), (F.sum("p") / F.sum("np")).alias("avg_pnl_r"),
        F.min(F.struct((-F.col("n")).alias("a"), F.col("family").alias("v")))["v"].alias("common_family"),
    )
    return g.orderBy(F.col("count").desc(), "failure_reason").limit(k)


def structure_questions(taxonomy: DataFrame, families: DataFrame) -> DataFrame:
    """The most frequent failure and the best family, as one row."""
    worst = taxonomy.orderBy(F.col("count").desc(), "failure_reason").limit(1).select("failure_reason")
    best = families.orderBy(F.col("avg_pnl_r").desc(), "family").limit(1).select(F.col("family").alias("best_family"))
    return worst.crossJoin(F.broadcast(best))


def state_definitions(attempts: DataFrame) -> DataFrame:
    """Counts of every value on the three state axes."""
    axes = ["environment_state", "setup_state", "path_class"]
    fine = attempts.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"))
    return fine.unpivot(["n"], axes, "axis", "label").groupBy("axis", "label").agg(F.sum("n").alias("sample_size")).withColumn(
        "state_key", F.concat_ws(":", "axis", "label")
    )


def state_transitions(attempts: DataFrame) -> DataFrame:
    """Counts and probabilities from environment state to path class."""
    key = ["environment_state", "path_class"]
    g = attempts.groupBy(*key).agg(F.count(F.lit(1)).alias("sample_size"))
    total = F.sum("sample_size").over(W.partitionBy("environment_state"))
    med = exact_quantiles(attempts, key, "bars_held", {"persistence_bars": 0.5})
    return g.withColumn("transition_probability", F.col("sample_size") / total).join(med, key, "left").select(
        F.col("environment_state").alias("from_state"), F.col("path_class").alias("to_state"), "sample_size",
        "transition_probability", "persistence_bars",
    )


def is_continuation() -> Column:
    return F.coalesce(F.lower("path_class").isin("runner", "continuation"), F.lit(False)) | F.coalesce(
        F.lower("outcome") == "target", F.lit(False)) | F.coalesce(F.col("label") == 1, F.lit(False))


def is_failure() -> Column:
    return F.coalesce(F.lower("path_class").isin("failure", "chop"), F.lit(False)) | F.coalesce(
        F.lower("outcome").isin("stop", "timeout"), F.lit(False)) | F.coalesce(F.col("label") == 0, F.lit(False))


def continuation_profiles(attempts: DataFrame) -> DataFrame:
    """Continuation and failure rates per environment state."""
    g = attempts.groupBy("environment_state").agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg(F.when(is_continuation(), 1.0).otherwise(0.0)).alias("continuation_rate"),
        F.avg(F.when(is_failure(), 1.0).otherwise(0.0)).alias("failure_rate"), F.avg("pnl_r").alias("avg_pnl_r"),
    )
    med = exact_quantiles(attempts, ["environment_state"], "bars_held", {"median_persistence_bars": 0.5})
    return g.join(med, "environment_state", "left").withColumnRenamed("environment_state", "state")


def failure_profiles(clusters: DataFrame) -> DataFrame:
    """Failure clusters seen as state profiles."""
    return clusters.select(
        F.col("family").alias("failure_family"), F.col("environment_state").alias("state"), F.col("rows").alias("sample_size"),
        "avg_pnl_r", F.col("path_class_mode").alias("dominant_path_class"), F.col("setup_state").alias("dominant_repair_state"),
    )


def persistence_statistics(attempts: DataFrame) -> DataFrame:
    med = exact_quantiles(attempts.withColumn("__all", F.lit(0)), ["__all"], "bars_held", {"median_bars_held": 0.5}).drop("__all")
    return attempts.agg(
        F.count(F.lit(1)).alias("attempt_count"),
        F.count(F.when(F.col("path_class") == "runner", 1)).alias("runner_count"),
        F.count(F.when(F.col("path_class") == "chop", 1)).alias("chop_count"),
        F.count(F.when(F.col("path_class") == "failure", 1)).alias("failure_count"),
    ).crossJoin(F.broadcast(med))


def with_clock(rows: DataFrame) -> DataFrame:
    return rows.withColumn("time_bucket", F.coalesce(hhmm("entry_time"), F.lit("unknown")))


def path_attribution(rows: DataFrame) -> DataFrame:
    """Executed trades of each path by subtype, clock, volatility and trend.

    One pre-aggregation per path, then one grouping-sets roll-up.
    """
    axes = ["setup_subtype", "time_bucket", "volatility_regime", "trend_regime"]
    r = with_clock(rows).select(
        "path_id", "setup_subtype", "time_bucket", num0("reg_high_vol_state").cast("string").alias("volatility_regime"),
        num0("reg_trending_state").cast("string").alias("trend_regime"), "executed_pnl_r",
    )
    fine = r.groupBy("path_id", *axes).agg(
        F.count(F.lit(1)).alias("n"), F.sum("executed_pnl_r").alias("p"), F.count(F.when(F.col("executed_pnl_r") > 0, 1)).alias("w")
    )
    g = fine.groupingSets([["path_id", a] for a in axes], "path_id", *axes).agg(
        F.sum("n").alias("trade_count"), F.sum("p").alias("total_pnl_r"), (F.sum("p") / F.sum("n")).alias("avg_trade_r"),
        (F.sum("w") / F.sum("n")).alias("win_rate"), *[F.grouping(a).alias(f"g_{a}") for a in axes],
    )
    axis = ladder([(F.col(f"g_{a}") == 0, a) for a in axes], "none")
    return g.select("path_id", axis.alias("axis"), F.coalesce(*axes).alias("key"), "trade_count", "total_pnl_r", "avg_trade_r", "win_rate")


def probability_bin(p="probability", edges=(0.55, 0.65), names=("[0.45,0.55)", "[0.55,0.65)", "[0.65,1.00]")) -> Column:
    """Bin label with explicit upper edges; below the first edge is the first bin."""
    x = num0(p)
    return ladder([(x < e, n) for e, n in zip(edges, names)], names[-1])


def probability_bins(rows: DataFrame, by: list[str]) -> DataFrame:
    """Half-open probability bins [0.45, 0.55), [0.55, 0.65), [0.65, 1.01)."""
    p = F.col("probability")
    b = F.when((p >= 0.45) & (p < 0.55), "[0.45,0.55)").when((p >= 0.55) & (p < 0.65), "[0.55,0.65)").when(
        (p >= 0.65) & (p < 1.01), "[0.65,1.01)")
    return rows.withColumn("bucket", b).filter(F.col("bucket").isNotNull()).groupBy(*by, "bucket").agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum("executed_pnl_r").alias("total_pnl_r"), F.avg("executed_pnl_r").alias("avg_trade_r")
    )


def dominant_axes(rows: DataFrame) -> DataFrame:
    """Largest loss group on every axis: by count, then by the larger loss.

    Losers decide when there are any, otherwise all rows.
    """
    r = with_clock(rows).withColumn("loser", F.col("executed_pnl_r") < 0)
    axes = {
        "subtype": F.coalesce("setup_subtype", F.lit("unknown")),
        "time_of_day": F.col("time_bucket"),
        "volatility_regime": F.when(num0("reg_high_vol_state") != 0, "on").otherwise("off"),
        "trend_regime": F.when(num0("reg_trending_state") != 0, "on").otherwise("off"),
        "probability_bucket": probability_bin(),
    }
    fine = r.groupBy("loser", *[v.alias(k) for k, v in axes.items()]).agg(F.count(F.lit(1)).alias("n"), F.sum("executed_pnl_r").alias("p"))
    any_loser = fine.agg(F.coalesce(F.bool_or("loser"), F.lit(False)).alias("__any"))
    used = fine.crossJoin(F.broadcast(any_loser)).filter(~F.col("__any") | F.col("loser"))
    g = used.unpivot(["n", "p"], list(axes), "axis", "key").groupBy("axis", "key").agg(
        F.sum("n").alias("trade_count"), F.sum("p").alias("total_pnl_r")
    )
    w = W.partitionBy("axis").orderBy(F.col("trade_count").desc(), "total_pnl_r", "key")
    return g.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r")


def failure_type(rollup: DataFrame) -> DataFrame:
    """Kind of failure of a path roll-up."""
    return rollup.withColumn(
        "failure_type",
        ladder(
            [
                (
                    (F.col("median_total_pnl_r") > 0) & (F.col("path_positive_rate") >= 0.60) & (F.col("mean_total_pnl_r") <= 0)
                    & (F.col("min_path_pnl_r") < -5.0),
                    "tail_path_fragility",
                ),
                (F.col("path_positive_rate") < 0.50, "weak_edge"),
            ],
            "mixed_path_instability",
        ),
    )


def tail_attribution(rows: DataFrame, by: list[str]) -> DataFrame:
    """Policy rows by subtype and probability bin, one grouping-sets pass."""
    r = rows.select(*by, F.coalesce("setup_subtype", F.lit("unknown")).alias("setup_subtype"), probability_bin().alias("bin"), "executed_pnl_r")
    fine = r.groupBy(*by, "setup_subtype", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("executed_pnl_r").alias("p"))
    g = fine.groupingSets([[*by, "setup_subtype"], [*by, "bin"]], *by, "setup_subtype", "bin").agg(
        F.sum("n").alias("trade_count"), F.sum("p").alias("total_pnl_r"), F.grouping("bin").alias("g")
    )
    return g.select(*by, F.when(F.col("g") == 1, "setup_subtype").otherwise("probability_bin").alias("axis"),
                    F.coalesce("setup_subtype", "bin").alias("key"), "trade_count", "total_pnl_r")


def calibration_by_state(rows: DataFrame) -> DataFrame:
    return rows.groupBy("market_state").agg(
        F.count(F.lit(1)).alias("count"), F.avg("probability").alias("probability_mean"), F.avg("label").alias("hit_rate"), F.avg("pnl_r").alias("avg_pnl_r")
    )


def state_contribution(executed: DataFrame, states: DataFrame, key: str = "candidate_id") -> DataFrame:
    j = executed.select(key, "executed_pnl_r").join(states.select(key, "market_state"), key, "left")
    return j.groupBy(F.coalesce("market_state", F.lit("unknown")).alias("market_state")).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum("executed_pnl_r").alias("total_pnl_r")
    )


def loss_runs(trades: DataFrame, by: list[str], order: list[str], pnl: str) -> DataFrame:
    """Every stretch of consecutive losses with its length and sum."""
    n = running(trades, by, order, {"run_id": ("sum", F.when(F.col(pnl) < 0, 0).otherwise(1))})
    return n.filter(F.col(pnl) < 0).groupBy(*by, "run_id").agg(F.count(F.lit(1)).alias("length"), F.sum(pnl).alias("loss_r"))
