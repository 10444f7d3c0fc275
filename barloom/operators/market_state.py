"""Market-state scores, provisional states and state policies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.functions.columns import clip, fan_out, ladder, num0, ratio
from barloom.functions.stats import column_quantiles, exact_quantiles, unpivot_numeric

# fixed values: domains
MARKET_STATES = [
    "clean_strong_continuation", "weak_or_grindy_continuation", "auction_repair", "balanced_chop", "messy_transition",
    "failed_directional",
]
SETUP_QUALITIES = ["high_quality", "marginal", "avoid"]
WEAK = "weak_or_grindy_continuation"

# fixed values: score -> (fallback inputs, inverted inputs)
FALLBACK = {
    "directional_efficiency_open_to_now": (["reg_trend_strength_30", "reg_trend_strength_10", "break_efficiency_ratio"], []),
    "recent_directional_efficiency": (["break_efficiency_ratio", "continuation_displacement_ratio"], []),
    "body_to_range_ratio_recent": (["break_body_fraction", "reclaim_body_strength"], []),
    "wick_rejection_ratio_recent": (["first_break_wick_only", "pivot_overlap_ratio", "reclaim_failure_count"], []),
    "alternating_bar_ratio": (["reg_chop_10", "pivot_overlap_ratio"], []),
    "local_swing_overlap_score": (["pivot_overlap_ratio", "reg_range_ratio_10"], []),
    "impulse_speed_score": (["break_range_expansion", "break_efficiency_ratio", "break_volume_surge"], []),
    "repair_speed_score": (["reclaim_body_strength", "reclaim_close_location", "reclaim_latency_bars"], ["reclaim_latency_bars"]),
    "flem_compression_score": (["pivot_overlap_ratio", "reclaim_latency_bars", "pre_trigger_range"], []),
    "pivot_cleanliness_score": (
        ["pivot_symmetry", "pivot_overlap_ratio", "reclaim_failure_count"], ["pivot_overlap_ratio", "reclaim_failure_count"],
    ),
    "distance_to_recent_high_low": (["entry_distance_from_zone_high", "entry_distance_from_zone_low"], []),
    "failed_followthrough_count": (["reclaim_failure_count", "opposite_boundary_close_violation"], []),
}
# fixed values: composite -> (inputs, inverted inputs)
COMPOSITE = {
    "msq_candle_speed_volatility": (["break_range_expansion", "reg_vol_ratio", "reg_vol_10", "impulse_speed_score"], []),
    "msq_wick_body_structure": (
        ["body_to_range_ratio_recent", "reclaim_close_location", "post_reclaim_close_strength", "wick_rejection_ratio_recent"],
        ["wick_rejection_ratio_recent"],
    ),
    "msq_impulse_strength": (
        ["recent_directional_efficiency", "continuation_displacement_ratio", "reg_trend_strength_10", "impulse_speed_score"], [],
    ),
    "msq_flem_shape": (
        ["post_reclaim_close_strength", "continuation_displacement_ratio", "flem_compression_score", "opposite_boundary_close_violation"],
        ["flem_compression_score", "opposite_boundary_close_violation"],
    ),
    "msq_pivot_shape": (
        ["pivot_cleanliness_score", "reclaim_close_location", "deepest_zone_retrace_fraction", "repair_speed_score"], [],
    ),
    "msq_recent_high_low_context": (
        ["distance_to_recent_high_low", "local_swing_overlap_score", "pre_trigger_range", "zone_width"],
        ["distance_to_recent_high_low", "local_swing_overlap_score"],
    ),
    "msq_day_structure": (
        ["directional_efficiency_open_to_now", "reg_trend_strength_30", "reg_trend_30", "reg_range_ratio_30", "reg_chop_30"],
        ["reg_range_ratio_30", "reg_chop_30"],
    ),
    "msq_chop_range_unpredictability": (
        ["reg_chop_10", "reg_chop_30", "alternating_bar_ratio", "local_swing_overlap_score", "wick_rejection_ratio_recent",
         "flem_compression_score", "failed_followthrough_count"], [],
    ),
}
CLARITY = (
    ["msq_impulse_strength", "msq_wick_body_structure", "msq_flem_shape", "msq_day_structure", "msq_chop_range_unpredictability"],
    ["msq_chop_range_unpredictability"],
)
# fixed values: feature groups of the missingness report
FEATURE_GROUPS = {
    "candle_speed_volatility": ["msq_candle_speed_volatility"],
    "wick_body_structure": ["msq_wick_body_structure"],
    "impulse_strength": ["msq_impulse_strength"],
    "flem_shape": ["msq_flem_shape"],
    "pivot_shape": ["msq_pivot_shape"],
    "recent_highs_lows_context": ["msq_recent_high_low_context"],
    "day_structure": ["msq_day_structure"],
    "chop_range_unpredictability_avoidance": ["msq_chop_range_unpredictability", "msq_auction_clarity"],
    "requested_pit_features": list(FALLBACK),
}
# fixed values: name tokens a point-in-time feature must not contain
FORBIDDEN_TOKENS = ["pnl", "mfe", "mae", "exit", "target", "stop", "bars_held", "outcome", "label"]
# fixed values: state weights per policy variant; states not listed get the default weight
STATE_POLICIES = [
    ("baseline", 1.0, {}),
    ("exclude_weak_or_grindy_continuation", 1.0, {"weak_or_grindy_continuation": 0.0}),
    ("exclude_messy_transition", 1.0, {"messy_transition": 0.0}),
    ("exclude_weak_or_grindy_continuation_and_messy_transition", 1.0, {"weak_or_grindy_continuation": 0.0, "messy_transition": 0.0}),
    ("size_haircut_weak_or_grindy_continuation", 1.0, {"weak_or_grindy_continuation": 0.5}),
    ("size_haircut_messy_transition", 1.0, {"messy_transition": 0.5}),
    ("allow_only_clean_strong_continuation_and_auction_repair", 0.0, {"clean_strong_continuation": 1.0, "auction_repair": 1.0}),
]
TRIAL_POLICIES = [
    ("baseline", 1.0, {}),
    ("exclude_weak_or_grindy_continuation", 1.0, {"weak_or_grindy_continuation": 0.0}),
    ("haircut_weak_or_grindy_continuation", 1.0, {"weak_or_grindy_continuation": 0.5}),
    ("exclude_weak_or_grindy_continuation_and_messy_transition", 1.0, {"weak_or_grindy_continuation": 0.0, "messy_transition": 0.0}),
]
# fixed values: follow-through gates (variant name, gate)
FOLLOWTHROUGH = [
    ("baseline", "baseline"),
    ("exclude_weak_or_grindy_continuation", "exclude_weak"),
    ("exclude_weak_or_grindy_plus_pre_entry_tempo_persistence_gate", "tempo_persistence"),
    ("exclude_weak_or_grindy_plus_pre_entry_breakout_quality_gate", "breakout_quality"),
    ("exclude_weak_or_grindy_plus_delayed_followthrough_confirmation_entry", "delayed_followthrough"),
    ("exclude_weak_or_grindy_plus_liquidity_proximity_rejection_veto", "liquidity_veto"),
    ("exclude_weak_or_grindy_plus_combined_conservative_gate", "combined_conservative"),
]


def bounds(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """5th and 95th percentile of every column: two numbers per feature column.

    Fit on all rows (the default convention) or on a training slice, which
    keeps the scores point-in-time.
    """
    return {c: (q["lo"], q["hi"]) for c, q in column_quantiles(df, cols, {"lo": 0.05, "hi": 0.95}).items()}


def _normalized(x: np.ndarray, q: tuple[float, float] | None) -> np.ndarray:
    """``x`` between its bounds as a share clipped to [0, 1]; NaN without value or bounds."""
    if q is None:
        return np.full(len(x), np.nan)
    lo, hi = q
    with np.errstate(invalid="ignore", over="ignore"):
        share = np.full(len(x), 0.5) if hi == lo else (x - lo) / (hi - lo)
    # as in SQL, a share that is no number counts as the largest
    return np.where(np.isnan(x), np.nan, np.clip(np.where(np.isnan(share), 1.0, share), 0.0, 1.0))


def _row_means(columns: dict[str, np.ndarray], rows: int, specs: dict[str, tuple[list[str], list[str]]], q: dict) -> dict[str, np.ndarray]:
    unit = {x: _normalized(columns[x], q.get(x)) for x in {x for xs, _ in specs.values() for x in xs} & set(columns)}
    out = {}
    for target, (xs, inv) in specs.items():
        total, n = np.zeros(rows), np.zeros(rows)
        for x in xs:
            if x in unit:
                part = 1.0 - unit[x] if x in inv else unit[x]
                known = ~np.isnan(part)
                total, n = total + np.where(known, part, 0.0), n + known
        out[target] = np.where(n > 0, total / np.maximum(n, 1), np.nan)
    return out


def with_scores(df: DataFrame, *passes: tuple[dict[str, tuple[list[str], list[str]]], dict]) -> DataFrame:
    """Add row means of normalized inputs, skipping nulls and absent columns, by every pass ``(specs, bounds)`` in turn.

    Means are computed on blocks of columns: as expressions they make generated
    methods too long to be compiled, which Spark then interprets row by row.
    """
    made = [t for specs, _ in passes for t in specs]
    reads = sorted({x for specs, _ in passes for xs, _ in specs.values() for x in xs} & set(df.columns))
    keep = [f for f in df.schema.fields if f.name not in made]
    schema = StructType([*keep, *[StructField(t, DoubleType()) for t in dict.fromkeys(made)]])
    # inputs as doubles beside the columns they may replace
    rows = df.select(*[F.col(f"`{f.name}`") for f in keep], *[F.col(x).cast("double").alias(f"__in_{x}") for x in reads])

    def run(batches):
        for batch in batches:
            columns = {x: batch.column(f"__in_{x}").to_numpy(zero_copy_only=False) for x in reads}
            for specs, q in passes:
                columns.update(_row_means(columns, batch.num_rows, specs, q))
            done = [pa.array(columns[f.name], from_pandas=True) for f in schema.fields[len(keep) :]]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *done], names=schema.names)

    order = [*df.columns, *[t for t in dict.fromkeys(made) if t not in df.columns]]
    return rows.mapInArrow(run, schema).select(*[F.col(f"`{x}`") for x in order])


def market_features(df: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Twelve normalized scores, eight composites and the clarity score.

    Three passes, because composites normalize scores that are themselves
    normalized: inputs, then scores, then composites.  Each pass fits two
    numbers per column; an expensive input should be stored by the caller.
    """
    present = set(df.columns)
    inputs = sorted(({x for xs, _ in FALLBACK.values() for x in xs} | set(FALLBACK)) & present)
    q1 = bounds(df if fit_on is None else fit_on, inputs)
    # the preferred column is used unless it is absent or entirely null
    first = {n: ([n], []) if n in q1 else spec for n, spec in FALLBACK.items()}

    later = {x for xs, _ in COMPOSITE.values() for x in xs}
    ref = df if fit_on is None else fit_on
    # bounds read their inputs only
    ref = ref.select(*[x for x in ref.columns if x in later | set(inputs)])
    one = (first, q1)
    q2 = bounds(with_scores(ref, one), sorted(later & (present | set(first))))
    two = (COMPOSITE, q2)
    q3 = bounds(with_scores(ref, one, two), CLARITY[0])
    return with_scores(df, one, two, ({"msq_auction_clarity": CLARITY}, q3))


def assign_states(df: DataFrame) -> DataFrame:
    """Six provisional states and three setup qualities."""
    v = lambda x, d: F.coalesce(F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")), F.lit(d)) if x in df.columns else F.lit(d)
    chop, impulse = v("msq_chop_range_unpredictability", 0.5), v("msq_impulse_strength", 0.5)
    flem, pivot, clarity = v("msq_flem_shape", 0.5), v("msq_pivot_shape", 0.5), v("msq_auction_clarity", 0.5)
    day, recent, body = v("msq_day_structure", 0.5), v("recent_directional_efficiency", 0.5), v("body_to_range_ratio_recent", 0.5)
    failed, depth = v("failed_followthrough_count", 0.0), v("deepest_zone_retrace_fraction", 0.0)
    reclaims, violation = v("reclaim_count", 0.0), v("opposite_boundary_close_violation", 0.0)
    # counted in arrays: a sum of conditions, repeated in every rule, makes a method too long to be compiled
    count = lambda conds: F.size(F.filter(F.array(*conds), lambda x: x))
    chops = count(
        [chop >= 0.58, v("local_swing_overlap_score", 0.5) >= 0.58, v("alternating_bar_ratio", 0.5) >= 0.55,
         v("wick_rejection_ratio_recent", 0.5) >= 0.58, recent <= 0.42, v("flem_compression_score", 0.5) >= 0.60, failed >= 0.55]
    )
    messy = count([clarity <= 0.48, pivot <= 0.45, flem <= 0.45, depth >= 0.55, reclaims >= 2, body <= 0.40])
    counted = df.withColumns({"__chops": chops, "__messy": messy})
    chops, messy = F.col("__chops"), F.col("__messy")
    strong = (clarity >= 0.64) & (impulse >= 0.58) & (recent >= 0.55) & (day >= 0.52) & (chops <= 1)
    state = ladder(
        [
            ((violation > 0) | (failed >= 0.75), "failed_directional"),
            ((chops >= 3) | ((chop >= 0.55) & (recent <= 0.45)), "balanced_chop"),
            (messy >= 3, "messy_transition"),
            ((depth >= 0.65) | (reclaims >= 2) | (pivot <= 0.35), "auction_repair"),
            (strong, "clean_strong_continuation"),
        ],
        WEAK,
    )
    s = F.col("market_state")
    quality = ladder(
        [
            ((s == "clean_strong_continuation") & (clarity >= 0.62), "high_quality"),
            (
                s.isin("balanced_chop", "messy_transition", "failed_directional")
                | ((s == WEAK) & ((recent <= 0.50) | (impulse <= 0.45)))
                | (clarity <= 0.40),
                "avoid",
            ),
        ],
        "marginal",
    )
    return counted.withColumn("market_state", state).withColumn("setup_quality", quality).drop("__chops", "__messy")


def state_policy_table(spark: SparkSession, policies=STATE_POLICIES) -> DataFrame:
    """Long table (variant, market_state, weight) over the whole state domain."""
    rows = [(n, s, float(w.get(s, d))) for n, d, w in policies for s in MARKET_STATES]
    return spark.createDataFrame(rows, "variant string, market_state string, policy_weight double")


def followthrough_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOLLOWTHROUGH, "variant string, gate string")


def followthrough_gate() -> Column:
    """Gate decision struct (weight, fill_impact, pit_valid) from column ``gate``.

    A delayed entry costs 0.05 R.  Null features count as 0.
    """
    n = num0
    tempo = (
        (n("recent_directional_efficiency") >= 0.35) & (n("impulse_speed_score") >= 0.18)
        & (n("alternating_bar_ratio") <= 0.72) & (n("wick_rejection_ratio_recent") <= 0.68)
    )
    breakout = (
        (n("first_break_close_confirmed") >= 0.5) & (n("break_efficiency_ratio") >= 0.12)
        & (n("break_close_distance_to_zone") >= 0.05) & (n("first_break_wick_only") < 0.5)
    )
    liquid = (n("distance_to_recent_high_low") > 0.20) & (n("wick_rejection_ratio_recent") < 0.70)
    delayed = (n("continuation_displacement_ratio") >= 0.30) & (n("post_reclaim_close_strength") >= 0.35)
    g = F.col("gate")
    weak = (g != "baseline") & F.coalesce(F.col("market_state") == WEAK, F.lit(False))
    keep = ladder(
        [(weak, F.lit(False)), (g == "tempo_persistence", tempo), (g == "breakout_quality", breakout),
         (g == "delayed_followthrough", delayed), (g == "liquidity_veto", liquid),
         (g == "combined_conservative", tempo & breakout & liquid)],
        F.lit(True),
    )
    return F.struct(
        keep.cast("double").alias("weight"),
        F.when(keep & (g == "delayed_followthrough"), -0.05).otherwise(0.0).alias("fill_impact"),
        F.lit(True).alias("pit_valid"),
    )


def apply_gates(rows: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """Rows under every follow-through gate with weight and fill impact."""
    t = followthrough_table(rows.sparkSession) if gates is None else gates
    return fan_out(rows, t).withColumn("__g", followthrough_gate()).select(
        *[F.col(x) for x in rows.columns], "variant", "gate",
        F.col("__g.weight").alias("policy_weight"), F.col("__g.fill_impact").alias("fill_impact_r"), F.col("__g.pit_valid").alias("pit_valid"),
    )


# fixed values: columns that each follow-through gate reads
_TEMPO = ["recent_directional_efficiency", "impulse_speed_score", "alternating_bar_ratio", "wick_rejection_ratio_recent"]
_BREAKOUT = ["first_break_close_confirmed", "break_efficiency_ratio", "break_close_distance_to_zone", "first_break_wick_only"]
_LIQUID = ["distance_to_recent_high_low", "wick_rejection_ratio_recent"]
GATE_COLUMNS = {
    "baseline": [],
    "exclude_weak": [],
    "tempo_persistence": _TEMPO,
    "breakout_quality": _BREAKOUT,
    "delayed_followthrough": ["continuation_displacement_ratio", "post_reclaim_close_strength"],
    "liquidity_veto": _LIQUID,
    "combined_conservative": [*_TEMPO, *_BREAKOUT, *_LIQUID],
}


def gate_leakage(gated: DataFrame, audit: DataFrame, by: list[str] | None = None, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Per variant and ``by``: rows kept, those of them whose features are not from before the entry, status.

    ``audit`` has ``candidate_id`` and ``status``; a kept row without an audit
    counts as failed.  A gate that reads a path id or an outcome fails whatever
    its rows say.
    """
    columns = columns or GATE_COLUMNS
    reads = {g: "path_id" in c for g, c in columns.items()}
    betrays = {g: bool(forbidden_features(c)) for g, c in columns.items()}
    known = lambda flags: ladder([(F.col("gate") == g, F.lit(f)) for g, f in flags.items()], F.lit(False))
    j = gated.filter(F.col("policy_weight") > 0).join(audit.select("candidate_id", F.col("status").alias("__s")), "candidate_id", "left")
    kept = j.groupBy("variant", *(by or [])).agg(F.count(F.lit(1)).alias("kept_rows"), F.count(F.when(F.coalesce("__s", F.lit("fail")) != "pass", 1)).alias("late_rows"))
    every = gated.groupBy("variant", "gate", *(by or [])).agg(F.count(F.lit(1)).alias("rows"))
    out = every.join(kept, ["variant", *(by or [])], "left").fillna(0, ["kept_rows", "late_rows"])
    out = out.withColumns({"uses_path_id_as_filter": known(reads), "__o": known(betrays)})
    ok = (F.col("late_rows") == 0) & ~F.col("uses_path_id_as_filter") & ~F.col("__o")
    return out.select("variant", *(by or []), "kept_rows", "late_rows", (F.col("late_rows") == 0).alias("point_in_time_valid"), "uses_path_id_as_filter",
                      F.when(ok, "pass").otherwise("fail").alias("status"))


def entry_audit(rows: DataFrame, used: str = "feature_time", entry: str = "entry_time") -> DataFrame:
    """``(candidate_id, status)``: fails where the latest bar behind the features is not before the entry."""
    return rows.select("candidate_id", F.when(F.col(used) < F.col(entry), "pass").otherwise("fail").alias("status"))


def worst_path(path_rows: DataFrame) -> str | None:
    """Path with the least total, ties to the least id: one row of a few."""
    worst = path_rows.groupBy("path_id").agg(F.sum("executed_pnl_r").alias("t")).orderBy("t", "path_id").first()
    return worst["path_id"] if worst else None


def state_weights(rows: DataFrame, policies=None) -> DataFrame:
    """``(variant, candidate_id, policy_weight, fill_impact_r)`` of state-weight policies."""
    t = state_policy_table(rows.sparkSession, policies or TRIAL_POLICIES)
    return rows.select("candidate_id", "market_state").join(F.broadcast(t), "market_state").select("variant", "candidate_id", "policy_weight", F.lit(0.0).alias("fill_impact_r"))


def policy_simulation(rows: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Weighted result per variant and per (variant, state): one grouping-sets job."""
    t = state_policy_table(rows.sparkSession) if policies is None else policies
    j = rows.select("market_state", num0("pnl_r").alias("pnl_r")).join(F.broadcast(t), "market_state")
    return _contribution(j)


def gate_simulation(rows: DataFrame) -> DataFrame:
    """Follow-through gates: per variant and per (variant, state)."""
    g = apply_gates(rows.withColumn("pnl_r", num0("pnl_r")))
    return _contribution(g, fill=True)


def _contribution(j: DataFrame, fill: bool = False) -> DataFrame:
    w, p = F.col("policy_weight"), F.col("pnl_r")
    # pre-aggregate to (variant, state), then roll the few rows up
    base = j.groupBy("variant", "market_state").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.when(w > 0, 1).otherwise(0)).alias("t"), F.sum(w).alias("e"), F.sum(p).alias("b"),
        F.sum(((p + F.col("fill_impact_r")) if fill else p) * w).alias("wp"), F.sum(p * (1.0 - w)).alias("a"),
        (F.sum("fill_impact_r") if fill else F.lit(0.0)).alias("f"),
    )
    g = base.groupingSets([["variant"], ["variant", "market_state"]], "variant", "market_state").agg(
        F.sum("c").alias("candidate_count"), F.sum("t").alias("trade_count"),
        F.sum("e").alias("effective_trade_count"), F.sum("b").alias("baseline_pnl_r"), F.sum("wp").alias("weighted_pnl_r"),
        F.sum("a").alias("avoided_pnl_r"), F.sum("f").alias("fill_impact_r"),
        F.grouping("market_state").alias("is_total"),
    )
    g = g.withColumn("market_state", F.when(F.col("is_total") == 1, "all").otherwise(F.col("market_state"))).withColumn(
        "retained_fraction", ratio(F.col("trade_count").cast("double"), F.col("candidate_count").cast("double"))
    )
    return g.drop("is_total") if fill else g.drop("is_total", "fill_impact_r")


def avoidance_scenarios(rows: DataFrame) -> DataFrame:
    """Retained and avoided results under four avoidance rules, in one pass."""
    bad = ["balanced_chop", "messy_transition", "failed_directional"]
    rules = {
        "avoid_quality_or_bad_state": (F.col("setup_quality") == "avoid") | F.col("market_state").isin(bad),
        "avoid_setup_quality_only": F.col("setup_quality") == "avoid",
        "avoid_weak_messy_failed_only": F.col("market_state").isin(WEAK, "messy_transition", "failed_directional"),
        "avoid_balanced_chop_only": F.col("market_state") == "balanced_chop",
    }
    r = rows.withColumn("scenario", F.explode(F.array(*[
        F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("avoid")) for k, v in rules.items()
    ])))
    av, p = F.col("scenario.avoid"), num0("pnl_r")
    g = r.groupBy(F.col("scenario.name").alias("scenario")).agg(
        F.count(F.when(~av, 1)).alias("retained_candidate_count"),
        F.sum(F.when(~av, p).otherwise(0.0)).alias("retained_total_pnl_r"),
        F.count(F.when(av, 1)).alias("avoided_candidate_count"),
        F.sum(F.when(av, p).otherwise(0.0)).alias("avoided_total_pnl_r"),
        F.sum(p).alias("baseline_total_pnl_r"),
        F.avg(F.when(~av, 1.0).otherwise(0.0)).alias("retained_fraction"),
    )
    return g.withColumn("pnl_delta_if_avoided", F.col("retained_total_pnl_r") - F.col("baseline_total_pnl_r"))


def label_balance(rows: DataFrame) -> DataFrame:
    """Counts and positive rate overall, by state and by quality (grouping sets)."""
    base = rows.groupBy("market_state", "setup_quality").agg(
        F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("n"),
        F.count("label").alias("l"),
    )
    g = base.groupingSets([[], ["market_state"], ["setup_quality"]], "market_state", "setup_quality").agg(
        F.sum("c").alias("count"), F.sum("p").alias("positive_count"), F.sum("n").alias("negative_count"),
        ratio(F.sum("p").cast("double"), F.sum("l").cast("double"), None).alias("positive_rate"),
        F.grouping_id().alias("gid"),
    )
    axis = F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "market_state").otherwise("setup_quality")
    return g.select(axis.alias("axis"), F.coalesce("market_state", "setup_quality", F.lit("all")).alias("key"), "count",
                    "positive_count", "negative_count", "positive_rate")


def pnl_by_group(rows: DataFrame) -> DataFrame:
    """Count, total, mean and win rate by state and by quality."""
    base = rows.groupBy("market_state", "setup_quality").agg(
        F.count(F.lit(1)).alias("c"), F.sum("pnl_r").alias("s"), F.count("pnl_r").alias("n"), F.count(F.when(F.col("pnl_r") > 0, 1)).alias("w"),
    )
    g = base.groupingSets([["market_state"], ["setup_quality"]], "market_state", "setup_quality").agg(
        F.sum("c").alias("count"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("total_pnl_r"),
        ratio(F.sum("s"), F.sum("n").cast("double")).alias("avg_pnl_r"), ratio(F.sum("w").cast("double"), F.sum("n").cast("double")).alias("win_rate"),
        F.grouping("market_state").alias("g"),
    )
    return g.select(
        F.when(F.col("g") == 0, "market_state").otherwise("setup_quality").alias("axis"),
        F.coalesce("market_state", "setup_quality").alias("key"), "count", "total_pnl_r", "avg_pnl_r", "win_rate",
    )


def support_sufficiency(rows: DataFrame, min_rows: int = 30, min_class: int = 5) -> DataFrame:
    b = label_balance(rows).filter(F.col("axis") != "overall")
    return b.select(
        "axis", "key", "count", "positive_count", "negative_count",
        ((F.col("count") >= min_rows) & (F.col("positive_count") >= min_class) & (F.col("negative_count") >= min_class)).alias("enough_support_for_modeling"),
    )


def reliability_warnings(rows: DataFrame, minimum: int = 25, by: list[str] | None = None) -> DataFrame:
    """States of the domain with too few rows, in every group of ``by``; empty states appear with 0."""
    by = by or []
    states = F.explode(F.array(*[F.lit(s) for s in MARKET_STATES])).alias("state")
    domain = rows.select(*by).distinct().select(*by, states) if by else rows.sparkSession.range(1).select(states)
    n = rows.groupBy(*by, F.col("market_state").alias("state")).agg(F.count(F.lit(1)).alias("count"))
    return domain.join(n, [*by, "state"], "left").select(
        *by, "state", F.coalesce("count", F.lit(0)).alias("count"), F.lit(f"state_has_fewer_than_{minimum}_rows").alias("warning")
    ).filter(F.col("count") < minimum)


def missingness(rows: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Mean null rate per feature group; groups without columns count as missing."""
    groups = groups or FEATURE_GROUPS
    cols = [x for xs in groups.values() for x in xs if x in rows.columns]
    rates = rows.agg(*[F.avg(F.when(F.col(x).isNull() | F.isnan(F.col(x)), 1.0).otherwise(0.0)).alias(x) for x in cols])
    member = rows.sparkSession.createDataFrame(
        [(g, x) for g, xs in groups.items() for x in xs], "feature_group string, feature string"
    )
    long = rates.unpivot([], cols, "feature", "rate")
    g = member.join(F.broadcast(long), "feature", "left").groupBy("feature_group").agg(
        F.count("rate").alias("columns_present"), F.coalesce(F.avg("rate"), F.lit(1.0)).alias("missing_rate")
    )
    return g.withColumn(
        "status", ladder([(F.col("columns_present") == 0, "missing"), (F.col("missing_rate") <= 0.20, "complete")], "sparse")
    )


def forbidden_features(columns: list[str]) -> list[str]:
    """Feature names that betray a label or an outcome (driver-side check)."""
    return [c for c in columns if any(t in c.lower() for t in FORBIDDEN_TOKENS)]


def leakage_audit(audit: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Name check plus failed feature audits, as one row per ``by``."""
    bad = forbidden_features(columns)
    g = audit.groupBy(*(by or [])).agg(F.count(F.when(F.col("status") != "pass", 1)).alias("failed_audits"))
    return g.select(
        *(by or []), F.lit(len(bad)).alias("forbidden_names"), "failed_audits",
        F.when((F.lit(len(bad)) == 0) & (F.col("failed_audits") == 0), "pass").otherwise("fail").alias("status"),
    )


# fixed values: residual loss clusters, each a rule over features (null counts as 0)
def residual_rules() -> dict[str, Column]:
    n = num0
    return {
        "failed_breakout_no_followthrough": (n("first_break_wick_only") >= 0.5) | (n("first_break_close_confirmed") < 0.5)
        | (n("break_close_distance_to_zone") <= 0.15) | (n("continuation_displacement_ratio") <= 0.25)
        | (n("opposite_boundary_close_violation") > 0),
        "poor_followthrough_after_trigger": (n("continuation_displacement_ratio") <= 0.30)
        | (n("post_reclaim_close_strength") <= 0.40) | (n("failed_followthrough_count") >= 0.50),
        "volatility_expansion_then_collapse": (n("break_range_expansion") >= 1.50)
        & ((n("continuation_displacement_ratio") <= 0.35) | (n("body_to_range_ratio_recent") <= 0.45)),
        "liquidity_proximity_rejection": (n("distance_to_recent_high_low") <= 0.35) | (n("wick_rejection_ratio_recent") >= 0.55),
        "late_opening_window_exhaustion": (n("trigger_seconds_after_open") >= 3600)
        & ((n("recent_directional_efficiency") <= 0.45) | (n("impulse_speed_score") <= 0.35)),
        "low_quality_repair": (n("reclaim_latency_bars") >= 2) | (n("reclaim_failure_count") >= 1)
        | (n("reclaim_body_strength") <= 0.35) | (n("repair_speed_score") <= 0.20),
        "messy_pivot_or_overlap": (n("pivot_overlap_ratio") >= 0.40) | (n("pivot_cleanliness_score") <= 0.45)
        | (n("alternating_bar_ratio") >= 0.55) | (n("local_swing_overlap_score") >= 0.65),
        "trend_persistence_breakdown": (n("directional_efficiency_open_to_now") <= 0.45)
        | (n("recent_directional_efficiency") <= 0.40) | (n("reg_trend_strength_10") <= 0.25),
        "candle_tempo_deterioration": (n("impulse_speed_score") <= 0.35) | (n("alternating_bar_ratio") >= 0.55)
        | (n("wick_rejection_ratio_recent") >= 0.55),
    }


# fixed values: features described for the residual losses
RESIDUAL_FEATURES = [
    "continuation_displacement_ratio", "post_reclaim_close_strength", "break_efficiency_ratio", "break_range_expansion",
    "distance_to_recent_high_low", "wick_rejection_ratio_recent", "trigger_seconds_after_open", "reclaim_latency_bars",
    "reclaim_body_strength", "pivot_overlap_ratio", "pivot_cleanliness_score", "alternating_bar_ratio", "impulse_speed_score",
    "recent_directional_efficiency", "directional_efficiency_open_to_now", "failed_followthrough_count",
]


def residual_losses(path_rows: DataFrame, states: DataFrame, path_id: str) -> DataFrame:
    """Losing trades of one path that survive the weak-state exclusion."""
    return survivors(path_rows, states, path_id).filter(F.col("executed_pnl_r") < 0)


# fixed values: what the loss clusters and the support of a loss read of a trade
CLUSTER_COLUMNS = [
    "session_date", "first_break_wick_only", "first_break_close_confirmed", "break_close_distance_to_zone", "continuation_displacement_ratio",
    "opposite_boundary_close_violation", "post_reclaim_close_strength", "failed_followthrough_count", "break_range_expansion", "body_to_range_ratio_recent",
    "distance_to_recent_high_low", "wick_rejection_ratio_recent", "trigger_seconds_after_open", "recent_directional_efficiency", "impulse_speed_score",
    "reclaim_latency_bars", "reclaim_failure_count", "reclaim_body_strength", "repair_speed_score", "pivot_overlap_ratio", "pivot_cleanliness_score",
    "alternating_bar_ratio", "local_swing_overlap_score", "directional_efficiency_open_to_now", "reg_trend_strength_10",
]


def survivors(path_rows: DataFrame, states: DataFrame, path_id: str, columns: list[str] | None = None) -> DataFrame:
    """Trades of one path that survive the weak-state exclusion, with ``columns`` of their states or all.

    Trades of weak states go before the join.
    """
    one = path_rows.filter(F.col("path_id") == path_id).select("path_id", "candidate_id", "executed_pnl_r")
    rows = states.filter(F.col("market_state") != WEAK)
    rows = rows.drop("executed_pnl_r") if columns is None else rows.select("candidate_id", *columns)
    return one.join(rows, "candidate_id")


def residual_support(path_rows: DataFrame, states: DataFrame, path_id: str) -> DataFrame:
    return survivor_support(survivors(path_rows, states, path_id, ["session_date"]))


def survivor_support(s: DataFrame) -> DataFrame:
    """Trades, sessions and losses of what ``survivors`` returns."""
    per = s.groupBy("session_date").agg(
        F.count(F.lit(1)).alias("t"), F.count(F.when(F.col("executed_pnl_r") < 0, 1)).alias("l"),
        F.sum("executed_pnl_r").alias("p"), F.sum(F.when(F.col("executed_pnl_r") < 0, F.col("executed_pnl_r")).otherwise(0.0)).alias("lp"),
    )
    return per.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("surviving_trade_count"), F.count(F.lit(1)).alias("surviving_session_count"),
        F.coalesce(F.sum("p"), F.lit(0.0)).alias("surviving_total_pnl_r"),
        F.coalesce(F.sum("l"), F.lit(0)).alias("loss_trade_count"), F.count(F.when(F.col("l") > 0, 1)).alias("loss_session_count"),
        F.coalesce(F.sum("lp"), F.lit(0.0)).alias("loss_total_pnl_r"),
    )


def residual_clusters(losses: DataFrame) -> DataFrame:
    """Overlapping loss clusters: a row belongs to every rule it meets."""
    member = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in residual_rules().items()]))
    total = losses.agg(F.abs(F.sum("executed_pnl_r")).alias("total_loss"))
    rows = losses.withColumn("cluster", F.explode(member))
    per = rows.groupBy("cluster", "session_date").agg(F.count(F.lit(1)).alias("t"), F.sum("executed_pnl_r").alias("p"))
    g = per.groupBy("cluster").agg(
        F.sum("t").alias("trade_count"), F.count(F.lit(1)).alias("session_count"), F.sum("p").alias("total_pnl_r")
    )
    return g.crossJoin(F.broadcast(total)).select(
        "cluster", "trade_count", "session_count", "total_pnl_r", (F.col("total_pnl_r") / F.col("trade_count")).alias("avg_pnl_r"),
        ratio(F.abs("total_pnl_r"), "total_loss").alias("loss_share"),
    )


def residual_explanations(losses: DataFrame) -> DataFrame:
    """Mean and quartiles of the explanatory features over the losses."""
    cols = [x for x in RESIDUAL_FEATURES if x in losses.columns]
    long = unpivot_numeric(losses, [], cols).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    q = exact_quantiles(long, ["feature"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return long.groupBy("feature").agg(F.avg("value").alias("mean")).join(q, "feature")


def structural_coherence(clusters: DataFrame, support: DataFrame) -> DataFrame:
    """Do the losses share structure?  Clusters are nine rows at most."""
    top = F.slice(F.sort_array(F.collect_list("trade_count"), False), 1, 3)
    c = clusters.agg(top.alias("top"))
    n = F.col("loss_trade_count")
    j = support.select("loss_trade_count").crossJoin(F.broadcast(c))
    first = F.coalesce(F.get("top", F.lit(0)), F.lit(0)) / F.nullif(n, F.lit(0))
    cover = F.aggregate("top", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    return j.select(
        "loss_trade_count",
        F.coalesce(first, F.lit(0.0)).alias("top_cluster_share_of_loss_trades"),
        F.coalesce(cover, F.lit(0.0)).alias("top_3_cluster_membership_per_loss_trade"),
        ladder(
            [(n == 0, "no_residual_losses"), ((first >= 0.50) | (cover >= 1.25), "structurally_coherent"),
             ((first >= 0.30) | (cover >= 0.80), "partly_structural")],
            "mostly_random_or_underexplained",
        ).alias("assessment"),
    )


def worst_path_exposure(path_rows: DataFrame, states: DataFrame, k: int = 3) -> DataFrame:
    """State and quality exposure of the worst paths, per path and overall."""
    totals = path_rows.groupBy("path_id").agg(F.sum("executed_pnl_r").alias("path_total_pnl_r"))
    worst = totals.orderBy("path_total_pnl_r", "path_id").limit(k)
    j = path_rows.select("path_id", "candidate_id", "executed_pnl_r").join(F.broadcast(worst), "path_id").join(
        states.select("candidate_id", "market_state", "setup_quality"), "candidate_id"
    )
    base = j.groupBy("path_id", "market_state", "setup_quality").agg(F.count(F.lit(1)).alias("c"), F.sum("executed_pnl_r").alias("s"))
    g = base.groupingSets(
        [["path_id", "market_state"], ["market_state"], ["setup_quality"]], "path_id", "market_state", "setup_quality"
    ).agg(F.sum("c").alias("trade_count"), F.sum("s").alias("total_pnl_r"))
    return g.select(
        F.coalesce("path_id", F.lit("all")).alias("path_id"), F.coalesce("market_state", F.lit("all")).alias("market_state"),
        F.coalesce("setup_quality", F.lit("all")).alias("setup_quality"), "trade_count", "total_pnl_r",
        (F.col("total_pnl_r") / F.col("trade_count")).alias("avg_trade_r"),
    )


def replay_on_paths(path_rows: DataFrame, weights: DataFrame, run: str = "variant", key: str = "candidate_id") -> DataFrame:
    """Result of each policy on each path: ``weights`` has one row (run, key, weight, fill_impact_r) per policy and trade.

    Path rows a policy does not know keep weight 1.  The weights of a trade
    are laid side by side, so that no path row is repeated per policy.
    """
    names = [r[0] for r in weights.select(run).distinct().orderBy(run).collect()]  # configured policies
    w, f = [F.col(f"__w{i}") for i in range(len(names))], [F.col(f"__f{i}") for i in range(len(names))]
    pick = lambda n, c: F.max(F.when(F.col(run).eqNullSafe(F.lit(n)), F.col(c)))
    each = [(pick(n, "policy_weight").alias(f"__w{i}"), pick(n, "fill_impact_r").alias(f"__f{i}")) for i, n in enumerate(names)]
    if not names:
        each = [(F.count(F.lit(1)).alias("__n"),)]
    wide = weights.groupBy(key).agg(*[c for pair in each for c in pair])
    # sizes of repeated rows are taken too low: a broadcast would bring every trade to the driver
    j = path_rows.select("path_id", key, F.col("executed_pnl_r").alias("p")).join(wide.hint("merge"), key, "left")
    w, f = [F.coalesce(c, F.lit(1.0)) for c in w], [F.coalesce(c, F.lit(0.0)) for c in f]
    sums = [F.struct(F.lit(n).alias(run), F.sum((F.col("p") + f[i]) * w[i]).alias("total_pnl_r"), F.sum(F.when(w[i] > 0, 1).otherwise(0)).alias("trade_count"),
                     F.sum(w[i]).alias("effective_trade_count")) for i, n in enumerate(names)]
    kind = weights.schema[run].dataType.simpleString()
    per = j.groupBy("path_id").agg(F.sum("p").alias("baseline_total_pnl_r"), F.array(*sums).cast(
        f"array<struct<{run}:{kind},total_pnl_r:double,trade_count:bigint,effective_trade_count:double>>").alias("__s"))
    return per.select("path_id", "baseline_total_pnl_r", F.explode("__s").alias("__s")).select(
        f"__s.{run}", "path_id", "baseline_total_pnl_r", "__s.total_pnl_r", "__s.trade_count", "__s.effective_trade_count")
