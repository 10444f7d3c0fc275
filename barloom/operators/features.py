"""Point-in-time features of candidates.

Everything that depends only on "the session up to a bar" is a running or
rolling window over bars and is picked at the trigger or break bar by an
equi-join.  Only quantities between two bars of one candidate (break to
trigger, pivot to trigger, last 16 bars) use a candidate-bar join, restricted
to those bars and closed by one aggregation.  No bar at or after the cutoff is
ever joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.asof import asof
from barloom.functions.columns import flag, iso, ratio
from barloom.operators.candidates import first_per_id
from barloom.schemas import SESSION_KEY, SessionSpec
from barloom.session import cut

RECENT = 16  # fixed value: bars in the recent market-state window
PRIOR = 6  # fixed value: bars before the break used as its baseline
ATR = 14  # fixed value: true ranges averaged

# fixed values: column families of the feature matrix
FAMILY_COLUMNS = {
    "bnr_geometry": [
        "direction_long", "zone_width", "zone_width_bps", "zone_midpoint", "entry_distance_from_midpoint",
        "entry_distance_from_zone_high", "entry_distance_from_zone_low", "first_break_wick_only",
        "first_break_close_confirmed", "first_break_wick_excess_points", "first_break_close_excess_points",
        "continuation_displacement_ratio", "break_close_distance_to_zone", "break_body_fraction",
        "break_speed_bars", "break_volume_surge", "break_range_expansion", "break_efficiency_ratio",
    ],
    "pivot_reclaim": [
        "pivot_duration_bars", "continuation_delay_bars", "reentry_count", "reclaim_count",
        "deepest_zone_retrace_fraction", "post_reclaim_close_strength", "opposite_boundary_close_violation",
        "pivot_symmetry", "pivot_overlap_ratio", "reclaim_latency_bars", "reclaim_close_location",
        "reclaim_body_strength", "reclaim_failure_count",
    ],
    "pre_trigger_context": [
        "trigger_seconds_after_open", "pre_trigger_return", "pre_trigger_range", "pre_trigger_volume",
        "prior_close_gap",
    ],
    "sequence_structure": [
        "retrace_at_entry", "pivot_flem_dist", "time_since_pivot_sec", "body_last", "body_sum", "body_mean",
        "in_dir_ratio", "max_in_dir_run", "bars_since_pivot", "zone_over_range", "pivot_over_range",
        "dist_to_extrema_atr", "zone_to_extrema_atr",
    ],
    "regime_features": [
        "reg_vol_10", "reg_vol_30", "reg_vol_ratio", "reg_trend_10", "reg_trend_30", "reg_trend_strength_10",
        "reg_trend_strength_30", "reg_chop_10", "reg_chop_30", "reg_range_ratio_10", "reg_range_ratio_30",
        "reg_pretrigger_bar_count", "reg_high_vol_state", "reg_trending_state",
    ],
    "manual_quality_prior": [
        "manual_validity_probability", "manual_high_quality_probability", "manual_example_matched",
    ],
}
# fixed values: raw market-state columns
MARKET_RAW = [
    "directional_efficiency_open_to_now", "recent_directional_efficiency", "body_to_range_ratio_recent",
    "wick_rejection_ratio_recent", "alternating_bar_ratio", "local_swing_overlap_score", "impulse_speed_score",
    "repair_speed_score", "flem_compression_score", "pivot_cleanliness_score", "distance_to_recent_high_low",
    "failed_followthrough_count",
]


def bar_context(bars: DataFrame, spec: SessionSpec) -> DataFrame:
    """Running and rolling quantities of every bar, inside its session only."""
    asc = W.partitionBy(*SESSION_KEY).orderBy("sod")
    upto = asc.rowsBetween(W.unboundedPreceding, 0)
    tail = lambda n: asc.rowsBetween(-(n - 1), 0)
    before = asc.rowsBetween(-PRIOR, -1)
    earlier = asc.rowsBetween(W.unboundedPreceding, -1)
    rng, body = F.col("high") - F.col("low"), F.abs(F.col("close") - F.col("open"))
    b = bars.withColumns(
        {
            "pos": F.row_number().over(asc),
            "prev_close": F.lag("close").over(asc),
            "prev_low": F.lag("low").over(asc),
            "prev_high": F.lag("high").over(asc),
            "prev_sod": F.lag("sod").over(asc),
            "body": body,
            "side": F.signum(F.col("close") - F.col("open")).cast("int"),
            "body_share": ratio(body, rng),
            "wick_share": ratio(F.greatest(rng - body, F.lit(0.0)), rng),
        }
    )
    turn = F.abs(F.col("close") - F.col("prev_close"))
    b = b.withColumns(
        {
            "ret": F.col("close") / F.nullif(F.col("prev_close"), F.lit(0.0)) - 1,
            "turn": turn,
            "tr": F.greatest(
                rng, F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close"))
            ),
            "prev_side": F.last(
                F.when(F.col("side") != 0, F.struct(F.col("side").alias("v"), F.col("pos").alias("pos"))), True
            ).over(earlier),
            "overlaps": F.coalesce(
                (F.col("high") >= F.col("prev_low")) & (F.col("low") <= F.col("prev_high")), F.lit(False)
            ),
        }
    )
    out = {
        "s_open": F.first("open").over(upto),
        "s_first_close": F.first("close").over(upto),
        "s_high": F.max("high").over(upto),
        "s_low": F.min("low").over(upto),
        "s_volume": F.sum("volume").over(upto),
        "s_turn": F.sum("turn").over(upto),
        "s_speed": F.sum(F.when(F.col("sod") >= spec.decision, 1).otherwise(0)).over(upto),
        "atr": F.avg("tr").over(tail(ATR)),
        "p_range": (F.max("high").over(before) - F.min("low").over(before)) / F.count("sod").over(before),
        "p_volume": F.avg("volume").over(before),
        "w_first_close": F.first("close").over(tail(RECENT)),
        "w_first_open": F.first("open").over(tail(RECENT)),
        "w_turn": F.sum("turn").over(tail(RECENT - 1)),
        "w_high": F.max("high").over(tail(RECENT)),
        "w_low": F.min("low").over(tail(RECENT)),
        "w_body": F.avg("body_share").over(tail(RECENT)),
        "w_wick": F.avg("wick_share").over(tail(RECENT)),
    }
    for n in (10, 30):
        out[f"vol_{n}"] = F.coalesce(F.stddev_samp("ret").over(tail(n)), F.lit(0.0))
        out[f"net_{n}"] = F.sum("ret").over(tail(n))
        out[f"abs_{n}"] = F.sum(F.abs("ret")).over(tail(n))
        out[f"open_{n}"] = F.first("open").over(tail(n))
        out[f"range_{n}"] = F.max("high").over(tail(n)) - F.min("low").over(tail(n))
    return b.withColumns(out)


def session_gaps(bars: DataFrame) -> DataFrame:
    """Opening gap of each session against the last close before it."""
    per = bars.groupBy(*SESSION_KEY).agg(
        F.min_by("open", "sod").alias("first_open"), F.max_by("close", "sod").alias("final_close")
    )
    prior = F.lag("final_close").over(W.partitionBy("symbol").orderBy("session_date"))
    return per.select(*SESSION_KEY, ratio(F.col("first_open") - prior, prior).alias("prior_close_gap"))


TRIGGER_COLS = [
    "pos", "open", "high", "low", "close", "body", "s_open", "s_first_close", "s_high", "s_low", "s_volume", "s_turn", "atr",
    "w_first_close", "w_first_open", "w_turn", "w_high", "w_low", "w_body", "w_wick", "vol_10", "vol_30", "net_10", "net_30",
    "abs_10", "abs_30", "open_10", "open_30", "range_10", "range_30",
]
BREAK_COLS = ["open", "high", "low", "close", "volume", "s_speed", "p_range", "p_volume"]


def candidate_bars(cands: DataFrame, ctx: DataFrame, key: list[str]) -> DataFrame:
    """Per candidate: trigger bar, break bar and the bars between, in one pass.

    One join on the session key and one aggregation on (session, candidate);
    both follow the partitioning the bars already have, so the bars are
    shuffled once.  The break bar is the bar that starts with the break; where
    that bar is missing, the first bar up to the trigger whose wick leaves the
    zone.
    """
    c = cands.select(*SESSION_KEY, *key, "direction", "break_sod", "pivot_sod", "trigger_sod", "zone_high", "zone_low")
    rows = c.join(ctx, SESSION_KEY).filter(F.col("sod") <= F.col("trigger_sod"))
    group = [*SESSION_KEY, *key]
    rows = rows.withColumn("t_pos", F.max("pos").over(W.partitionBy(*group)))
    long = F.col("direction") == "long"
    in_pivot = F.col("sod") > F.col("break_sod")
    in_seq = (F.col("sod") >= F.col("pivot_sod")) & in_pivot
    in_recent = F.col("pos") > F.col("t_pos") - RECENT
    crossing = F.when(long, F.col("high") > F.col("zone_high")).otherwise(F.col("low") < F.col("zone_low"))
    with_dir = F.when(long, F.col("side") > 0).otherwise(F.col("side") < 0)
    fails = F.when(long, F.col("close") < F.col("zone_high")).otherwise(F.col("close") > F.col("zone_low"))
    weak = F.when(long, F.col("close") <= F.col("zone_high")).otherwise(F.col("close") >= F.col("zone_low"))
    rows = rows.filter(in_pivot | in_recent | crossing | (F.col("sod") == F.col("break_sod")))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    brk = F.struct(*BREAK_COLS)
    agg = rows.groupBy(*group).agg(
        F.max_by(F.struct(*TRIGGER_COLS), "pos").alias("t"),
        F.coalesce(
            F.max(F.when(F.col("sod") == F.col("break_sod"), brk)), F.min_by(brk, F.when(crossing, F.col("sod")))
        ).alias("b"),
        n(in_pivot).alias("v_bars"),
        n(in_pivot & F.col("overlaps") & (F.col("prev_sod") > F.col("break_sod"))).alias("v_overlaps"),
        n(in_pivot & fails).alias("v_fails"),
        n(in_pivot & weak).alias("v_weak"),
        F.max(F.when(in_pivot, F.col("high"))).alias("v_high"),
        F.min(F.when(in_pivot, F.col("low"))).alias("v_low"),
        n(in_seq).alias("q_bars"),
        F.sum(F.when(in_seq, F.col("body"))).alias("q_body"),
        n(in_seq & with_dir).alias("q_with"),
        F.array_sort(F.collect_list(F.when(in_seq, F.struct("sod", with_dir.alias("d"))))).alias("q_run"),
        n(in_recent & (F.col("side") != 0)).alias("r_moves"),
        n(in_recent).alias("r_bars"),
        n(
            in_recent & (F.col("side") != 0) & (F.col("prev_side.v") != F.col("side"))
            & (F.col("prev_side.pos") > F.col("t_pos") - RECENT)
        ).alias("r_turns"),
        n(in_recent & F.col("overlaps") & (F.col("pos") - 1 > F.col("t_pos") - RECENT)).alias("r_overlaps"),
    )
    return agg.select(
        *group, *[F.col("t")[x].alias("t_" + x) for x in TRIGGER_COLS], *[F.col("b")[x].alias("b_" + x) for x in BREAK_COLS],
        *[x for x in agg.columns if x not in (*group, "t", "b")],
    )


def longest_run(flags: Column) -> Column:
    """Longest stretch of true in an ordered array of (sod, d)."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(x["d"], acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(flags, start, step, lambda acc: acc["best"])


def feature_matrix(bars: DataFrame, cands: DataFrame, spec: SessionSpec, key: list[str] | None = None) -> DataFrame:
    """One wide row per candidate; ``cands`` are finalized candidates."""
    key = key or ["candidate_id"]
    cands = cut(first_per_id(cands, key))  # small, read twice
    facts = candidate_bars(cands, bar_context(bars, spec), key)
    f = cands.join(facts, [*SESSION_KEY, *key]).join(session_gaps(bars), SESSION_KEY)
    long = F.col("direction") == "long"
    width = F.greatest(F.col("zone_width"), F.lit(spec.min_points))
    pos = lambda x: F.greatest(x, F.lit(0.0))
    tiny = lambda x: F.greatest(x, F.lit(1e-9))
    entry = F.col("entry_price")
    b_range = tiny(F.col("b_high") - F.col("b_low"))
    move = F.when(long, F.col("b_close") - F.col("zone_high")).otherwise(F.col("zone_low") - F.col("b_close"))
    t_range = tiny(F.col("t_high") - F.col("t_low"))
    day = F.col("t_s_high") - F.col("t_s_low")
    reach = F.abs(F.col("flem_price") - F.col("pivot_price"))
    back = F.when(long, entry - F.col("pivot_price")).otherwise(F.col("pivot_price") - entry)
    zone_edge = F.when(long, F.col("zone_high")).otherwise(F.col("zone_low"))
    extreme = F.when(long, F.col("t_s_high") - entry).otherwise(entry - F.col("t_s_low"))
    z_extreme = F.when(long, F.col("t_s_high") - F.col("zone_high")).otherwise(F.col("zone_low") - F.col("t_s_low"))
    has_p, has_q, has_b = F.col("v_bars") > 0, F.col("q_bars") > 0, F.col("b_close").isNotNull()
    zero = F.lit(0.0)
    when_p = lambda x: F.when(has_p, x).otherwise(zero)
    when_q = lambda x: F.when(has_q, x).otherwise(zero)
    when_b = lambda x: F.when(has_b, x).otherwise(zero)
    cols = {
        "direction_long": F.when(long, 1).otherwise(0),
        "zone_midpoint": F.col("zone_mid"),
        "entry_distance_from_midpoint": entry - F.col("zone_mid"),
        "entry_distance_from_zone_high": entry - F.col("zone_high"),
        "entry_distance_from_zone_low": entry - F.col("zone_low"),
        "trigger_seconds_after_open": F.col("trigger_sod") - spec.session_start,
        "pre_trigger_return": ratio(F.col("t_close") - F.col("t_s_open"), "t_s_open"),
        "pre_trigger_range": day,
        "pre_trigger_volume": F.col("t_s_volume"),
        "break_close_distance_to_zone": when_b(pos(move / width)),
        "break_body_fraction": when_b(F.abs(F.col("b_close") - F.col("b_open")) / b_range),
        "break_speed_bars": when_b(F.greatest(F.col("b_s_speed") - 1, F.lit(0)).cast("double")),
        "break_volume_surge": when_b(F.when(F.col("b_p_volume") > 0, F.col("b_volume") / F.col("b_p_volume")).otherwise(zero)),
        "break_range_expansion": when_b(F.when(F.col("b_p_range") > 0, b_range / F.col("b_p_range")).otherwise(zero)),
        "break_efficiency_ratio": when_b(pos(move) / b_range),
        "pivot_symmetry": when_p(F.abs(entry - F.col("pivot_price")) / width),
        "pivot_overlap_ratio": when_p(F.col("v_overlaps") / F.col("v_bars")),
        "reclaim_latency_bars": when_p((F.col("v_bars") - 1).cast("double")),
        "reclaim_close_location": when_p(
            F.when(long, F.col("t_close") - F.col("t_low")).otherwise(F.col("t_high") - F.col("t_close")) / t_range
        ),
        "reclaim_body_strength": when_p(F.col("t_body") / t_range),
        "reclaim_failure_count": when_p(F.col("v_fails").cast("double")),
        "retrace_at_entry": when_q(pos(F.when(reach != 0, back / F.when(long, F.col("flem_price") - F.col("pivot_price")).otherwise(
            F.col("pivot_price") - F.col("flem_price"))).otherwise(zero))),
        "pivot_flem_dist": when_q(reach),
        "time_since_pivot_sec": when_q(F.greatest(F.col("trigger_sod") - F.col("pivot_sod"), F.lit(0)).cast("double")),
        "body_last": when_q(F.col("t_body")),
        "body_sum": when_q(F.col("q_body")),
        "body_mean": when_q(F.col("q_body") / F.col("q_bars")),
        "in_dir_ratio": when_q(F.col("q_with") / F.col("q_bars")),
        "max_in_dir_run": when_q(longest_run(F.col("q_run")).cast("double")),
        "bars_since_pivot": when_q(F.col("q_bars").cast("double")),
        "zone_over_range": when_q(F.when(day > 0, F.abs(F.col("flem_price") - zone_edge) / day).otherwise(zero)),
        "pivot_over_range": when_q(F.when(day > 0, reach / day).otherwise(zero)),
        "dist_to_extrema_atr": when_q(F.when(F.col("t_atr") > 0, extreme / F.col("t_atr")).otherwise(zero)),
        "zone_to_extrema_atr": when_q(F.when(F.col("t_atr") > 0, z_extreme / F.col("t_atr")).otherwise(zero)),
        "reg_vol_10": F.col("t_vol_10"),
        "reg_vol_30": F.col("t_vol_30"),
        "reg_vol_ratio": F.when(F.col("t_vol_30") > 0, F.col("t_vol_10") / F.col("t_vol_30")).otherwise(zero),
        "reg_pretrigger_bar_count": F.col("t_pos").cast("double"),
    }
    for n in (10, 30):
        trend = ratio(F.col("t_close") - F.col(f"t_open_{n}"), f"t_open_{n}")
        cols[f"reg_trend_{n}"] = trend
        cols[f"reg_trend_strength_{n}"] = F.when(F.col(f"t_vol_{n}") > 0, trend / F.col(f"t_vol_{n}")).otherwise(zero)
        cols[f"reg_chop_{n}"] = F.coalesce(F.col(f"t_abs_{n}") / tiny(F.abs(F.round(F.col(f"t_net_{n}"), 12))), zero)
        cols[f"reg_range_ratio_{n}"] = F.col(f"t_range_{n}") / width
    pivot_range = F.col("v_high") - F.col("v_low")
    progress = F.when(long, F.col("t_close") - F.col("t_w_first_open")).otherwise(F.col("t_w_first_open") - F.col("t_close"))
    repair = F.when(long, F.col("t_close") - F.col("v_low")).otherwise(F.col("v_high") - F.col("t_close"))
    cols.update(
        {
            "directional_efficiency_open_to_now": ratio(F.abs(F.col("t_close") - F.col("t_s_first_close")), "t_s_turn"),
            "recent_directional_efficiency": ratio(F.abs(F.col("t_close") - F.col("t_w_first_close")), "t_w_turn"),
            "body_to_range_ratio_recent": F.col("t_w_body"),
            "wick_rejection_ratio_recent": F.col("t_w_wick"),
            "alternating_bar_ratio": F.when(
                (F.col("r_bars") >= 3) & (F.col("r_moves") >= 2), F.col("r_turns") / (F.col("r_moves") - 1)
            ).otherwise(zero),
            "local_swing_overlap_score": F.when(
                F.col("r_bars") >= 3, F.col("r_overlaps") / (F.col("r_bars") - 1)
            ).otherwise(zero),
            "impulse_speed_score": pos(progress) / width / F.col("r_bars"),
            "repair_speed_score": when_p(pos(repair) / width / F.col("v_bars")),
            "flem_compression_score": when_p(pos(1 - F.least(pivot_range / width, F.lit(2.0)) / 2)),
            "pivot_cleanliness_score": when_p(
                F.when(F.col("v_bars") >= 3, 1 - F.col("v_overlaps") / (F.col("v_bars") - 1)).otherwise(F.lit(1.0))
            ),
            "distance_to_recent_high_low": F.least(
                F.abs(entry - F.col("t_w_high")), F.abs(entry - F.col("t_w_low"))
            ) / width,
            "failed_followthrough_count": when_p(F.col("v_weak").cast("double")),
        }
    )
    f = f.withColumns(cols)
    f = f.withColumns(
        {
            "reg_high_vol_state": flag(F.col("reg_vol_ratio") > 1.1),
            "reg_trending_state": flag((F.abs(F.col("reg_trend_strength_10")) > 1.0) & (F.col("reg_chop_10") < 8.0)),
        }
    )
    keep = ["reentry_count", "reclaim_count", "zone_width", "zone_width_bps", "first_break_wick_only",
            "first_break_close_confirmed", "first_break_wick_excess_points", "first_break_close_excess_points",
            "pivot_duration_bars", "continuation_delay_bars", "deepest_zone_retrace_fraction",
            "continuation_displacement_ratio", "post_reclaim_close_strength", "opposite_boundary_close_violation",
            "prior_close_gap"]
    names = list(dict.fromkeys([*keep, *cols, "reg_high_vol_state", "reg_trending_state"]))
    return f.select(*key, *SESSION_KEY, "direction", "setup_subtype", *names)


def recomputed_break_context(bars: DataFrame, cands: DataFrame, spec: SessionSpec, key: list[str] | None = None) -> DataFrame:
    """Break context from bars alone, for candidates that carry no trace."""
    key = key or ["candidate_id"]
    cands = first_per_id(cands, key)
    long = F.col("direction") == "long"
    crossing = F.when(long, F.col("high") > F.col("zone_high")).otherwise(F.col("low") < F.col("zone_low"))
    c = cands.select(*SESSION_KEY, *key, "direction", "break_sod", "trigger_sod", "entry_price", "zone_high", "zone_low", "zone_width")
    rows = c.join(bars.select(*SESSION_KEY, "sod", "open", "high", "low", "close"), SESSION_KEY).filter(
        F.col("sod") <= F.col("trigger_sod")
    )
    own = F.min(F.when(F.col("sod") == F.col("break_sod"), F.col("sod")))
    w = W.partitionBy(*key)
    rows = rows.withColumn(
        "brk", F.coalesce(own.over(w), F.min(F.when(crossing, F.col("sod"))).over(w))
    ).filter(F.col("brk").isNotNull())
    at_brk, after = F.col("sod") == F.col("brk"), F.col("sod") > F.col("brk")
    touch = F.when(long, F.col("low") <= F.col("zone_high")).otherwise(F.col("high") >= F.col("zone_low"))
    beyond = F.when(long, F.col("close") > F.col("zone_high")).otherwise(F.col("close") < F.col("zone_low"))
    through = F.when(long, F.col("close") < F.col("zone_low")).otherwise(F.col("close") > F.col("zone_high"))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("double")
    g = rows.groupBy(*key, "direction", "entry_price", "zone_high", "zone_low", "zone_width").agg(
        F.max(F.when(at_brk, F.col("high"))).alias("bh"),
        F.max(F.when(at_brk, F.col("low"))).alias("bl"),
        F.max(F.when(at_brk, F.col("close"))).alias("bc"),
        n(after).alias("n_after"),
        n(after & touch).alias("reentry_count"),
        n(after & touch & beyond).alias("reclaim_count"),
        F.min(F.when(after, F.col("low"))).alias("lo"),
        F.max(F.when(after, F.col("high"))).alias("hi"),
        F.max(F.when(after, F.col("close"))).alias("chi"),
        F.min(F.when(after, F.col("close"))).alias("clo"),
        F.max(flag(after & through)).alias("opposite_boundary_close_violation"),
        F.sum(F.when((F.col("sod") >= F.col("brk")) & (F.col("sod") < F.col("trigger_sod")), 1).otherwise(0)).cast("double").alias("continuation_delay_bars"),
    )
    zw = F.coalesce(F.nullif(F.col("zone_width"), F.lit(0.0)), F.lit(1.0))
    pos = lambda x: F.coalesce(F.greatest(x, F.lit(0.0)), F.lit(0.0))
    wick = pos(F.when(long, F.col("bh") - F.col("zone_high")).otherwise(F.col("zone_low") - F.col("bl")))
    close = pos(F.when(long, F.col("bc") - F.col("zone_high")).otherwise(F.col("zone_low") - F.col("bc")))
    return g.select(
        *key,
        flag((wick > 0) & (close <= 0)).alias("first_break_wick_only"),
        flag(close > 0).alias("first_break_close_confirmed"),
        wick.alias("first_break_wick_excess_points"),
        close.alias("first_break_close_excess_points"),
        F.col("n_after").alias("pivot_duration_bars"),
        "continuation_delay_bars",
        "reentry_count",
        "reclaim_count",
        F.when(F.col("n_after") > 0, pos(F.when(long, F.col("zone_high") - F.col("lo")).otherwise(F.col("hi") - F.col("zone_low"))) / zw).otherwise(F.lit(0.0)).alias("deepest_zone_retrace_fraction"),
        (F.abs(F.col("entry_price") - F.col("bc")) / zw).alias("continuation_displacement_ratio"),
        F.when(F.col("n_after") > 0, pos(F.when(long, F.col("chi") - F.col("zone_high")).otherwise(F.col("zone_low") - F.col("clo"))) / zw).otherwise(F.lit(0.0)).alias("post_reclaim_close_strength"),
        "opposite_boundary_close_violation",
    )


def feature_audit(bars: DataFrame, cands: DataFrame, spec: SessionSpec) -> DataFrame:
    """Latest bar used per candidate and whether it lies before the cutoff."""
    c = cands.dropDuplicates(["candidate_id"])
    used = asof(
        c.select("candidate_id", *SESSION_KEY, "decision_sod"),
        bars.select(*SESSION_KEY, "sod"),
        by=SESSION_KEY, left_time="decision_sod", right_time="sod", key="sod", take=["sod"], strict=True, prefix="used_",
    )
    late = F.col("used_sod") >= F.col("decision_sod")
    return used.select(
        "candidate_id",
        F.when(late, "fail").otherwise("pass").alias("status"),
        iso("session_date", "used_sod").alias("latest_feature_timestamp"),
        iso("session_date", "decision_sod").alias("feature_cutoff_time"),
        F.array_compact(F.array(F.when(late, F.lit("feature_timestamp_after_cutoff")))).alias("issues"),
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    base = audit.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("status") != "pass", 1)).alias("failed"))
    issues = audit.filter(F.col("status") != "pass").select(F.explode("issues").alias("i")).agg(
        F.array_sort(F.collect_set("i")).alias("issues")
    )
    return base.crossJoin(F.broadcast(issues))


# fixed values: parts of each composite family; "eng" adds the indicator columns
FAMILY_PARTS = {
    "engineer_indicators": ["eng"],
    "bnr_core": ["bnr_geometry", "pivot_reclaim"],
    "bnr_plus_context": ["bnr_geometry", "pivot_reclaim", "pre_trigger_context", "sequence_structure", "manual_quality_prior"],
    "bnr_plus_engineer": ["bnr_geometry", "pivot_reclaim", "sequence_structure", "manual_quality_prior", "eng"],
    "context_plus_reclaim": ["pre_trigger_context", "pivot_reclaim", "sequence_structure", "manual_quality_prior"],
    "context_plus_geometry": ["pre_trigger_context", "bnr_geometry", "sequence_structure", "manual_quality_prior"],
    "reclaim_plus_engineer": ["pivot_reclaim", "manual_quality_prior", "eng"],
    "context_plus_regime": ["pre_trigger_context", "sequence_structure", "regime_features", "manual_quality_prior"],
    "reclaim_plus_regime": ["pivot_reclaim", "sequence_structure", "regime_features", "manual_quality_prior"],
}


def apply_feature_family(features: DataFrame, family: str) -> DataFrame:
    """Select one column family; a pure projection, so the scan reads only it.

    The input order of columns is kept; an unknown family keeps everything.
    """
    if family in ("", "all", "all_features"):
        return features
    parts = FAMILY_PARTS.get(family, [family])
    keep = {"candidate_id", "session_date", "setup_subtype"}
    for part in parts:
        keep.update(FAMILY_COLUMNS.get(part, []))
    cols = [x for x in features.columns if x in keep or ("eng" in parts and x.startswith("eng_"))]
    return features.select(*cols) if cols else features


def numeric_feature_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    """Numeric columns not excluded and not entirely null (one narrow pass)."""
    kinds = {"double", "float", "integer", "long", "short", "byte"}
    names = [f.name for f in df.schema.fields if f.dataType.typeName() in kinds and f.name not in exclude]
    filled = df.agg(*[F.max(F.col(x).isNotNull()).alias(x) for x in names]).first()
    return [x for x in names if filled[x]]
