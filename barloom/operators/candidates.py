"""Break, pull-back, reclaim candidates.

A break is a coarse bar that leaves the zone; the entry is the first fine bar
after a later pull-back bar that closes beyond the same edge again.  A plain
reading compares every break with every later bar of its session.  Here every
quantity is a property of bar rows alone, computed with running windows over
the session, so the work is linear in bars:

* the entry of a pull-back bar is the next qualifying bar after it;
* the entry of a break is the entry of the first pull-back bar after it;
* counts between two rows are differences of running counts;
* the pivot is a suffix minimum inside the stretch that ends at the entry, the
  extreme before it a suffix maximum inside the stretch between pull-backs.

Both directions run through the same expressions on mirrored prices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.columns import at, iso, ladder, ratio
from barloom.schemas import SESSION_KEY, SessionSpec

BREAK_MODES = ("close", "wick", "wick_failed_close")


def rules_of(zones: DataFrame, spec: SessionSpec, *, break_mode: str = "close", buffer: float = 0.0, cap: int = 0) -> DataFrame:
    """Attach one set of candidate rules to each zone row."""
    return zones.withColumns(
        {
            "break_mode": F.lit(break_mode),
            "buffer": F.lit(float(buffer)),
            "earliest_sod": F.lit(spec.earliest),
            "latest_sod": F.lit(spec.latest),
            "cap": F.lit(int(cap)),
        }
    )


def break_predicate(close: Column, extreme: Column, edge: Column, mode: Column) -> Column:
    """Break test on mirrored prices: by close, by wick, or by failed wick."""
    by_close, by_wick = close > edge, extreme > edge
    return (
        F.when(mode == "close", by_close)
        .when(mode == "wick", by_wick)
        .when(mode == "wick_failed_close", by_wick & ~by_close)
        .otherwise(F.lit(False))
    )


def pullback_predicate(open_: Column, close: Column, low: Column, high: Column, zone_low: Column, zone_high: Column, long: Column) -> Column:
    """Bar that touches the zone with its body against the direction."""
    against = F.when(long, close < open_).otherwise(close > open_)
    return (low <= zone_high) & (high >= zone_low) & against


def mirrored(bars: DataFrame, rules: DataFrame, spec: SessionSpec, extra: list[str]) -> DataFrame:
    """Bars joined with their session's rules, once per direction, prices mirrored.

    The last fine bar of each coarse bar carries that coarse bar's values, so
    the coarse stream needs no second scan and no union.
    """
    coarse = (F.floor(F.col("sod") / spec.coarse) * spec.coarse).cast("int")
    bucket = W.partitionBy(*SESSION_KEY, "coarse_sod")
    order = bucket.orderBy("sod").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # one shuffle on the session serves every window below, before rows are replicated
    b = (
        bars.select(*SESSION_KEY, "sod", "open", "high", "low", "close")
        .repartition(*SESSION_KEY)
        .withColumn("coarse_sod", coarse)
        .withColumns(
            {
                "c_high": F.max("high").over(bucket),
                "c_low": F.min("low").over(bucket),
                "c_close": F.last("close").over(order),
                "carrier": F.col("sod") == F.max("sod").over(bucket),
            }
        )
    )
    long = F.col("sign") > 0
    return (
        b.join(rules.select(*SESSION_KEY, *extra, "zone_high", "zone_low", "decision_sod", "break_mode", "buffer",
                            "earliest_sod", "latest_sod", "cap"), SESSION_KEY)
        .filter(F.col("sod") + spec.fine <= F.col("latest_sod"))
        .withColumn("sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
        .withColumns(
            {
                "t": F.col("sod") + spec.fine,
                "ct": F.col("coarse_sod") + spec.coarse,
                "edge": F.col("sign") * F.when(long, F.col("zone_high")).otherwise(F.col("zone_low")),
                "opp": F.col("sign") * F.when(long, F.col("zone_low")).otherwise(F.col("zone_high")),
                "x": F.col("sign") * F.col("close"),
                "fav": F.col("sign") * F.when(long, F.col("high")).otherwise(F.col("low")),
                "adv": F.col("sign") * F.when(long, F.col("low")).otherwise(F.col("high")),
                "cx": F.col("sign") * F.col("c_close"),
                "c_fav": F.col("sign") * F.when(long, F.col("c_high")).otherwise(F.col("c_low")),
                "pb": pullback_predicate(F.col("open"), F.col("close"), F.col("low"), F.col("high"),
                                         F.col("zone_low"), F.col("zone_high"), long),
            }
        )
    )


def reclaim_candidates(
    bars: DataFrame,
    rules: DataFrame,
    spec: SessionSpec,
    *,
    extra: list[str] | None = None,
    dedup: bool = False,
) -> DataFrame:
    """Candidates of the canonical engine for every row of ``rules``.

    ``extra`` names further key columns of ``rules`` (for example a universe
    variant), so many definitions run as one job.  ``dedup`` keeps the first
    break per entry before the per-direction cap is applied.
    """
    extra = list(extra or [])
    key = [*SESSION_KEY, *extra, "sign"]
    m = mirrored(bars, rules, spec, extra)
    asc = W.partitionBy(*key).orderBy("sod")
    upto = asc.rowsBetween(W.unboundedPreceding, 0)
    desc = W.partitionBy(*key).orderBy(F.col("sod").desc())
    later = desc.rowsBetween(W.unboundedPreceding, -1)
    here_on = desc.rowsBetween(W.unboundedPreceding, 0)
    one = lambda cond: F.when(cond, 1).otherwise(0)

    beyond = F.col("x") > F.col("edge")
    m = m.withColumns(
        {
            "fresh": ~F.col("pb") & beyond & ~F.coalesce(F.lag(beyond).over(asc), F.lit(False)),
            "qual": ~F.col("pb") & beyond & (F.col("t") >= F.col("earliest_sod")),
            "broke": F.col("carrier")
            & (F.col("ct") >= F.col("decision_sod"))
            & (F.col("ct") <= F.col("latest_sod"))
            & break_predicate(F.col("cx"), F.col("c_fav"), F.col("edge") + F.col("buffer"), F.col("break_mode")),
        }
    )
    m = m.withColumns(
        {
            "n_pb": F.sum(one(F.col("pb"))).over(upto),
            "n_fresh": F.sum(one(F.col("fresh"))).over(upto),
            "to_entry": F.sum(one(F.col("qual"))).over(here_on),
            "to_pb": F.coalesce(F.sum(one(F.col("pb"))).over(later), F.lit(0)),
            "void_t": F.min(F.when(F.col("carrier") & (F.col("cx") < F.col("opp")), F.col("ct"))).over(here_on),
        }
    )
    m = m.withColumns(
        {
            "entry": F.min(
                F.when(F.col("qual"), F.struct("t", "sod", F.col("close").alias("price"), "n_pb", "n_fresh"))
            ).over(later),
            "pivot": F.min(F.struct(F.col("adv").alias("v"), F.col("t").alias("t"))).over(
                W.partitionBy(*key, "to_entry").orderBy(F.col("sod").desc()).rowsBetween(W.unboundedPreceding, 0)
            ),
            "reach": F.max(F.struct(F.col("fav").alias("v"), F.col("t").alias("t"))).over(
                W.partitionBy(*key, "to_entry").orderBy(F.col("sod").desc()).rowsBetween(W.unboundedPreceding, 0)
            ),
            "before_pb": F.max(F.struct(F.col("fav").alias("v"), F.col("t").alias("t"))).over(
                W.partitionBy(*key, "to_pb").orderBy(F.col("sod").desc()).rowsBetween(W.unboundedPreceding, -1)
            ),
        }
    )
    m = m.withColumn(
        "first_pb",
        F.min(F.when(F.col("pb"), F.struct("t", "entry", "pivot", "reach", "n_fresh"))).over(later),
    )
    e = F.col("first_pb.entry")
    flem = F.greatest(
        F.struct(F.col("c_fav").alias("v"), F.col("ct").alias("t")), F.col("before_pb"), F.col("first_pb.reach")
    )
    found = m.filter(F.col("broke") & e.isNotNull()).filter(F.col("void_t").isNull() | (F.col("void_t") > e["t"]))
    out = found.select(
        *SESSION_KEY,
        *extra,
        "cap",
        F.when(F.col("sign") > 0, "long").otherwise("short").alias("direction"),
        F.col("coarse_sod").alias("break_sod"),
        F.col("ct").alias("break_decision_sod"),
        e["sod"].alias("trigger_sod"),
        e["t"].alias("decision_sod"),
        e["price"].alias("entry_price"),
        (F.col("sign") * F.col("first_pb.pivot.v")).alias("pivot_price"),
        F.col("first_pb.pivot.t").alias("pivot_sod"),
        (F.col("sign") * flem["v"]).alias("flem_price"),
        flem["t"].alias("flem_sod"),
        (e["n_pb"] - F.col("n_pb")).cast("int").alias("reentry_count"),
        (e["n_fresh"] - F.col("first_pb.n_fresh")).cast("int").alias("reclaim_count"),
        F.col("c_close").alias("break_close"),
        F.col("c_high").alias("break_high"),
        F.col("c_low").alias("break_low"),
        F.lit("canonical").alias("candidate_engine"),
        F.lit(1).alias("break_sequence"),
        F.lit(1).alias("attempt_sequence"),
    )
    side = [*SESSION_KEY, *extra, "direction"]
    if dedup:
        w = W.partitionBy(*side, "trigger_sod").orderBy("break_sod")
        out = out.withColumn("__d", F.row_number().over(w)).filter(F.col("__d") == 1).drop("__d")
    return cap_per_direction(out, side)


def cap_per_direction(cands: DataFrame, side: list[str]) -> DataFrame:
    """First ``cap`` candidates per session and direction in break order (0: all)."""
    w = W.partitionBy(*side).orderBy("break_sod", "trigger_sod")
    return (
        cands.withColumn("__r", F.row_number().over(w))
        .filter((F.col("cap") <= 0) | (F.col("__r") <= F.col("cap")))
        .drop("__r", "cap")
    )


def first_per_id(cands: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per candidate id: the earliest break that leads to the entry."""
    w = W.partitionBy(*(key or ["candidate_id"])).orderBy("break_sod")
    return cands.withColumn("__f", F.row_number().over(w)).filter(F.col("__f") == 1).drop("__f")


def finalize(cands: DataFrame, zones: DataFrame, spec: SessionSpec, zone_key: list[str] | None = None) -> DataFrame:
    """Identity, reference prices and trace ratios over the zone width."""
    on = [*SESSION_KEY, *(zone_key or [])]
    z = zones.select(*on, "zone_high", "zone_low", "zone_mid", "zone_width", "zone_width_bps", "quality_flags")
    long = F.col("direction") == "long"
    pos = lambda x: F.greatest(x, F.lit(0.0))
    wick = pos(F.when(long, F.col("break_high") - F.col("zone_high")).otherwise(F.col("zone_low") - F.col("break_low")))
    close = pos(F.when(long, F.col("break_close") - F.col("zone_high")).otherwise(F.col("zone_low") - F.col("break_close")))
    retrace = pos(F.when(long, F.col("zone_high") - F.col("pivot_price")).otherwise(F.col("pivot_price") - F.col("zone_low")))
    moved = pos(F.when(long, F.col("entry_price") - F.col("pivot_price")).otherwise(F.col("pivot_price") - F.col("entry_price")))
    strength = pos(F.when(long, F.col("entry_price") - F.col("zone_high")).otherwise(F.col("zone_low") - F.col("entry_price")))
    setup = F.concat(F.lit("break_reentry_reclaim_"), F.col("direction"))
    return cands.join(z, on).withColumns(
        {
            "setup_type": setup,
            "candidate_id": F.concat_ws(
                "-", "symbol", F.col("session_date").cast("string"), setup, iso("session_date", "trigger_sod")
            ),
            "invalidation_price": F.when(long, F.col("zone_low")).otherwise(F.col("zone_high")),
            "first_break_wick_excess_points": wick,
            "first_break_close_excess_points": close,
            "first_break_wick_only": F.when((wick > 0) & (close <= 0), 1.0).otherwise(0.0),
            "first_break_close_confirmed": F.when(close > 0, 1.0).otherwise(0.0),
            "pivot_duration_bars": F.greatest(F.col("reentry_count") + F.col("reclaim_count") - 1, F.lit(0)).cast("double"),
            "continuation_delay_bars": F.greatest(
                F.floor((F.col("decision_sod") - F.col("break_decision_sod")) / spec.fine), F.lit(0)
            ).cast("double"),
            "deepest_zone_retrace_fraction": ratio(retrace, "zone_width"),
            "continuation_displacement_ratio": ratio(moved, "zone_width"),
            "post_reclaim_close_strength": ratio(strength, "zone_width"),
            "opposite_boundary_close_violation": F.lit(0.0),
            "decision_time": at("session_date", "decision_sod"),
        }
    )


def subtype() -> Column:
    """Five-way ordered subtype of a finalized candidate."""
    retrace, cont = F.col("deepest_zone_retrace_fraction"), F.col("post_reclaim_close_strength")
    return ladder(
        [
            ((F.col("first_break_close_confirmed") > 0) & (retrace <= 0.35) & (cont >= 0.5), "clean_break_continuation"),
            (retrace >= 0.65, "deep_retrace_repair"),
            ((F.col("first_break_wick_only") > 0) & (F.col("reclaim_count") >= 1), "wick_reclaim_repair"),
            ((cont < 0.2) | (F.col("continuation_displacement_ratio") < 0.35), "weak_follow_through"),
        ],
        "balanced_reclaim_continuation",
    )


def with_subtype(cands: DataFrame) -> DataFrame:
    return cands.withColumn("setup_subtype", subtype())


def filter_subtype(cands: DataFrame, name: str) -> DataFrame:
    """Keep one subtype; an empty name, ``all`` or ``all_subtypes`` keeps everything."""
    return cands if name in ("", "all", "all_subtypes") else cands.filter(F.col("setup_subtype") == name)


def canonical(bars: DataFrame, spec: SessionSpec, *, buffer: float = 0.0, cap: int = 0, zones: DataFrame | None = None) -> DataFrame:
    """Zones, candidates and trace of the default definition in one call."""
    from barloom.operators.zones import opening_zones

    z = opening_zones(bars, spec) if zones is None else zones
    found = reclaim_candidates(bars, rules_of(z, spec, buffer=buffer, cap=cap), spec)
    return with_subtype(finalize(found, z, spec))


def inventory(cands: DataFrame) -> DataFrame:
    """Counts per ten-minute trigger bucket and engine."""
    minute = F.floor(F.col("trigger_sod") / 600) * 600
    return cands.groupBy(
        F.date_format(at("session_date", minute), "HH:mm").alias("ten_minute_bucket"), "candidate_engine"
    ).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.min(iso("session_date", "trigger_sod")).alias("earliest_trigger_time"),
        F.max(iso("session_date", "trigger_sod")).alias("latest_trigger_time"),
    )


def subtype_counts(cands: DataFrame) -> DataFrame:
    return cands.groupBy("setup_subtype").agg(F.count(F.lit(1)).alias("candidates"))
