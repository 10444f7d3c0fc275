"""Signal policies: gates, thresholds, sizing, regime rules.

A policy is a row of a small configured table.  Gates are evaluated for every
policy at once by fanning predictions out over the table, so one job covers a
whole grid; the policy name is part of every later key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import c, clip, fan_out, hhmm, ladder, num0

SCOPED_DEEP = ["balanced_reclaim_continuation", "deep_retrace_repair"]
SCOPED_CLEAN = ["balanced_reclaim_continuation", "clean_break_continuation"]

# fixed values: breakout-quality gates (name, subtypes in scope, min efficiency, min body)
BREAK_QUALITY = [
    ("baseline_no_gate", None, None, None),
    ("break_eff_ge_0.10", None, 0.10, None),
    ("break_eff_ge_0.20", None, 0.20, None),
    ("break_eff_ge_0.30", None, 0.30, None),
    ("body_ge_0.40", None, None, 0.40),
    ("body_ge_0.50", None, None, 0.50),
    ("balanced_deep_eff_ge_0.20", SCOPED_DEEP, 0.20, None),
    ("balanced_deep_eff_ge_0.20_body_ge_0.40", SCOPED_DEEP, 0.20, 0.40),
]
# fixed values: reclaim gates (name, subtypes in scope, min close location, min close strength, min body)
RECLAIM_META = [
    ("baseline_gated", None, None, None, None),
    ("balanced_clean_reclaim_close_ge_0.15", SCOPED_CLEAN, 0.15, None, None),
    ("balanced_clean_reclaim_close_ge_0.25", SCOPED_CLEAN, 0.25, None, None),
    ("balanced_clean_post_reclaim_ge_0.30", SCOPED_CLEAN, None, 0.30, None),
    ("balanced_clean_post_reclaim_ge_0.50", SCOPED_CLEAN, None, 0.50, None),
    ("balanced_clean_reclaim_body_ge_0.35", SCOPED_CLEAN, None, None, 0.35),
    ("balanced_clean_close_ge_0.15_post_ge_0.30", SCOPED_CLEAN, 0.15, 0.30, None),
]
# fixed values: tail clean-up policies; the two on exact clock buckets are diagnostic only
TAIL_CLEANUP = {
    "exclude_deep_retrace": {"exclude": "deep_retrace_repair"},
    "deep_retrace_threshold_070": {"lift": ("deep_retrace_repair", 0.70)},
    "deep_retrace_size_half": {"haircut": ("deep_retrace_repair", 0.50)},
    "exclude_1432_bucket": {"diagnostic": True, "bucket": "14:32"},
    "haircut_1432_bucket": {"diagnostic": True, "bucket": "14:32"},
    "deep_retrace_high_conf_cap": {"ceiling": ("deep_retrace_repair", 0.65, 0.64)},
    "deep_retrace_regime_confirmed_only": {"confirm": "deep_retrace_repair"},
}
# fixed values: sizing, throttle and regime-size policies
SIZING = {
    "binary_threshold_v1": ("binary",),
    "confidence_linear_v1": ("linear", 0.50, 1.50),
    "confidence_tiered_v1": ("tiered", 0.50, 1.00, 1.50, 0.20),
    "fractional_kelly_proxy_v1": ("kelly", 0.25, 1.25, 0.50),
}
THROTTLE = {
    "none": (None, None),
    "suppress_high_vol_v1": (0.0, None),
    "trending_only_v1": (None, 1.0),
    "high_vol_or_non_trending_off_v1": (0.0, 1.0),
}
REGIME_SIZE = {
    "none": None,
    "trend_vol_scale_v1": (1.00, 0.75, 0.35),
    "high_vol_haircut_v1": (1.00, 0.80, 0.50),
}


def subtype_policy(
    preds: DataFrame,
    *,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    default_threshold: float = 0.45,
    overrides: dict[str, float] | None = None,
) -> DataFrame:
    """Include / exclude subtypes and apply per-subtype thresholds."""
    sub = F.coalesce("setup_subtype", F.lit("unknown"))
    limit = ladder([(sub == k, float(v)) for k, v in (overrides or {}).items()], float(default_threshold))
    out = preds
    if include:
        out = out.filter(sub.isin(list(include)))
    if exclude:
        out = out.filter(~sub.isin(list(exclude)))
    return out.withColumn("applied_threshold", limit).filter(num0("probability") >= F.col("applied_threshold"))


def policy_record_counts(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    return records.groupBy(*(by or []), F.coalesce("setup_subtype", F.lit("unknown")).alias("setup_subtype")).agg(
        F.count(F.lit(1)).alias("records")
    )


def break_quality_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BREAK_QUALITY, "gate string, scope array<string>, min_eff double, min_body double")


def reclaim_meta_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RECLAIM_META, "meta string, scope array<string>, min_close double, min_post double, min_body double"
    )


def _floor(value: str, limit: str) -> Column:
    """Minimum test that passes when the policy sets no limit; null counts as 0."""
    return F.col(limit).isNull() | (num0(value) >= F.col(limit))


def _in_scope() -> Column:
    return F.col("scope").isNull() | F.array_contains("scope", F.coalesce("setup_subtype", F.lit("unknown")))


def break_quality(preds: DataFrame, threshold: float, gates: DataFrame | None = None) -> DataFrame:
    """Predictions kept by each breakout-quality gate, tagged with ``gate``."""
    table = break_quality_table(preds.sparkSession) if gates is None else gates
    kept = fan_out(preds.filter(num0("probability") >= threshold), table)
    ok = ~_in_scope() | (_floor("break_efficiency_ratio", "min_eff") & _floor("break_body_fraction", "min_body"))
    return kept.filter(ok).drop("scope", "min_eff", "min_body")


def reclaim_meta(records: DataFrame, metas: DataFrame | None = None) -> DataFrame:
    """Records kept by each reclaim gate, tagged with ``meta``."""
    table = reclaim_meta_table(records.sparkSession) if metas is None else metas
    ok = ~_in_scope() | (
        _floor("reclaim_close_location", "min_close")
        & _floor("post_reclaim_close_strength", "min_post")
        & _floor("reclaim_body_strength", "min_body")
    )
    return fan_out(records, table).filter(ok).drop("scope", "min_close", "min_post", "min_body")


def tail_cleanup(records: DataFrame, policy: str) -> DataFrame:
    """Apply one tail clean-up policy; diagnostic-only policies are refused."""
    if policy not in TAIL_CLEANUP:
        raise KeyError(f"unknown tail clean-up policy: {policy}")
    rule = TAIL_CLEANUP[policy]
    if rule.get("diagnostic"):
        raise ValueError(f"diagnostic-only policy cannot be executed: {policy}")
    if "policy_size_multiplier" not in records.columns:
        records = records.withColumn("policy_size_multiplier", F.lit(1.0))
    sub, p = F.coalesce("setup_subtype", F.lit("")), num0("probability")
    if "exclude" in rule:
        return records.filter(sub != rule["exclude"])
    if "lift" in rule:
        name, limit = rule["lift"]
        return records.filter((sub != name) | (p >= limit))
    if "haircut" in rule:
        name, factor = rule["haircut"]
        size = F.coalesce("policy_size_multiplier", F.lit(1.0))
        return records.withColumn("policy_size_multiplier", F.when(sub == name, size * factor).otherwise(size))
    if "ceiling" in rule:
        name, start, ceiling = rule["ceiling"]
        return records.withColumn(
            "probability", F.when((sub == name) & (p >= start), F.least(p, F.lit(ceiling))).otherwise(F.col("probability"))
        )
    confirmed = (num0("reg_high_vol_state") < 1.0) & (num0("reg_trending_state") >= 1.0)
    return records.filter((sub != rule["confirm"]) | confirmed)


def tail_cleanup_all(records: DataFrame) -> DataFrame:
    """Every executable clean-up policy, tagged with ``cleanup``."""
    out = None
    for name, rule in TAIL_CLEANUP.items():
        if rule.get("diagnostic"):
            continue
        part = tail_cleanup(records, name).withColumn("cleanup", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def clock_bucket() -> Column:
    return F.coalesce(hhmm("entry_time"), F.lit("unknown"))


def position_size(threshold, policy) -> Column:
    """Size multiplier by sizing policy; both arguments may be columns."""
    p, t = num0("probability"), c(threshold) if not isinstance(threshold, float) else F.lit(threshold)
    name = policy if isinstance(policy, Column) else F.lit(policy)
    edge = clip((p - t) / F.greatest(1.0 - t, F.lit(1e-9)), 0.0, 1.0)
    rules = []
    for key, spec in SIZING.items():
        if spec[0] == "linear":
            lo, hi = spec[1:]
            v = F.when(t >= 1.0, F.lit(lo)).otherwise(lo + (hi - lo) * edge)
        elif spec[0] == "tiered":
            lo, mid, hi, off = spec[1:]
            v = ladder([(p >= F.least(F.lit(1.0), t + off), hi), (p >= F.least(F.lit(1.0), t + off / 2), mid)], lo)
        elif spec[0] == "kelly":
            lo, hi, part = spec[1:]
            v = F.when(t >= 1.0, F.lit(lo)).otherwise(clip(hi * part * edge, lo, hi))
        else:
            v = F.lit(1.0)
        rules.append((name == key, v))
    return F.when(p < t, 0.0).otherwise(ladder(rules, 1.0))


def allow_signal(policy) -> Column:
    """Regime throttle: may the signal trade at all?"""
    name = policy if isinstance(policy, Column) else F.lit(policy)
    rules = []
    for key, (max_vol, min_trend) in THROTTLE.items():
        ok = F.lit(True)
        if max_vol is not None:
            ok = ok & (num0("reg_high_vol_state") <= max_vol)
        if min_trend is not None:
            ok = ok & (num0("reg_trending_state") >= min_trend)
        rules.append((name == key, ok))
    return ladder(rules, True)


def regime_multiplier(policy) -> Column:
    """Size multiplier for good / ambiguous / bad regimes."""
    name = policy if isinstance(policy, Column) else F.lit(policy)
    vol, trend = num0("reg_high_vol_state") >= 1.0, num0("reg_trending_state") >= 1.0
    rules = []
    for key, sizes in REGIME_SIZE.items():
        rules.append(
            (name == key, F.lit(1.0) if sizes is None else ladder([(trend & ~vol, sizes[0]), (trend | ~vol, sizes[1])], sizes[2]))
        )
    return ladder(rules, 1.0)


def missing_policy_inputs(records: DataFrame, cols: list[str]) -> DataFrame:
    """How many records lack each gate input (they are silently gated as 0)."""
    wide = records.agg(*[F.count(F.when(F.col(x).isNull(), 1)).alias(x) for x in cols])
    return wide.unpivot([], cols, "input", "missing")
