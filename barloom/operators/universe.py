"""Candidate universe: named definitions, lineage, de-duplication, support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.columns import iso, ladder
from barloom.operators.candidates import finalize, reclaim_candidates, with_subtype
from barloom.operators.zones import opening_zones
from barloom.schemas import SESSION_KEY, SessionSpec
from barloom.session import cut

BASELINE = "first_reclaim_only_baseline"

# fixed values: universe definitions
# (name, break mode, zone, latest trigger: "morning" or "session", cap per direction)
VARIANTS = [
    ("first_reclaim_only_baseline", "close", "opening", "morning", 1),
    ("multiple_reclaim_attempts", "close", "opening", "morning", 3),
    ("allow_wick_through_breaks", "wick", "opening", "morning", 1),
    ("allow_delayed_reclaim", "close", "opening", "session", 1),
    ("allow_post_failed_break_repair", "wick_failed_close", "opening", "session", 2),
    ("allow_multiple_same_direction_candidates", "close", "opening", "session", 5),
    ("allow_midday_continuation_structure", "close", "opening", "session", 3),
    ("extended_structure_zone", "close", "extended", "session", 2),
]


def variants(spark: SparkSession, spec: SessionSpec, extended: SessionSpec, names: list[str] | None = None) -> DataFrame:
    """The configured definitions as a table (eight rows).

    ``names`` keeps a subset; the baseline is always part of it.  Names that
    match nothing keep the full list.
    """
    known = [v[0] for v in VARIANTS]
    wanted = [n for n in known if n in set(names or [])] or known
    if BASELINE not in wanted:
        wanted.insert(0, BASELINE)
    rows = [
        (i + 1, n, mode, zone, (extended if zone == "extended" else spec).earliest,
         spec.latest if until == "morning" else spec.session_end, cap)
        for i, (n, mode, zone, until, cap) in enumerate(v for v in VARIANTS if v[0] in wanted)
    ]
    return spark.createDataFrame(
        rows, "trial int, variant string, break_mode string, zone_mode string, earliest_sod int, latest_sod int, cap int"
    )


def variant_zones(bars: DataFrame, spec: SessionSpec, extended: SessionSpec) -> DataFrame:
    """Zones of every mode, tagged with ``zone_mode``."""
    return (
        opening_zones(bars, spec).withColumn("zone_mode", F.lit("opening"))
        .unionByName(opening_zones(bars, extended).withColumn("zone_mode", F.lit("extended")))
    )


def universe_candidates(
    bars: DataFrame, spec: SessionSpec, extended: SessionSpec, *, names: list[str] | None = None, buffer: float = 0.0
) -> DataFrame:
    """Candidates of every definition in one job, keyed by ``variant``."""
    z = variant_zones(bars, spec, extended)
    v = variants(bars.sparkSession, spec, extended, names)
    rules = z.join(F.broadcast(v), "zone_mode").withColumn("buffer", F.lit(float(buffer)))
    found = reclaim_candidates(bars, rules, spec, extra=["variant", "zone_mode"], dedup=True)
    return with_subtype(finalize(found, z, spec, ["zone_mode"]))


def lineage(cands: DataFrame) -> DataFrame:
    """Lineage key, de-duplication key and attribution of each candidate."""
    day = F.col("session_date").cast("string")
    decided = iso("session_date", "decision_sod")
    return cands.withColumns(
        {
            "candidate_family": F.lit("candidate_universe_expansion"),
            "lineage_key": F.concat_ws("|", "symbol", day, "direction", iso("session_date", "break_sod"), decided),
            "dedup_key": F.concat_ws("|", day, "direction", decided, F.format_string("%.2f", "entry_price")),
        }
    )


def deduplicate(records: DataFrame, by: list[str]) -> DataFrame:
    """First record per de-duplication key (earliest break, then identity)."""
    first = F.min_by(F.struct(*records.columns), F.struct("break_sod", "candidate_id"))
    return records.groupBy(*by, "dedup_key").agg(first.alias("__r")).select("__r.*")


def dedup_summary(records: DataFrame, by: list[str]) -> DataFrame:
    """Raw, kept and duplicate counts; clusters are counted before the roll-up."""
    per = records.groupBy(*by, "dedup_key").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(
        F.sum("n").alias("raw_count"),
        F.count(F.lit(1)).alias("deduped_count"),
        F.sum(F.col("n") - 1).alias("duplicate_count"),
        F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_cluster_count"),
        (F.sum(F.col("n") - 1) / F.greatest(F.sum("n"), F.lit(1))).alias("duplicate_ratio"),
    )


def effective_sample_size(records: DataFrame, by: list[str]) -> DataFrame:
    """Cluster-adjusted support: every cluster of correlated rows counts once."""
    per = records.groupBy(*by, "session_date", "direction").agg(F.count(F.lit(1)).alias("n"))
    sess = per.groupBy(*by, "session_date").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("dirs"), F.max("n").alias("biggest_side"),
    )
    return sess.groupBy(*by).agg(
        F.sum("n").alias("raw_n"),
        F.count(F.lit(1)).cast("double").alias("session_cluster_ess"),
        F.sum("dirs").cast("double").alias("session_direction_cluster_ess"),
        F.avg("n").alias("avg_cluster_size_session"),
        (F.sum("n") / F.sum("dirs")).alias("avg_cluster_size_session_direction"),
        F.max("n").alias("max_candidates_per_session"),
    )


def compare_to_baseline(records: DataFrame) -> DataFrame:
    """Per variant: keys new against the baseline and keys shared with it."""
    keys = records.select("variant", "dedup_key").distinct()
    base = keys.filter(F.col("variant") == BASELINE).select("dedup_key", F.lit(1).alias("__in"))
    return keys.join(base, "dedup_key", "left").groupBy("variant").agg(
        F.count(F.when(F.col("__in").isNull(), 1)).alias("new_deduped_candidates_vs_baseline"),
        F.count("__in").alias("overlap_with_baseline"),
    )


def governance_decision() -> Column:
    """Rule ladder over support columns of one variant."""
    return ladder(
        [
            (F.col("candidate_count") == 0, "reject_no_support"),
            (F.col("duplicate_ratio") > 0.35, "reject_duplicate_risk"),
            (F.col("session_direction_cluster_ess") < 0.60 * F.col("candidate_count"), "diagnostic_only_correlated_candidates"),
        ],
        "eligible_for_labeling_diagnostic",
    )


def universe_summary(cands: DataFrame, all_variants: DataFrame) -> DataFrame:
    """One row per definition: counts, duplicates, support, decision."""
    rec = cut(lineage(cands))  # a few rows per session, read by five aggregates
    kept = deduplicate(rec, ["variant"])
    counts = kept.groupBy("variant").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count(F.when(F.col("direction") == "long", 1)).alias("long_count"),
        F.count(F.when(F.col("direction") == "short", 1)).alias("short_count"),
    )
    out = (
        all_variants.select("trial", "variant")
        .join(counts, "variant", "left")
        .join(dedup_summary(rec, ["variant"]), "variant", "left")
        .join(effective_sample_size(kept, ["variant"]), "variant", "left")
        .join(compare_to_baseline(kept), "variant", "left")
    )
    zeros = [x for x in out.columns if x not in ("variant", "trial")]
    out = out.fillna(0, zeros)
    base = F.max(F.when(F.col("variant") == BASELINE, F.col("candidate_count"))).over(W.partitionBy(F.lit(0)))
    return out.select(
        F.format_string("candidate-universe-%03d", "trial").alias("trial_id"),
        "variant",
        "candidate_count",
        F.col("raw_count").alias("raw_candidate_count"),
        (F.col("candidate_count") - base).alias("candidate_count_delta_vs_baseline"),
        "new_deduped_candidates_vs_baseline",
        "overlap_with_baseline",
        F.col("session_cluster_ess").cast("bigint").alias("session_count"),
        F.coalesce(F.col("candidate_count") / F.nullif(F.col("session_cluster_ess"), F.lit(0.0)), F.lit(0.0)).alias("avg_candidates_per_session"),
        "max_candidates_per_session",
        "long_count",
        "short_count",
        "duplicate_count",
        "duplicate_cluster_count",
        "duplicate_ratio",
        "session_direction_cluster_ess",
        governance_decision().alias("governance_decision"),
    )


def select_next_stage(summary: DataFrame, k: int = 3) -> DataFrame:
    """Best-supported eligible definitions."""
    return (
        summary.filter(F.col("governance_decision") == "eligible_for_labeling_diagnostic")
        .orderBy(F.col("session_direction_cluster_ess").desc(), F.col("new_deduped_candidates_vs_baseline").desc(), "trial_id")
        .limit(k)
        .select("variant", "candidate_count", "session_direction_cluster_ess")
    )


def delta_vs_baseline(cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates to compute anew and, per variant, how many can be reused.

    A candidate found by several definitions has one label and one feature
    row; only the distinct ones are computed and every variant joins to them.
    """
    zone_key = ["candidate_id", "zone_mode"]
    distinct = cands.dropDuplicates(zone_key)
    base = cands.filter(F.col("variant") == BASELINE).select("candidate_id", F.lit(1).alias("__in")).distinct()
    counts = (
        cands.select("variant", "candidate_id").distinct().join(base, "candidate_id", "left")
        .groupBy("variant")
        .agg(
            F.count("__in").alias("reused_candidate_count"),
            F.count(F.when(F.col("__in").isNull(), 1)).alias("new_candidate_count"),
        )
    )
    return distinct, counts


def labeling_diagnostic(labels: DataFrame, auc: DataFrame | None = None) -> DataFrame:
    """Per variant: rows, positive rate, mean R, ranked by (AUC, R, rows)."""
    per = labels.groupBy("variant").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.avg("label").alias("positive_rate"),
        F.avg("pnl_r").alias("avg_pnl_r"),
    )
    if auc is not None:
        per = per.join(auc.select("variant", "roc_auc"), "variant", "left")
    else:
        per = per.withColumn("roc_auc", F.lit(None).cast("double"))
    order = W.orderBy(
        F.coalesce("roc_auc", F.lit(0.0)).desc(), F.col("avg_pnl_r").desc(), F.col("candidate_count").desc(), "variant"
    )
    # at most one row per configured definition is ranked here
    return per.withColumn("rank", F.row_number().over(order))


def session_key_of(df: DataFrame) -> DataFrame:
    return df.select(*SESSION_KEY).distinct()
