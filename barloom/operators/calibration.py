"""Score buckets, calibration and single-feature ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.columns import share
from barloom.functions.scan import running
from barloom.functions.stats import rank_auc, unpivot_numeric


def _ranked(preds: DataFrame, by: list[str], key: str) -> DataFrame:
    """0-based rank by probability and group size, without one task per group."""
    r = running(preds, by, ["probability", key], {"__rank": ("count", F.lit(1))}).withColumn("__rank", F.col("__rank") - 1)
    n = preds.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    return r.join(n, by) if by else r.crossJoin(F.broadcast(n))


def _buckets(n: Column, lo: int, hi: int) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), F.floor(F.sqrt(n.cast("double")))))


def score_buckets(preds: DataFrame, by: list[str] | None = None, key: str = "candidate_id") -> DataFrame:
    """2 to 5 rank buckets: count, mean probability, hit rate, mean R."""
    by = by or []
    r = _ranked(preds, by, key).withColumn("q", _buckets(F.col("__n"), 2, 5))
    b = F.greatest(F.lit(0), F.ceil(F.col("__rank") * F.col("q") / F.greatest(F.col("__n") - 1, F.lit(1))) - 1)
    return r.groupBy(*by, b.cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("probability").alias("probability_mean"),
        F.avg("label").alias("positive_rate"),
        F.avg("pnl_r").alias("avg_pnl_r"),
    )


def bucket_monotonicity(buckets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """True when hit rates never fall from bucket to bucket (at least two)."""
    by = by or []
    w = W.partitionBy(*by).orderBy("probability_mean") if by else W.partitionBy(F.lit(0)).orderBy("probability_mean")
    b = buckets.withColumn("__prev", F.lag("positive_rate").over(w))
    return b.groupBy(*by).agg(
        F.count(F.lit(1)).alias("buckets"),
        (
            (F.count(F.lit(1)) >= 2)
            & F.coalesce(F.bool_and(F.col("positive_rate") >= F.col("__prev")), F.lit(True))
        ).alias("monotonic"),
    )


def uncertainty(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    return preds.groupBy(*(by or [])).agg(
        F.avg("probability").alias("probability_mean"),
        F.coalesce(F.stddev_pop("probability"), F.lit(0.0)).alias("probability_std"),
        share(F.col("probability") >= 0.7).alias("high_confidence_share"),
        share(F.col("probability") <= 0.3).alias("low_confidence_share"),
    )


def reliability_rows(preds: DataFrame, by: list[str] | None = None, key: str = "candidate_id") -> DataFrame:
    """3 to 10 equal-count buckets: predicted against observed rate."""
    by = by or []
    r = _ranked(preds, by, key).withColumn("q", _buckets(F.col("__n"), 3, 10))
    b = F.least(F.col("q") - 1, F.floor(F.col("__rank") * F.col("q") / F.greatest(F.col("__n"), F.lit(1))))
    g = r.groupBy(*by, b.cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("probability").alias("probability_mean"), F.avg("label").alias("hit_rate")
    )
    return g.withColumn("abs_gap", F.abs(F.col("probability_mean") - F.col("hit_rate")))


def calibration_review(preds: DataFrame, by: list[str] | None = None, key: str = "candidate_id", limit: float = 0.08) -> DataFrame:
    """Expected calibration error and the Brier decomposition."""
    by = by or []
    rows = reliability_rows(preds, by, key)
    whole = preds.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg("label").alias("base_rate"))
    j = rows.join(whole, by) if by else rows.crossJoin(F.broadcast(whole))
    w = F.col("count") / F.col("rows")
    gap, res = F.col("probability_mean") - F.col("hit_rate"), F.col("hit_rate") - F.col("base_rate")
    g = j.groupBy(*by).agg(
        F.max("rows").alias("rows"),
        F.sum(w * F.col("abs_gap")).alias("ece"),
        (F.max("base_rate") * (1.0 - F.max("base_rate"))).alias("uncertainty"),
        F.sum(w * gap * gap).alias("reliability"),
        F.sum(w * res * res).alias("resolution"),
    )
    return g.withColumn("status", F.when(F.col("ece") <= limit, "pass").otherwise("fail"))


def feature_validation(rows: DataFrame, cols: list[str], label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Missing rate, distinct count and label correlation of every feature.

    Distinct values are counted from (feature, value) pairs that are already
    combined map-side, never from a per-group set.
    """
    by = by or []
    long = unpivot_numeric(rows, [*by, label], cols)
    pairs = long.groupBy(*by, "feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("y"),
        F.sum(F.col(label).cast("double") * F.col(label)).alias("yy"), F.count(label).alias("ny"),
    )
    v, n, y = F.col("value"), F.col("n").cast("double"), F.col("y")
    has = v.isNotNull()
    s = lambda x: F.sum(F.when(has, x))
    g = pairs.groupBy(*by, "feature").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(~has, F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("unique_count"),
        s(n).alias("m"), s(n * v).alias("sx"), s(n * v * v).alias("sxx"), s(y).alias("sy"), s(F.col("yy")).alias("syy"),
        s(v * y).alias("sxy"), F.min("value").alias("lo"), F.max("value").alias("hi"),
    )
    cov = F.col("m") * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = F.col("m") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("m") * F.col("syy") - F.col("sy") * F.col("sy")
    corr = F.when((F.col("hi") > F.col("lo")) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    return g.select(
        *by, "feature",
        (F.col("missing") / F.col("rows")).alias("missing_rate"),
        "unique_count",
        corr.alias("label_corr"),
        (F.col("unique_count") <= 1).alias("is_constant"),
    )


def top_correlated(validation: DataFrame, k: int = 15) -> DataFrame:
    return validation.filter(F.col("label_corr").isNotNull()).orderBy(F.abs(F.col("label_corr")).desc(), "feature").limit(k)


def single_feature_auc(split: DataFrame, cols: list[str], label: str = "label") -> DataFrame:
    """Holdout AUC of each feature, oriented by its training correlation.

    A one-feature logistic model is monotone in the feature, so its ranking is
    the feature's own ranking, turned over when the training slope is negative.
    Missing values take the training median, as the model's imputer would.
    """
    from barloom.functions.stats import exact_quantiles

    long = unpivot_numeric(split, ["role", label], cols)
    train = long.filter(F.col("role") == "train")
    med = exact_quantiles(train, ["feature"], "value", {"median": 0.5})
    filled = long.join(F.broadcast(med), "feature").withColumn("value", F.coalesce("value", "median"))
    slope = filled.filter(F.col("role") == "train").groupBy("feature").agg(
        F.covar_pop("value", F.col(label).cast("double")).alias("slope")
    )
    auc = rank_auc(filled.filter(F.col("role") == "test"), "value", label, ["feature"])
    return auc.join(slope, "feature").select(
        "feature",
        F.when(F.col("slope") < 0, 1.0 - F.col("roc_auc")).otherwise(F.col("roc_auc")).alias("single_feature_roc_auc"),
    )


def regime_ic(preds: DataFrame, gap: str = "prior_close_gap", minimum: int = 5) -> DataFrame:
    """Correlation of probability and label on gap-up and gap-down sessions.

    Regimes with too few rows or a single class are left out.
    """
    regime = F.when(F.col(gap) > 0, "gap_up").when(F.col(gap) < 0, "gap_down")
    g = preds.withColumn("regime", regime).filter(F.col("regime").isNotNull()).groupBy("regime").agg(
        F.count(F.lit(1)).alias("count"),
        F.corr("probability", F.col("label").cast("double")).alias("conditional_ic"),
        F.avg("pnl_r").alias("avg_pnl_r"),
        F.min("label").alias("__lo"),
        F.max("label").alias("__hi"),
    )
    return g.filter((F.col("count") >= minimum) & (F.col("__hi") > F.col("__lo"))).drop("__lo", "__hi")


def cross_model(folds: DataFrame, limit: float = 0.55) -> DataFrame:
    """Per model family: mean and spread of fold AUC, advancement."""
    g = folds.groupBy("model_family").agg(
        F.count(F.lit(1)).alias("fold_count"), F.avg("roc_auc").alias("roc_auc_mean"),
        F.coalesce(F.stddev_pop("roc_auc"), F.lit(0.0)).alias("roc_auc_std"),
    )
    return g.withColumn(
        "advancement_recommendation",
        F.when(F.col("roc_auc_mean") >= limit, "advance_to_signal_stage").otherwise("freeze"),
    )
