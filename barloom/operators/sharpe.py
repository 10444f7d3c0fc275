"""Sharpe, probabilistic and deflated Sharpe over tables of trials."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.columns import c
from barloom.functions.stats import normal_cdf, sharpe, standardized_moment

# fixed value: Euler-Mascheroni constant to the digits used
GAMMA = 0.5772156649


def sharpe_table(returns: DataFrame, by: list[str], pnl: str) -> DataFrame:
    """Observed Sharpe, observation count, skew and kurtosis per group."""
    return returns.groupBy(*by).agg(
        F.count(pnl).alias("n_obs"),
        sharpe(pnl).alias("observed_sharpe"),
        standardized_moment(pnl, 3, 3, 0.0).alias("skew"),
        standardized_moment(pnl, 4, 4, 3.0).alias("kurtosis"),
    )


def max_sharpe_factor(n_trials: int) -> float:
    """Expected maximum of ``n_trials`` standard normals (driver-side constant)."""
    if n_trials <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    inside = lambda q: min(1 - 1e-12, max(1e-12, q))
    return (1 - GAMMA) * inv(inside(1 - 1 / n_trials)) + GAMMA * inv(inside(1 - 1 / (n_trials * 2.718281828459045)))


def psr(observed, benchmark, n_obs, skew=0.0, kurtosis=3.0) -> Column:
    """P(true Sharpe > benchmark); 0 below two observations."""
    sr, n = c(observed), c(n_obs).cast("double")
    sk = skew if isinstance(skew, Column) else F.lit(float(skew))
    ku = kurtosis if isinstance(kurtosis, Column) else F.lit(float(kurtosis))
    bm = benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))
    var = (1.0 - sk * sr + (ku - 1.0) / 4.0 * sr * sr) / F.greatest(n - 1, F.lit(1.0))
    z = (sr - bm) / F.sqrt(F.when(var > 0, var))
    return F.when((n > 1) & sr.isNotNull(), F.coalesce(normal_cdf(z), F.lit(0.0))).otherwise(F.lit(0.0))


def attach_dsr(trials: DataFrame, *, n_trials: int, batch: list[str] | None = None) -> DataFrame:
    """Deflated and probabilistic Sharpe of each trial of a batch.

    The dispersion is the sample std of the batch's observed Sharpes.  A batch
    is a handful of trial rows, so the window holds one row per trial.
    """
    w = W.partitionBy(*(batch or [F.lit(0)]))
    t = trials.withColumn("sr_std", F.coalesce(F.stddev_samp("observed_sharpe").over(w), F.lit(0.0)))
    bar = F.col("sr_std") * max_sharpe_factor(n_trials)
    t = t.withColumns(
        {
            "dsr_probability": F.when(F.col("sr_std") > 0, psr("observed_sharpe", bar, "n_obs")).otherwise(F.lit(0.0)),
            "psr_probability": psr("observed_sharpe", 0.0, "n_obs"),
            "n_trials": F.lit(n_trials),
        }
    )
    ok = (F.col("dsr_probability") >= 0.95) & (F.col("psr_probability") >= 0.95) & (F.coalesce("observed_sharpe", F.lit(0.0)) > 0)
    return t.withColumn("dsr_status", F.when(ok, "pass").otherwise("fail"))


def deflated_audit(returns: DataFrame, path_sharpes: DataFrame, *, pnl: str, n_trials: int, path_col: str = "sharpe_r") -> DataFrame:
    """One-row audit of a trade list against the dispersion of path Sharpes."""
    obs = sharpe_table(returns, [], pnl)
    disp = path_sharpes.filter(F.col(path_col).isNotNull()).agg(
        F.count(F.lit(1)).alias("n_paths"), F.stddev_samp(path_col).alias("sr_std")
    )
    k = max_sharpe_factor(max(n_trials, 1))
    j = obs.crossJoin(F.broadcast(disp))
    p = psr("observed_sharpe", F.col("sr_std") * k, "n_obs", F.col("skew"), F.col("kurtosis"))
    return j.select(
        "n_obs", "observed_sharpe", "skew", "kurtosis", "sr_std",
        F.lit(n_trials).alias("n_trials"),
        (F.col("observed_sharpe") - F.col("sr_std") * k).alias("deflated_sharpe"),
        p.alias("probability"),
    ).withColumn(
        "status",
        F.when(F.col("observed_sharpe").isNull() | (F.coalesce("sr_std", F.lit(0.0)) <= 0), "pending")
        .when((F.col("probability") >= 0.95) & (F.col("observed_sharpe") > 0), "pass")
        .otherwise("fail"),
    )
