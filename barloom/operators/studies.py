"""Studies that refit: label settings, feature families, subtypes and universes.

A study is a table of rows keyed by ``variant``; a variant has rows, labels,
folds and feature columns of its own.  All variants and folds are fitted in one
job, and one backtest runs keyed by variant and threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.columns import fan_out, num0
from barloom.functions.scan import running
from barloom.operators.backtest import Fill, run_backtest, sized_signals, utility
from barloom.operators.many_fits import fit_many, predict_many
from barloom.operators.models import split_metrics
from barloom.operators.splits import fold_spans
from barloom.session import cut


def _variants(rows: DataFrame, variant: str) -> list[str]:
    return [r[0] for r in rows.select(variant).distinct().orderBy(variant).collect()]  # configured values


def _placed(rows: DataFrame, names: list[str], variant: str) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col(variant)).cast("int") - 1


def _both_labels(preds: DataFrame, by: list[str], label: str) -> DataFrame:
    both = preds.groupBy(*by).agg(F.countDistinct(label).alias("n")).filter("n > 1").select(*by)
    return preds.join(both, by, "left_semi")


def walk_forward_study(rows: DataFrame, cols: list[str], *, variant: str = "variant", uses: dict[str, set[str]] | None = None, label: str = "label",
                       min_train: int = 10, test: int = 5, embargo_seconds: int = 60) -> DataFrame:
    """Stitched out-of-sample predictions: test rows with ``fold``, ``probability``, ``prediction``.

    ``uses`` names the columns of each variant, all by default.  Folds without
    both labels in training or test have none.
    """
    names = _variants(rows, variant)
    keep = [c for c in rows.columns if c not in ("probability", "prediction", "fold")]
    spans = cut(fold_spans(rows.select(*keep), min_train=min_train, test=test, embargo_seconds=embargo_seconds, by=[variant]))
    folds = spans.agg(F.max("spans.train.hi")).first()[0] or 0
    base = _placed(spans, names, variant) * folds - 1
    span = lambda n: F.array(F.struct((base + F.col(f"spans.{n}.lo")).alias("lo"), (base + F.col(f"spans.{n}.hi")).alias("hi")))
    table = cut(spans.select(*keep, span("train").alias("train"), span("test").alias("test")))
    fits = fit_many(table, cols, [str(f + 1) for _ in names for f in range(folds)], label=label, uses=[uses[v] for v in names for _ in range(folds)] if uses else None)
    preds = predict_many(table.drop("train"), fits, name="fold").withColumn("fold", F.col("fold").cast("int"))
    return _both_labels(cut(preds), [variant, "fold"], label)


def refit_study(rows: DataFrame, preds: DataFrame, thresholds: DataFrame, *, variant: str = "variant", minimum: float = 0.55, fill: Fill = Fill()) -> DataFrame:
    """One row per variant and threshold: candidates, walk-forward AUC and status, backtest, utility, rank."""
    counts = rows.groupBy(variant).agg(F.count(F.lit(1)).alias("candidate_count"))
    folds = split_metrics(preds, by=[variant, "fold"]).groupBy(variant).agg(F.count("roc_auc").alias("fold_count"), F.avg("roc_auc").alias("walk_forward_mean_roc_auc"))
    status = F.when(F.coalesce("fold_count", F.lit(0)) < 2, "pending").when(F.col("walk_forward_mean_roc_auc") >= minimum, "pass").otherwise("fail")
    run = [variant, "threshold"]
    book = run_backtest(sized_signals(fan_out(preds, thresholds), threshold="threshold", fill=fill), run)[1]
    head = fan_out(counts.join(folds, variant, "left"), thresholds).withColumn("walk_forward_status", status)
    zero = [num0(c).alias(c) for c in ("total_pnl_r", "avg_trade_r", "win_rate", "max_drawdown_r")]
    out = head.join(book, run, "left").select(
        *run, "candidate_count", "walk_forward_status", "walk_forward_mean_roc_auc", F.coalesce("signal_count", F.lit(0)).alias("signal_count"),
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"), *zero, F.when(F.coalesce("trade_count", F.lit(0)) > 0, utility()).alias("utility_score"))
    # one row per configured variant and threshold is ranked here
    order = W.orderBy(F.col("utility_score").desc_nulls_last(), F.col("total_pnl_r").desc(), F.col("avg_trade_r").desc(), *run)
    return out.withColumn("rank", F.row_number().over(order))


def holdout_study(rows: DataFrame, cols: list[str], *, variant: str = "variant", share: float = 0.7, label: str = "label", key: str = "candidate_id") -> DataFrame:
    """Predictions on the last rows of every variant by a fit on its first ``share``, in (session, id) order."""
    names = _variants(rows, variant)
    keep = [c for c in rows.columns if c not in ("probability", "prediction")]
    order = running(rows.select(*keep), [variant], ["session_date", key], {"__n": ("count", F.lit(1))})
    total = rows.groupBy(variant).agg(F.greatest(F.floor(F.count(F.lit(1)) * share), F.lit(1)).alias("__first"))
    at = _placed(rows, names, variant)
    here = lambda rule: F.filter(F.array(F.when(rule, F.struct(at.alias("lo"), at.alias("hi")))), lambda s: s.isNotNull())
    # one row per configured variant
    table = order.join(F.broadcast(total), variant).select(*keep, here(F.col("__n") <= F.col("__first")).alias("train"), here(F.col("__n") > F.col("__first")).alias("test"))
    table = cut(table)
    preds = predict_many(table.drop("train"), fit_many(table, cols, names, label=label), name="__fit").drop("__fit")
    return _both_labels(cut(preds), [variant], label)


def variant_metrics(rows: DataFrame, preds: DataFrame, variant: str = "variant") -> DataFrame:
    """Label summary of all rows and the holdout's metrics per variant, ranked by (AUC, mean R, rows)."""
    labels = rows.groupBy(variant).agg(F.count(F.lit(1)).alias("candidate_count"), F.avg("label").alias("positive_rate"), F.avg("pnl_r").alias("avg_pnl_r"))
    scores = split_metrics(preds, by=[variant]).select(variant, F.col("rows").alias("test_rows"), "roc_auc", "precision", "recall", "brier")
    order = W.orderBy(F.coalesce("roc_auc", F.lit(0.0)).desc(), F.col("avg_pnl_r").desc(), F.col("candidate_count").desc(), variant)
    return labels.join(scores, variant, "left").withColumn("rank", F.row_number().over(order))
