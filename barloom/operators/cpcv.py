"""Combinatorial paths with a fit and a backtest each, and their audit.

One job fits all paths (``many_fits``), one gives every test row the
probabilities of the paths that test it, and one backtest runs for all paths.
Rows are stored once, whatever the number of paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import num0
from barloom.functions.intervals import non_overlapping_lists
from barloom.functions.stats import confusion, rank_auc, sharpe
from barloom.operators.backtest import SUMMARY_COLUMNS, equity_curve, largest_loss_cluster, results, sized_signals
from barloom.operators.many_fits import each_fit, fit_many, predict_lists
from barloom.operators.splits import cpcv_paths, cpcv_spans, path_rollup, session_ranks
from barloom.schemas import TRADE_REQUIRED
from barloom.session import cut, packed

#: Columns of predictions that are not dropped with the features.
KEPT = {*TRADE_REQUIRED, *SUMMARY_COLUMNS}
#: Sessions below which no audit is made.
LEAST_SESSIONS = 40


def group_count(sessions: int) -> int:
    """Number of session groups: one per twenty sessions, six to eight."""
    return min(8, max(6, sessions // 20))


def tested(spans: DataFrame, names: list[str], name: str = "path_id") -> DataFrame:
    """Rows once per path that tests them, as ``predict_many`` returns them, with what they hold already."""
    options = F.array(*[F.lit(n) for n in names])
    each = spans.withColumn("__f", F.explode(F.flatten(F.transform("test", lambda s: F.sequence(s["lo"], s["hi"])))))
    return each.withColumn(name, F.get(options, F.col("__f"))).drop("__f", "test", "train")


def given_lists(spans: DataFrame) -> DataFrame:
    """Rows once, as ``predict_lists`` returns them, with the probability they hold for every path that tests them."""
    numbers = F.flatten(F.transform("test", lambda s: F.sequence(s["lo"].cast("int"), s["hi"].cast("int"))))
    return spans.withColumn("__p", F.transform(numbers, lambda f: F.struct(f.alias("f"), F.col("probability").alias("p")))).drop("train", "test")


def diverse(preds: DataFrame, name: str = "path_id", label: str = "label") -> DataFrame:
    """Predictions of the paths whose test rows have both labels."""
    # one row per path
    both = cut(preds.groupBy(name).agg(F.min(label).alias("a"), F.max(label).alias("b")).filter("a < b").select(name))
    return preds.join(F.broadcast(both), name, "left_semi")


def path_names(paths: DataFrame) -> list[str]:
    """The paths by number; configuration."""
    return sorted(r["path_id"] for r in paths.collect())


def cpcv_lists(rows: DataFrame, cols: list[str], *, n_groups: int | None = None, limit: int | None = None, horizon: int = 20, embargo_bars: int = 0,
               per_group: bool = False, label: str = "label", key: str = "candidate_id") -> tuple[DataFrame, list[str]]:
    """Rows once with ``__p``, the out-of-sample probabilities of all paths that test them, and the names of the paths.

    A path without both labels in training has none.  Features are not among the
    columns that return; ``rows`` are read more than once.
    """
    n_groups = n_groups or group_count(session_ranks(rows).count())
    paths = cpcv_paths(rows.sparkSession, n_groups, limit=limit)
    names = path_names(paths)
    rows = rows.select(*[c for c in rows.columns if c not in ("probability", "prediction")])
    spans = cpcv_spans(rows, paths, n_groups, horizon=horizon, embargo_bars=embargo_bars, per_group=per_group, key=key)
    fits = fit_many(spans, cols, names, label=label)
    return packed(predict_lists(spans.drop("train", "session_group"), fits, drop=set(cols) - KEPT - {label, key})), names


def cpcv_predictions(rows: DataFrame, cols: list[str], *, label: str = "label", **how) -> DataFrame:
    """Out-of-sample predictions of every path: ``rows`` with ``path_id``, ``probability``, ``prediction``.

    As ``cpcv_lists``, once per path; a path without both labels in its test rows has none.
    """
    lists, names = cpcv_lists(rows, cols, label=label, **how)
    return diverse(each_fit(lists, "path_id", names), label=label)


def path_backtests(lists: DataFrame, names: list[str], *, threshold: float = 0.45, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(executed trades, one row per path): test rows, AUC, precision, trades, R, drawdown, Sharpe, loss cluster.

    ``lists`` holds every row once, with the probabilities of its paths in
    ``__p``.  A path without both labels in its test rows has no row.
    """
    name = F.get(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("__f")).alias("path_id")
    each = lists.select(label, F.explode("__p").alias("e")).select(label, F.col("e.f").alias("__f"), F.col("e.p").alias("probability"))
    ends = each.groupBy("__f").agg(F.count(F.lit(1)).alias("test_rows"), confusion("probability", label)["precision"].alias("precision"), F.min(label).alias("a"), F.max(label).alias("b"))
    scores = cut(ends.filter("a < b").join(rank_auc(each, "probability", label, ["__f"]), "__f", "left").select("__f", name, "test_rows", num0("roc_auc").alias("roc_auc"), "precision"))
    # a signal of fixed size has the same result in every path
    signal = lambda e: (e["p"] >= threshold) & (num0(e["p"]) >= threshold)
    signals = lists.withColumns({"probability": F.lit(float(threshold)), "__runs": F.transform(F.filter("__p", signal), lambda e: e["f"])})
    signals = sized_signals(signals, threshold=float(threshold)).filter((F.col("risk_points") > 0) & (F.col("size_multiplier") > 0))
    signals = signals.select("candidate_id", "entry_time", "exit_time", (F.col("gross_executed_pnl_r") * F.col("size_multiplier")).alias("executed_pnl_r"), "__runs")
    took = non_overlapping_lists(signals, runs="__runs", name="__f", entry="entry_time", exit_="exit_time", key="candidate_id")
    # one row per path
    took = took.join(F.broadcast(scores.select("__f", "path_id")), "__f").drop("__f")
    executed = cut(equity_curve(took, ["path_id"], "executed_pnl_r", ["entry_time", "candidate_id"]))
    trades = executed.groupBy("path_id").agg(*results(), sharpe("executed_pnl_r").alias("sharpe_r"))
    losses = largest_loss_cluster(executed, ["path_id"], "executed_pnl_r", ["entry_time", "candidate_id"])
    out = scores.drop("__f").join(trades, "path_id", "left").join(losses, "path_id", "left")
    return executed, out.fillna(0.0, ["total_pnl_r", "avg_trade_r", "win_rate", "max_drawdown_r", "largest_loss_cluster_r"]).fillna(0, ["trade_count"])


def cpcv_audit(paths: DataFrame) -> DataFrame:
    """The roll-up over paths with their mean AUC."""
    return path_rollup(paths).crossJoin(F.broadcast(paths.agg(F.avg("roc_auc").alias("mean_roc_auc"))))
