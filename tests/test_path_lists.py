"""Paths and their backtests from rows that are stored once, whatever the number of paths."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from barloom.functions import scan
from barloom.functions.intervals import non_overlapping, non_overlapping_lists
from barloom.functions.stats import rank_auc
from barloom.operators import cpcv as CV
from barloom.operators import splits as S
from barloom.plans.tables import setups


def test_runs_in_lists_equal_runs_in_rows(spark):
    rng, t0 = random.Random(8), dt.datetime(2024, 1, 1)
    rows = [(f"k{i:05d}", t0 + dt.timedelta(seconds=a), t0 + dt.timedelta(seconds=a + rng.choice([0, 0, 1, 3, 8])), sorted(rng.sample(range(5), rng.randrange(5)))) for i in range(3000) for a in [rng.randrange(400)]]
    df = spark.createDataFrame(rows, "key string, a timestamp_ntz, b timestamp_ntz, runs array<int>").repartition(7)
    got = non_overlapping_lists(df, runs="runs", name="run", entry="a", exit_="b", key="key")
    assert got.columns == ["key", "a", "b", "run"]
    each = df.withColumn("run", F.explode("runs")).drop("runs")
    want = non_overlapping(each, run=["run"], entry="a", exit_="b", key="key")
    assert {(r["run"], r["key"]) for r in got.collect()} == {(r["run"], r["key"]) for r in want.collect()}
    assert non_overlapping_lists(df.limit(0), runs="runs", name="run", entry="a", exit_="b", key="key").count() == 0


def test_spans_do_not_shuffle_whole_rows(spark, monkeypatch):
    seen, plain = [], scan.running
    monkeypatch.setattr(S, "running", lambda rows, *a, **k: seen.append(rows.columns) or plain(rows, *a, **k))
    rows = setups(spark, "/root/testdata/sf0.001").withColumn("entry_time", F.when(F.col("trade_no") % 50 > 0, F.col("entry_time")))
    paths = S.cpcv_paths(spark, 6)
    got = S.cpcv_spans(rows, paths, 6, embargo_bars=2)
    assert all("pnl_r" not in columns for columns in seen)
    names = CV.path_names(paths)
    spans = {(r["candidate_id"], names[s["lo"]], role) for r in got.collect() for role in ("train", "test") for s in r[role]}
    monkeypatch.undo()
    assert spans == {(r["candidate_id"], r["path_id"], r["role"]) for r in S.cpcv_rows(rows, paths, 6, embargo_bars=2).collect() if r["role"] != "purged"}


def test_path_results_need_no_row_per_path(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(CV, "packed", lambda df: stored.append(df) or df)
    rows = setups(spark, "/root/testdata/sf0.001")
    features = ["break_body_fraction", "reg_vol_10"]
    lists, names = CV.cpcv_lists(rows.select("candidate_id", "session_date", "direction", "entry_time", "exit_time", "entry_price", "exit_price", "stop_price", "pnl_r", "label",
                                             "reg_high_vol_state", "reg_trending_state", *features), features, n_groups=6)
    executed, out = CV.path_backtests(lists, names)
    assert stored[0].count() == rows.count() and len(names) == 15
    each = CV.each_fit(lists, "path_id", names).filter("probability >= 0.45")
    want = non_overlapping(each, run=["path_id"], entry="entry_time", exit_="exit_time", key="candidate_id")
    assert {(r["path_id"], r["candidate_id"]) for r in executed.collect()} == {(r["path_id"], r["candidate_id"]) for r in want.collect()}
    counts = {r["path_id"]: r["count"] for r in CV.each_fit(lists, "path_id", names).groupBy("path_id").count().collect()}
    assert {r["path_id"]: r["test_rows"] for r in out.collect()} == counts


def test_auc_with_nulls_ties_and_no_number(spark):
    g = np.random.default_rng(4)
    x, y, k = np.round(g.normal(0, 2, 900), 1), g.integers(0, 2, 900), g.integers(0, 3, 900)
    x[::97] = np.nan
    data = [(None if c == 2 else int(c), float(a), int(b)) for a, b, c in zip(x, y, k)] + [(0, None, 1), (1, 2.0, None)]
    df = spark.createDataFrame(data, "k int, x double, y int").repartition(6)
    got = {r["k"]: (r["positives"], r["negatives"], r["roc_auc"]) for r in rank_auc(df, "x", "y", ["k"]).collect()}
    for c in range(3):
        a, b = np.nan_to_num(x[k == c], nan=1e9), y[k == c]
        pos, neg = a[b == 1], a[b == 0]
        want = np.mean([(v > neg).mean() + 0.5 * (v == neg).mean() for v in pos])
        found = got[None if c == 2 else c]
        assert found[:2] == (len(pos), len(neg)) and abs(found[2] - want) < 1e-12
