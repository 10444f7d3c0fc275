"""The single position among many trades at one entry, and what a backtest stores of its signals."""

import datetime as dt
import random

from pyspark.sql import functions as F

from barloom.functions.intervals import non_overlapping
from barloom.operators.backtest import SIGNAL_COLUMNS, run_backtest


def test_many_trades_at_one_entry_equal_plain_loop(spark):
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(f"r{i % 3}", f"k{i:05d}", t0 + dt.timedelta(seconds=a), t0 + dt.timedelta(seconds=a + rng.choice([0, 0, 1, 3, 8]))) for i in range(3000) for a in [rng.randrange(90)]]
    df = spark.createDataFrame(rows, "run string, key string, a timestamp_ntz, b timestamp_ntz").repartition(7)
    want, busy = set(), {}
    for run, key, a, b in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if run not in busy or a >= busy[run]:
            want.add((run, key))
            busy[run] = b
    got = non_overlapping(df, run=["run"], entry="a", exit_="b", key="key")
    assert {(r["run"], r["key"]) for r in got.collect()} == want


def test_backtest_keeps_only_what_its_summary_reads(spark):
    t = "timestamp_ntz'2024-01-01 10:00:00'"
    s = spark.range(5).select(
        F.lit("r").alias("run"), F.format_string("c%d", "id").alias("candidate_id"), F.expr("date'2024-01-01'").alias("session_date"),
        F.expr(f"{t} + make_dt_interval(0, 0, CAST(id AS INT), 0)").alias("entry_time"), F.expr(f"{t} + make_dt_interval(0, 0, CAST(id AS INT) + 2, 0)").alias("exit_time"),
        F.lit(True).alias("allowed"), *[F.lit(1.0).alias(c) for c in SIGNAL_COLUMNS[5:]], F.lit("x" * 50).alias("wide_feature"))
    trades, summary = run_backtest(s, ["run"])
    assert "wide_feature" not in trades.columns and trades.count() == 3
    row = summary.first()
    assert (row["trade_count"], row["total_pnl_r"], row["overlap_skips"]) == (3, 3.0, 2)
