"""Anchors are carried once per time and windows once per bar, not per trade; path rows are stored once."""

import datetime as dt

from barloom.operators import matching as M
from barloom.plans import source_queries
from barloom.schemas import SESSION_KEY

DAY = dt.date(2024, 1, 2)


def test_trades_of_one_time_share_an_anchor(spark):
    bars = spark.createDataFrame([("A", DAY, s, 1.0, 2.0, 0.5, 1.5, 3.0) for s in (100, 200, 300)], "symbol string, session_date date, sod int, open double, high double, low double, close double, volume double")
    rows = [("x", "A", DAY, 250), ("y", "A", DAY, 250), ("y", "A", DAY, 250), (None, "A", DAY, 50), ("n", "A", DAY, None), ("m", "A", DAY, -1), ("z", "B", DAY, 250)]
    trades = spark.createDataFrame(rows, "id string, symbol string, session_date date, sod int")
    at = M.align_to_bars(trades, bars, "id")
    assert at.columns == [*trades.columns, "anchor_sod"]
    # a trade listed twice stays two rows, and one without an id has its anchor
    assert sorted((str(r["id"]), r["anchor_sod"]) for r in at.collect() if r["symbol"] == "A") == [("None", 100), ("m", 100), ("n", 100), ("x", 200), ("y", 200), ("y", 200)]
    assert at.filter("symbol = 'B'").first()["anchor_sod"] is None
    want = M.sequences(M.context_windows(at.filter("id in ('x', 'm')"), bars, "id", before=1, after=1), "id")
    got = at.filter("id in ('x', 'm')").join(M.anchor_sequences(bars, before=1, after=1), [*SESSION_KEY, "anchor_sod"])
    assert {r["id"]: r["bars"] for r in got.collect()} == {r["id"]: r["bars"] for r in want.collect()}


def test_path_rows_are_stored_once(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(source_queries, "cut", lambda df: cuts.append(df) or df)
    assert source_queries.source_path_rows(spark, "/root/testdata/sf0.001").count() > 0
    assert not cuts
