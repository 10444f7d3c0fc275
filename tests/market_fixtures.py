"""Shared names of the market tests: the short clock, random sessions, bar frames."""

import os
import random

from barloom.schemas import SessionSpec

SPEC = SessionSpec()
SF_DIR = os.environ.get("BARLOOM_TEST_DIR", "/root/testdata/sf0.001")


def random_session(rng: random.Random, symbol: str, day: str, minutes: int = 60, drop: float = 0.1):
    """A random walk on a 30-second grid with gaps and ties."""
    rows, price = [], 100.0
    for i in range(minutes * 2):
        if i > 1 and rng.random() < drop:
            continue
        o = price
        steps = [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) for _ in range(4)]
        path = [o]
        for s in steps:
            path.append(path[-1] + s)
        price = path[-1]
        rows.append(dict(symbol=symbol, day=day, sod=34200 + 30 * i, open=o, high=max(path), low=min(path),
                         close=price, volume=float(rng.randint(1, 50))))
    return rows


def bars_frame(spark, rows):
    from pyspark.sql import functions as F

    from barloom.functions.columns import at

    df = spark.createDataFrame(
        [(r["symbol"], r["day"], r["sod"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in rows],
        "symbol string, day string, sod int, open double, high double, low double, close double, volume double",
    )
    return df.withColumn("session_date", F.to_date("day")).drop("day").withColumn("ts", at("session_date", "sod"))
