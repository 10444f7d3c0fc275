"""Bounds and scores of the market state on blocks of columns."""

import math
import random

import numpy as np
import pytest

from barloom.functions.stats import column_quantiles
from barloom.operators import market_state as MS

NAN = float("nan")


def test_column_quantiles_equal_sorted_rows(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1e3), float(rng.randrange(4)), rng.choice([None, -0.0, 0.0, 2.5, 1e-300]), None, rng.choice([1.0, 2.0, 3.0])) for _ in range(4001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    got = column_quantiles(df, ["a", "b", "c", "d", "e"], {"lo": 0.05, "mid": 0.5, "hi": 0.95})
    assert "d" not in got
    for i, c in enumerate("abc"):
        x = [r[i] for r in rows if r[i] is not None]
        for name, p in (("lo", 0.05), ("mid", 0.5), ("hi", 0.95)):
            assert got[c][name] == pytest.approx(np.quantile(x, p))


def test_bounds_take_nan_as_the_largest_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(NAN,)] * 4, "x double").repartition(3)
    lo, hi = MS.bounds(df, ["x"])["x"]
    assert (lo, hi) == (pytest.approx(1 + 103 * 0.05), pytest.approx(1 + 103 * 0.95))


def test_scores_keep_columns_types_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, 2.0, None), ("b", 5, NAN, None), ("c", 9, 4.0, 7.0)], "k string, x int, y double, z double")
    out = MS.with_scores(df, ({"y": (["y"], []), "s": (["x", "y"], ["y"]), "none": (["no_such"], [])}, {"x": (1.0, 9.0), "y": (2.0, 2.0)}))
    assert out.columns == ["k", "x", "y", "z", "s", "none"]
    rows = {r["k"]: r for r in out.collect()}
    assert [rows[k]["x"] for k in "abc"] == [1, 5, 9] and rows["c"]["z"] == 7.0 and rows["a"]["z"] is None
    assert [rows[k]["y"] for k in "abc"] == [0.5, None, 0.5]
    assert [rows[k]["s"] for k in "abc"] == [0.25, 0.5, 0.75] and all(rows[k]["none"] is None for k in "abc")
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows.values() for v in r)
