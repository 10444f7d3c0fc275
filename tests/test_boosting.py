"""Boosted trees, bins and holdout roles against plain readings."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.stats import column_bins
from barloom.operators import boosting as B
from barloom.operators import models as ML
from barloom.operators import splits as S

COLS = ["a", "b", "c"]


def plain_trees(x, y, t, rounds, depth=4, rate=0.05):
    """Probabilities for ``t``: every split of every node is tried, row by row sums."""
    f, ft = (np.full(len(v), np.log(y.mean() / (1 - y.mean()))) for v in (x, t))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)

        def grow(rows, test, level):
            best = (0.0, None)
            if level < depth:
                for j in range(x.shape[1]):
                    values = np.unique(x[:, j])
                    for end in (values[:-1] + values[1:]) / 2:
                        left = rows & (x[:, j] <= end)
                        right = rows & ~left
                        if min(left.sum(), right.sum()) >= 20 and min(h[left].sum(), h[right].sum()) >= 1e-3:
                            gain = sum(g[s].sum() ** 2 / h[s].sum() for s in (left, right)) - g[rows].sum() ** 2 / h[rows].sum()
                            if gain > best[0] + 1e-9:
                                best = (gain, (j, end))
            if best[1] is None:
                step = -rate * g[rows].sum() / h[rows].sum()
                move[rows], moved[test] = step, step
                return
            j, end = best[1]
            grow(rows & (x[:, j] <= end), test & (t[:, j] <= end), level + 1)
            grow(rows & (x[:, j] > end), test & (t[:, j] > end), level + 1)

        move, moved = np.zeros(len(x)), np.zeros(len(t))
        grow(np.ones(len(x), bool), np.ones(len(t), bool), 0)
        f, ft = f + move, ft + moved
    return 1 / (1 + np.exp(-ft))


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(5)
    n = 700
    x = np.stack([g.integers(0, 23, n).astype(float), np.round(g.normal(size=n), 1), g.integers(0, 2, n) * 1e9 + g.integers(0, 3, n)], axis=1)
    y = (g.random(n) < 1 / (1 + np.exp(1.0 - 0.1 * x[:, 0] + x[:, 1] * (x[:, 2] > 5)))).astype(int)
    gap = g.random(n) < 0.1
    x[gap, 0] = np.nan
    data = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], int(y[i])) for i in range(n)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, label int").repartition(5)
    return df, np.where(np.isnan(x), np.nanmedian(x, axis=0), x), y


def test_boosted_trees_equal_plain_ones(rows):
    df, x, y = rows
    train = np.arange(len(x)) < 500
    model = ML.fit_classifier(df.filter("id < 500"), COLS, "gbm", rounds=12)
    # medians are of the training rows
    med = np.median(np.array([r["a"] for r in df.filter("id < 500 AND a IS NOT NULL").collect()]))
    gaps = [r["id"] for r in df.filter("a IS NULL").collect()]
    x = x.copy()
    x[gaps, 0] = med
    got = {r["id"]: (r["probability"], r["prediction"]) for r in ML.score(model, df, COLS).collect()}
    want = plain_trees(x[train], y[train], x, 12)
    assert len(got) == len(x) and max(abs(got[i][0] - want[i]) for i in got) < 1e-6
    assert all(p == int(v >= 0.5) for v, p in got.values())


def test_jobs_grow_the_trees_of_one_task(rows, monkeypatch):
    df, _, _ = rows
    here = B.fit_boosted(df, COLS, rounds=20)
    monkeypatch.setattr(B, "ONE_TASK", 0)
    jobs = B.fit_boosted(df.repartition(3), COLS, rounds=20)
    assert len(here.trees) == len(jobs.trees) == 20
    for a, b in zip(here.trees, jobs.trees):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all()


def test_all_rounds_of_few_rows_take_few_jobs(spark, rows):
    df, _, _ = rows
    spark.sparkContext.setJobGroup("boosted", "boosted")
    model = ML.fit_classifier(df, COLS, "gbm")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("boosted")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.trees) == 200 and 0 < len(jobs) < 60


def test_fits_without_rows_labels_or_values(rows):
    df, _, _ = rows
    assert {r["probability"] for r in ML.score(B.fit_boosted(df.limit(0), COLS), df, COLS).collect()} == {0.5}
    sure = B.fit_boosted(df.withColumn("label", F.lit(1)), COLS, rounds=3)
    assert min(r["probability"] for r in sure.score(df).collect()) > 0.999
    empty = B.fit_boosted(df.withColumn("a", F.lit(None).cast("double")), COLS, rounds=3)
    assert not any((t.feature[t.cut < 255] == 0).any() for t in empty.trees)


@pytest.mark.parametrize("seed, make", [
    (1, lambda g, n: g.integers(-120, 120, n).astype(float)),
    (2, lambda g, n: g.normal(size=n)),
    (3, lambda g, n: 1e9 + g.integers(0, 100_000, n) / 1000),
    (4, lambda g, n: np.where(g.random(n) < 0.6, 0.0, g.lognormal(0, 20, n))),
    (5, lambda g, n: np.full(n, 7.0)),
])
def test_bins_hold_one_value_or_an_equal_share(spark, seed, make):
    g = np.random.default_rng(seed)
    n = 20_000
    v = make(g, n)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)] * 1001, "v double").repartition(4)
    medians, (ends,) = column_bins(df, ["v"], 255, n + 1001)
    assert medians[0] == np.median(v)
    v = np.append(v, np.full(1001, medians[0]))
    values = np.unique(v)
    if len(values) <= 255:
        assert np.allclose(ends, (values[:-1] + values[1:]) / 2, rtol=1e-12)
        return
    assert (np.diff(ends) > 0).all() and 90 < len(ends) <= 254
    sizes = np.bincount(np.searchsorted(ends, v, side="left"))
    largest = np.unique(v, return_counts=True)[1].max()
    assert sizes.max() <= largest + 1.3 * len(v) / 255


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_roles_equal_those_of_the_numbered_split(spark, seed):
    rng = random.Random(seed)
    days = [None] * (seed % 2) + [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(4)]
    data = [(f"c{i:03d}", rng.choice(days if seed < 3 else days[-1:] * 5 + days)) for i in range(101)]
    df = spark.createDataFrame(data, "candidate_id string, session_date date").repartition(3)
    for share in (0.7, 0.005, 1.0):
        want = {(r["candidate_id"], r["role"]) for r in S.holdout_split(df, share).collect()}
        assert {(r["candidate_id"], r["role"]) for r in S.holdout_roles(df, share).collect()} == want
    assert S.holdout_roles(df.limit(0)).count() == 0
