"""Grouped fits, fold spans and path spans against plain readings."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import cpcv as CV
from barloom.operators import many_fits as M
from barloom.operators import models as ML
from barloom.operators import splits as S


def plain_fit(x, y):
    """Newton steps on the balanced ridge objective of one training set."""
    med = np.array([np.sort(c[~np.isnan(c)])[(np.count_nonzero(~np.isnan(c)) + 1) // 2 - 1] for c in x.T])
    x = np.where(np.isnan(x), med, x)
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    sd = np.where(sd == 0, np.inf, sd)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge, b = np.r_[0.0, np.ones(x.shape[1])], np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (y - p)) - ridge * b)
    beta = b[1:] / sd
    return np.r_[b[0] - (beta * mean).sum(), beta]


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(1)
    n, k = 500, 6
    x = g.normal(size=(n, 4)) * [1, 10, 0.1, 3] + [0, 100, 5, -2]
    x[g.random(n) < 0.2, 1] = np.nan
    x[:, 3] = np.round(x[:, 3])
    y = (g.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    first = g.integers(0, k, n)
    x[first < 1, 2] = 5.0  # no variance in the first fit
    data = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], int(y[i]), [(int(first[i]), k - 1)], [(i % k, i % k), (3, 2)]) for i in range(n)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, e double, label int, train array<struct<lo:int,hi:int>>, test array<struct<lo:int,hi:int>>").repartition(5)
    return df, x, y, first, k


COLS = ["a", "b", "c", "e"]


def test_every_fit_equals_a_plain_one(rows):
    df, x, y, first, k = rows
    fits = M.fit_many(df, COLS, [f"f{i}" for i in range(k)])
    for i in range(k):
        mine = first <= i
        assert np.allclose(fits.plain()[i], plain_fit(x[mine], y[mine]), atol=1e-8), i
    preds = {(r["id"], r["fit"]): r["probability"] for r in M.predict_many(df, fits).collect()}
    assert len(preds) == len(x)
    b = fits.plain()[2]
    at = [i for i in range(len(x)) if i % k == 2 and not np.isnan(x[i]).any()]
    assert np.allclose([preds[i, "f2"] for i in at], 1 / (1 + np.exp(-(b[0] + x[at] @ b[1:]))), atol=1e-10)


def test_fits_without_both_labels_or_rows(rows):
    df, _, _, _, k = rows
    one = M.fit_many(df.withColumn("label", F.lit(1)), COLS, ["x"] * k)
    assert not one.fitted.any() and M.predict_many(df, one).count() == 0
    none = M.fit_many(df.limit(0), COLS, ["x"] * k)
    assert not none.fitted.any()
    more = M.fit_many(df, COLS, [str(i) for i in range(k + 1)])
    assert list(more.fitted) == [True] * k + [False]
    null = M.fit_many(df.withColumn("a", F.lit(None).cast("double")), COLS, ["x"] * k)
    assert null.fitted.all() and not null.plain()[:, 1].any()


def test_one_fit_equals_the_pipeline_of_models(rows):
    df, _, _, first, k = rows
    full = df.filter("b IS NOT NULL").withColumn("train", F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"))))
    fit = M.fit_many(full, COLS, ["all"])
    model = ML.fit_classifier(full.select(*COLS, "label"), COLS)
    got = {r["id"]: r["probability"] for r in ML.score(model, full.select("id", *COLS), COLS).collect()}
    mine = M.predict_many(full.withColumn("test", F.col("train")), fit).collect()
    assert max(abs(r["probability"] - got[r["id"]]) for r in mine) < 1e-5


def trades(spark, rng, days=40):
    start, out = dt.datetime(2024, 1, 1, 9, 30), []
    for d in range(days):
        for _ in range(rng.randrange(0, 5)):
            a = start + dt.timedelta(days=d * (1 + d % 3), seconds=30 * rng.randrange(700))
            out.append((len(out), a.date(), a, a + dt.timedelta(seconds=rng.choice([0, 30, 7200, 200_000]))))
    out.append((len(out), out[3][1], out[3][2], None))
    return spark.createDataFrame(out, "candidate_id long, session_date date, entry_time timestamp_ntz, exit_time timestamp_ntz"), out


@pytest.mark.parametrize("min_train, test, step, embargo", [(5, 3, None, 0), (4, 5, 2, 3600), (10, 4, 6, 90_000), (100, 5, None, 0)])
def test_fold_spans_equal_a_plain_reading(spark, min_train, test, step, embargo):
    df, data = trades(spark, random.Random(min_train))
    days = sorted({r[1] for r in data})
    want, counts = set(), {}
    for fold, at in enumerate(range(min_train, len(days) - test + 1, step or test), 1):
        inside = [r for r in data if r[1] in days[at : at + test]]
        edge = min(r[2] for r in inside)
        for r in data:
            if days.index(r[1]) < at + test:
                gap = None if r[3] is None else r[3] >= edge
                near = None if r[3] is None else r[3] >= edge - dt.timedelta(seconds=embargo)
                role = "test" if r in inside else "purged" if gap else "embargo" if near else "train"
                want.add((r[0], fold, role))
                counts[fold, role] = counts.get((fold, role), 0) + 1
    how = dict(min_train=min_train, test=test, step=step, embargo_seconds=embargo)
    got = S.walk_forward(df, **how)
    assert {(r["candidate_id"], r["fold"], r["role"]) for r in got.collect()} == want
    assert {*got.columns} == {*df.columns, "session_no", "fold", "role", "test_start"}
    found = S.role_measures(S.fold_spans(df, **how), {"ids": F.col("candidate_id")}).collect()
    assert {(r["fold"], r["role"]): r["rows"] for r in found} == counts
    assert sum(r["ids"] for r in found) == sum(i for i, _, _ in want)


@pytest.mark.parametrize("per_group", [False, True])
def test_path_spans_equal_tagged_rows(spark, per_group):
    df, _ = trades(spark, random.Random(3))
    paths = S.cpcv_paths(spark, 6)
    names = sorted(r["path_id"] for r in paths.collect())
    how = dict(horizon=4, embargo_bars=2, per_group=per_group)
    want = {(r["candidate_id"], r["path_id"], r["role"]) for r in S.cpcv_rows(df, paths, 6, **how).collect() if r["role"] != "purged"}
    got = {(r["candidate_id"], names[s["lo"]], role) for r in S.cpcv_spans(df, paths, 6, **how).collect() for role in ("train", "test") for s in r[role]}
    assert got == want
    tested = CV.tested(S.cpcv_spans(df, paths, 6, **how), names)
    assert {(r["candidate_id"], r["path_id"]) for r in tested.collect()} == {(c, p) for c, p, role in want if role == "test"}
