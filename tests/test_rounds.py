"""Matching rounds, affine recurrences, pointer doubling, refitting studies and audits against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import intervals as I
from barloom.operators import indicators as IN
from barloom.operators import many_fits as M
from barloom.operators import market_state as MS
from barloom.operators import models as ML
from barloom.operators import splits as S
from barloom.operators import studies as ST
from barloom.operators.matching import match_examples


def scan(examples, cands, tolerance):
    """Each trade in time order takes the nearest free candidate."""
    used, out = set(), set()
    for ex, t in sorted(examples, key=lambda e: (e[1], e[0])):
        near = sorted((abs(t - ct), c) for c, ct in cands if abs(t - ct) <= tolerance and c not in used)
        if near:
            used.add(near[0][1])
            out.add((ex, near[0][1], float(near[0][0])))
    return out


@pytest.mark.parametrize("seed, n, m, span", [(1, 40, 30, 400), (2, 300, 4, 60), (3, 60, 60, 60), (4, 5, 0, 10)])
def test_rounds_equal_the_ordered_scan(spark, seed, n, m, span):
    rng = random.Random(seed)
    ex = [(i, rng.randrange(span)) for i in range(n)]
    cs = [(f"c{i}", rng.randrange(span)) for i in range(m)]
    day = dt.date(2024, 1, 2)
    left = spark.createDataFrame([(i, day, "long", t) for i, t in ex], "example_id long, session_date date, direction string, t int")
    right = spark.createDataFrame([(c, day, "long", t) for c, t in cs], "candidate_id string, session_date date, direction string, t int")
    got = {tuple(r) for r in match_examples(left, right, tolerance=20).collect()}
    assert got == scan(ex, cs, 20)


def test_recurrences_equal_a_loop(spark, rnd=random.Random(5)):
    x = {s: [rnd.gauss(100, 5) for _ in range(n)] for s, n in (("a", 700), ("b", 1), ("c", 64), ("d", 65))}
    df = spark.createDataFrame([(s, i + 1, v) for s, vs in x.items() for i, v in enumerate(vs)], "symbol string, bar_no long, v double").repartition(6)
    alphas = {"fast": 1.0, "mid": 2 / 21, "slow": 0.004, "half": 0.5}
    got = {(r["symbol"], r["bar_no"]): r for r in IN.recurrences(df, {n: ("v", a) for n, a in alphas.items()}, block=16).collect()}
    for s, vs in x.items():
        y = {n: vs[0] for n in alphas}
        for i, v in enumerate(vs):
            y = {n: v if i == 0 else a * v + (1 - a) * y[n] for n, a in alphas.items()}
            for n in alphas:
                assert got[s, i + 1][n] == pytest.approx(y[n], rel=1e-9), (s, i, n)


def plain_taken(start, end, busy):
    out = []
    for a, b in zip(start, end):
        out.append(bool(a >= busy))
        busy = b if a >= busy else busy
    return out, busy


def test_pointers_equal_a_loop():
    for seed in range(500):
        rng = random.Random(seed)
        start = np.array(sorted(rng.randrange(12) for _ in range(rng.randrange(15))), dtype=np.int64)
        end = start + np.array([rng.choice([0, 0, 1, 3, 8]) for _ in start], dtype=np.int64)
        for busy in (-5, 3, 20):
            assert I.taken(start, end, busy).tolist() == plain_taken(start, end, busy)[0]
        tails = I.tails(start, end)
        for i in range(len(start)):
            assert tails[i] == plain_taken(start[i + 1 :], end[i + 1 :], end[i])[1]


def test_hot_run_over_many_partitions(spark):
    rng = random.Random(8)
    rows = [("hot", i, t := rng.randrange(3000), t + rng.choice([0, 1, 5, 40])) for i in range(4000)] + [(f"r{i}", 10_000 + i, 5, 9) for i in range(20)]
    df = spark.createDataFrame(rows, "run string, id long, a long, b long").select("run", "id", F.timestamp_seconds("a").alias("entry"), F.timestamp_seconds("b").alias("out"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["run"], r["id"]) for r in I.non_overlapping(df, run=["run"], entry="entry", exit_="out", key="id").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = set()
    for run in {r[0] for r in rows}:
        mine = sorted((r[2], r[1], r[3]) for r in rows if r[0] == run)
        kept, _ = plain_taken([m[0] for m in mine], [m[2] for m in mine], -1)
        want |= {(run, m[1]) for m, k in zip(mine, kept) if k}
    assert got == want


@pytest.fixture(scope="module")
def study(spark):
    g = np.random.default_rng(3)
    out = []
    for v, days in (("x", 30), ("y", 22)):
        for d in range(days):
            for i in range(int(g.integers(2, 6))):
                a = float(g.normal())
                at = dt.datetime(2024, 1, 1, 10) + dt.timedelta(days=d, minutes=int(g.integers(300)))
                out.append((v, f"{v}{d:02d}{i}", at.date(), at, at + dt.timedelta(minutes=30), a, float(g.normal()), int(g.random() < 1 / (1 + np.exp(-2 * a))), 100.0, 101.0, 99.0, "long", float(g.normal())))
    return spark.createDataFrame(out, "variant string, candidate_id string, session_date date, entry_time timestamp_ntz, exit_time timestamp_ntz, a double, b double, label int, entry_price double, exit_price double, stop_price double, direction string, pnl_r double").withColumns({"reg_high_vol_state": F.lit(0), "reg_trending_state": F.lit(1)})


def test_study_of_variants_equals_single_studies(study):
    uses = {"x": {"a", "b"}, "y": {"a"}}
    both = {(r["candidate_id"], r["fold"]): r["probability"] for r in ST.walk_forward_study(study, ["a", "b"], uses=uses, min_train=6, test=4).collect()}
    single = {}
    for v, cols in (("x", ["a", "b"]), ("y", ["a"])):
        spans = S.fold_spans(study.filter(F.col("variant") == v), min_train=6, test=4, embargo_seconds=60)
        single |= {(r["candidate_id"], r["fold"]): r["probability"] for r in ML.walk_forward_scores(spans, cols).collect()}
    assert both.keys() == single.keys() and len(both) > 50
    assert max(abs(both[k] - single[k]) for k in both) < 1e-9


def test_refit_rows_are_ranked_and_whole(spark, study):
    preds = ST.walk_forward_study(study, ["a", "b"], min_train=6, test=4)
    th = spark.createDataFrame([(0.3,), (0.99999,)], "threshold double")
    rows = {(r["variant"], r["threshold"]): r for r in ST.refit_study(study, preds, th).collect()}
    assert len(rows) == 4 and sorted(r["rank"] for r in rows.values()) == [1, 2, 3, 4]
    assert all(rows[v, 0.99999]["trade_count"] == 0 and rows[v, 0.99999]["utility_score"] is None for v in "xy")
    assert all(rows[v, 0.3]["trade_count"] > 0 and rows[v, 0.3]["walk_forward_status"] == "pass" for v in "xy")


def test_holdout_study_fits_the_first_rows(study):
    preds = ST.holdout_study(study, ["a", "b"])
    one = study.filter("variant = 'y'")
    ids = [r["candidate_id"] for r in one.orderBy("session_date", "candidate_id").collect()]
    first = set(ids[: int(len(ids) * 0.7)])
    got = {r["candidate_id"]: r["probability"] for r in preds.filter("variant = 'y'").collect()}
    assert set(got) == set(ids) - first
    zero = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    fit = M.fit_many(one.filter(F.col("candidate_id").isin(sorted(first))).withColumn("train", zero), ["a", "b"], ["y"])
    want = {r["candidate_id"]: r["probability"] for r in M.predict_many(one.withColumn("test", zero), fit).collect()}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-9


def test_gate_leakage_passes_and_fails(spark):
    rows = spark.createDataFrame([("v", "tempo_persistence", "c1", 1.0), ("v", "tempo_persistence", "c2", 0.0), ("w", "baseline", "c2", 1.0), ("p", "by_path", "c1", 1.0), ("o", "by_result", "c1", 1.0), ("n", "baseline", "c9", 1.0)],
                                 "variant string, gate string, candidate_id string, policy_weight double")
    times = spark.createDataFrame([("c1", 1, 2), ("c2", 2, 2)], "candidate_id string, feature_time int, entry_time int")
    columns = {**MS.GATE_COLUMNS, "by_path": ["path_id"], "by_result": ["label"]}
    got = {r["variant"]: (r["late_rows"], r["uses_path_id_as_filter"], r["status"]) for r in MS.gate_leakage(rows, MS.entry_audit(times), columns=columns).collect()}
    # a late row that the gate drops does no harm; a kept row without an audit does
    assert got == {"v": (0, False, "pass"), "w": (1, False, "fail"), "p": (0, True, "fail"), "o": (0, False, "fail"), "n": (1, False, "fail")}


def test_reliability_warnings_per_group(spark):
    state = MS.MARKET_STATES[0]
    rows = spark.createDataFrame([("a", state)] * 3 + [("b", state)], "g string, market_state string")
    got = {(r["g"], r["state"]): r["count"] for r in MS.reliability_warnings(rows, 2, ["g"]).collect()}
    assert ("a", state) not in got and got["b", state] == 1 and len(got) == 2 * len(MS.MARKET_STATES) - 1
