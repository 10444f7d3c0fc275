import random

import market_brute as brute
import pytest
from market_fixtures import SPEC, bars_frame, random_session
from pyspark.sql import functions as F

from barloom.functions.asof import asof
from barloom.functions.intervals import non_overlapping, trailing_streak
from barloom.functions.scan import running
from barloom.functions.stats import exact_quantiles, rank_auc
from barloom.operators import exits as E
from barloom.operators import policies as P
from barloom.operators import splits as S
from barloom.operators.backtest import equity_curve, executed_trades, overlap_skips, sized_signals
from barloom.operators.candidates import finalize, first_per_id, reclaim_candidates, rules_of
from barloom.operators.labels import triple_barrier
from barloom.operators.matching import match_examples
from barloom.operators.zones import opening_zones
from dataclasses import replace


def _trades(spark, rows):
    df = spark.createDataFrame(rows, "run string, id string, a double, b double")
    at = lambda c: F.timestamp_seconds(F.col(c)).cast("timestamp_ntz")
    return df.withColumns({"entry": at("a"), "exit": at("b")})


def test_single_position_equals_plain_loop_over_many_days(spark):
    rng = random.Random(5)
    rows = []
    for run, spread in (("sparse", 9e7), ("dense", 3e5), ("hot", 1e6)):
        n = 1500 if run == "hot" else 300
        for i in range(n):
            a = float(rng.randint(0, int(spread) // 600) * 600)
            rows.append((run, f"{run}{i:05d}", a, a + rng.choice([0, 600, 1800, 86400 * 3, 86400 * 200 if i % 97 == 0 else 60])))
    got = {r.id for r in non_overlapping(_trades(spark, rows), run=["run"], entry="entry", exit_="exit", key="id").collect()}
    want = set()
    for run in ("sparse", "dense", "hot"):
        mine = [r for r in rows if r[0] == run]
        want |= {mine[i][1] for i in brute.single_position([(r[2], r[3], r[1]) for r in mine])}
    assert got == want and len(want) > 100


def test_running_equals_window(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.9 else None, rng.choice([0.0, -1.5, 1e-9, 3.25, 1e6]) * rng.random(), i, rng.choice([None, 1.0, -2.0])) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, t double, i int, v double")
    from pyspark.sql import Window as W

    for reverse in (False, True):
        for inclusive in (False, True):
            got = running(df, ["g"], ["t", "i"], {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v"), "n": ("count", "v")}, inclusive=inclusive, reverse=reverse)
            o = [F.col("t").desc(), F.col("i").desc()] if reverse else [F.col("t"), F.col("i")]
            w = W.partitionBy("g").orderBy(*o).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
            want = df.select("i", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.last("v", True).over(w).alias("l"), F.count(F.lit(1)).over(w).alias("n"))
            a = {r.i: (round(r.s, 6) if r.s is not None else None, r.m, r.l, r.n) for r in got.collect()}
            b = {r.i: (round(r.s, 6) if r.s is not None else None, r.m, r.l, r.n) for r in want.collect()}
            assert a == b


def test_asof_directions_and_strictness(spark):
    left = spark.createDataFrame([("s", 1, 10), ("s", 2, 15), ("s", 3, 1), ("t", 4, 10)], "k string, id int, t int")
    right = spark.createDataFrame([("s", 5, "a"), ("s", 10, "b"), ("s", 20, "c")], "k string, u int, x string")
    kw = dict(by=["k"], left_time="t", right_time="u", key="u", take=["x"])
    pick = lambda **o: {r.id: r.x for r in asof(left, right, **kw, **o).collect()}
    assert pick() == {1: "b", 2: "b", 3: None, 4: None}
    assert pick(strict=True) == {1: "a", 2: "b", 3: None, 4: None}
    assert pick(direction="forward") == {1: "b", 2: "c", 3: "a", 4: None}
    assert pick(direction="forward", strict=True) == {1: "c", 2: "c", 3: "a", 4: None}


def test_exact_quantiles_and_auc(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1e-4, 300), rng.normal(5, 3, 300), np.full(400, 2.5)])
    y = (rng.random(1000) < 0.3).astype(int)
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(x, y)], "g string, x double, y int")
    q = exact_quantiles(df, ["g"], "x", {"p05": 0.05, "p50": 0.5, "p93": 0.93}).first()
    for name, p in (("p05", 5), ("p50", 50), ("p93", 93)):
        assert abs(q[name] - np.percentile(x, p)) < 1e-12
    got = rank_auc(df, "x", "y", ["g"]).first().roc_auc
    pos, neg = x[y == 1], x[y == 0]
    want = np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])
    assert abs(got - want) < 1e-9


def test_exit_policies_equal_plain_loop(spark):
    rng = random.Random(21)
    data = [random_session(rng, "S%d" % (i % 2), "2024-03-%02d" % (i // 2 + 1), minutes=45) for i in range(24)]
    spec = replace(SPEC, latest=34200 + 2000)
    bars = bars_frame(spark, [r for s in data for r in s]).cache()
    zones = opening_zones(bars, spec)
    c = first_per_id(finalize(reclaim_candidates(bars, rules_of(zones, spec), spec), zones, spec))
    lab = triple_barrier(bars, c, spec).select("candidate_id", "stop_price", "target_price", "pnl_r")
    entries = c.join(lab, "candidate_id").withColumn("distance_to_recent_high_low", F.col("continuation_displacement_ratio")).cache()
    got = {(r.candidate_id, r.policy): r for r in E.replay_exits(bars, entries, spec).collect()}
    flat = {}
    for s in data:
        flat.setdefault(s[0]["symbol"], []).extend((r["day"], r["sod"], r) for r in s)
    seen = set()
    for r in entries.collect():
        after = [x[2] for x in sorted(flat[r.symbol], key=lambda x: x[:2]) if x[:2] >= (str(r.session_date), r.decision_sod)][:20]
        for p in E.POLICIES:
            want = exit_loop(after, r, dict(zip(("name", "target_r", "be", "trail", "partial", "cut", "scratch", "time", "tempo"), p)))
            have = got[(r.candidate_id, p[0])]
            assert (have.outcome, have.bars_held) == want[:2], (p[0], r.candidate_id)
            assert abs(have.pnl_r - want[2]) < 1e-9
            seen.add(have.outcome)
    assert {"stop", "target", "timeout", "time_stop", "scratch_no_followthrough", "tempo_deterioration", "mae_cut"} <= seen


def exit_loop(bars, r, p):
    """Plain bar-by-bar reading of one exit policy."""
    up = r.direction == "long"
    s = 1.0 if up else -1.0
    e, stop = r.entry_price, r.stop_price
    risk = max(abs(e - stop), 0.25)
    recent = max(0.5, min(r.distance_to_recent_high_low or 1.5, 1.5))
    target = r.target_price if p["target_r"] is None else e + s * (recent if p["target_r"] == 0 else p["target_r"]) * risk
    mfe, taken, out, px, held = 0.0, False, "timeout", e, 0
    better = max if up else min
    for k, b in enumerate(bars, 1):
        fav, adv = (b["high"], b["low"]) if up else (b["low"], b["high"])
        mfe, held, px = max(mfe, s * (fav - e) / risk), k, b["close"]
        if p["be"] is not None and mfe >= p["be"]:
            stop = better(stop, e)
        three = bars[max(0, k - 3):k]
        sides = [(x["close"] > x["open"]) - (x["close"] < x["open"]) for x in three]
        nz = [x for x in sides if x]
        go = len(nz) >= 2 and sum(x == (1 if up else -1) for x in nz) >= 2
        trail = k >= 3 and {"half_r": mfe >= 0.5, "one_r": mfe >= 1.0, "continuation": mfe >= 0.5 and go, "partial": taken, None: False}[p["trail"]]
        if trail:
            stop = better(stop, (min if up else max)(x["low" if up else "high"] for x in three))
        if p["partial"] and not taken and s * (fav - e) >= risk:
            taken, stop = True, e
        hs, ht = s * (adv - stop) <= 0, s * (fav - target) >= 0
        if hs or ht:
            out, px = ("ambiguous_stop_first" if hs and ht else "stop" if hs else "target"), (stop if hs else target)
            break
        if p["cut"] is not None and s * (e - adv) / risk >= p["cut"]:
            out = "mae_cut"
            break
        if p["scratch"] == k and mfe < 0.25:
            out = "scratch_no_followthrough"
            break
        if p["time"] == k:
            out = "time_stop"
            break
        if p["tempo"] and k >= 4:
            four = bars[k - 4:k]
            sg = [(x["close"] > x["open"]) - (x["close"] < x["open"]) for x in four]
            body = [abs(x["close"] - x["open"]) for x in four]
            if sum(1 for a, c in zip(sg, sg[1:]) if a and c and a != c) >= 2 or body[-1] <= max(body[0], 1e-9) * 0.5:
                out = "tempo_deterioration"
                break
    net = (s * (px - e) - 1.5) / risk
    return out, held, 0.5 + 0.5 * net if p["partial"] and taken else net


def test_session_drawdown_stop(spark):
    rows = [("d1", 1, "a", -2.0), ("d1", 2, "b", -1.5), ("d1", 3, "c", 5.0), ("d2", 1, "d", -1.0), ("d2", 2, "e", 1.0)]
    df = spark.createDataFrame(rows, "session_date string, decision_sod int, candidate_id string, pnl_r double")
    got = {r.candidate_id: r.session_drawdown_stop_triggered for r in E.session_drawdown_stop(df, []).collect()}
    assert got == {"a": False, "b": True, "d": False, "e": False}


def test_policy_rules(spark):
    rows = [("1", "deep_retrace_repair", 0.66, 1, 1), ("2", "clean_break_continuation", 0.66, 0, 1), ("3", "deep_retrace_repair", 0.72, 0, 1)]
    df = spark.createDataFrame(rows, "candidate_id string, setup_subtype string, probability double, reg_high_vol_state int, reg_trending_state int")
    ids = lambda d: sorted(r.candidate_id for r in d.collect())
    assert ids(P.tail_cleanup(df, "exclude_deep_retrace")) == ["2"]
    assert ids(P.tail_cleanup(df, "deep_retrace_threshold_070")) == ["2", "3"]
    assert ids(P.tail_cleanup(df, "deep_retrace_regime_confirmed_only")) == ["2", "3"]
    capped = {r.candidate_id: r.probability for r in P.tail_cleanup(df, "deep_retrace_high_conf_cap").collect()}
    assert capped == {"1": 0.64, "2": 0.66, "3": 0.64}
    for name in ("exclude_1432_bucket", "haircut_1432_bucket"):
        with pytest.raises(ValueError):
            P.tail_cleanup(df, name)
    with pytest.raises(KeyError):
        P.tail_cleanup(df, "unknown")


def test_backtest_throttle_and_overlap(spark):
    base = "2024-01-02 09:3%d:00"
    rows = [("a", "long", 0.9, base % 0, base % 3, 100.0, 101.5, 99.0, 1.5, 0, 1), ("b", "short", 0.8, base % 1, base % 4, 100.0, 99.0, 101.0, 1.0, 0, 1),
            ("c", "long", 0.7, base % 5, base % 6, 100.0, 99.0, 99.0, -1.0, 1, 0), ("d", "long", 0.6, base % 7, base % 8, 100.0, 100.5, 100.0, 0.0, 0, 1)]
    df = spark.createDataFrame(
        rows, "candidate_id string, direction string, probability double, entry_time string, exit_time string, entry_price double, exit_price double, "
        "stop_price double, pnl_r double, reg_high_vol_state int, reg_trending_state int"
    ).withColumns({"entry_time": F.to_timestamp_ntz("entry_time"), "exit_time": F.to_timestamp_ntz("exit_time"), "session_date": F.lit("2024-01-02")})
    s = sized_signals(df, threshold=0.45, sizing="confidence_linear_v1", throttle="high_vol_or_non_trending_off_v1").withColumn("run", F.lit("r"))
    ex = executed_trades(s, ["run"]).collect()
    assert [r.candidate_id for r in ex] == ["a"]
    assert ex[0].size_multiplier > 0.5 and abs(ex[0].gross_executed_pnl_r - 0.0) < 1e-9
    assert overlap_skips(s, executed_trades(s, ["run"]), ["run"]).first().overlap_skips == 1
    assert s.filter(~F.col("allowed")).count() == 1


def test_drawdown_floor(spark):
    df = spark.createDataFrame([("r", 1, "a", -1.0), ("r", 2, "b", -1.0), ("r", 3, "c", 3.0)], "run string, t int, id string, p double")
    with_floor = [r.drawdown_r for r in equity_curve(df, ["run"], "p", ["t", "id"]).orderBy("t").collect()]
    without = [r.drawdown_r for r in equity_curve(df, ["run"], "p", ["t", "id"], floor_zero=False).orderBy("t").collect()]
    assert with_floor == [-1.0, -2.0, 0.0] and without == [0.0, -1.0, 0.0]


def test_walk_forward_purge_invariant(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", f"2024-01-{d:02d}", f"2024-01-{d:02d} 10:{rng.randint(0, 59):02d}:00", rng.randint(1, 3000)) for i, d in enumerate(rng.choices(range(1, 29), k=200))]
    df = spark.createDataFrame(rows, "candidate_id string, session_date string, e string, hold int").withColumns(
        {"session_date": F.to_date("session_date"), "entry_time": F.to_timestamp_ntz("e")}
    ).withColumn("exit_time", F.col("entry_time") + F.make_dt_interval(mins=F.col("hold")))
    t = S.walk_forward(df, min_train=10, test=5, embargo_seconds=3600)
    bad = t.filter((F.col("role") == "train") & (F.col("exit_time") >= F.col("test_start") - F.expr("INTERVAL 1 HOUR")))
    assert bad.count() == 0 and t.filter("role = 'purged'").count() > 0
    assert {r.role for r in t.select("role").distinct().collect()} >= {"train", "test"}


def test_permutation_keeps_the_probabilities(spark):
    df = spark.createDataFrame([(f"c{i}", i / 100, i) for i in range(100)], "candidate_id string, probability double, t int").withColumn("entry_time", F.timestamp_seconds("t"))
    out = S.shuffle_probabilities(df).collect()
    assert sorted(r.probability for r in out) == sorted(i / 100 for i in range(100))
    assert sum(r.probability == r.t / 100 for r in out) < 20


def test_familywise_bootstrap(spark):
    rows = [("t1", 0.01), ("t2", 0.015), ("t3", 0.02), ("t4", 0.08)]
    d = spark.createDataFrame(rows, "trial_id string, net_delta_vs_baseline double")
    acc = d.filter("trial_id = 't4'").withColumn("roc_auc_delta_vs_baseline", F.lit(0.01))
    r = S.familywise_pvalue(d, acc).first()
    assert r.familywise_pvalue <= 0.05 and r.status == "pass"


def test_matching_equals_plain_loop(spark):
    rng = random.Random(9)
    manual = [(i, rng.choice("ab"), "long", rng.randint(0, 4000)) for i in range(80)]
    cands = [(f"c{i}", rng.choice("ab"), "long", rng.randint(0, 4000)) for i in range(60)]
    m = spark.createDataFrame(manual, "example_id int, session_date string, direction string, t int")
    c = spark.createDataFrame(cands, "candidate_id string, session_date string, direction string, t int")
    got = {(r.example_id, r.candidate_id) for r in match_examples(m, c).collect()}
    used, want = set(), set()
    for i, s, _, t in sorted(manual, key=lambda r: (r[3], r[0])):
        free = sorted((abs(ct - t), cid) for cid, cs, _, ct in cands if cs == s and cid not in used)
        if free and free[0][0] <= 90:
            used.add(free[0][1])
            want.add((i, free[0][1]))
    assert got == want and len(want) > 20


def test_trailing_streak(spark):
    d = spark.createDataFrame([("g", 1, "x"), ("g", 2, "y"), ("g", 3, "x"), ("g", 4, "x")], "g string, i int, f string")
    r = trailing_streak(d, by=["g"], order=["i"], value="f").first()
    assert (r.last_value, r.streak) == ("x", 2)


def test_replay_keeps_every_run(spark):
    from pyspark.sql import functions as F

    from barloom.operators.replay import replayed

    one = spark.sql("SELECT id AS candidate_id, timestamp_ntz '2024-01-02 09:30:00' + make_interval(0, 0, 0, 0, 0, int(id)) AS entry_time, "
                    "timestamp_ntz '2024-01-02 09:30:30' + make_interval(0, 0, 0, 0, 0, int(id)) AS exit_time, 0.5D AS probability, 'long' AS direction, "
                    "10D AS entry_price, 10D + id AS exit_price FROM range(4)")
    both = one.withColumn("run", F.explode(F.array(F.lit("A"), F.lit("B"))))
    got = replayed(both, by=["run"]).groupBy("run").agg(F.count("*").alias("n"), F.sum("net_pnl").alias("pnl")).collect()
    assert {r["run"] for r in got} == {"A", "B"} and len({(r["n"], r["pnl"]) for r in got}) == 1 and got[0]["n"] == 4
