"""Policies replayed on paths: sums of a plain loop, and no trade list in a broadcast."""

from pyspark.sql import functions as F

from barloom.operators.market_state import replay_on_paths


def test_replay_equals_plain_loop_without_broadcast(spark):
    paths = [(f"p{i % 3}", f"c{i % 40}", (i * 7 % 11 - 5) / 4.0) for i in range(120)]
    weights = [(v, f"c{i}", (i * k % 3) / 2.0 if i % 5 else None, -0.25 if i % 4 == 0 else 0.0) for k, v in enumerate(("base", "half", "it's")) for i in range(40) if (i + k) % 7]
    p = spark.createDataFrame(paths, "path_id string, candidate_id string, executed_pnl_r double")
    w = spark.createDataFrame(weights, "variant string, candidate_id string, policy_weight double, fill_impact_r double")
    df = replay_on_paths(p, w)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    known = {(v, c): (1.0 if x is None else x, f) for v, c, x, f in weights}
    want = {}
    for v in ("base", "half", "it's"):
        for path, c, r in paths:
            x, f = known.get((v, c), (1.0, 0.0))
            s = want.setdefault((v, path), [0.0, 0.0, 0, 0.0])
            s[0], s[1], s[2], s[3] = s[0] + r, s[1] + (r + f) * x, s[2] + (x > 0), s[3] + x
    got = {(r["variant"], r["path_id"]): [r["baseline_total_pnl_r"], r["total_pnl_r"], r["trade_count"], r["effective_trade_count"]] for r in df.collect()}
    assert got == want
    assert replay_on_paths(p, w.filter(F.lit(False))).count() == 0
