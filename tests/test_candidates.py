import random
from dataclasses import replace

from market_fixtures import SPEC, bars_frame, random_session

import market_brute as brute
from barloom.operators.candidates import finalize, reclaim_candidates, rules_of
from barloom.operators.labels import triple_barrier
from barloom.operators.zones import opening_zones

FIELDS = ["direction", "break_sod", "trigger_sod", "entry_price", "pivot_price", "pivot_sod", "flem_price",
          "flem_sod", "reentry_count", "reclaim_count"]


def sessions(n, seed, **kw):
    rng = random.Random(seed)
    return [random_session(rng, "S%d" % (i % 3), "2024-01-%02d" % (i // 3 + 1), **kw) for i in range(n)]


def test_set_form_equals_bar_by_bar_scan(spark):
    data = sessions(60, 7)
    spec = replace(SPEC, latest=34200 + 3000)
    bars = bars_frame(spark, [r for s in data for r in s]).cache()
    zones = opening_zones(bars, spec)
    total = 0
    for mode, cap, dedup, buf in [("close", 0, False, 0.0), ("close", 1, False, 0.0), ("wick", 0, False, 0.0),
                                  ("wick_failed_close", 2, True, 0.0), ("close", 3, True, 0.5)]:
        rules = rules_of(zones, spec, break_mode=mode, buffer=buf, cap=cap)
        got = reclaim_candidates(bars, rules, spec, dedup=dedup).collect()
        got = sorted((r.symbol, str(r.session_date), *[r[f] for f in FIELDS]) for r in got)
        want = sorted(
            (s[0]["symbol"], s[0]["day"], *[c[f] for f in FIELDS])
            for s in data
            for c in brute.candidates(s, spec, mode, buf, cap, dedup)
        )
        assert got == want
        total += len(want)
    assert total > 300


def test_labels_equal_bar_by_bar_scan(spark):
    data = sessions(30, 11, minutes=40)
    spec = replace(SPEC, latest=34200 + 2400)
    bars = bars_frame(spark, [r for s in data for r in s]).cache()
    zones = opening_zones(bars, spec)
    cands = finalize(reclaim_candidates(bars, rules_of(zones, spec), spec), zones, spec).dropDuplicates(["candidate_id"])
    rows = cands.collect()
    got = {r.candidate_id: r for r in triple_barrier(bars, cands, spec, horizon=20).collect()}
    assert len(got) == len(rows) > 50
    flat = {}
    for s in data:
        flat.setdefault(s[0]["symbol"], []).extend((r["day"], r["sod"], r) for r in s)
    spilled = 0
    for r in rows:
        mine = sorted(flat[r.symbol], key=lambda x: x[:2])
        after = [x[2] for x in mine if x[:2] >= (str(r.session_date), r.decision_sod)]
        spilled += len(after) >= 20 and after[19]["day"] != str(r.session_date)
        want = brute.label(after, r.entry_price, r.zone_width, r.direction == "long", 20, 1.0, 1.5)
        have = got[r.candidate_id]
        assert (have.outcome, have.bars_held) == (want["outcome"], want["bars_held"])
        assert abs(have.mfe - want["mfe"]) < 1e-9 and abs(have.mae - want["mae"]) < 1e-9
        assert abs(have.pnl_r - want["pnl_r"]) < 1e-9
    assert spilled > 0
