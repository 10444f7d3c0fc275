import random
from dataclasses import replace

from market_fixtures import SPEC, bars_frame, random_session

import market_brute as brute
from barloom.operators.attempts import event_driven_candidates
from barloom.operators.zones import opening_zones

FIELDS = ["direction", "break_sod", "trigger_sod", "pivot_price", "pivot_sod", "flem_price", "flem_sod",
          "reentry_count", "reclaim_count", "break_sequence", "attempt_sequence"]


def test_event_engine_equals_plain_loop(spark):
    rng = random.Random(3)
    data = [random_session(rng, "S%d" % (i % 4), "2024-02-%02d" % (i // 4 + 1)) for i in range(60)]
    spec = replace(SPEC, latest=34200 + 3000)
    bars = bars_frame(spark, [r for s in data for r in s]).cache()
    zones = opening_zones(bars, spec)
    seen = 0
    for cap, buf in [(0, 0.0), (1, 0.0), (3, 0.25)]:
        got = event_driven_candidates(bars, zones, spec, buffer=buf, cap=cap).collect()
        got = sorted((r.symbol, str(r.session_date), *[r[f] for f in FIELDS]) for r in got)
        want = sorted((s[0]["symbol"], s[0]["day"], *[c[f] for f in FIELDS])
                      for s in data for c in brute.event_engine(s, spec, cap, buf))
        assert got == want
        seen += len(want)
    assert seen > 100
