"""Event-driven candidate engine: several attempts per break, with resets.

State feeds back from one bar to the next (an accepted reclaim clears the
attempt, a close through the far edge clears the break), so this is a fold.
It runs per ``(symbol, session_date)``, a group bounded by the bar grid of one
session; the same step function serves the streaming twin.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.sessions import resample
from barloom.schemas import SESSION_KEY, SessionSpec

ATTEMPT_DDL = (
    "symbol string, session_date date, direction string, break_sod int, break_decision_sod int, trigger_sod int, "
    "decision_sod int, entry_price double, pivot_price double, pivot_sod int, flem_price double, flem_sod int, "
    "reentry_count int, reclaim_count int, break_close double, break_high double, break_low double, "
    "candidate_engine string, break_sequence int, attempt_sequence int"
)


@dataclass
class Break:
    """State of one session: the live break, the live attempt, the counters."""

    side: int = 0  # +1 long, -1 short, 0 none
    at: int = 0
    done: int = 0
    close: float = 0.0
    high: float = 0.0
    low: float = 0.0
    reach: float = 0.0
    reach_at: int = 0
    pivot: float | None = None
    pivot_at: int = 0
    pulls: int = 0
    reclaims: int = 0
    outside: bool = False
    breaks: int = 0
    tries_up: int = 0
    tries_down: int = 0

    def tries(self, side: int) -> int:
        return self.tries_up if side > 0 else self.tries_down

    def clear_attempt(self, outside: bool) -> None:
        self.pivot, self.pulls, self.reclaims, self.outside = None, 0, 0, outside


def step(s: Break, ev: dict, spec: SessionSpec, *, buffer: float, cap: int) -> dict | None:
    """Advance the state by one event; returns an accepted attempt or None."""
    hi, lo, t = ev["zone_high"], ev["zone_low"], ev["t"]
    if t < spec.decision:
        return None
    open_side = lambda side: cap <= 0 or s.tries(side) < cap
    if ev["coarse"]:
        side = 1 if ev["close"] > hi + buffer else -1 if ev["close"] < lo - buffer else 0
        if side and side != s.side and open_side(side):
            s.side, s.at, s.done = side, ev["sod"], t
            s.close, s.high, s.low = ev["close"], ev["high"], ev["low"]
            s.reach, s.reach_at = (s.high if side > 0 else s.low), t
            s.breaks += 1
            s.clear_attempt(True)
        return None
    if cap > 0 and not open_side(1) and not open_side(-1):
        return None
    if not s.side or t <= s.done:
        return None
    up = s.side > 0
    if t > spec.latest or (ev["close"] < lo if up else ev["close"] > hi):
        s.side = 0
        return None
    far, near = (ev["high"], ev["low"]) if up else (ev["low"], ev["high"])
    if (far - s.reach) * s.side >= 0:
        s.reach, s.reach_at = far, t
    touches = ev["low"] <= hi and ev["high"] >= lo
    pull = touches and (ev["open"] - ev["close"]) * s.side > 0
    s.pulls += pull
    if s.pulls and (s.pivot is None or (near - s.pivot) * s.side < 0):
        s.pivot, s.pivot_at = near, t
    beyond = ev["close"] > hi if up else ev["close"] < lo
    if not (s.pulls and not pull and beyond) or s.outside:
        s.outside = beyond
        return None
    s.reclaims += 1
    s.outside = True
    if t < spec.earliest or not open_side(s.side):
        return None
    if up:
        s.tries_up += 1
    else:
        s.tries_down += 1
    found = {
        "direction": "long" if up else "short", "break_sod": s.at, "break_decision_sod": s.done,
        "trigger_sod": ev["sod"], "decision_sod": t, "entry_price": ev["close"], "pivot_price": s.pivot,
        "pivot_sod": s.pivot_at, "flem_price": s.reach, "flem_sod": s.reach_at, "reentry_count": s.pulls,
        "reclaim_count": s.reclaims, "break_close": s.close, "break_high": s.high, "break_low": s.low,
        "candidate_engine": "event_driven_v1", "break_sequence": s.breaks, "attempt_sequence": s.tries(s.side),
    }
    s.clear_attempt(beyond)
    return found


def event_stream(bars: DataFrame, zones: DataFrame, spec: SessionSpec) -> DataFrame:
    """Fine and coarse bars as one stream ordered by completion time.

    At one completion time coarse bars come first, then bars by start.
    """
    cols = ["open", "high", "low", "close", "volume"]
    fine = bars.select(*SESSION_KEY, "sod", *cols, (F.col("sod") + spec.fine).alias("t"), F.lit(False).alias("coarse"))
    coarse = resample(bars, spec).select(*SESSION_KEY, "sod", *cols, (F.col("sod") + spec.coarse).alias("t"), F.lit(True).alias("coarse"))
    return fine.unionByName(coarse).join(zones.select(*SESSION_KEY, "zone_high", "zone_low"), SESSION_KEY)


def order_events(events: pd.DataFrame) -> pd.DataFrame:
    return events.assign(rank=~events["coarse"]).sort_values(["t", "rank", "sod"], kind="stable")


def event_driven_candidates(
    bars: DataFrame, zones: DataFrame, spec: SessionSpec, *, buffer: float = 0.0, cap: int = 0
) -> DataFrame:
    """All accepted attempts of each session."""

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = Break(), []
        for ev in order_events(pdf).to_dict("records"):
            hit = step(state, ev, spec, buffer=buffer, cap=cap)
            if hit:
                out.append({"symbol": key[0], "session_date": key[1], **hit})
        return pd.DataFrame(out, columns=names)

    names = [x.strip().split(" ")[0] for x in ATTEMPT_DDL.split(",")]
    return event_stream(bars, zones, spec).groupBy(*SESSION_KEY).applyInPandas(fold, ATTEMPT_DDL)


def pack(state: Break) -> dict:
    """State as a flat record (for a state store)."""
    return asdict(state)
