"""Plain row-by-row readings of the rules, used only to check the Spark jobs."""

from __future__ import annotations


def coarse_of(bars, spec):
    out = {}
    for b in sorted(bars, key=lambda r: r["sod"]):
        s = b["sod"] // spec.coarse * spec.coarse
        if s not in out:
            out[s] = dict(b, sod=s)
        else:
            o = out[s]
            o["high"], o["low"] = max(o["high"], b["high"]), min(o["low"], b["low"])
            o["close"] = b["close"]
            o["volume"] += b["volume"]
    return [out[k] for k in sorted(out)]


def zone_of(bars, spec):
    z = [b for b in bars if spec.zone_start <= b["sod"] <= spec.zone_end]
    if not z:
        return None
    return max(b["high"] for b in z), min(b["low"] for b in z)


def is_pullback(b, up, hi, lo):
    touch = b["low"] <= hi and b["high"] >= lo
    return touch and (b["close"] < b["open"] if up else b["close"] > b["open"])


def breaks(b, up, hi, lo, mode, buf):
    by_close = b["close"] > hi + buf if up else b["close"] < lo - buf
    by_wick = b["high"] > hi + buf if up else b["low"] < lo - buf
    return {"close": by_close, "wick": by_wick, "wick_failed_close": by_wick and not by_close}[mode]


def candidates(bars, spec, mode="close", buf=0.0, cap=0, dedup=False):
    """All candidates of one session, scanning bar by bar from every break."""
    bars = sorted(bars, key=lambda r: r["sod"])
    zone = zone_of(bars, spec)
    if zone is None:
        return []
    hi, lo = zone
    coarse = coarse_of(bars, spec)
    out, count, seen = [], {True: 0, False: 0}, set()
    for c in coarse:
        ct = c["sod"] + spec.coarse
        if ct < spec.decision or ct > spec.latest:
            continue
        for up in (True, False):
            if cap and count[up] >= cap or not breaks(c, up, hi, lo, mode, buf):
                continue
            got = scan(bars, coarse, c, up, hi, lo, spec)
            if got is None or (dedup and (up, got["trigger_sod"]) in seen):
                continue
            seen.add((up, got["trigger_sod"]))
            count[up] += 1
            out.append(got)
    return out


def scan(bars, coarse, brk, up, hi, lo, spec):
    bt = brk["sod"] + spec.coarse
    flem, flem_t = (brk["high"] if up else brk["low"]), bt
    pivot = pivot_t = None
    n_pb = n_rc = 0
    seen = False
    prev = brk["close"] > hi if up else brk["close"] < lo
    for b in bars:
        t = b["sod"] + spec.fine
        if t <= bt:
            continue
        if t > spec.latest:
            return None
        far = b["high"] if up else b["low"]
        if (far >= flem) if up else (far <= flem):
            flem, flem_t = far, t
        for m in coarse:
            if m["sod"] >= brk["sod"] and m["sod"] + spec.coarse <= t:
                if (m["close"] < lo) if up else (m["close"] > hi):
                    return None
        pb = is_pullback(b, up, hi, lo)
        if pb:
            seen, n_pb = True, n_pb + 1
        if seen:
            near = b["low"] if up else b["high"]
            if pivot is None or ((near < pivot) if up else (near > pivot)):
                pivot, pivot_t = near, t
        beyond = b["close"] > hi if up else b["close"] < lo
        reclaim = seen and not pb and beyond
        if reclaim and not prev:
            n_rc += 1
        prev = beyond
        if reclaim and t >= spec.earliest:
            return dict(direction="long" if up else "short", break_sod=brk["sod"], trigger_sod=b["sod"],
                        entry_price=b["close"], pivot_price=pivot, pivot_sod=pivot_t, flem_price=flem,
                        flem_sod=flem_t, reentry_count=n_pb, reclaim_count=n_rc)
    return None


def label(bars_after, entry, width, up, horizon, stop_mult, target_mult, min_points=0.25):
    risk = max(width * stop_mult, min_points)
    stop = entry - risk if up else entry + risk
    target = entry + width * target_mult if up else entry - width * target_mult
    mfe = mae = 0.0
    outcome, price, held = "timeout", None, 0
    for i, b in enumerate(bars_after[:horizon], 1):
        held = i
        mfe = max(mfe, b["high"] - entry if up else entry - b["low"])
        mae = min(mae, b["low"] - entry if up else entry - b["high"])
        s = b["low"] <= stop if up else b["high"] >= stop
        t = b["high"] >= target if up else b["low"] <= target
        if s or t:
            outcome = "ambiguous_stop_first" if s and t else "stop" if s else "target"
            price = stop if s else target
            break
    if price is None:
        price = bars_after[:horizon][-1]["close"] if bars_after[:horizon] else entry
    pnl = (price - entry) if up else (entry - price)
    return dict(outcome=outcome, bars_held=held, mfe=mfe, mae=mae, pnl_r=pnl / risk)


def event_engine(bars, spec, cap=0, buf=0.0):
    """Event-driven attempts of one session: reset rules along one event stream."""
    bars = sorted(bars, key=lambda r: r["sod"])
    zone = zone_of(bars, spec)
    if zone is None:
        return []
    hi, lo = zone
    events = [(c["sod"] + spec.coarse, 0, c) for c in coarse_of(bars, spec)]
    events += [(b["sod"] + spec.fine, 1, b) for b in bars]
    events.sort(key=lambda e: (e[0], e[1], e[2]["sod"]))
    out, count, attempts, n_break = [], {True: 0, False: 0}, {True: 0, False: 0}, 0
    full = lambda d: cap > 0 and count[d] >= cap
    up = brk = bt = flem = flem_t = None
    pivot = pivot_t = None
    n_pb = n_rc = 0
    prev = False
    for t, kind, b in events:
        if t < spec.decision:
            continue
        if kind == 0:
            side = True if b["close"] > hi + buf else False if b["close"] < lo - buf else None
            if side is not None:
                if up is not side and not full(side):
                    up, brk, bt, n_break = side, b, t, n_break + 1
                    flem, flem_t = (b["high"] if side else b["low"]), t
                    pivot, n_pb, n_rc = None, 0, 0
                    prev = True
                continue
            continue
        if up is None or t <= bt:
            continue
        gone = t > spec.latest or (b["close"] < lo if up else b["close"] > hi)
        if gone:
            up = None
            continue
        far = b["high"] if up else b["low"]
        if (far >= flem) if up else (far <= flem):
            flem, flem_t = far, t
        pb = is_pullback(b, up, hi, lo)
        n_pb += pb
        if n_pb:
            near = b["low"] if up else b["high"]
            if pivot is None or ((near < pivot) if up else (near > pivot)):
                pivot, pivot_t = near, t
        beyond = b["close"] > hi if up else b["close"] < lo
        if n_pb and not pb and beyond and not prev:
            n_rc += 1
            prev = True
            if t >= spec.earliest and not full(up):
                attempts[up] += 1
                count[up] += 1
                out.append(dict(direction="long" if up else "short", break_sod=brk["sod"], trigger_sod=b["sod"],
                                pivot_price=pivot, pivot_sod=pivot_t, flem_price=flem, flem_sod=flem_t,
                                reentry_count=n_pb, reclaim_count=n_rc, break_sequence=n_break,
                                attempt_sequence=attempts[up]))
                pivot, n_pb, n_rc, prev = None, 0, 0, beyond
                continue
        else:
            prev = beyond
        if cap > 0 and full(True) and full(False):
            break
    return out


def single_position(trades):
    """Indexes kept when a trade may only start after the last kept one ended."""
    busy, keep = None, []
    for i in sorted(range(len(trades)), key=lambda i: (trades[i][0], trades[i][2])):
        a, b, _ = trades[i]
        if busy is None or a >= busy:
            keep.append(i)
            busy = b
    return keep
