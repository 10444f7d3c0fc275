"""Oracle SQL: the same results written as plain SQL over the raw tables.

Candidates are found by comparing every break with every later bar, labels and
features by joining every bar; nothing here shares logic with the Spark jobs.
"""

from __future__ import annotations

from barloom.plans.tables import SETUP_FIELDS

SETUPS = (
    "setups0 AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in SETUP_FIELDS.items()) + " FROM orders), "
    "setups AS (SELECT *, CAST(session_date AS TIMESTAMP) + to_seconds(34200 + slot * 30) AS entry_time, "
    "CAST(session_date AS TIMESTAMP) + to_seconds(34200 + slot * 30 + bars_held * 30) AS exit_time FROM setups0), "
    "path_rows AS (SELECT s.*, 'cpcv_' || lpad(CAST(p AS VARCHAR), 3, '0') AS path_id, pnl_r - 0.1 AS executed_pnl_r "
    "FROM setups s, unnest([s.trade_no % 8 + 1, (s.trade_no + 3) % 8 + 1]) AS t(p))"
)

BARS = (
    "bars AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS session_date, "
    "CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 1800 * 1800 AS INT) AS sod, arg_min(value, ts) AS open, max(value) AS high, "
    "min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2, 3), "
    "coarse AS (SELECT symbol, session_date, sod // 3600 * 3600 AS sod, arg_min(open, sod) AS open, max(high) AS high, min(low) AS low, "
    "arg_max(close, sod) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2, 3)"
)


def zones(name: str = "zones", end: int = 7199, decision: int = 7200) -> str:
    return (
        f"{name} AS (SELECT symbol, session_date, min(sod) AS zone_first_sod, max(sod) AS zone_last_sod, {decision} AS decision_sod, "
        "max(high) AS zone_high, min(low) AS zone_low, (max(high) + min(low)) / 2 AS zone_mid, max(high) - min(low) AS zone_width, "
        "CASE WHEN max(high) + min(low) = 0 THEN 0 ELSE (max(high) - min(low)) / ((max(high) + min(low)) / 2) * 10000 END AS zone_width_bps, "
        f"count(*) AS zone_bars FROM bars WHERE sod BETWEEN 0 AND {end} GROUP BY 1, 2)"
    )


ONE_RULE = (
    "rules AS (SELECT z.*, 'base' AS variant, 'opening' AS zone_mode, 'close' AS break_mode, 10800 AS earliest, 72000 AS latest, {cap} AS cap FROM zones z)"
)
VARIANT_ROWS = [
    (1, "first_reclaim_only_baseline", "close", "opening", 10800, 72000, 1),
    (2, "multiple_reclaim_attempts", "close", "opening", 10800, 72000, 3),
    (3, "allow_wick_through_breaks", "wick", "opening", 10800, 72000, 1),
    (4, "allow_delayed_reclaim", "close", "opening", 10800, 86400, 1),
    (5, "allow_post_failed_break_repair", "wick_failed_close", "opening", 10800, 86400, 2),
    (6, "allow_multiple_same_direction_candidates", "close", "opening", 10800, 86400, 5),
    (7, "allow_midday_continuation_structure", "close", "opening", 10800, 86400, 3),
    (8, "extended_structure_zone", "close", "extended", 18000, 86400, 2),
]
ALL_RULES = (
    zones("z_open") + ", " + zones("z_ext", 14399, 14400) + ", "
    "zones AS (SELECT *, 'opening' AS zone_mode FROM z_open UNION ALL SELECT *, 'extended' FROM z_ext), "
    "variants AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in VARIANT_ROWS) + ") v(trial, variant, break_mode, zone_mode, earliest, latest, cap)), "
    "rules AS (SELECT z.*, v.variant, v.break_mode, v.earliest, v.latest, v.cap FROM zones z JOIN variants v USING (zone_mode))"
)

_K = "variant, zone_mode, symbol, session_date, s, break_sod"
FOUND = f"""
brk AS (SELECT r.variant, r.zone_mode, r.symbol, r.session_date, d.s, c.sod AS break_sod, c.sod + 3600 AS bt, c.close AS break_close,
  c.high AS break_high, c.low AS break_low, CASE WHEN d.s > 0 THEN r.zone_high ELSE r.zone_low END AS edge,
  CASE WHEN d.s > 0 THEN r.zone_low ELSE r.zone_high END AS opp, r.zone_high, r.zone_low, r.zone_mid, r.zone_width, r.zone_width_bps,
  r.earliest, r.latest, r.cap
  FROM rules r JOIN coarse c USING (symbol, session_date), (VALUES (1.0), (-1.0)) d(s)
  WHERE c.sod + 3600 >= r.decision_sod AND c.sod + 3600 <= r.latest AND CASE r.break_mode
    WHEN 'close' THEN (CASE WHEN d.s > 0 THEN c.close > r.zone_high ELSE c.close < r.zone_low END)
    WHEN 'wick' THEN (CASE WHEN d.s > 0 THEN c.high > r.zone_high ELSE c.low < r.zone_low END)
    ELSE (CASE WHEN d.s > 0 THEN c.high > r.zone_high AND NOT c.close > r.zone_high ELSE c.low < r.zone_low AND NOT c.close < r.zone_low END) END),
seq AS (SELECT b.*, f.sod, f.sod + 1800 AS t, f.close, CASE WHEN b.s > 0 THEN f.high ELSE f.low END AS fav,
  CASE WHEN b.s > 0 THEN f.low ELSE f.high END AS adv,
  (f.low <= b.zone_high AND f.high >= b.zone_low AND CASE WHEN b.s > 0 THEN f.close < f.open ELSE f.close > f.open END) AS pb,
  CASE WHEN b.s > 0 THEN f.close > b.edge ELSE f.close < b.edge END AS beyond
  FROM brk b JOIN bars f USING (symbol, session_date) WHERE f.sod + 1800 > b.bt AND f.sod + 1800 <= b.latest),
seq2 AS (SELECT *, coalesce(max(CAST(pb AS INT)) OVER (PARTITION BY {_K} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen,
  coalesce(lag(beyond) OVER (PARTITION BY {_K} ORDER BY t), CASE WHEN s > 0 THEN break_close > edge ELSE break_close < edge END) AS prev FROM seq),
ent AS (SELECT {_K}, min(t) AS entry_t FROM seq2 WHERE seen AND NOT pb AND beyond AND t >= earliest GROUP BY ALL),
inval AS (SELECT b.variant, b.zone_mode, b.symbol, b.session_date, b.s, b.break_sod, min(c.sod + 3600) AS void_t FROM brk b
  JOIN coarse c ON c.symbol = b.symbol AND c.session_date = b.session_date AND c.sod >= b.break_sod
  AND CASE WHEN b.s > 0 THEN c.close < b.opp ELSE c.close > b.opp END GROUP BY ALL),
agg AS (SELECT {_K}, any_value(bt) AS bt, any_value(entry_t) AS entry_t, any_value(break_close) AS break_close, any_value(break_high) AS break_high,
  any_value(break_low) AS break_low, any_value(zone_high) AS zone_high, any_value(zone_low) AS zone_low, any_value(zone_mid) AS zone_mid,
  any_value(zone_width) AS zone_width, any_value(zone_width_bps) AS zone_width_bps, any_value(cap) AS cap,
  max(CASE WHEN t = entry_t THEN sod END) AS trigger_sod, max(CASE WHEN t = entry_t THEN close END) AS entry_price,
  count(*) FILTER (WHERE pb) AS reentry_count, count(*) FILTER (WHERE seen AND NOT pb AND beyond AND NOT prev) AS reclaim_count,
  first(adv ORDER BY s * adv, t) FILTER (WHERE seen OR pb) AS pivot_price, first(t ORDER BY s * adv, t) FILTER (WHERE seen OR pb) AS pivot_sod,
  first(fav ORDER BY s * fav DESC, t DESC) AS row_fav, first(t ORDER BY s * fav DESC, t DESC) AS row_fav_t
  FROM seq2 JOIN ent USING ({_K}) WHERE t <= entry_t GROUP BY {_K}),
found0 AS (SELECT a.*, CASE WHEN a.s > 0 THEN 'long' ELSE 'short' END AS direction,
  CASE WHEN a.s > 0 THEN (CASE WHEN row_fav >= break_high THEN row_fav ELSE break_high END) ELSE (CASE WHEN row_fav <= break_low THEN row_fav ELSE break_low END) END AS flem_price,
  CASE WHEN a.s > 0 THEN (CASE WHEN row_fav >= break_high THEN row_fav_t ELSE bt END) ELSE (CASE WHEN row_fav <= break_low THEN row_fav_t ELSE bt END) END AS flem_sod
  FROM agg a LEFT JOIN inval i USING ({_K}) WHERE i.void_t IS NULL OR a.entry_t < i.void_t)"""

CAPPED = """
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, zone_mode, symbol, session_date, direction ORDER BY break_sod, trigger_sod) AS rn
  FROM found0) WHERE cap <= 0 OR rn <= cap)"""
DEDUPED = """
found1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, zone_mode, symbol, session_date, direction, trigger_sod ORDER BY break_sod) AS dd FROM found0) WHERE dd = 1),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, zone_mode, symbol, session_date, direction ORDER BY break_sod, trigger_sod) AS rn
  FROM found1) WHERE cap <= 0 OR rn <= cap)"""


def clock(date: str, sod: str) -> str:
    return f"strftime(CAST({date} AS TIMESTAMP) + to_seconds({sod}), '%Y-%m-%dT%H:%M:%S')"


FINAL = f"""
cands0 AS (SELECT *, symbol || '-' || CAST(session_date AS VARCHAR) || '-break_reentry_reclaim_' || direction || '-' || {clock('session_date', 'trigger_sod')} AS candidate_id,
  entry_t AS decision_sod,
  greatest(CASE WHEN s > 0 THEN break_high - zone_high ELSE zone_low - break_low END, 0) AS first_break_wick_excess_points,
  greatest(CASE WHEN s > 0 THEN break_close - zone_high ELSE zone_low - break_close END, 0) AS first_break_close_excess_points,
  CAST(greatest(reentry_count + reclaim_count - 1, 0) AS DOUBLE) AS pivot_duration_bars,
  CAST(greatest((entry_t - bt) // 1800, 0) AS DOUBLE) AS continuation_delay_bars,
  CASE WHEN zone_width = 0 THEN 0 ELSE greatest(CASE WHEN s > 0 THEN zone_high - pivot_price ELSE pivot_price - zone_low END, 0) / zone_width END AS deepest_zone_retrace_fraction,
  CASE WHEN zone_width = 0 THEN 0 ELSE greatest(CASE WHEN s > 0 THEN entry_price - pivot_price ELSE pivot_price - entry_price END, 0) / zone_width END AS continuation_displacement_ratio,
  CASE WHEN zone_width = 0 THEN 0 ELSE greatest(CASE WHEN s > 0 THEN entry_price - zone_high ELSE zone_low - entry_price END, 0) / zone_width END AS post_reclaim_close_strength
  FROM found),
cands AS (SELECT *, CASE WHEN first_break_wick_excess_points > 0 AND first_break_close_excess_points <= 0 THEN 1e0 ELSE 0e0 END AS first_break_wick_only,
  CASE WHEN first_break_close_excess_points > 0 THEN 1e0 ELSE 0e0 END AS first_break_close_confirmed,
  CASE WHEN first_break_close_excess_points > 0 AND deepest_zone_retrace_fraction <= 0.35 AND post_reclaim_close_strength >= 0.5 THEN 'clean_break_continuation'
    WHEN deepest_zone_retrace_fraction >= 0.65 THEN 'deep_retrace_repair'
    WHEN first_break_wick_excess_points > 0 AND first_break_close_excess_points <= 0 AND reclaim_count >= 1 THEN 'wick_reclaim_repair'
    WHEN post_reclaim_close_strength < 0.2 OR continuation_displacement_ratio < 0.35 THEN 'weak_follow_through'
    ELSE 'balanced_reclaim_continuation' END AS setup_subtype FROM cands0)"""

#: One row per candidate id (several breaks may lead to one entry).
UNIQUE = "ucands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY break_sod) AS un FROM cands) WHERE un = 1)"

NUMBERED = (
    "nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date, sod) AS bar_no, "
    "row_number() OVER (PARTITION BY symbol, session_date ORDER BY sod) AS pos FROM bars)"
)


def canonical(cap: int = 0) -> str:
    return ", ".join([BARS, zones(), ONE_RULE.format(cap=cap), FOUND, CAPPED, FINAL])


def universe() -> str:
    return ", ".join([BARS, ALL_RULES, FOUND, DEDUPED, FINAL])


def labels(source: str = "ucands", key: str = "candidate_id", horizon: str = "20", stop: str = "1.0", target: str = "1.5", extra: str = "") -> str:
    """Label CTEs over ``source`` (columns of cands); ``extra`` adds key columns."""
    k = f"{key}{', ' + extra if extra else ''}"
    return f"""{NUMBERED},
lsrc AS (SELECT c.*, greatest(zone_width * {stop}, 0.25) AS risk, CASE WHEN direction = 'long' THEN 1.0 ELSE -1.0 END AS sg,
  (SELECT count(*) FROM nb WHERE nb.symbol = c.symbol AND (nb.session_date < c.session_date OR (nb.session_date = c.session_date AND nb.sod < c.decision_sod))) + 1 AS start_no
  FROM {source} c),
lpath AS (SELECT {k}, l.sg, l.entry_price, l.entry_price - l.sg * l.risk AS stop_price, l.entry_price + l.sg * l.zone_width * {target} AS target_price, l.risk,
  n.bar_no - l.start_no + 1 AS k, n.session_date AS bdate, n.sod AS bsod, n.open AS bopen, n.high, n.low, n.close AS bclose
  FROM lsrc l JOIN nb n ON n.symbol = l.symbol AND n.bar_no BETWEEN l.start_no AND l.start_no + {horizon} - 1),
lhit AS (SELECT *, CASE WHEN sg > 0 THEN low <= stop_price ELSE high >= stop_price END AS sh, CASE WHEN sg > 0 THEN high >= target_price ELSE low <= target_price END AS th FROM lpath),
lend AS (SELECT {k}, coalesce(min(k) FILTER (WHERE sh OR th), max(k)) AS ek FROM lhit GROUP BY {k}),
lagg AS (SELECT {k}, any_value(ek) AS bars_held, greatest(max(CASE WHEN sg > 0 THEN high - entry_price ELSE entry_price - low END), 0) AS mfe,
  least(min(CASE WHEN sg > 0 THEN low - entry_price ELSE entry_price - high END), 0) AS mae,
  bool_or(sh) FILTER (WHERE k = ek) AS sh, bool_or(th) FILTER (WHERE k = ek) AS th, max(bclose) FILTER (WHERE k = ek) AS last_close,
  max({clock('bdate', 'bsod')}) FILTER (WHERE k = ek) AS exit_time
  FROM lhit JOIN lend USING ({k}) WHERE k <= ek GROUP BY {k}),
labels AS (SELECT l.*, {clock('l.session_date', 'l.decision_sod')} AS entry_time, l.entry_price - l.sg * l.risk AS stop_price, l.entry_price + l.sg * l.zone_width * {target} AS target_price,
  a.exit_time, coalesce(a.bars_held, 0) AS bars_held, coalesce(a.mfe, 0) AS mfe, coalesce(a.mae, 0) AS mae,
  CASE WHEN a.th AND NOT a.sh THEN 1 ELSE 0 END AS label,
  CASE WHEN a.sh AND a.th THEN 'ambiguous_stop_first' WHEN a.sh THEN 'stop' WHEN a.th THEN 'target' ELSE 'timeout' END AS outcome,
  CASE WHEN a.sh THEN l.entry_price - l.sg * l.risk WHEN a.th THEN l.entry_price + l.sg * l.zone_width * {target} ELSE a.last_close END AS exit_price
  FROM lsrc l LEFT JOIN lagg a USING ({k})),
labelled AS (SELECT *, l.sg * (coalesce(exit_price, entry_price) - entry_price) / l.risk AS pnl_r FROM labels l)"""


def r6(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {alias or expr}"
