"""Queries over point-in-time features of candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import candidates as C
from barloom.operators import exit_paths as EP
from barloom.operators import exits as E
from barloom.operators import features as X
from barloom.operators import labels as L
from barloom.operators import matching as M
from barloom.operators.calibration import feature_validation
from barloom.operators.diagnostics import structure_families
from barloom.operators.indicators import indicators, recursive_indicators, rolling_indicators, snapshot
from barloom.plans import oracle_sql as O
from barloom.plans.registry import query
from barloom.plans.study_queries import _cands, _out
from barloom.plans.tables import STUDY, study_bars
from barloom.schemas import SESSION_KEY
from barloom.session import cut

_BASE = f"WITH {O.canonical()}, {O.UNIQUE}"
_PRE = """pre AS (SELECT c.candidate_id, c.direction, c.break_sod, c.trigger_sod, c.pivot_sod, c.entry_price, c.pivot_price, c.flem_price, c.zone_high, c.zone_low, greatest(c.zone_width, 0.25) AS zw,
 b.sod, b.open, b.high, b.low, b.close, b.volume, row_number() OVER (PARTITION BY c.candidate_id ORDER BY b.sod) AS pos, row_number() OVER (PARTITION BY c.candidate_id ORDER BY b.sod DESC) AS back,
 lag(b.close) OVER (PARTITION BY c.candidate_id ORDER BY b.sod) AS pc FROM ucands c JOIN bars b ON b.symbol = c.symbol AND b.session_date = c.session_date AND b.sod <= c.trigger_sod)"""


def _matrix(spark, d):
    return X.feature_matrix(study_bars(spark, d), _cands(spark, d), STUDY)


def _pick(spark, d, cols):
    return _out(_matrix(spark, d).select("candidate_id", *cols))


@query(
    "feature_context",
    f"""{_BASE}, {_PRE}, g AS (SELECT candidate_id, first(open ORDER BY sod) AS o1, first(close ORDER BY sod DESC) AS c1, max(high) - min(low) AS rng, sum(volume) AS vol FROM pre GROUP BY 1),
    ses AS (SELECT symbol, session_date, arg_min(open, sod) AS so, arg_max(close, sod) AS sc FROM bars GROUP BY 1, 2), gap AS (SELECT symbol, session_date, coalesce((so - lag(sc) OVER w) / nullif(lag(sc) OVER w, 0), 0) AS gap FROM ses WINDOW w AS (PARTITION BY symbol ORDER BY session_date))
    SELECT c.candidate_id, CAST(CASE WHEN c.direction = 'long' THEN 1 ELSE 0 END AS INT) AS direction_long, {O.r6('zone_width')}, {O.r6('zone_width_bps')}, {O.r6('zone_mid', 'zone_midpoint')}, {O.r6('entry_price - zone_mid', 'entry_distance_from_midpoint')}, {O.r6('entry_price - zone_high', 'entry_distance_from_zone_high')}, {O.r6('entry_price - zone_low', 'entry_distance_from_zone_low')}, trigger_sod AS trigger_seconds_after_open, {O.r6('(c1 - o1) / o1', 'pre_trigger_return')}, {O.r6('rng', 'pre_trigger_range')}, {O.r6('vol', 'pre_trigger_volume')}, {O.r6('gap', 'prior_close_gap')}
    FROM ucands c JOIN g USING (candidate_id) JOIN gap USING (symbol, session_date)""",
)
def feature_context(spark, d):
    """Geometry, pre-trigger context and the opening gap."""
    return _pick(spark, d, ["direction_long", "zone_width", "zone_width_bps", "zone_midpoint", "entry_distance_from_midpoint", "entry_distance_from_zone_high",
                            "entry_distance_from_zone_low", "trigger_seconds_after_open", "pre_trigger_return", "pre_trigger_range", "pre_trigger_volume", "prior_close_gap"])


_CROSS = "CASE WHEN direction = 'long' THEN high > zone_high ELSE low < zone_low END"


@query(
    "feature_break_lab",
    f"""{_BASE}, {_PRE}, bb AS (SELECT candidate_id, coalesce(max(sod) FILTER (WHERE sod = break_sod), min(sod) FILTER (WHERE {_CROSS})) AS bsod FROM pre GROUP BY 1),
    p6 AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY sod DESC) AS r FROM pre JOIN bb USING (candidate_id) WHERE sod < bsod),
    pr AS (SELECT candidate_id, (max(high) - min(low)) / count(*) AS rr, avg(volume) AS rv FROM p6 WHERE r <= 6 GROUP BY 1),
    sp AS (SELECT candidate_id, count(*) FILTER (WHERE sod >= 7200) AS n FROM pre JOIN bb USING (candidate_id) WHERE sod <= bsod GROUP BY 1),
    x AS (SELECT p.*, CASE WHEN direction = 'long' THEN close - zone_high ELSE zone_low - close END AS mv, greatest(high - low, 1e-9) AS br FROM pre p JOIN bb ON p.candidate_id = bb.candidate_id AND p.sod = bb.bsod)
    SELECT x.candidate_id, {O.r6('greatest(mv / zw, 0)', 'break_close_distance_to_zone')}, {O.r6('abs(close - open) / br', 'break_body_fraction')}, {O.r6('CAST(greatest(n - 1, 0) AS DOUBLE)', 'break_speed_bars')}, {O.r6('CASE WHEN rv > 0 THEN volume / rv ELSE 0 END', 'break_volume_surge')}, {O.r6('CASE WHEN rr > 0 THEN br / rr ELSE 0 END', 'break_range_expansion')}, {O.r6('greatest(mv, 0) / br', 'break_efficiency_ratio')}
    FROM x LEFT JOIN pr USING (candidate_id) JOIN sp USING (candidate_id)""",
)
def feature_break_lab(spark, d):
    """Quality of the break bar."""
    return _pick(spark, d, ["break_close_distance_to_zone", "break_body_fraction", "break_speed_bars", "break_volume_surge", "break_range_expansion", "break_efficiency_ratio"])


_PIV = """v AS (SELECT *, lag(low) OVER w AS pl, lag(high) OVER w AS ph, row_number() OVER (PARTITION BY candidate_id ORDER BY sod DESC) AS vb FROM pre WHERE sod > break_sod WINDOW w AS (PARTITION BY candidate_id ORDER BY sod))"""


@query(
    "feature_reclaim_lab",
    f"""{_BASE}, {_PRE}, {_PIV}, g AS (SELECT candidate_id, count(*) AS n, count(*) FILTER (WHERE high >= pl AND low <= ph) AS ov, count(*) FILTER (WHERE CASE WHEN direction = 'long' THEN close < zone_high ELSE close > zone_low END) AS fl FROM v GROUP BY 1)
    SELECT candidate_id, {O.r6('abs(entry_price - pivot_price) / zw', 'pivot_symmetry')}, {O.r6('ov / n', 'pivot_overlap_ratio')}, {O.r6('CAST(n - 1 AS DOUBLE)', 'reclaim_latency_bars')}, {O.r6("CASE WHEN direction = 'long' THEN close - low ELSE high - close END / greatest(high - low, 1e-9)", 'reclaim_close_location')}, {O.r6('abs(close - open) / greatest(high - low, 1e-9)', 'reclaim_body_strength')}, {O.r6('CAST(fl AS DOUBLE)', 'reclaim_failure_count')}
    FROM v JOIN g USING (candidate_id) WHERE vb = 1""",
)
def feature_reclaim_lab(spark, d):
    """Micro-structure of the reclaim."""
    return _pick(spark, d, ["pivot_symmetry", "pivot_overlap_ratio", "reclaim_latency_bars", "reclaim_close_location", "reclaim_body_strength", "reclaim_failure_count"])


@query(
    "feature_sequence_lab",
    f"""{_BASE}, {_PRE}, q0 AS (SELECT *, CASE WHEN direction = 'long' THEN close > open ELSE close < open END AS ind FROM pre WHERE sod >= pivot_sod),
    q1 AS (SELECT *, sum(CASE WHEN ind THEN 0 ELSE 1 END) OVER (PARTITION BY candidate_id ORDER BY sod ROWS UNBOUNDED PRECEDING) AS isl FROM q0),
    run AS (SELECT candidate_id, max(n) AS mr FROM (SELECT candidate_id, isl, count(*) FILTER (WHERE ind) AS n FROM q1 GROUP BY 1, 2) GROUP BY 1),
    q AS (SELECT candidate_id, count(*) AS n, sum(abs(close - open)) AS bs, count(*) FILTER (WHERE ind) AS ni, first(abs(close - open) ORDER BY sod DESC) AS bl FROM q0 GROUP BY 1),
    tr AS (SELECT candidate_id, back, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM pre), atr AS (SELECT candidate_id, avg(tr) AS atr FROM tr WHERE back <= 14 GROUP BY 1),
    day AS (SELECT candidate_id, max(high) AS sh, min(low) AS sl, max(high) - min(low) AS dr FROM pre GROUP BY 1),
    z AS (SELECT c.*, q.n, q.bs, q.ni, q.bl, run.mr, atr.atr, day.sh, day.sl, day.dr, abs(flem_price - pivot_price) AS reach FROM ucands c LEFT JOIN q USING (candidate_id) LEFT JOIN run USING (candidate_id) JOIN atr USING (candidate_id) JOIN day USING (candidate_id))
    SELECT candidate_id, {O.r6("CASE WHEN n > 0 AND reach <> 0 THEN greatest(CASE WHEN direction = 'long' THEN (entry_price - pivot_price) / (flem_price - pivot_price) ELSE (pivot_price - entry_price) / (pivot_price - flem_price) END, 0) ELSE 0 END", 'retrace_at_entry')},
    {O.r6('CASE WHEN n > 0 THEN reach ELSE 0 END', 'pivot_flem_dist')}, {O.r6('CAST(CASE WHEN n > 0 THEN greatest(trigger_sod - pivot_sod, 0) ELSE 0 END AS DOUBLE)', 'time_since_pivot_sec')}, {O.r6('coalesce(bl, 0)', 'body_last')}, {O.r6('coalesce(bs, 0)', 'body_sum')}, {O.r6('coalesce(bs / n, 0)', 'body_mean')}, {O.r6('coalesce(ni / n, 0)', 'in_dir_ratio')}, {O.r6('CAST(coalesce(mr, 0) AS DOUBLE)', 'max_in_dir_run')}, {O.r6('CAST(coalesce(n, 0) AS DOUBLE)', 'bars_since_pivot')},
    {O.r6("CASE WHEN n > 0 AND dr > 0 THEN abs(flem_price - CASE WHEN direction = 'long' THEN zone_high ELSE zone_low END) / dr ELSE 0 END", 'zone_over_range')}, {O.r6('CASE WHEN n > 0 AND dr > 0 THEN reach / dr ELSE 0 END', 'pivot_over_range')}, {O.r6("CASE WHEN n > 0 AND atr > 0 THEN CASE WHEN direction = 'long' THEN sh - entry_price ELSE entry_price - sl END / atr ELSE 0 END", 'dist_to_extrema_atr')}, {O.r6("CASE WHEN n > 0 AND atr > 0 THEN CASE WHEN direction = 'long' THEN sh - zone_high ELSE zone_low - sl END / atr ELSE 0 END", 'zone_to_extrema_atr')} FROM z""",
)
def feature_sequence_lab(spark, d):
    """Sequence snapshot between pivot and entry, with the true-range average."""
    return _pick(spark, d, X.FAMILY_COLUMNS["sequence_structure"])


def _reg(n):
    return f"""r{n} AS (SELECT candidate_id, coalesce(stddev_samp(close / pc - 1), 0) AS vol{n}, coalesce(sum(abs(close / pc - 1)) / greatest(abs(round(sum(close / pc - 1), 12)), 1e-9), 0) AS chop{n}, max(high) - min(low) AS rng{n}, (first(close ORDER BY sod DESC) - first(open ORDER BY sod)) / first(open ORDER BY sod) AS tr{n} FROM pre WHERE back <= {n} GROUP BY 1)"""


@query(
    "feature_regime",
    f"""{_BASE}, {_PRE}, {_reg(10)}, {_reg(30)}, z AS (SELECT *, CASE WHEN vol30 > 0 THEN vol10 / vol30 ELSE 0 END AS vr, CASE WHEN vol10 > 0 THEN tr10 / vol10 ELSE 0 END AS ts10, CASE WHEN vol30 > 0 THEN tr30 / vol30 ELSE 0 END AS ts30 FROM ucands JOIN r10 USING (candidate_id) JOIN r30 USING (candidate_id) JOIN (SELECT candidate_id, count(*) AS n FROM pre GROUP BY 1) USING (candidate_id))
    SELECT candidate_id, {O.r6('vol10', 'reg_vol_10')}, {O.r6('vol30', 'reg_vol_30')}, {O.r6('vr', 'reg_vol_ratio')}, {O.r6('tr10', 'reg_trend_10')}, {O.r6('tr30', 'reg_trend_30')}, {O.r6('ts10', 'reg_trend_strength_10')}, {O.r6('ts30', 'reg_trend_strength_30')}, {O.r6('rng10 / greatest(zone_width, 0.25)', 'reg_range_ratio_10')}, {O.r6('rng30 / greatest(zone_width, 0.25)', 'reg_range_ratio_30')}, {O.r6('CAST(n AS DOUBLE)', 'reg_pretrigger_bar_count')}, CASE WHEN vr > 1.1 THEN 1e0 ELSE 0e0 END AS reg_high_vol_state, CASE WHEN abs(ts10) > 1 AND chop10 < 8 THEN 1e0 ELSE 0e0 END AS reg_trending_state, {O.r6('chop10', 'reg_chop_10')}, {O.r6('chop30', 'reg_chop_30')} FROM z""",
)
def feature_regime(spark, d):
    """Volatility and trend regime over the last 10 and 30 bars."""
    return _pick(spark, d, X.FAMILY_COLUMNS["regime_features"])


@query(
    "feature_market_raw",
    f"""{_BASE}, {_PRE}, s AS (SELECT *, abs(close - pc) AS dc, CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END AS bsh, CASE WHEN high > low THEN greatest(high - low - abs(close - open), 0) / (high - low) ELSE 0 END AS wsh, sign(close - open) AS sd FROM pre),
    a AS (SELECT candidate_id, first(close ORDER BY sod DESC) AS c1, first(close ORDER BY sod) AS c0, coalesce(sum(dc), 0) AS path FROM s GROUP BY 1),
    w AS (SELECT *, lag(low) OVER ww AS pl, lag(high) OVER ww AS ph, lag(close) OVER ww AS pcw FROM s WHERE back <= 16 WINDOW ww AS (PARTITION BY candidate_id ORDER BY sod)),
    wa AS (SELECT candidate_id, count(*) AS n, abs(first(close ORDER BY sod DESC) - first(close ORDER BY sod)) AS net, coalesce(sum(abs(close - pcw)), 0) AS path, avg(bsh) AS body, avg(wsh) AS wick, count(*) FILTER (WHERE high >= pl AND low <= ph) AS ov, first(open ORDER BY sod) AS o0, first(close ORDER BY sod DESC) AS c1, max(high) AS wh, min(low) AS wl FROM w GROUP BY 1),
    nz AS (SELECT candidate_id, sd, lag(sd) OVER (PARTITION BY candidate_id ORDER BY sod) AS ps FROM s WHERE back <= 16 AND sd <> 0), al AS (SELECT candidate_id, count(*) AS m, count(*) FILTER (WHERE ps <> sd) AS alt FROM nz GROUP BY 1),
    {_PIV}, va AS (SELECT candidate_id, count(*) AS vn, max(high) AS vh, min(low) AS vl, count(*) FILTER (WHERE high >= pl AND low <= ph) AS vo, count(*) FILTER (WHERE CASE WHEN direction = 'long' THEN close <= zone_high ELSE close >= zone_low END) AS wk FROM v GROUP BY 1),
    z AS (SELECT c.*, greatest(zone_width, 0.25) AS zw, a.c0, a.path AS sp, wa.n AS wn, wa.net, wa.path AS wp, wa.body, wa.wick, wa.ov, wa.o0, wa.c1, wa.wh, wa.wl, al.m, al.alt, va.* EXCLUDE (candidate_id) FROM ucands c JOIN a USING (candidate_id) JOIN wa USING (candidate_id) LEFT JOIN al USING (candidate_id) JOIN va USING (candidate_id))
    SELECT candidate_id, {O.r6('CASE WHEN sp > 0 THEN abs(c1 - c0) / sp ELSE 0 END', 'directional_efficiency_open_to_now')}, {O.r6('CASE WHEN wp > 0 THEN net / wp ELSE 0 END', 'recent_directional_efficiency')}, {O.r6('body', 'body_to_range_ratio_recent')}, {O.r6('wick', 'wick_rejection_ratio_recent')}, {O.r6('CASE WHEN wn >= 3 AND m >= 2 THEN alt / (m - 1) ELSE 0 END', 'alternating_bar_ratio')}, {O.r6('CASE WHEN wn >= 3 THEN ov / (wn - 1) ELSE 0 END', 'local_swing_overlap_score')}, {O.r6("greatest(CASE WHEN direction = 'long' THEN c1 - o0 ELSE o0 - c1 END, 0) / zw / wn", 'impulse_speed_score')}, {O.r6("greatest(CASE WHEN direction = 'long' THEN c1 - vl ELSE vh - c1 END, 0) / zw / vn", 'repair_speed_score')}, {O.r6('greatest(0, 1 - least((vh - vl) / zw, 2) / 2)', 'flem_compression_score')}, {O.r6('CASE WHEN vn >= 3 THEN 1 - vo / (vn - 1) ELSE 1 END', 'pivot_cleanliness_score')}, {O.r6('least(abs(entry_price - wh), abs(entry_price - wl)) / zw', 'distance_to_recent_high_low')}, {O.r6('CAST(wk AS DOUBLE)', 'failed_followthrough_count')} FROM z""",
)
def feature_market_raw(spark, d):
    """Twelve raw market-state features."""
    return _pick(spark, d, X.MARKET_RAW)


@query(
    "feature_recomputed_context",
    f"""{_BASE}, {_PRE}, bb AS (SELECT candidate_id, coalesce(max(sod) FILTER (WHERE sod = break_sod), min(sod) FILTER (WHERE {_CROSS})) AS bsod FROM pre GROUP BY 1),
    p AS (SELECT pre.*, bsod FROM pre JOIN bb USING (candidate_id)), ba AS (SELECT candidate_id, high AS bh, low AS bl, close AS bc FROM p WHERE sod = bsod),
    g AS (SELECT candidate_id, any_value(direction) AS direction, any_value(zone_high) AS zh, any_value(zone_low) AS zl, any_value(entry_price) AS ep, count(*) FILTER (WHERE sod > bsod) AS na,
     count(*) FILTER (WHERE sod > bsod AND CASE WHEN direction = 'long' THEN low <= zone_high ELSE high >= zone_low END) AS re, count(*) FILTER (WHERE sod > bsod AND CASE WHEN direction = 'long' THEN low <= zone_high AND close > zone_high ELSE high >= zone_low AND close < zone_low END) AS rc,
     min(low) FILTER (WHERE sod > bsod) AS lo, max(high) FILTER (WHERE sod > bsod) AS hi, max(close) FILTER (WHERE sod > bsod) AS ch, min(close) FILTER (WHERE sod > bsod) AS cl, count(*) FILTER (WHERE sod > bsod AND CASE WHEN direction = 'long' THEN close < zone_low ELSE close > zone_high END) AS ov, count(*) FILTER (WHERE sod >= bsod AND sod < trigger_sod) AS dl FROM p GROUP BY 1),
    z AS (SELECT *, greatest(CASE WHEN direction = 'long' THEN bh - zh ELSE zl - bl END, 0) AS wx, greatest(CASE WHEN direction = 'long' THEN bc - zh ELSE zl - bc END, 0) AS cx, coalesce(nullif(zh - zl, 0), 1) AS w FROM g JOIN ba USING (candidate_id))
    SELECT candidate_id, CASE WHEN wx > 0 AND cx <= 0 THEN 1e0 ELSE 0e0 END AS first_break_wick_only, CASE WHEN cx > 0 THEN 1e0 ELSE 0e0 END AS first_break_close_confirmed, {O.r6('wx', 'first_break_wick_excess_points')}, {O.r6('cx', 'first_break_close_excess_points')}, {O.r6('CAST(na AS DOUBLE)', 'pivot_duration_bars')}, {O.r6('CAST(dl AS DOUBLE)', 'continuation_delay_bars')}, {O.r6('CAST(re AS DOUBLE)', 'reentry_count')}, {O.r6('CAST(rc AS DOUBLE)', 'reclaim_count')}, {O.r6("CASE WHEN na > 0 THEN greatest(CASE WHEN direction = 'long' THEN zh - lo ELSE hi - zl END, 0) / w ELSE 0 END", 'deepest_zone_retrace_fraction')}, {O.r6('abs(ep - bc) / w', 'continuation_displacement_ratio')}, {O.r6("CASE WHEN na > 0 THEN greatest(CASE WHEN direction = 'long' THEN ch - zh ELSE zl - cl END, 0) / w ELSE 0 END", 'post_reclaim_close_strength')}, CASE WHEN ov > 0 THEN 1e0 ELSE 0e0 END AS opposite_boundary_close_violation FROM z""",
)
def feature_recomputed_context(spark, d):
    """Break context recomputed from bars for candidates without a trace."""
    return _out(X.recomputed_break_context(study_bars(spark, d), _cands(spark, d), STUDY))


@query("feature_audit", f"{_BASE} SELECT c.candidate_id, 'pass' AS status, (SELECT max({O.clock('b.session_date', 'b.sod')}) FROM bars b WHERE b.symbol = c.symbol AND b.session_date = c.session_date AND b.sod < c.decision_sod) AS latest_feature_timestamp, {O.clock('c.session_date', 'c.decision_sod')} AS feature_cutoff_time FROM ucands c")
def feature_audit(spark, d):
    """Latest bar used per candidate (strict backward as-of)."""
    return X.feature_audit(study_bars(spark, d), _cands(spark, d), STUDY).drop("issues")


@query("feature_audit_summary", f"{_BASE} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS failed, '' AS issues FROM ucands")
def feature_audit_summary(spark, d):
    a = X.audit_summary(X.feature_audit(study_bars(spark, d), _cands(spark, d), STUDY))
    return a.withColumn("issues", F.array_join("issues", "|"))


@query("feature_family_projection", f"{_BASE}, {_PRE}, g AS (SELECT candidate_id, max(high) - min(low) AS rng FROM pre GROUP BY 1) SELECT 27 + 7 AS columns, count(*) AS rows, {O.r6('sum(rng)', 'range_sum')} FROM ucands JOIN g USING (candidate_id)")
def feature_family_projection(spark, d):
    """One feature family: a pure projection of the matrix."""
    f = X.apply_feature_family(_matrix(spark, d), "context_plus_reclaim")
    return _out(f.agg(F.lit(len(f.columns)).alias("columns"), F.count(F.lit(1)).alias("rows"), F.sum("pre_trigger_range").alias("range_sum")))


_LAB = f"{_BASE}, {O.labels()}"


@query(
    "structure_lab_families",
    f"""{_LAB}, f AS (SELECT *, (CASE WHEN first_break_close_confirmed > 0 THEN 'close_break' ELSE 'wick_break' END) || ':' || (CASE WHEN deepest_zone_retrace_fraction <= 0.35 THEN 'shallow' ELSE 'deep' END) || ':' || (CASE WHEN reclaim_count >= 2 THEN 'multi_reclaim' ELSE 'single_reclaim' END) || ':' || (CASE WHEN post_reclaim_close_strength >= 0.5 THEN 'strong_cont' ELSE 'weak_cont' END) AS family FROM labelled)
    SELECT family, count(*) AS count, {O.r6('avg(label)', 'positive_rate')}, {O.r6('avg(pnl_r)', 'avg_pnl_r')}, {O.r6('avg(reclaim_count)', 'reclaim_mean')}, {O.r6('avg(deepest_zone_retrace_fraction)', 'retrace_mean')}, {O.r6('avg(post_reclaim_close_strength)', 'continuation_strength_mean')} FROM f GROUP BY 1""",
)
def structure_lab_families(spark, d):
    """Structure families of labelled candidates."""
    return _out(structure_families(_labelled(spark, d)))


def _labelled(spark, d):
    """Candidates with their labels; one row per candidate id."""
    c = cut(_cands(spark, d))
    lab = L.triple_barrier(study_bars(spark, d), c, STUDY).select(
        "candidate_id", "label", "outcome", "pnl_r", "stop_price", "target_price", "bars_held", "mfe", "mae", "exit_time"
    )
    return C.first_per_id(c).join(lab, "candidate_id")


@query("feature_validation_candidates", None)
def feature_validation_candidates(spark, d):
    """Validation of the whole candidate feature matrix."""
    m = cut(_matrix(spark, d))
    lab = L.triple_barrier(study_bars(spark, d), _cands(spark, d), STUDY).select("candidate_id", "label")
    cols = [c for c in m.columns if c not in ("candidate_id", "symbol", "session_date", "direction", "setup_subtype")]
    return _out(feature_validation(m.join(lab, "candidate_id"), cols))


# --------------------------------------------------------------- indicators


_ROLL = """x AS (SELECT *, (high + low + close) / 3 AS tp, lag((high + low + close) / 3) OVER w AS ptp, lag(close) OVER w AS pc FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
    y AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, count(*) OVER v AS n, stddev_samp(close) OVER v AS sd, sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) OVER v AS up, sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) OVER v AS dn, max(high) OVER v - min(low) OVER v AS span FROM x WINDOW v AS (PARTITION BY symbol ORDER BY bar_no ROWS 13 PRECEDING)),
    z AS (SELECT *, avg(tr) OVER v AS atr, sum(tr) OVER v AS str FROM y WINDOW v AS (PARTITION BY symbol ORDER BY bar_no ROWS 13 PRECEDING)),
    ro AS (SELECT symbol, session_date, sod, bar_no, CASE WHEN n = 14 THEN atr END AS atr, CASE WHEN n = 14 THEN sd END AS stddev, CASE WHEN n = 14 THEN CASE WHEN up + dn > 0 THEN 100 * up / (up + dn) ELSE 50 END END AS mfi, CASE WHEN n = 14 AND span > 0 THEN 100 * log10(str / span) / log10(14) END AS choppiness_index FROM z)"""
_RECUR = """xr AS (SELECT symbol, session_date, sod, bar_no, close, greatest(coalesce(close - lag(close) OVER w, 0), 0) AS g0, greatest(-coalesce(close - lag(close) OVER w, 0), 0) AS l0 FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
    r AS (SELECT symbol, bar_no, close AS ema, g0 AS g, l0 AS l FROM xr WHERE bar_no = 1 UNION ALL SELECT x.symbol, x.bar_no, 2.0 / 21 * x.close + (1 - 2.0 / 21) * r.ema, x.g0 / 14 + r.g * 13 / 14, x.l0 / 14 + r.l * 13 / 14 FROM r JOIN xr x ON x.symbol = r.symbol AND x.bar_no = r.bar_no + 1),
    rc AS (SELECT symbol, session_date, sod, bar_no, ema, CASE WHEN g + l > 0 THEN 100 * g / (g + l) ELSE 50 END AS rsi FROM r JOIN xr USING (symbol, bar_no))"""
_SIX = ["atr", "stddev", "mfi", "choppiness_index", "ema", "rsi"]


@query(
    "indicator_rolling",
    f"WITH {O.BARS}, {O.NUMBERED}, {_ROLL} SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, sod, bar_no, {', '.join(O.r6(c) for c in _SIX[:4])} FROM ro",
)
def indicator_rolling(spark, d):
    """Rolling indicators over each symbol's whole history, in blocks with a halo."""
    return _out(rolling_indicators(study_bars(spark, d), block=512))


@query("indicator_recursive", f"WITH RECURSIVE {O.BARS}, {O.NUMBERED}, {_RECUR} SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, sod, bar_no, {O.r6('ema')}, {O.r6('rsi')} FROM rc")
def indicator_recursive(spark, d):
    """Exponential average and Wilder strength as composed affine maps."""
    return _out(recursive_indicators(study_bars(spark, d), block=512))


@query(
    "indicator_snapshot",
    f"""{_BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {O.NUMBERED}, {_ROLL}, {_RECUR},
    k AS (SELECT c.candidate_id, c.symbol, (SELECT max(bar_no) FROM nb WHERE nb.symbol = c.symbol AND (nb.session_date < c.session_date OR (nb.session_date = c.session_date AND nb.sod < c.decision_sod))) AS bar_no FROM ucands c)
    SELECT candidate_id, {', '.join(O.r6(c, 'eng_' + c) for c in _SIX)} FROM k LEFT JOIN ro USING (symbol, bar_no) LEFT JOIN rc USING (symbol, bar_no)""",
)
def indicator_snapshot(spark, d):
    """All six indicators of the last bar strictly before each cutoff."""
    b = study_bars(spark, d)
    return _out(snapshot(_cands(spark, d), indicators(b, block=512), _SIX).select("candidate_id", *[f"eng_{c}" for c in _SIX]))


# --------------------------------------------------------- trade alignment

_MAN = "mt AS (SELECT event_id AS example_id, event_type AS symbol, CAST(ts AS DATE) AS session_date, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS sod, value FROM events)"


def _examples(spark, d):
    """Ticks as hand-marked trades."""
    from barloom.plans.tables import ticks
    from barloom.sources.bars import with_session_keys

    t = with_session_keys(ticks(spark, d))
    return t.select(F.col("event_id").alias("example_id"), F.col("event_type").alias("symbol"), "session_date", "sod", "value")


@query("match_bar_alignment", f"WITH {O.BARS}, {_MAN} SELECT example_id, coalesce((SELECT max(b.sod) FROM bars b WHERE b.symbol = mt.symbol AND b.session_date = mt.session_date AND b.sod <= mt.sod), (SELECT min(b.sod) FROM bars b WHERE b.symbol = mt.symbol AND b.session_date = mt.session_date AND b.sod > mt.sod)) AS anchor_sod FROM mt")
def match_bar_alignment(spark, d):
    """Last bar at or before each trade, else the first after."""
    return M.align_to_bars(_examples(spark, d), study_bars(spark, d), "example_id").select("example_id", "anchor_sod")


@query(
    "match_context_window",
    f"WITH {O.BARS}, {O.NUMBERED}, {_MAN}, a AS (SELECT mt.*, (SELECT max(b.sod) FROM bars b WHERE b.symbol = mt.symbol AND b.session_date = mt.session_date AND b.sod <= mt.sod) AS anchor FROM mt), p AS (SELECT a.*, nb.pos AS ap FROM a JOIN nb ON nb.symbol = a.symbol AND nb.session_date = a.session_date AND nb.sod = a.anchor) "
    f"SELECT example_id, CAST(nb.pos - 1 AS INT) AS bar_index, CAST(nb.pos - ap AS INT) AS bars_from_entry_anchor, nb.sod, {O.r6('nb.close', 'close')}, nb.pos = ap AS is_entry_anchor FROM p JOIN nb ON nb.symbol = p.symbol AND nb.session_date = p.session_date AND nb.pos BETWEEN ap - 12 AND ap + 24",
)
def match_context_window(spark, d):
    """Bars around each trade's anchor."""
    b = study_bars(spark, d)
    w = M.context_windows(M.align_to_bars(_examples(spark, d), b, "example_id"), b, "example_id")
    return _out(w.select("example_id", "bar_index", "bars_from_entry_anchor", "sod", "close", "is_entry_anchor"))


@query(
    "match_sequences",
    f"WITH {O.BARS}, {O.NUMBERED}, {_MAN}, a AS (SELECT mt.*, (SELECT max(b.sod) FROM bars b WHERE b.symbol = mt.symbol AND b.session_date = mt.session_date AND b.sod <= mt.sod) AS anchor FROM mt), p AS (SELECT a.*, nb.pos AS ap FROM a JOIN nb ON nb.symbol = a.symbol AND nb.session_date = a.session_date AND nb.sod = a.anchor) "
    f"SELECT example_id, count(*) AS n_bars, string_agg(CAST(nb.sod AS VARCHAR), ',' ORDER BY nb.pos) AS sods FROM p JOIN nb ON nb.symbol = p.symbol AND nb.session_date = p.session_date AND nb.pos BETWEEN ap - 12 AND ap + 24 GROUP BY 1",
)
def match_sequences(spark, d):
    """Nested bar arrays per trade."""
    b = study_bars(spark, d)
    sods = F.array_join(F.transform("bars", lambda x: x["sod"].cast("string")), ",")
    s = M.anchor_sequences(b).select(*SESSION_KEY, "anchor_sod", F.size("bars").cast("bigint").alias("n_bars"), sods.alias("sods"))
    return M.align_to_bars(_examples(spark, d), b, "example_id").join(s, [*SESSION_KEY, "anchor_sod"]).select("example_id", "n_bars", "sods")


@query("match_manual_examples")
def match_manual_examples(spark, d):
    """One-to-one match of marked trades to candidates (plain loop in the tests)."""
    c = _cands(spark, d).dropDuplicates(["candidate_id"]).select(
        F.concat_ws("|", "symbol", F.col("session_date").cast("string")).alias("session_date"), "direction", "candidate_id", F.col("decision_sod").alias("t")
    )
    m = _examples(spark, d).select(
        "example_id", F.concat_ws("|", "symbol", F.col("session_date").cast("string")).alias("session_date"), F.col("sod").alias("t"),
        F.when(F.col("example_id") % 2 == 0, "long").otherwise("short").alias("direction"),
    )
    return M.match_examples(m, c, tolerance=1800)


# ------------------------------------------------------------------- exits


def _entries(spark, d):
    return _labelled(spark, d).withColumn("distance_to_recent_high_low", F.col("continuation_displacement_ratio"))


def _replay(spark, d, names=None):
    return cut(E.replay_exits(study_bars(spark, d), _entries(spark, d), STUDY, policies=E.policy_table(spark, names)))


@query("exit_policy_replay")
def exit_policy_replay(spark, d):
    """Every entry under all eighteen exit policies (plain loop in the tests)."""
    return _out(_replay(spark, d).select("candidate_id", "policy", "outcome", "exit_time", "bars_held", "pnl_r"))


_FIXED = "net AS (SELECT candidate_id, session_date, direction, decision_sod, entry_price, pnl_r AS base, outcome, bars_held, sg * (exit_price - entry_price) - 1.5 AS pts, risk FROM labelled)"


@query("exit_fixed_baseline", f"{_LAB}, {_FIXED} SELECT candidate_id, outcome, CAST(bars_held AS INT) AS bars_held, {O.r6('pts / greatest(risk, 0.25)', 'pnl_r')} FROM net")
def exit_fixed_baseline(spark, d):
    """The fixed target and stop, net of slippage."""
    return _out(_replay(spark, d, ["fixed_1_5r_tp_sl_baseline"]).select("candidate_id", "outcome", "bars_held", "pnl_r"))


_SCR = """fx AS (SELECT h.*, greatest(max(CASE WHEN sg > 0 THEN (high - entry_price) / risk ELSE (entry_price - low) / risk END) OVER (PARTITION BY candidate_id ORDER BY k), 0) AS m FROM lhit h),
ev AS (SELECT *, CASE WHEN sh AND th THEN 'ambiguous_stop_first' WHEN sh THEN 'stop' WHEN th THEN 'target' WHEN {rule} END AS how FROM fx),
fin AS (SELECT candidate_id, coalesce(min(k) FILTER (WHERE how IS NOT NULL), max(k)) AS ek FROM ev GROUP BY 1),
res AS (SELECT e.candidate_id, coalesce(e.how, 'timeout') AS outcome, CAST(e.k AS INT) AS bars_held, (e.sg * (CASE WHEN e.sh THEN e.stop_price WHEN e.th THEN e.target_price ELSE e.bclose END - e.entry_price) - 1.5) / greatest(e.risk, 0.25) AS pnl_r FROM ev e JOIN fin f ON e.candidate_id = f.candidate_id AND e.k = f.ek)"""


def _rule_sql(rule):
    return f"{_LAB}, {_SCR.format(rule=rule)} SELECT candidate_id, outcome, bars_held, {O.r6('pnl_r')} FROM res"


@query("exit_scratch_three_bars", _rule_sql("k = 3 AND m < 0.25 THEN 'scratch_no_followthrough'"))
def exit_scratch_three_bars(spark, d):
    return _out(_replay(spark, d, ["scratch_no_followthrough_after_3_bars"]).select("candidate_id", "outcome", "bars_held", "pnl_r"))


@query("exit_time_stop", _rule_sql("k = 10 THEN 'time_stop'"))
def exit_time_stop(spark, d):
    return _out(_replay(spark, d, ["time_stop_10_bars"]).select("candidate_id", "outcome", "bars_held", "pnl_r"))


@query("exit_mae_cut", _rule_sql("(CASE WHEN sg > 0 THEN entry_price - low ELSE high - entry_price END) / risk >= 0.65 THEN 'mae_cut' WHEN k = 3 AND m < 0.25 THEN 'scratch_no_followthrough'"))
def exit_mae_cut(spark, d):
    return _out(_replay(spark, d, ["scratch_3_bars_plus_mae_cut_0_65r"]).select("candidate_id", "outcome", "bars_held", "pnl_r"))


#: Exit rules that SQL repeats, by policy.
_RULES = {
    "fixed_1_5r_tp_sl_baseline": "false THEN ''",
    "scratch_no_followthrough_after_3_bars": "k = 3 AND m < 0.25 THEN 'scratch_no_followthrough'",
    "time_stop_10_bars": "k = 10 THEN 'time_stop'",
    "scratch_3_bars_plus_mae_cut_0_65r": "(CASE WHEN sg > 0 THEN entry_price - low ELSE high - entry_price END) / risk >= 0.65 THEN 'mae_cut' WHEN k = 3 AND m < 0.25 THEN 'scratch_no_followthrough'",
}
_ALL_RULES = " UNION ALL ".join(f"SELECT '{p}' AS policy, * FROM (WITH {_SCR.format(rule=r)} SELECT * FROM res)" for p, r in _RULES.items())


@query(
    "exit_policy_evaluation",
    f"{_LAB}, al AS ({_ALL_RULES}), r AS (SELECT al.*, c.session_date, c.decision_sod FROM al JOIN ucands c USING (candidate_id)), "
    "cu AS (SELECT *, sum(pnl_r) OVER (PARTITION BY policy ORDER BY session_date, decision_sod, candidate_id) AS cum FROM r), dd AS (SELECT *, cum - greatest(max(cum) OVER (PARTITION BY policy ORDER BY session_date, decision_sod, candidate_id), 0) AS dd FROM cu) "
    f"SELECT policy, count(*) AS trade_count, {O.r6('sum(pnl_r)', 'total_pnl_r')}, {O.r6('avg(pnl_r)', 'avg_trade_r')}, {O.r6('median(pnl_r)', 'median_trade_r')}, {O.r6('avg(CASE WHEN pnl_r > 0 THEN 1 ELSE 0 END)', 'win_rate')}, {O.r6('coalesce(avg(pnl_r) FILTER (WHERE pnl_r > 0) / avg(-pnl_r) FILTER (WHERE pnl_r < 0), 0)', 'payoff_ratio')}, {O.r6('least(min(dd), 0)', 'max_drawdown_r')} FROM dd GROUP BY 1",
)
def exit_policy_evaluation(spark, d):
    """Totals, median, payoff and drawdown of every policy whose rule SQL repeats; ``exit_policies_evaluated`` has all."""
    return _out(E.evaluate_policies(_replay(spark, d, list(_RULES))).drop("right_tail_p90_r"))


@query("exit_policies_evaluated")
def exit_policies_evaluated(spark, d):
    """All eighteen policies evaluated."""
    return _out(E.evaluate_policies(_replay(spark, d)))


@query("exit_batches")
def exit_batches(spark, d):
    """All policies evaluated, attributed and tagged with batch and family."""
    r = E.with_drawdown_stop(_replay(spark, d))
    ev = E.evaluate_policies(r).join(E.improvement_attribution(r, "fixed_1_5r_tp_sl_baseline"), "policy")
    return _out(ev.withColumns({
        "exit_family": E.variant_family(), "in_exit_batch": F.col("policy").isin(E.EXIT_BATCH), "in_scratch_batch": F.col("policy").isin(E.SCRATCH_BATCH),
        "in_structure_batch": F.col("policy").isin(E.STRUCTURE_BATCH),
    }))


_ATT = f"{_LAB}, {_SCR.format(rule=chr(39).join(['k = 3 AND m < 0.25 THEN ', 'scratch_no_followthrough', '']))}, b AS (SELECT candidate_id, (sg * (exit_price - entry_price) - 1.5) / greatest(risk, 0.25) AS base FROM labelled), j AS (SELECT base, pnl_r - base AS d FROM res JOIN b USING (candidate_id)), g AS (SELECT coalesce(sum(d) FILTER (WHERE base < 0 AND d > 0), 0) AS a, coalesce(sum(d) FILTER (WHERE base > 0 AND d > 0), 0) AS b, coalesce(sum(d) FILTER (WHERE base > 0 AND d < 0), 0) AS c, coalesce(sum(d) FILTER (WHERE base < 0 AND d < 0), 0) AS e FROM j)"


@query("exit_improvement_attribution", f"{_ATT} SELECT 'scratch_no_followthrough_after_3_bars' AS policy, {O.r6('a', 'cutting_losers_r')}, {O.r6('b', 'expanding_winners_r')}, {O.r6('c', 'winner_giveback_r')}, {O.r6('e', 'worsened_losers_r')}, CASE WHEN a >= greatest(b, abs(c), abs(e)) THEN 'cutting_losers' WHEN b > 0 THEN 'expanding_winners' ELSE 'mixed_or_negative' END AS primary_source FROM g")
def exit_improvement_attribution(spark, d):
    """Where a policy's change against the fixed exit comes from."""
    names = ["fixed_1_5r_tp_sl_baseline", "scratch_no_followthrough_after_3_bars"]
    r = _replay(spark, d, names)
    return _out(E.improvement_attribution(r, "fixed_1_5r_tp_sl_baseline", policies=E.policy_table(spark, names)).filter(F.col("policy") != "fixed_1_5r_tp_sl_baseline"))


_PATH = f"""{_LAB}, pp AS (SELECT candidate_id, k, sg, entry_price, risk, bopen, bclose, high, low, (CASE WHEN sg > 0 THEN high - entry_price ELSE entry_price - low END) / risk AS fr, (CASE WHEN sg > 0 THEN low - entry_price ELSE entry_price - high END) / risk AS ar, sign(bclose - bopen) AS sd, lag(sign(bclose - bopen)) OVER (PARTITION BY candidate_id ORDER BY k) AS ps, count(*) OVER (PARTITION BY candidate_id) AS n FROM lpath),
pg AS (SELECT candidate_id, any_value(n) AS n, max(fr) AS mfe, min(ar) AS mae, first(k ORDER BY fr DESC, k) AS tm, first(k ORDER BY ar, k) AS ta, count(*) FILTER (WHERE k <= 6 AND sg * bclose > sg * entry_price) AS good,
 avg(abs(bclose - bopen)) FILTER (WHERE k <= 3 OR n < 3) AS b1, avg(abs(bclose - bopen)) FILTER (WHERE k > n - 3 AND n >= 3) AS b2, avg(high - low) FILTER (WHERE k <= 3 OR n < 3) AS r1, avg(high - low) FILTER (WHERE k > n - 3 AND n >= 3) AS r2, count(*) FILTER (WHERE sd <> 0 AND ps <> 0 AND sd <> ps) AS tn FROM pp GROUP BY 1),
pd AS (SELECT l.candidate_id, l.session_date, l.pnl_r, coalesce(mfe_1, 0) AS mfe_r, coalesce(mae_1, 0) AS mae_r, coalesce(tm, 0) AS tm, coalesce(ta, 0) AS ta, coalesce(good / greatest(1, least(6, n)), 0) AS ft, coalesce(1 - least(coalesce(b2, b1) / greatest(b1, 1e-9), 1), 0) AS td, coalesce(1 - least(coalesce(r2, r1) / greatest(r1, 1e-9), 1), 0) AS vc, CASE WHEN mfe_1 > 0 THEN greatest(mfe_1 - l.pnl_r, 0) / greatest(mfe_1, 1e-9) ELSE 0 END AS rv, coalesce(tn / greatest(n - 1, 1), 0) AS al FROM labelled l LEFT JOIN (SELECT * RENAME (mfe AS mfe_1, mae AS mae_1) FROM pg) USING (candidate_id)),
px AS (SELECT *, CASE WHEN mae_r <= -0.75 AND ta <= 3 AND mfe_r < 0.35 THEN 'fast_failure' WHEN mfe_r >= 1.5 AND pnl_r > 0.5 THEN 'runner' WHEN mfe_r >= 1 AND ft >= 0.55 AND pnl_r > 0 THEN 'strong_continuation' WHEN mfe_r >= 0.75 AND pnl_r <= 0 AND rv >= 0.7 THEN 'late_reversal' WHEN pnl_r < 0 AND abs(mae_r) < 0.75 AND ta > 3 THEN 'slow_bleed' WHEN al >= 0.45 OR td >= 0.55 OR vc >= 0.55 THEN 'chop_decay' WHEN pnl_r > 0 THEN 'strong_continuation' ELSE 'slow_bleed' END AS tax FROM pd)"""


def _paths(spark, d):
    return cut(EP.path_diagnostics(study_bars(spark, d), _labelled(spark, d), STUDY))


@query("path_diagnostics", f"{_PATH} SELECT candidate_id, {O.r6('pnl_r')}, {O.r6('mfe_r')}, {O.r6('mae_r')}, CAST(tm AS INT) AS time_to_mfe_bars, CAST(ta AS INT) AS time_to_mae_bars, {O.r6('ft', 'follow_through_persistence')}, {O.r6('td', 'tempo_decay')}, {O.r6('vc', 'volatility_collapse')}, {O.r6('rv', 'reversal_behavior')}, {O.r6('al', 'alternating_bar_ratio_path')}, {O.r6('greatest(0, least(1, (ft + greatest(mfe_r, 0) / 1.5 + (1 - rv)) / 3))', 'continuation_quality_after_entry')}, tax AS trade_outcome_taxonomy FROM px")
def path_diagnostics(spark, d):
    """Shape of the path after each entry, with its archetype."""
    return _out(_paths(spark, d).drop("symbol", "session_date", "direction", "liquidity_rejection"))


@query("path_archetypes", f"{_PATH} SELECT tax AS archetype, count(*) AS trade_count, CAST(count(DISTINCT session_date) AS BIGINT) AS session_count, {O.r6('sum(pnl_r)', 'total_pnl_r')}, {O.r6('avg(pnl_r)', 'avg_pnl_r')}, {O.r6('median(pnl_r)', 'median_pnl_r')}, {O.r6('avg(mfe_r)', 'avg_mfe_r')}, {O.r6('avg(mae_r)', 'avg_mae_r')}, {O.r6('avg(ft)', 'avg_follow_through_persistence')}, {O.r6('avg(td)', 'avg_tempo_decay')}, {O.r6('avg(vc)', 'avg_volatility_collapse')} FROM px GROUP BY 1")
def path_archetypes(spark, d):
    return _out(EP.archetype_summary(_paths(spark, d)).drop("liquidity_rejection_count"))


@query("path_focus_summary", f"{_PATH} SELECT count(*) AS trade_count, CAST(count(DISTINCT session_date) AS BIGINT) AS session_count, {O.r6('sum(pnl_r)', 'total_pnl_r')}, {O.r6('avg(mfe_r)', 'avg_mfe_r')}, {O.r6('avg(mae_r)', 'avg_mae_r')}, {O.r6('avg(tm)', 'avg_time_to_mfe_bars')}, {O.r6('avg(ta)', 'avg_time_to_mae_bars')}, {O.r6('avg(ft)', 'avg_follow_through_persistence')}, {O.r6('avg(td)', 'avg_tempo_decay')}, {O.r6('avg(vc)', 'avg_volatility_collapse')} FROM px WHERE tax IN ('fast_failure', 'late_reversal', 'fake_breakout', 'slow_bleed')")
def path_focus_summary(spark, d):
    """Path means over the archetypes of one focus."""
    return _out(EP.path_summary(_paths(spark, d), "failure"))


@query("path_exit_families", f"{_PATH}, fam AS (SELECT * FROM (VALUES ('scratch_exits', 'fast_failure'), ('scratch_exits', 'fake_breakout'), ('structure_trailing', 'late_reversal'), ('structure_trailing', 'runner'), ('partial_profit_runner', 'runner'), ('partial_profit_runner', 'late_reversal'), ('time_stop', 'slow_bleed'), ('time_stop', 'chop_decay'), ('break_even_policy', 'late_reversal'), ('volatility_based_exit', 'chop_decay'), ('volatility_based_exit', 'slow_bleed'), ('liquidity_rejection_exit', 'fake_breakout')) v(family, tax)), g AS (SELECT family, count(candidate_id) AS n, coalesce(sum(pnl_r), 0) AS p FROM fam LEFT JOIN px USING (tax) GROUP BY 1) SELECT family, n AS diagnostic_support_trades, {O.r6('p', 'supported_archetype_pnl_r')}, CASE WHEN n >= 10 THEN 'eligible_for_bounded_replay' ELSE 'diagnostic_only_low_support' END AS initial_status FROM g")
def path_exit_families(spark, d):
    """Support of each exit family."""
    return _out(EP.candidate_exit_families(EP.archetype_summary(_paths(spark, d))))


@query("path_losing_archetypes", f"{_PATH} SELECT tax AS trade_outcome_taxonomy, count(*) AS losses FROM px WHERE pnl_r <= 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def path_losing_archetypes(spark, d):
    return EP.losing_archetypes(_paths(spark, d))
