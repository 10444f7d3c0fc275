"""Queries over bars: sessions, quality, zones, candidates, labels, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import at, iso, round_doubles
from barloom.operators import candidates as C
from barloom.operators import features as X
from barloom.operators import labels as L
from barloom.operators import sessions as S
from barloom.operators import universe as U
from barloom.operators.attempts import event_driven_candidates, event_stream
from barloom.operators.indicators import recursive_indicators, rolling_indicators, snapshot
from barloom.operators.zones import opening_zones
from barloom.plans import oracle_sql as O
from barloom.plans.registry import query
from barloom.plans.tables import EXTENDED, STUDY, study_bars, table, ticks
from barloom.sources.bars import canonical_bars, split_by_boundary
from barloom.sources.manifest import build_manifest, register, select_source, without_holdout

DAY = "CAST(session_date AS VARCHAR) AS session_date"


def _day(df):
    return df.withColumn("session_date", F.col("session_date").cast("string"))


def _out(df):
    """Stable output: text dates, rounded doubles."""
    if "session_date" in df.columns:
        df = _day(df)
    return round_doubles(df)


def _sod_local(c):
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c).cast("int")


# ---------------------------------------------------------------- sources


@query(
    "source_canonical_bars",
    f"""WITH {O.BARS} SELECT symbol, strftime((CAST(session_date AS TIMESTAMP) + to_seconds(sod)) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS ts_local,
    strftime(CAST(session_date AS TIMESTAMP) + to_seconds(sod), '%Y-%m-%d %H:%M:%S') AS ts_utc,
    CAST(CAST((CAST(session_date AS TIMESTAMP) + to_seconds(sod)) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS VARCHAR) AS session_date,
    '30m' AS source_timeframe, {O.r6('open')}, {O.r6('close')}, {O.r6('volume')} FROM bars""",
)
def source_canonical_bars(spark, d):
    """Canonical bars from raw rows with UTC text times, on exchange-local sessions."""
    raw = study_bars(spark, d).select(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias(" Timestamp "), "symbol",
        F.col("open").alias("Open"), F.col("high").alias("HIGH"), F.col("low").alias("Low"), F.col("close").alias("Close "), F.col("volume").alias("Volume"),
    )
    b = canonical_bars(raw, timeframe="30m")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return _out(b.select(
        "symbol", F.date_format("ts", fmt).alias("ts_local"),
        F.date_format(F.to_utc_timestamp(F.from_utc_timestamp("ts_event_utc", "America/New_York"), "America/New_York"), fmt).alias("ts_utc"),
        "session_date", "source_timeframe", "open", "close", "volume",
    ))


@query(
    "source_boundary_roles",
    f"""WITH {O.BARS}, bd AS (SELECT * FROM (VALUES ('exploration', DATE '2024-01-01', DATE '2024-01-15'), ('validation', DATE '2024-01-16', DATE '2024-01-24'), ('holdout', DATE '2024-01-25', DATE '2024-12-31')) v(boundary_role, a, b))
    SELECT boundary_role, symbol, count(*) AS bars, CAST(count(DISTINCT session_date) AS BIGINT) AS sessions, {O.r6('sum(volume)', 'volume')} FROM bars JOIN bd ON session_date BETWEEN a AND b GROUP BY 1, 2""",
)
def source_boundary_roles(spark, d):
    """Bars split into evidence windows."""
    import datetime as dt

    bd = spark.createDataFrame(
        [("exploration", dt.date(2024, 1, 1), dt.date(2024, 1, 15)), ("validation", dt.date(2024, 1, 16), dt.date(2024, 1, 24)),
         ("holdout", dt.date(2024, 1, 25), dt.date(2024, 12, 31))],
        "boundary_role string, date_start date, date_end date",
    )
    per = split_by_boundary(study_bars(spark, d), bd).groupBy("boundary_role", "symbol", "session_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("v")
    )
    return _out(per.groupBy("boundary_role", "symbol").agg(
        F.sum("n").alias("bars"), F.count(F.lit(1)).alias("sessions"), F.sum("v").alias("volume")
    ))


_QUALITY = f"""qs AS (SELECT symbol, session_date, 48 - count(*) AS missing, count(*) FILTER (WHERE sod BETWEEN 0 AND 7199) AS zb, max(sod) AS last_sod FROM bars GROUP BY 1, 2),
q AS (SELECT b.symbol, any_value(n) AS rows, any_value(d0) AS date_start, any_value(d1) AS date_end, count(*) AS sessions, min({O.clock('session_date', 'last_sod')}) AS earliest_session_end,
 max({O.clock('session_date', 'last_sod')}) AS latest_session_end, CAST(sum(missing) AS BIGINT) AS missing_regular_session_bars, CAST(0 AS BIGINT) AS duplicate_timestamps, count(*) FILTER (WHERE zb >= 2) AS opening_zone_sessions
 FROM qs b JOIN (SELECT symbol, count(*) AS n, min({O.clock('session_date', 'sod')}) AS d0, max({O.clock('session_date', 'sod')}) AS d1 FROM bars GROUP BY 1) t USING (symbol) GROUP BY 1)"""
_FLAGS = "(CASE WHEN missing_regular_session_bars > 0 THEN 'missing_regular_session_bars' ELSE '' END) || (CASE WHEN opening_zone_sessions < sessions THEN (CASE WHEN missing_regular_session_bars > 0 THEN '|' ELSE '' END) || 'missing_opening_zone_sessions' ELSE '' END)"


def _as_text(df, col):
    return df.withColumn(col, F.array_join(col, "|"))


@query("source_manifest_build", f"WITH {O.BARS}, {_QUALITY} SELECT * REPLACE (symbol || '_30s_bars.parquet' AS symbol), {_FLAGS} AS quality_flags, '30s' AS timeframe FROM q".replace("AS symbol)", "AS symbol)").replace("SELECT * REPLACE (symbol || '_30s_bars.parquet' AS symbol)", "SELECT '/data/' || symbol || '_30s_bars.parquet' AS source_path, rows, date_start, date_end, sessions, earliest_session_end, latest_session_end, missing_regular_session_bars, duplicate_timestamps, opening_zone_sessions"))
def source_manifest_build(spark, d):
    """One manifest row per source file."""
    b = study_bars(spark, d).withColumn("source_path", F.concat(F.lit("/data/"), "symbol", F.lit("_30s_bars.parquet")))
    return _as_text(build_manifest(b, STUDY), "quality_flags")


@query(
    "source_manifest_register",
    f"WITH {O.BARS}, {_QUALITY}, m AS (SELECT symbol AS source_path, rows, sessions FROM q) "
    "SELECT source_path, rows, sessions, 'old' AS origin FROM m WHERE source_path NOT IN ('click', 'view') UNION ALL "
    "SELECT source_path, rows + 1 AS rows, sessions, 'new' AS origin FROM m WHERE source_path IN ('click', 'view')",
)
def source_manifest_register(spark, d):
    """Replaced and appended manifest entries."""
    q = S.quality_report(study_bars(spark, d), STUDY).select(
        F.col("symbol").alias("source_path"), "rows", "sessions", F.lit("old").alias("origin"), F.lit("30s").alias("timeframe")
    )
    new = q.filter(F.col("source_path").isin("click", "view")).withColumns({"rows": F.col("rows") + 1, "origin": F.lit("new")})
    return register(q, new).drop("timeframe")


@query(
    "source_manifest_select",
    f"WITH {O.BARS}, {_QUALITY}, m AS (SELECT *, CASE WHEN symbol IN ('view', 'error') THEN 'holdout' ELSE 'exploration' END AS boundary_role FROM q) "
    "SELECT symbol AS source_path, boundary_role, sessions, rows FROM m WHERE boundary_role = 'exploration' ORDER BY sessions DESC, rows DESC, symbol LIMIT 1",
)
def source_manifest_select(spark, d):
    """Best exploration source; holdout sources are refused by role."""
    q = S.quality_report(study_bars(spark, d), STUDY).select(
        F.col("symbol").alias("source_path"), "rows", "sessions", F.lit("30s").alias("timeframe"), F.lit(None).cast("int").alias("stage2_priority"),
        F.when(F.col("symbol").isin("view", "error"), "holdout").otherwise("exploration").alias("boundary_role"),
    )
    return select_source(without_holdout(q, q), "30s", "exploration").select("source_path", "boundary_role", "sessions", "rows")


# --------------------------------------------------------------- sessions


@query("session_regular_hours", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS session_date, count(*) AS bars, round(sum(value), 6) + 0.0 AS total FROM events WHERE hour(ts) * 3600 + minute(ts) * 60 + second(ts) >= 34200 AND hour(ts) * 3600 + minute(ts) * 60 + second(ts) < 57600 GROUP BY 1")
def session_regular_hours(spark, d):
    """Rows that start inside the regular session, per day."""
    from barloom.schemas import SessionSpec
    from barloom.sources.bars import with_session_keys

    t = with_session_keys(ticks(spark, d))
    return _out(S.regular_session(t, SessionSpec()).groupBy("session_date").agg(F.count(F.lit(1)).alias("bars"), F.sum("value").alias("total")))


@query("session_quality_report", f"WITH {O.BARS}, {_QUALITY} SELECT *, {_FLAGS} AS quality_flags FROM q")
def session_quality_report(spark, d):
    """Data-quality row per symbol."""
    return _as_text(S.quality_report(study_bars(spark, d), STUDY), "quality_flags")


@query(
    "session_duplicate_timestamps",
    "SELECT event_type AS symbol, count(*) - CAST(count(DISTINCT date_trunc('minute', ts)) AS BIGINT) AS duplicate_timestamps FROM events GROUP BY 1",
)
def session_duplicate_timestamps(spark, d):
    """Repeated minute stamps per symbol."""
    from barloom.sources.bars import with_session_keys

    t = with_session_keys(ticks(spark, d).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))).withColumnRenamed("event_type", "symbol")
    return S.duplicate_timestamps(t, ["symbol"])


@query(
    "session_missing_bars",
    f"WITH {O.BARS}, g AS (SELECT symbol, session_date, unnest(generate_series(0, 86399, 1800)) AS sod FROM (SELECT DISTINCT symbol, session_date FROM bars)) "
    f"SELECT g.symbol, CAST(g.session_date AS VARCHAR) AS session_date, CAST(g.sod AS INT) AS sod FROM g ANTI JOIN bars b ON g.symbol = b.symbol AND g.session_date = b.session_date AND g.sod = b.sod",
)
def session_missing_bars(spark, d):
    """Every absent grid slot."""
    return _day(S.missing_bars(study_bars(spark, d), STUDY))


@query(
    "session_gap_counts",
    f"WITH {O.BARS} SELECT symbol, {DAY}, count(*) AS session_rows, 48 - count(*) AS missing_bars, count(*) FILTER (WHERE sod <= 7199) AS zone_bars, max(sod) AS last_sod FROM bars GROUP BY symbol, session_date",
)
def session_gap_counts(spark, d):
    """Rows, gaps, zone coverage and last bar per session."""
    return _day(S.session_rollup(study_bars(spark, d), STUDY, ["symbol"]))


@query("session_horizon_coverage", f"WITH {O.BARS} SELECT symbol, min(l) AS min_last_sod, min(l) >= 72000 + 4 * 1800 AS covers_horizon FROM (SELECT symbol, session_date, max(sod) AS l FROM bars GROUP BY 1, 2) GROUP BY 1")
def session_horizon_coverage(spark, d):
    """Does the earliest-closing session hold the label horizon?"""
    return S.session_end_coverage(study_bars(spark, d), STUDY, 4)


@query("session_last_sessions", f"WITH {O.BARS} SELECT symbol, {DAY}, count(*) AS bars FROM bars WHERE session_date IN (SELECT DISTINCT session_date FROM bars ORDER BY 1 DESC LIMIT 10) GROUP BY symbol, session_date")
def session_last_sessions(spark, d):
    """The last ten session dates."""
    return _day(S.slice_sessions(study_bars(spark, d), 10).groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("bars")))


@query("session_first_sessions", f"WITH {O.BARS} SELECT symbol, {DAY}, count(*) AS bars FROM bars WHERE session_date IN (SELECT DISTINCT session_date FROM bars ORDER BY 1 LIMIT 5) GROUP BY symbol, session_date")
def session_first_sessions(spark, d):
    """The first five session dates."""
    return _day(S.slice_sessions(study_bars(spark, d), 5, last=False).groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("bars")))


@query("session_bar_numbers", f"WITH {O.BARS}, {O.NUMBERED} SELECT symbol, {DAY}, sod, bar_no, CAST(pos AS INT) AS pos, max(bar_no) OVER (PARTITION BY symbol, session_date) AS session_last_no FROM nb")
def session_bar_numbers(spark, d):
    """Running bar numbers per symbol without a window over the symbol."""
    return _day(S.number_bars(study_bars(spark, d)).select("symbol", "session_date", "sod", "bar_no", "pos", "session_last_no"))


@query("bars_from_ticks", f"WITH {O.BARS} SELECT symbol, {DAY}, sod, {O.r6('open')}, {O.r6('high')}, {O.r6('low')}, {O.r6('close')}, {O.r6('volume')} FROM bars")
def bars_from_ticks_query(spark, d):
    """Half-hour bars."""
    return _out(study_bars(spark, d).drop("ts"))


@query("bars_resampled", f"WITH {O.BARS} SELECT symbol, {DAY}, sod, {O.r6('open')}, {O.r6('high')}, {O.r6('low')}, {O.r6('close')}, {O.r6('volume')} FROM coarse")
def bars_resampled(spark, d):
    """Hourly bars from half-hour bars."""
    return _out(S.resample(study_bars(spark, d), STUDY).drop("ts"))


@query("bars_event_stream", f"WITH {O.BARS}, {O.zones()}, ev AS (SELECT symbol, session_date, sod, close, sod + 1800 AS t, false AS coarse FROM bars UNION ALL SELECT symbol, session_date, sod, close, sod + 3600, true FROM coarse) SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, sod, t, coarse, {O.r6('close')}, row_number() OVER (PARTITION BY symbol, session_date ORDER BY t, NOT coarse, sod) AS event_no FROM ev JOIN zones USING (symbol, session_date)")
def bars_event_stream(spark, d):
    """Fine and coarse bars in completion order."""
    from pyspark.sql import Window as W

    b = study_bars(spark, d)
    w = W.partitionBy("symbol", "session_date").orderBy("t", ~F.col("coarse"), "sod")
    return _out(event_stream(b, opening_zones(b, STUDY), STUDY).select(
        "symbol", "session_date", "sod", "t", "coarse", "close", F.row_number().over(w).cast("bigint").alias("event_no")
    ))


@query("bars_completion_time", f"WITH {O.BARS} SELECT symbol, {DAY}, sod, sod + 1800 AS complete_sod, 'fine' AS kind FROM bars UNION ALL SELECT symbol, CAST(session_date AS VARCHAR), sod, sod + 3600, 'coarse' FROM coarse")
def bars_completion_time(spark, d):
    """When each bar is complete."""
    b = study_bars(spark, d)
    f = S.completion(b, STUDY).select("symbol", "session_date", "sod", "complete_sod", F.lit("fine").alias("kind"))
    c = S.completion(S.resample(b, STUDY), STUDY, coarse=True).select("symbol", "session_date", "sod", "complete_sod", F.lit("coarse").alias("kind"))
    return _day(f.unionByName(c))


# ------------------------------------------------------- zones, candidates

_ZONE_COLS = f"symbol, {DAY}, zone_first_sod, zone_last_sod, decision_sod, {O.r6('zone_high')}, {O.r6('zone_low')}, {O.r6('zone_mid')}, {O.r6('zone_width')}, {O.r6('zone_width_bps')}, (CASE WHEN zone_width <= 0 THEN 'non_positive_zone_width' ELSE '' END) || (CASE WHEN zone_bars < 2 THEN (CASE WHEN zone_width <= 0 THEN '|' ELSE '' END) || 'partial_opening_zone' ELSE '' END) AS quality_flags"


@query("zone_opening", f"WITH {O.BARS}, {O.zones()} SELECT {_ZONE_COLS} FROM zones")
def zone_opening(spark, d):
    """Opening zone of every session."""
    return _out(_as_text(opening_zones(study_bars(spark, d), STUDY), "quality_flags"))


@query("zone_extended", f"WITH {O.BARS}, {O.zones('zones', 14399, 14400)} SELECT {_ZONE_COLS} FROM zones")
def zone_extended(spark, d):
    """Extended zone of every session."""
    return _out(_as_text(opening_zones(study_bars(spark, d), EXTENDED), "quality_flags"))


@query(
    "zone_break_flags",
    f"WITH {O.BARS}, {O.zones()} SELECT c.symbol, CAST(c.session_date AS VARCHAR) AS session_date, c.sod, c.close > zone_high AS close_up, c.close < zone_low AS close_down, c.high > zone_high AS wick_up, c.low < zone_low AS wick_down, (c.high > zone_high AND NOT c.close > zone_high) AS failed_up, (c.low < zone_low AND NOT c.close < zone_low) AS failed_down, (c.low <= zone_high AND c.high >= zone_low AND c.close < c.open) AS pullback_long, (c.low <= zone_high AND c.high >= zone_low AND c.close > c.open) AS pullback_short FROM coarse c JOIN zones z USING (symbol, session_date)",
)
def zone_break_flags(spark, d):
    """Break predicates in the three modes and pull-back predicates."""
    b = study_bars(spark, d)
    z = opening_zones(b, STUDY).select("symbol", "session_date", "zone_high", "zone_low")
    c = S.resample(b, STUDY).join(z, ["symbol", "session_date"])
    up = lambda m: C.break_predicate(F.col("close"), F.col("high"), F.col("zone_high"), F.lit(m))
    dn = lambda m: C.break_predicate(-F.col("close"), -F.col("low"), -F.col("zone_low"), F.lit(m))
    pb = lambda long: C.pullback_predicate(F.col("open"), F.col("close"), F.col("low"), F.col("high"), F.col("zone_low"), F.col("zone_high"), F.lit(long))
    return _day(c.select(
        "symbol", "session_date", "sod", up("close").alias("close_up"), dn("close").alias("close_down"), up("wick").alias("wick_up"),
        dn("wick").alias("wick_down"), up("wick_failed_close").alias("failed_up"), dn("wick_failed_close").alias("failed_down"),
        pb(True).alias("pullback_long"), pb(False).alias("pullback_short"),
    ))


_FOUND = f"symbol, {DAY}, direction, break_sod, trigger_sod, decision_sod, {O.r6('entry_price')}, {O.r6('pivot_price')}, pivot_sod, {O.r6('flem_price')}, flem_sod, CAST(reentry_count AS INT) AS reentry_count, CAST(reclaim_count AS INT) AS reclaim_count"
_FOUND_COLS = ["symbol", "session_date", "direction", "break_sod", "trigger_sod", "decision_sod", "entry_price", "pivot_price", "pivot_sod", "flem_price", "flem_sod", "reentry_count", "reclaim_count"]


@query("candidate_canonical", f"WITH {O.canonical()} SELECT {_FOUND} FROM cands")
def candidate_canonical(spark, d):
    """Break, pull-back, reclaim candidates of every break."""
    return _out(C.canonical(study_bars(spark, d), STUDY).select(*_FOUND_COLS))


@query("candidate_capped", f"WITH {O.canonical(1)} SELECT {_FOUND} FROM cands")
def candidate_capped(spark, d):
    """First candidate per direction."""
    return _out(C.canonical(study_bars(spark, d), STUDY, cap=1).select(*_FOUND_COLS))


_TRACE = ["candidate_id", "first_break_wick_only", "first_break_close_confirmed", "first_break_wick_excess_points", "first_break_close_excess_points",
          "pivot_duration_bars", "continuation_delay_bars", "deepest_zone_retrace_fraction", "continuation_displacement_ratio",
          "post_reclaim_close_strength", "setup_subtype", "break_sod"]


@query("candidate_trace", f"WITH {O.canonical()} SELECT candidate_id, " + ", ".join(O.r6(x) for x in _TRACE[1:10]) + ", setup_subtype, break_sod FROM cands")
def candidate_trace(spark, d):
    """Identity, trace ratios and subtype."""
    return _out(C.canonical(study_bars(spark, d), STUDY).select(*_TRACE))


@query("candidate_subtype_counts", f"WITH {O.canonical()} SELECT setup_subtype, count(*) AS candidates FROM cands GROUP BY 1")
def candidate_subtype_counts(spark, d):
    return C.subtype_counts(C.canonical(study_bars(spark, d), STUDY))


@query("candidate_subtype_filter", f"WITH {O.canonical()} SELECT candidate_id, break_sod FROM cands WHERE setup_subtype = 'deep_retrace_repair'")
def candidate_subtype_filter(spark, d):
    return C.filter_subtype(C.canonical(study_bars(spark, d), STUDY), "deep_retrace_repair").select("candidate_id", "break_sod")


@query("candidate_inventory", f"WITH {O.canonical()} SELECT strftime(CAST(session_date AS TIMESTAMP) + to_seconds(trigger_sod // 600 * 600), '%H:%M') AS ten_minute_bucket, 'canonical' AS candidate_engine, count(*) AS candidates, min({O.clock('session_date', 'trigger_sod')}) AS earliest_trigger_time, max({O.clock('session_date', 'trigger_sod')}) AS latest_trigger_time FROM cands GROUP BY 1")
def candidate_inventory(spark, d):
    """Counts per ten-minute bucket and engine."""
    return C.inventory(C.canonical(study_bars(spark, d), STUDY))


@query("candidate_event_driven")
def candidate_event_driven(spark, d):
    """Attempts of the event-driven engine (checked against a plain loop in the tests)."""
    b = study_bars(spark, d)
    return _out(event_driven_candidates(b, opening_zones(b, STUDY), STUDY, cap=3))


_UNI = f"WITH {O.universe()}"
_KEYS = f"CAST(session_date AS VARCHAR) || '|' || direction || '|' || {O.clock('session_date', 'decision_sod')} || '|' || printf('%.2f', entry_price)"


def _universe(spark, d):
    return U.universe_candidates(study_bars(spark, d), STUDY, EXTENDED)


@query("universe_candidates", f"{_UNI} SELECT variant, candidate_id, break_sod, {O.r6('pivot_price')}, {O.r6('flem_price')}, CAST(reclaim_count AS INT) AS reclaim_count, setup_subtype FROM cands")
def universe_candidates(spark, d):
    """Candidates of all eight definitions in one job."""
    return _out(_universe(spark, d).select("variant", "candidate_id", "break_sod", "pivot_price", "flem_price", "reclaim_count", "setup_subtype"))


@query("universe_lineage", f"{_UNI} SELECT variant, candidate_id, symbol || '|' || CAST(session_date AS VARCHAR) || '|' || direction || '|' || {O.clock('session_date', 'break_sod')} || '|' || {O.clock('session_date', 'decision_sod')} AS lineage_key, {_KEYS} AS dedup_key FROM cands")
def universe_lineage(spark, d):
    """Lineage and de-duplication keys."""
    return U.lineage(_universe(spark, d)).select("variant", "candidate_id", "lineage_key", "dedup_key")


_DEDUP = f"""k AS (SELECT *, {_KEYS} AS dedup_key FROM cands), per AS (SELECT variant, dedup_key, count(*) AS n FROM k GROUP BY 1, 2)"""


@query("universe_dedup_summary", f"{_UNI}, {_DEDUP} SELECT variant, CAST(sum(n) AS BIGINT) AS raw_count, count(*) AS deduped_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_count, count(*) FILTER (WHERE n > 1) AS duplicate_cluster_count, {O.r6('sum(n - 1) / sum(n)', 'duplicate_ratio')} FROM per GROUP BY 1")
def universe_dedup_summary(spark, d):
    return _out(U.dedup_summary(U.lineage(_universe(spark, d)), ["variant"]))


_KEPT = f"{_DEDUP}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, dedup_key ORDER BY break_sod, candidate_id) AS kr FROM k) WHERE kr = 1)"


@query("universe_effective_sample_size", f"{_UNI}, {_KEPT}, c AS (SELECT *, count(*) OVER (PARTITION BY variant, session_date) AS ns, count(*) OVER (PARTITION BY variant, session_date, direction) AS nd FROM kept) SELECT variant, count(*) AS raw_n, {O.r6('sum(1.0 / ns)', 'session_cluster_ess')}, {O.r6('sum(1.0 / nd)', 'session_direction_cluster_ess')}, {O.r6('count(*) / sum(1.0 / ns)', 'avg_cluster_size_session')}, {O.r6('count(*) / sum(1.0 / nd)', 'avg_cluster_size_session_direction')}, max(ns) AS max_candidates_per_session FROM c GROUP BY 1")
def universe_effective_sample_size(spark, d):
    """Cluster-adjusted support per definition."""
    return _out(U.effective_sample_size(U.deduplicate(U.lineage(_universe(spark, d)), ["variant"]), ["variant"]))


@query("universe_vs_baseline", f"{_UNI}, {_KEPT}, b AS (SELECT DISTINCT dedup_key FROM kept WHERE variant = 'first_reclaim_only_baseline') SELECT variant, count(*) FILTER (WHERE dedup_key NOT IN (SELECT dedup_key FROM b)) AS new_deduped_candidates_vs_baseline, count(*) FILTER (WHERE dedup_key IN (SELECT dedup_key FROM b)) AS overlap_with_baseline FROM kept GROUP BY 1")
def universe_vs_baseline(spark, d):
    """Keys new against and shared with the baseline definition."""
    return U.compare_to_baseline(U.deduplicate(U.lineage(_universe(spark, d)), ["variant"]))


_SUMMARY = f"""{_KEPT}, c AS (SELECT *, count(*) OVER (PARTITION BY variant, session_date, direction) AS nd FROM kept), e AS (SELECT variant, count(*) AS candidate_count, sum(1.0 / nd) AS ess, CAST(count(DISTINCT session_date) AS BIGINT) AS session_count,
 count(*) FILTER (WHERE direction = 'long') AS long_count, count(*) FILTER (WHERE direction = 'short') AS short_count FROM c GROUP BY 1),
 dd AS (SELECT variant, sum(n - 1) / sum(n) AS duplicate_ratio, CAST(sum(n) AS BIGINT) AS raw_candidate_count FROM per GROUP BY 1), b AS (SELECT DISTINCT dedup_key FROM kept WHERE variant = 'first_reclaim_only_baseline'),
 nw AS (SELECT variant, count(*) FILTER (WHERE dedup_key NOT IN (SELECT dedup_key FROM b)) AS fresh FROM kept GROUP BY 1),
 summ AS (SELECT v.trial, v.variant, coalesce(candidate_count, 0) AS candidate_count, coalesce(raw_candidate_count, 0) AS raw_candidate_count, coalesce(session_count, 0) AS session_count, coalesce(long_count, 0) AS long_count, coalesce(short_count, 0) AS short_count, coalesce(duplicate_ratio, 0) AS duplicate_ratio, coalesce(ess, 0) AS ess, coalesce(fresh, 0) AS fresh,
 CASE WHEN coalesce(candidate_count, 0) = 0 THEN 'reject_no_support' WHEN duplicate_ratio > 0.35 THEN 'reject_duplicate_risk' WHEN ess < 0.6 * candidate_count THEN 'diagnostic_only_correlated_candidates' ELSE 'eligible_for_labeling_diagnostic' END AS governance_decision
 FROM variants v LEFT JOIN e USING (variant) LEFT JOIN dd USING (variant) LEFT JOIN nw USING (variant))"""


def _summary(spark, d):
    return U.universe_summary(_universe(spark, d), U.variants(spark, STUDY, EXTENDED))


@query("universe_summary", f"{_UNI}, {_SUMMARY} SELECT printf('candidate-universe-%03d', trial) AS trial_id, variant, candidate_count, raw_candidate_count, session_count, long_count, short_count, {O.r6('duplicate_ratio')}, {O.r6('ess', 'session_direction_cluster_ess')}, fresh AS new_deduped_candidates_vs_baseline, candidate_count - (SELECT candidate_count FROM summ WHERE trial = 1) AS candidate_count_delta_vs_baseline, governance_decision FROM summ")
def universe_summary(spark, d):
    """One row per definition with its governance decision."""
    return _out(_summary(spark, d).select("trial_id", "variant", "candidate_count", "raw_candidate_count", "session_count", "long_count", "short_count",
                                          "duplicate_ratio", "session_direction_cluster_ess", "new_deduped_candidates_vs_baseline",
                                          "candidate_count_delta_vs_baseline", "governance_decision"))


@query("universe_next_stage", f"{_UNI}, {_SUMMARY} SELECT variant, candidate_count, {O.r6('ess', 'session_direction_cluster_ess')} FROM summ WHERE governance_decision = 'eligible_for_labeling_diagnostic' ORDER BY ess DESC, fresh DESC, trial LIMIT 3")
def universe_next_stage(spark, d):
    """Best-supported eligible definitions."""
    return _out(U.select_next_stage(_summary(spark, d)))


@query("universe_variant_subset", f"{_UNI} SELECT variant, count(*) AS candidates FROM cands WHERE variant IN ('first_reclaim_only_baseline', 'allow_delayed_reclaim') GROUP BY 1")
def universe_variant_subset(spark, d):
    """A requested subset; the baseline always comes along."""
    c = U.universe_candidates(study_bars(spark, d), STUDY, EXTENDED, names=["allow_delayed_reclaim"])
    return c.groupBy("variant").agg(F.count(F.lit(1)).alias("candidates"))


@query("universe_delta_reuse", f"{_UNI}, b AS (SELECT DISTINCT candidate_id FROM cands WHERE variant = 'first_reclaim_only_baseline') SELECT variant, count(*) FILTER (WHERE candidate_id IN (SELECT candidate_id FROM b)) AS reused_candidate_count, count(*) FILTER (WHERE candidate_id NOT IN (SELECT candidate_id FROM b)) AS new_candidate_count FROM (SELECT DISTINCT variant, candidate_id FROM cands) GROUP BY 1")
def universe_delta_reuse(spark, d):
    """How many candidates of each definition the baseline already covers."""
    return U.delta_vs_baseline(_universe(spark, d))[1]


_VLAB = f"{_UNI}, ucands AS (SELECT * FROM cands), {O.labels('ucands', 'candidate_id', extra='variant')}"


@query("universe_labeling_diagnostic", f"{_VLAB}, g AS (SELECT variant, count(*) AS candidate_count, avg(label) AS positive_rate, avg(pnl_r) AS avg_pnl_r FROM labelled GROUP BY 1) SELECT variant, candidate_count, {O.r6('positive_rate')}, {O.r6('avg_pnl_r')}, CAST(row_number() OVER (ORDER BY avg_pnl_r DESC, candidate_count DESC, variant) AS INT) AS rank FROM g")
def universe_labeling_diagnostic(spark, d):
    """Labels per definition: every distinct candidate is labelled once."""
    c = _universe(spark, d)
    todo, _ = U.delta_vs_baseline(c)
    lab = L.triple_barrier(study_bars(spark, d), todo, STUDY, key=["candidate_id", "zone_mode"]).select("candidate_id", "zone_mode", "label", "pnl_r")
    rows = c.select("variant", "candidate_id", "zone_mode").join(lab, ["candidate_id", "zone_mode"])
    return _out(U.labeling_diagnostic(rows).drop("roc_auc"))


# ------------------------------------------------------------------ labels

_LAB = f"WITH {O.canonical()}, {O.UNIQUE}, {O.labels()}"


def _cands(spark, d):
    return C.canonical(study_bars(spark, d), STUDY)


@query("label_triple_barrier", f"{_LAB} SELECT candidate_id, direction, CAST(label AS INT) AS label, outcome, entry_time, {O.r6('entry_price')}, {O.r6('stop_price')}, {O.r6('target_price')}, exit_time, {O.r6('exit_price')}, CAST(bars_held AS INT) AS bars_held, {O.r6('mfe')}, {O.r6('mae')}, {O.r6('pnl_r')} FROM labelled")
def label_triple_barrier(spark, d):
    """First touch of stop or target within twenty bars."""
    out = L.triple_barrier(study_bars(spark, d), _cands(spark, d), STUDY)
    return _out(out.drop("symbol", "session_date", "decision_sod"))


@query("label_summary", f"{_LAB} SELECT direction, count(*) AS rows, {O.r6('avg(label)', 'positive_rate')}, {O.r6('avg(pnl_r)', 'avg_pnl_r')}, count(*) FILTER (WHERE outcome = 'target') AS outcome_target, count(*) FILTER (WHERE outcome = 'stop') AS outcome_stop, count(*) FILTER (WHERE outcome = 'timeout') AS outcome_timeout, count(*) FILTER (WHERE outcome = 'ambiguous_stop_first') AS outcome_ambiguous_stop_first FROM labelled GROUP BY 1")
def label_summary(spark, d):
    return _out(L.label_summary(L.triple_barrier(study_bars(spark, d), _cands(spark, d), STUDY), ["direction"]))


@query("label_forward_entry", f"WITH {O.canonical()}, {O.UNIQUE}, {O.NUMBERED} SELECT candidate_id, (SELECT count(*) FROM nb WHERE nb.symbol = c.symbol AND (nb.session_date < c.session_date OR (nb.session_date = c.session_date AND nb.sod < c.decision_sod))) + 1 AS start_no FROM ucands c")
def label_forward_entry(spark, d):
    """First bar at or after each decision (forward as-of)."""
    c = _cands(spark, d).dropDuplicates(["candidate_id"]).withColumn("event_key", F.col("candidate_id"))
    return L.entry_numbers(c, S.number_bars(study_bars(spark, d))).select("candidate_id", "start_no")


_POL = [("h10_s1_t15", 10, 1.0, 1.5), ("h20_s125_t15", 20, 1.25, 1.5), ("h20_s1_t2", 20, 1.0, 2.0)]
_GRID = " UNION ALL ".join(
    f"SELECT * FROM (WITH {O.labels('ucands', 'candidate_id', str(h), str(s), str(t))} SELECT '{n}' AS label_policy, count(*) AS rows, avg(label) AS positive_rate, avg(pnl_r) AS avg_pnl_r, avg(bars_held) AS avg_bars_held FROM labelled)"
    for n, h, s, t in _POL
)


@query("label_policy_grid", f"WITH {O.canonical()}, {O.UNIQUE}, g AS ({_GRID}) SELECT label_policy, rows, {O.r6('positive_rate')}, {O.r6('avg_pnl_r')}, {O.r6('avg_bars_held')} FROM g")
def label_policy_grid(spark, d):
    """Several label settings in one job."""
    pol = spark.createDataFrame(_POL, "label_policy string, horizon_bars int, stop_multiple double, target_multiple double")
    lab = L.triple_barrier(study_bars(spark, d), _cands(spark, d), STUDY, policies=pol, max_horizon=20)
    g = lab.groupBy("label_policy").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("label").alias("positive_rate"), F.avg("pnl_r").alias("avg_pnl_r"), F.avg("bars_held").alias("avg_bars_held")
    )
    # a setting that labels nothing has a row as well
    return _out(pol.select("label_policy").join(g, "label_policy", "left").fillna(0, ["rows"]))


@query(
    "entry_first_break_outcome",
    f"""WITH {O.BARS}, {O.zones()}, b AS (SELECT c.symbol, c.session_date, min(c.sod) AS sod FROM coarse c JOIN zones z USING (symbol, session_date) WHERE c.sod + 3600 >= 7200 AND (c.close > zone_high OR c.close < zone_low) GROUP BY 1, 2),
    e AS (SELECT symbol, session_date, arg_max(close, sod) AS final_close FROM bars GROUP BY 1, 2)
    SELECT z.symbol, CAST(z.session_date AS VARCHAR) AS session_date, {O.r6('zone_width')}, b.sod AS break_sod, CASE WHEN c.close > zone_high THEN 'long' WHEN c.close < zone_low THEN 'short' END AS direction,
    round(CASE WHEN c.close > zone_high THEN final_close - c.close ELSE c.close - final_close END / nullif(zone_width, 0), 6) + 0.0 AS close_r
    FROM zones z LEFT JOIN b USING (symbol, session_date) LEFT JOIN coarse c ON c.symbol = b.symbol AND c.session_date = b.session_date AND c.sod = b.sod LEFT JOIN e ON e.symbol = z.symbol AND e.session_date = z.session_date""",
)
def entry_first_break_outcome(spark, d):
    """Zone width, first hourly close beyond the zone, and its R at the session close."""
    b = study_bars(spark, d)
    z = opening_zones(b, STUDY)
    key = ["symbol", "session_date"]
    c = S.resample(b, STUDY).join(z.select(*key, "zone_high", "zone_low"), key)
    out = (F.col("close") > F.col("zone_high")) | (F.col("close") < F.col("zone_low"))
    first = c.filter((F.col("sod") + STUDY.coarse >= STUDY.decision) & out).groupBy(*key).agg(
        F.min(F.struct("sod", "close", (F.col("close") > F.col("zone_high")).alias("up"))).alias("brk")
    )
    last = b.groupBy(*key).agg(F.max_by("close", "sod").alias("final_close"))
    j = z.join(first, key, "left").join(last, key)
    move = F.when(F.col("brk.up"), F.col("final_close") - F.col("brk.close")).otherwise(F.col("brk.close") - F.col("final_close"))
    return _out(j.select(
        *key, "zone_width", F.col("brk.sod").alias("break_sod"), F.when(F.col("brk.up"), "long").when(~F.col("brk.up"), "short").alias("direction"),
        (move / F.nullif(F.col("zone_width"), F.lit(0.0))).alias("close_r"),
    ))
