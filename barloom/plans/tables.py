"""Bindings of the provided tables to bars, trades and path rows.

``events`` are price ticks of five symbols, cut into half-hour bars with hourly
coarse bars; ``orders`` are trade records whose fields are formulas on the
order.  Every row of a table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schemas import SessionSpec
from barloom.sources.bars import bars_from_ticks

#: Clock of the tick study: half-hour fine bars, hourly coarse bars, 24 h sessions.
STUDY = SessionSpec(
    fine=1800, coarse=3600, tz="UTC", session_start=0, session_end=86400, zone_start=0, zone_end=7199, decision=7200,
    earliest=10800, latest=72000,
)
EXTENDED = SessionSpec(
    fine=1800, coarse=3600, tz="UTC", session_start=0, session_end=86400, zone_start=0, zone_end=14399, decision=14400,
    earliest=18000, latest=86400,
)
HORIZON = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")


def study_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour bars per event type."""
    return bars_from_ticks(ticks(spark, sf_dir), symbol="event_type", ts="ts", price="value", key="event_id", seconds=STUDY.fine)


def _u(a: int, b: int, m: int = 1000) -> str:
    """Deterministic number in [0, 1) from the two order keys."""
    return f"(CAST((o_orderkey * {a} + o_custkey * {b}) % {m} AS DOUBLE) / {m}e0)"


def _gap(expr: str, a: int, b: int) -> str:
    return f"(CASE WHEN (o_orderkey * {a} + o_custkey * {b}) % 37 = 0 THEN NULL ELSE {expr} END)"


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_SLOT = "((o_orderkey * 7 + o_custkey) % 700)"
_PICK = f"({_CENTS} % 251)"
_RISK = "(1e0 + CAST(o_orderkey % 7 AS DOUBLE) * 5e-1)"
_SIDE = "(CASE WHEN o_orderkey % 2 = 0 THEN 1e0 ELSE -1e0 END)"
_ENTRY = f"(floor(CAST({_CENTS} AS DOUBLE) / 1e4 * 4e0) / 4e0)"
_PNL = f"((CAST({_PICK} AS DOUBLE) - 100e0) / 100e0)"
_LABEL = f"(CASE WHEN {_PICK} >= 190 THEN 1 ELSE 0 END)"
_PROB = f"(25e-2 + 5e-1 * {_u(13, 29)} + 2e-1 * {_LABEL})"

#: Fields of a trade record as expressions valid in Spark SQL and ANSI SQL alike.
SETUP_FIELDS: dict[str, str] = {
    "candidate_id": "concat('C', lpad(CAST(o_orderkey AS VARCHAR(20)), 10, '0'))",
    "trade_no": "o_orderkey",
    "session_date": "CAST(o_orderdate AS DATE)",
    "slot": _SLOT,
    "bars_held": "CAST(1 + (o_orderkey * 3 + o_custkey * 5) % 20 AS INT)",
    "direction": "(CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END)",
    "setup_subtype": "(CASE (o_custkey * 7 + o_orderkey) % 5 WHEN 0 THEN 'clean_break_continuation' WHEN 1 THEN "
    "'balanced_reclaim_continuation' WHEN 2 THEN 'deep_retrace_repair' WHEN 3 THEN 'wick_reclaim_repair' ELSE 'weak_follow_through' END)",
    "market_state": "(CASE (o_custkey * 11 + o_orderkey * 5) % 6 WHEN 0 THEN 'clean_strong_continuation' WHEN 1 THEN "
    "'weak_or_grindy_continuation' WHEN 2 THEN 'auction_repair' WHEN 3 THEN 'balanced_chop' WHEN 4 THEN 'messy_transition' ELSE "
    "'failed_directional' END)",
    "setup_quality": "(CASE (o_custkey + o_orderkey * 3) % 3 WHEN 0 THEN 'high_quality' WHEN 1 THEN 'marginal' ELSE 'avoid' END)",
    "entry_price": _ENTRY,
    "stop_price": f"({_ENTRY} - {_SIDE} * {_RISK})",
    "target_price": f"({_ENTRY} + {_SIDE} * 15e-1 * {_RISK})",
    "exit_price": f"({_ENTRY} + {_SIDE} * {_PNL} * {_RISK})",
    "pnl_r": _PNL,
    "label": _LABEL,
    "outcome": f"(CASE WHEN {_PICK} >= 190 THEN 'target' WHEN {_PICK} <= 40 THEN 'stop' WHEN {_PICK} <= 50 THEN 'ambiguous_stop_first' "
    "ELSE 'timeout' END)",
    "probability": _PROB,
    "prediction": f"(CASE WHEN {_PROB} >= 5e-1 THEN 1 ELSE 0 END)",
    "prior_close_gap": f"({_u(19, 41)} - 5e-1)",
    "trigger_seconds_after_open": f"({_SLOT} * 30)",
    "reg_high_vol_state": "CAST((o_orderkey + o_custkey) % 3 = 0 AS INT)",
    "reg_trending_state": "CAST((o_orderkey * 5 + o_custkey) % 2 = 0 AS INT)",
    "reclaim_failure_count": "CAST((o_orderkey + o_custkey * 3) % 4 AS DOUBLE)",
    "reclaim_count": "CAST((o_orderkey * 2 + o_custkey) % 3 AS INT)",
    "first_break_close_confirmed": "CAST(CAST((o_orderkey + o_custkey * 2) % 5 > 0 AS INT) AS DOUBLE)",
    "first_break_wick_only": "CAST(CAST((o_orderkey + o_custkey * 2) % 5 = 0 AS INT) AS DOUBLE)",
    "opposite_boundary_close_violation": "CAST(CAST((o_orderkey + o_custkey * 7) % 29 = 0 AS INT) AS DOUBLE)",
    "break_efficiency_ratio": _gap(_u(3, 17), 1, 2),
    "break_body_fraction": _u(23, 11),
    "break_close_distance_to_zone": _u(31, 7),
    "break_range_expansion": f"(3e0 * {_u(37, 5)})",
    "break_volume_surge": f"(2e0 * {_u(41, 3)})",
    "continuation_displacement_ratio": _u(43, 19),
    "post_reclaim_close_strength": _u(47, 23),
    "deepest_zone_retrace_fraction": _u(53, 13),
    "reclaim_close_location": _gap(_u(59, 37), 2, 1),
    "reclaim_body_strength": _u(61, 43),
    "reclaim_latency_bars": "CAST((o_orderkey * 3 + o_custkey) % 6 AS DOUBLE)",
    "pivot_overlap_ratio": _u(67, 47),
    "pivot_symmetry": _u(71, 53),
    "pre_trigger_range": f"(10e0 * {_u(73, 59)})",
    "zone_width": f"(5e-1 + 4e0 * {_u(79, 61)})",
    "entry_distance_from_zone_high": f"({_u(83, 67)} - 3e-1)",
    "entry_distance_from_zone_low": _u(89, 71),
    "reg_vol_ratio": f"(2e0 * {_u(97, 73)})",
    "reg_vol_10": _gap(f"(1e-2 * {_u(101, 79)})", 3, 1),
    "reg_trend_30": f"({_u(103, 83)} - 5e-1)",
    "reg_trend_strength_10": f"(4e0 * ({_u(107, 89)} - 5e-1))",
    "reg_trend_strength_30": f"(4e0 * ({_u(109, 97)} - 5e-1))",
    "reg_range_ratio_10": f"(6e0 * {_u(113, 101)})",
    "reg_range_ratio_30": f"(9e0 * {_u(127, 103)})",
    "reg_chop_10": f"(1e0 + 12e0 * {_u(131, 107)})",
    "reg_chop_30": f"(1e0 + 20e0 * {_u(137, 109)})",
    "directional_efficiency_open_to_now": _u(139, 113),
    "recent_directional_efficiency": _u(149, 127),
    "body_to_range_ratio_recent": _u(151, 131),
    "wick_rejection_ratio_recent": _u(157, 137),
    "alternating_bar_ratio": _u(163, 139),
    "local_swing_overlap_score": _u(167, 149),
    "impulse_speed_score": _u(173, 151),
    "repair_speed_score": _u(179, 157),
    "flem_compression_score": _u(181, 163),
    "pivot_cleanliness_score": _u(191, 167),
    "distance_to_recent_high_low": f"(2e0 * {_u(193, 173)})",
    "failed_followthrough_count": "CAST((o_orderkey * 3 + o_custkey * 2) % 5 AS DOUBLE)",
}
PATHS = 8
#: Slippage-free cost taken from every executed path row, in R.
PATH_COST = 0.1


def setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade records from orders, with entry and exit on a 30-second grid."""
    base = table(spark, sf_dir, "orders").selectExpr(*[f"{v} AS {k}" for k, v in SETUP_FIELDS.items()])
    entry = F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(secs=(34200 + F.col("slot") * 30).cast("decimal(18,6)"))
    return base.withColumn("entry_time", entry).withColumn(
        "exit_time", F.col("entry_time") + F.make_dt_interval(secs=(F.col("bars_held") * 30).cast("decimal(18,6)"))
    ).drop("slot")


def path_rows(rows: DataFrame) -> DataFrame:
    """Executed rows of eight evaluation paths; every setup is on two of them."""
    a = F.pmod(F.col("trade_no"), F.lit(PATHS)) + 1
    b = F.pmod(F.col("trade_no") + 3, F.lit(PATHS)) + 1
    return rows.withColumn("__p", F.explode(F.array(a, b))).withColumns(
        {"path_id": F.format_string("cpcv_%03d", F.col("__p")), "executed_pnl_r": F.col("pnl_r") - PATH_COST}
    ).drop("__p")


def thresholds(spark: SparkSession) -> DataFrame:
    # fixed values: threshold grid
    return spark.createDataFrame([(x,) for x in (0.45, 0.50, 0.55, 0.60, 0.65)], "threshold double")
