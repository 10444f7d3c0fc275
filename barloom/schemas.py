"""Table contracts and the session clock.

Every table is keyed by ``(symbol, session_date)``.  Times inside a session are
kept as seconds after local midnight (``sod``), so windows, joins and filters
are integer comparisons; wall-clock columns are derived only for output.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

OHLCV = ("open", "high", "low", "close", "volume")
SESSION_KEY = ["symbol", "session_date"]


@dataclass(frozen=True)
class SessionSpec:
    """Clock of one study; every value is in seconds after local midnight.

    The defaults describe a New York cash session on 30-second bars.
    """

    fine: int = 30
    coarse: int = 60
    tz: str = "America/New_York"
    session_start: int = 34200
    session_end: int = 57600
    zone_start: int = 34200
    zone_end: int = 34259
    decision: int = 34260
    earliest: int = 34320
    latest: int = 39600
    # fixed value: smallest zone width / risk used as a divisor
    min_points: float = 0.25

    @property
    def full_zone_bars(self) -> int:
        return self.coarse // self.fine

    def with_zone(self, zone_end: int, decision: int) -> "SessionSpec":
        return replace(self, zone_end=zone_end, decision=decision)


BAR_COLUMNS = {
    "symbol": "string",
    "session_date": "date",
    "ts": "timestamp_ntz",
    "sod": "int",
    "open": "double",
    "high": "double",
    "low": "double",
    "close": "double",
    "volume": "double",
}

ZONE_COLUMNS = [
    "symbol", "session_date", "zone_first_sod", "zone_last_sod", "decision_sod",
    "zone_high", "zone_low", "zone_mid", "zone_width", "zone_width_bps", "quality_flags",
]

#: Columns a prediction record needs before it can be executed by the backtest.
TRADE_REQUIRED = [
    "candidate_id", "direction", "probability", "entry_time", "exit_time",
    "entry_price", "exit_price", "stop_price", "pnl_r", "session_date",
]

EXPERIMENT_DDL = (
    "experiment_id STRING, hypothesis STRING, config_ref STRING, data_slice MAP<STRING,STRING>, "
    "result STRING, decision STRING, phase STRING, created_at TIMESTAMP"
)

MANIFEST_DDL = (
    "dataset_name STRING, provider STRING, timezone STRING, generated_at STRING, "
    "files ARRAY<STRUCT<symbol:STRING,timeframe:STRING,date_start:STRING,date_end:STRING,"
    "source_path:STRING,boundary_role:STRING,stage2_priority:INT,rows:BIGINT,sessions:BIGINT,"
    "missing_regular_session_bars:BIGINT,duplicate_timestamps:BIGINT,opening_zone_sessions:BIGINT,"
    "quality_flags:ARRAY<STRING>>>"
)


def require_columns(df, names, what: str = "input") -> None:
    """Fail before any job starts when ``df`` misses one of ``names``."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} misses columns: {missing}")
