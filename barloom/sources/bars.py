"""Bar sources and sinks: OHLCV files in, canonical bar tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schemas import OHLCV, SessionSpec, require_columns

# fixed values: accepted names of the time column, in order of preference
TIME_COLUMNS = ("ts_event", "timestamp", "datetime", "time", "date")
# fixed value: text times with an explicit zone
OFFSET_PATTERN = r"(Z|[+-]\d{2}:\d{2})$"


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim and lower-case column names; the five OHLCV columns must exist."""
    out = df.toDF(*[n.strip().lower() for n in df.columns])
    require_columns(out, OHLCV, "bar file")
    return out


def time_column(df: DataFrame) -> str:
    for name in TIME_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"no time column among {df.columns}")


def parse_instant(col, kind: str, tz: str, source_tz: str | None = None):
    """Instant of a time column, as UTC wall-clock time; the session zone plays no part.

    Text with an explicit offset is taken as is; everything without one is
    wall-clock time in ``source_tz`` (or the exchange zone).
    """
    zone = F.lit(source_tz or tz)
    if kind == "timestamp":
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))
    if kind in ("timestamp_ntz", "date"):
        return F.convert_timezone(zone, F.lit("UTC"), col.cast("timestamp_ntz"))
    text = col.cast("string")
    offset = F.regexp_replace(F.regexp_extract(text, OFFSET_PATTERN, 1), "Z", "+00:00")
    wall = F.to_timestamp_ntz(F.regexp_replace(text, r"\s*" + OFFSET_PATTERN, ""))
    return F.convert_timezone(F.when(offset != "", offset).otherwise(zone), F.lit("UTC"), wall)


def with_session_keys(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Derive session date and second of day from local wall-clock time."""
    t = F.col(ts)
    return df.withColumns(
        {
            "session_date": F.to_date(t),
            "sod": F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t).cast("int"),
        }
    )


def canonical_bars(
    raw: DataFrame,
    *,
    symbol: str | None = None,
    timeframe: str = "30s",
    tz: str = "America/New_York",
    source_tz: str | None = None,
) -> DataFrame:
    """Raw bar rows to the canonical table, alike under every session time zone."""
    df = normalize_columns(raw)
    t = time_column(df)
    instant = parse_instant(F.col(t), df.schema[t].dataType.typeName(), tz, source_tz)
    sym = F.lit(symbol) if symbol is not None else F.col("symbol")
    out = df.select(
        sym.alias("symbol"),
        F.convert_timezone(F.lit("UTC"), F.current_timezone(), instant).cast("timestamp").alias("ts_event_utc"),
        F.convert_timezone(F.lit("UTC"), F.lit(tz), instant).alias("ts"),
        F.lit(timeframe).alias("source_timeframe"),
        *[F.col(x).cast("double").alias(x) for x in OHLCV],
    )
    return with_session_keys(out)


def load_bars(spark: SparkSession, path: str, *, fmt: str | None = None, **kw) -> DataFrame:
    """Read a parquet or CSV bar file (or folder of files)."""
    kind = fmt or ("csv" if str(path).rstrip("/").lower().endswith(".csv") else "parquet")
    if kind == "csv":
        raw = spark.read.option("header", True).csv(path)
    elif kind == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported bar format: {kind}")
    return canonical_bars(raw, **kw)


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bar cache partitioned by session date, so date filters prune files."""
    bars.repartition("session_date").write.mode(mode).partitionBy("session_date").parquet(path)


def bars_from_ticks(ticks: DataFrame, *, symbol: str, ts: str, price: str, key: str, seconds: int) -> DataFrame:
    """Aggregate price ticks into bars of ``seconds`` (map-side combined)."""
    at = F.struct(ts, key)
    keyed = with_session_keys(ticks, ts).withColumn("sod", (F.floor(F.col("sod") / seconds) * seconds).cast("int"))
    return (
        keyed.groupBy(F.col(symbol).alias("symbol"), "session_date", "sod")
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .withColumn("ts", F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("sod").cast("decimal(18,6)")))
    )


def opening_window(bars: DataFrame, spec: SessionSpec, window_end: int) -> DataFrame:
    """Session bars from the open up to ``window_end``, both ends included."""
    return bars.filter(F.col("sod").between(spec.session_start, window_end))


def split_by_boundary(bars: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Tag bars with the role of the date window they fall in.

    ``boundaries`` is the configured list of disjoint windows (boundary_role,
    date_start, date_end): a handful of rows, so it is broadcast.
    """
    return bars.join(
        F.broadcast(boundaries), F.col("session_date").between(F.col("date_start"), F.col("date_end"))
    ).drop("date_start", "date_end")


def write_boundary_caches(bars: DataFrame, boundaries: DataFrame, path: str) -> None:
    """One folder per role; reading one role prunes the others."""
    split_by_boundary(bars, boundaries).write.mode("overwrite").partitionBy("boundary_role").parquet(path)
