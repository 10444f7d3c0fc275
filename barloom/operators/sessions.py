"""Sessions: filters, quality roll-ups, slices, bar numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.columns import at, iso
from barloom.schemas import SessionSpec

SESSION = ["symbol", "session_date"]


def regular_session(bars: DataFrame, spec: SessionSpec) -> DataFrame:
    """Bars that start in [session_start, session_end)."""
    return bars.filter((F.col("sod") >= spec.session_start) & (F.col("sod") < spec.session_end))


def session_keys(bars: DataFrame) -> DataFrame:
    return bars.select(*SESSION).distinct()


def resample(bars: DataFrame, spec: SessionSpec) -> DataFrame:
    """Coarse bars: left-closed, left-labelled, empty intervals absent."""
    start = (F.floor(F.col("sod") / spec.coarse) * spec.coarse).cast("int")
    return (
        bars.filter(F.col("open").isNotNull() & F.col("close").isNotNull())
        .groupBy("symbol", "session_date", start.alias("bucket"))
        .agg(
            F.min_by("open", "sod").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "sod").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bucket", "sod")
        .withColumn("ts", at("session_date", "sod"))
    )


def completion(bars: DataFrame, spec: SessionSpec, coarse: bool = False) -> DataFrame:
    """Time at which each bar is complete and may be acted on."""
    step = spec.coarse if coarse else spec.fine
    return bars.withColumn("complete_sod", F.col("sod") + F.lit(step))


def duplicate_timestamps(bars: DataFrame, by: list[str]) -> DataFrame:
    """Repeated bar times per source: two aggregations, no distinct per group."""
    per_ts = bars.groupBy(*by, "session_date", "sod").agg(F.count(F.lit(1)).alias("n"))
    return per_ts.groupBy(*by).agg(F.sum(F.col("n") - 1).alias("duplicate_timestamps"))


def session_rollup(bars: DataFrame, spec: SessionSpec, by: list[str]) -> DataFrame:
    """Per session: rows, distinct bars, gap count, zone coverage, last bar."""
    rth = regular_session(bars, spec)
    expected = (spec.session_end - spec.session_start + spec.fine - 1) // spec.fine
    on_grid = ((F.col("sod") - spec.session_start) % spec.fine) == 0
    per_ts = rth.groupBy(*by, "session_date", "sod").agg(F.count(F.lit(1)).alias("n"))
    return per_ts.groupBy(*by, "session_date").agg(
        F.sum("n").alias("session_rows"),
        (F.lit(expected) - F.count(F.when(on_grid, 1))).alias("missing_bars"),
        F.sum(
            F.when(F.col("sod").between(spec.zone_start, spec.zone_end), F.col("n")).otherwise(0)
        ).alias("zone_bars"),
        F.max("sod").alias("last_sod"),
    )


def missing_bars(bars: DataFrame, spec: SessionSpec) -> DataFrame:
    """The absent grid slots themselves: full grid left-anti observed bars."""
    grid = session_keys(regular_session(bars, spec)).select(
        *SESSION,
        F.explode(F.sequence(F.lit(spec.session_start), F.lit(spec.session_end - 1), F.lit(spec.fine))).alias("sod"),
    )
    return grid.join(bars.select(*SESSION, "sod"), [*SESSION, "sod"], "left_anti")


def quality_report(bars: DataFrame, spec: SessionSpec, by: list[str] | None = None) -> DataFrame:
    """One row per source: counts, date range, session ends, flags."""
    by = by or ["symbol"]
    whole = bars.groupBy(*by, "session_date", "sod").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - 1).alias("duplicate_timestamps"),
        F.min(F.struct("session_date", "sod")).alias("first_bar"),
        F.max(F.struct("session_date", "sod")).alias("final_bar"),
    )
    per = session_rollup(bars, spec, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.min(F.struct("session_date", "last_sod")).alias("early"),
        F.max(F.struct("session_date", "last_sod")).alias("late"),
        F.sum("missing_bars").alias("missing_regular_session_bars"),
        F.count(F.when(F.col("zone_bars") >= spec.full_zone_bars, 1)).alias("opening_zone_sessions"),
    )
    j = whole.join(per, by, "left").fillna(
        0, ["sessions", "missing_regular_session_bars", "opening_zone_sessions"]
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("duplicate_timestamps") > 0, F.lit("duplicate_timestamps")),
            F.when(F.col("missing_regular_session_bars") > 0, F.lit("missing_regular_session_bars")),
            F.when(F.col("opening_zone_sessions") < F.col("sessions"), F.lit("missing_opening_zone_sessions")),
        )
    )
    return j.select(
        *by,
        "rows",
        iso("first_bar.session_date", "first_bar.sod").alias("date_start"),
        iso("final_bar.session_date", "final_bar.sod").alias("date_end"),
        "sessions",
        iso("early.session_date", "early.last_sod").alias("earliest_session_end"),
        iso("late.session_date", "late.last_sod").alias("latest_session_end"),
        "missing_regular_session_bars",
        "duplicate_timestamps",
        "opening_zone_sessions",
        flags.alias("quality_flags"),
    )


def session_end_coverage(bars: DataFrame, spec: SessionSpec, horizon: int, by: list[str] | None = None) -> DataFrame:
    """Does even the earliest-closing session hold a full label horizon?"""
    by = by or ["symbol"]
    need = spec.latest + horizon * spec.fine
    return session_rollup(bars, spec, by).groupBy(*by).agg(
        F.min("last_sod").alias("min_last_sod"),
        (F.min("last_sod") >= F.lit(need)).alias("covers_horizon"),
    )


def slice_sessions(bars: DataFrame, n: int, *, last: bool = True) -> DataFrame:
    """Keep the first or last ``n`` distinct session dates of the table."""
    dates = bars.select("session_date").distinct()
    keep = dates.orderBy(F.col("session_date").desc() if last else F.col("session_date").asc()).limit(max(1, int(n)))
    return bars.join(F.broadcast(keep), "session_date", "left_semi")


def number_bars(bars: DataFrame) -> DataFrame:
    """Add ``pos`` (in session), ``bar_no`` (per symbol) and the session's last number.

    The per-symbol number is a running sum over one row per session, so no
    task ever sorts all bars of a symbol.
    """
    sizes = bars.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("__n"))
    prior = W.partitionBy("symbol").orderBy("session_date").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select(*SESSION, "__n", F.coalesce(F.sum("__n").over(prior), F.lit(0)).alias("__base"))
    inside = W.partitionBy(*SESSION).orderBy("sod")
    return (
        bars.join(base, SESSION)
        .withColumn("pos", F.row_number().over(inside))
        .withColumn("bar_no", F.col("__base") + F.col("pos"))
        .withColumn("session_last_no", F.col("__base") + F.col("__n"))
        .drop("__n", "__base")
    )
