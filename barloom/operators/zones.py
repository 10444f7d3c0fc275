"""Opening price zones: one row per session and zone definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schemas import SESSION_KEY, SessionSpec


def opening_zones(bars: DataFrame, spec: SessionSpec) -> DataFrame:
    """High, low, midpoint and width of the bars inside the zone window."""
    width = F.col("zone_high") - F.col("zone_low")
    z = (
        bars.filter(F.col("sod").between(spec.zone_start, spec.zone_end))
        .groupBy(*SESSION_KEY)
        .agg(
            F.min("sod").alias("zone_first_sod"),
            F.max("sod").alias("zone_last_sod"),
            F.max("high").alias("zone_high"),
            F.min("low").alias("zone_low"),
            F.count(F.lit(1)).alias("zone_bars"),
        )
    )
    return z.select(
        *SESSION_KEY,
        "zone_first_sod",
        "zone_last_sod",
        F.lit(spec.decision).alias("decision_sod"),
        "zone_high",
        "zone_low",
        ((F.col("zone_high") + F.col("zone_low")) / 2).alias("zone_mid"),
        width.alias("zone_width"),
        F.coalesce(
            width / F.nullif((F.col("zone_high") + F.col("zone_low")) / 2, F.lit(0.0)) * 10000, F.lit(0.0)
        ).alias("zone_width_bps"),
        F.array_compact(
            F.array(
                F.when(width <= 0, F.lit("non_positive_zone_width")),
                F.when(F.col("zone_bars") < spec.full_zone_bars, F.lit("partial_opening_zone")),
            )
        ).alias("quality_flags"),
    )
