"""Source manifest: build, register, select, guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.sessions import quality_report
from barloom.schemas import MANIFEST_DDL, SessionSpec


def infer_timeframe(path) -> F.Column:
    name = F.lower(F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1))
    return F.when(name.contains("30s"), "30s").when(name.contains("1m"), "1m").otherwise("unknown")


def build_manifest(bars: DataFrame, spec: SessionSpec, source: str = "source_path") -> DataFrame:
    """One row per source file with its quality columns."""
    q = quality_report(bars, spec, [source])
    return q.withColumn("timeframe", infer_timeframe(source)).withColumnRenamed(source, "source_path")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest JSON file to one row per source."""
    m = spark.read.schema(MANIFEST_DDL).option("multiLine", True).json(path)
    return m.select("dataset_name", "provider", "timezone", F.explode("files").alias("f")).select(
        "dataset_name", "provider", "timezone", "f.*"
    )


def register(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Replace entries with the same path, append, order by usefulness."""
    kept = manifest.join(entries.select("source_path"), "source_path", "left_anti")
    both = kept.unionByName(entries, allowMissingColumns=True)
    return both.orderBy(F.col("timeframe") != "30s", F.col("sessions").desc(), F.col("rows").desc(), "source_path")


def select_source(manifest: DataFrame, timeframe: str = "30s", role: str | None = None) -> DataFrame:
    """Best source of a timeframe by (priority, sessions, rows).

    A boundary role narrows the choice when it has any source at all.
    """
    m = manifest.filter(F.col("timeframe") == timeframe)
    fits = [F.coalesce(F.col("boundary_role") == role, F.lit(False)).desc()] if role else []
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return m.orderBy(*fits, z("stage2_priority").desc(), z("sessions").desc(), z("rows").desc(), "source_path").limit(1)


def boundary_role(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    return sources.join(manifest.select("source_path", "boundary_role"), "source_path", "left")


def refuse_holdout(path: str, manifest: DataFrame | None = None) -> None:
    """Raise before any read when the source is a holdout by name or by role."""
    named = "holdout" in path.lower()
    listed = manifest is not None and not manifest.filter(
        (F.col("source_path") == path) & (F.col("boundary_role") == "holdout")
    ).isEmpty()
    if named or listed:
        raise PermissionError(f"holdout source refused: {path}")


def without_holdout(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of ``sources`` whose path is not a holdout, as an anti join."""
    held = manifest.filter(F.col("boundary_role") == "holdout").select("source_path")
    return sources.filter(~F.lower("source_path").contains("holdout")).join(held, "source_path", "left_anti")
