"""Record sources and sinks: labels, reports, registries, ledgers, path rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schemas import EXPERIMENT_DDL

MANUAL_DDL = (
    "example_id STRING, open_date STRING, side STRING, entry_anchor_timestamp STRING, setup_valid_normalized STRING, quality_bucket STRING"
)


def read_manual_examples(spark: SparkSession, path: str, tz: str = "America/New_York") -> DataFrame:
    """Hand-labelled trades; rows without a parseable anchor are dropped."""
    return manual_examples(spark.read.option("header", True).schema(MANUAL_DDL).csv(path), tz)


def manual_examples(raw: DataFrame, tz: str = "America/New_York") -> DataFrame:
    t = F.try_to_timestamp("entry_anchor_timestamp")
    return (
        raw.withColumn("anchor_utc", t)
        .filter(F.col("anchor_utc").isNotNull())
        .select(
            "*",
            F.from_utc_timestamp("anchor_utc", tz).cast("timestamp_ntz").alias("anchor_local"),
            F.lower("side").alias("direction"),
            F.col("open_date").alias("session_date"),
            F.coalesce((F.lower("setup_valid_normalized") == "yes").cast("int"), F.lit(0)).alias("manual_validity_label"),
            F.coalesce((F.col("quality_bucket") == "high_quality").cast("int"), F.lit(0)).alias("manual_high_quality_label"),
        )
    )


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Summary table as JSON lines."""
    df.write.mode(mode).json(path)


def append_experiments(rows: DataFrame, path: str) -> None:
    """Append trials to the registry; every trial is one JSON line."""
    rows.write.mode("append").json(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows; lines that do not parse are dropped."""
    return spark.read.schema(EXPERIMENT_DDL).option("mode", "DROPMALFORMED").json(path)


def write_path_rows(rows: DataFrame, path: str, run_id: str) -> None:
    """Executed rows of combinatorial paths, partitioned so one path reads alone."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id", "path_id").parquet(path)


def read_path_rows(spark: SparkSession, path: str, run_id: str, path_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).filter(F.col("run_id") == run_id)
    return df if path_id is None else df.filter(F.col("path_id") == path_id)


def ledger_key(source: str, symbol: str, timeframe: str, variants: list[str], sessions: DataFrame, version: str) -> DataFrame:
    """Cache key of a candidate ledger: hash of its inputs.

    Sessions enter through a digest per year, so the text that is hashed stays
    small however long the history is.
    """
    per_year = sessions.select("session_date").distinct().groupBy(F.year("session_date").alias("y")).agg(
        F.sha1(F.array_join(F.array_sort(F.collect_list(F.col("session_date").cast("string"))), ",")).alias("d")
    )
    digest = per_year.agg(F.array_sort(F.collect_list(F.struct("y", "d"))).alias("days"))
    payload = F.to_json(
        F.struct(
            F.lit(source).alias("source_path"), F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"),
            F.array(*[F.lit(v) for v in sorted(variants)]).alias("variant_names"), F.col("days").alias("session_dates"),
            F.lit(version).alias("generator_version"),
        )
    )
    return digest.select(F.substring(F.sha1(payload), 1, 16).alias("ledger_key"))


def to_ledger(cands: DataFrame, variant: str = "variant") -> DataFrame:
    """Candidates to flat ledger records: key columns plus the row as JSON."""
    cols = [c for c in cands.columns if c != variant]
    return cands.select(F.col(variant).alias("ledger_variant"), "candidate_id", F.to_json(F.struct(*cols)).alias("record"))


def from_ledger(records: DataFrame, schema) -> DataFrame:
    """Ledger records back to typed candidates (``schema``: the record's type)."""
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")


def write_ledger(records: DataFrame, path: str, key: str) -> None:
    records.withColumn("ledger_key", F.lit(key)).write.mode("append").partitionBy("ledger_key", "ledger_variant").parquet(path)


def load_or_build(spark: SparkSession, path: str, key: str, build) -> tuple[DataFrame, bool]:
    """Ledger records for a key, from the table when present, else built and stored."""
    from pyspark.errors import AnalysisException

    def stored():
        return spark.read.parquet(path).filter(F.col("ledger_key") == key)

    try:
        if not stored().isEmpty():
            return stored(), True
    except AnalysisException:
        pass
    write_ledger(build(), path, key)
    return stored(), False
