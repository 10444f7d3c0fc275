"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str | int = "*", app: str = "barloom", shuffle: int | None = None) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    n = shuffle or (os.cpu_count() or 8 if cores == "*" else int(cores))
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BARLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once per session, wherever they start."""
    context = spark.sparkContext
    if not any(f.rsplit("/", 1)[-1] == "barloom.zip" for f in context.listFiles):
        root = Path(__file__).resolve().parent
        file = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/barloom", "zip", root.parent, root.name)
        context.addPyFile(file)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a scratch one only for local masters."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder; survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """``cut`` as Parquet: smaller, and readers take the columns they need; partitions and their order are not kept."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/barloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
