"""Sinks written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.operators import market_state as MS
from barloom.operators import universe as U
from barloom.plans import oracle_sql as O
from barloom.plans.evaluation_queries import W0, _out
from barloom.plans.registry import query
from barloom.plans.study_queries import _UNI
from barloom.plans.tables import EXTENDED, STUDY, path_rows, setups, study_bars, ticks
from barloom.session import checkpoint_dir, cut
from barloom.sources import bars as SB
from barloom.sources import records as R


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/barloom-{name}-{uuid.uuid4().hex}"


@query("source_bar_cache", f"WITH {O.BARS} SELECT symbol, year(session_date) AS year, count(*) AS bars, {O.r6('sum(volume)', 'volume')}, {O.r6('max(high)', 'high')} FROM bars GROUP BY 1, 2")
def source_bar_cache(spark, d):
    """Bars written as a cache by session date and read back."""
    path = _folder(spark, "bars")
    SB.write_bars(study_bars(spark, d), path)
    b = spark.read.parquet(path)
    return _out(b.groupBy("symbol", F.year("session_date").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"), F.max("high").alias("high")))


_WORST = "(SELECT path_id FROM path_rows GROUP BY 1 ORDER BY sum(executed_pnl_r), path_id LIMIT 1)"


@query("source_path_rows", f"{W0} SELECT path_id, market_state, count(*) AS trades, {O.r6('sum(executed_pnl_r)', 'total_pnl_r')} FROM path_rows WHERE path_id = {_WORST} GROUP BY 1, 2")
def source_path_rows(spark, d):
    """Path rows stored by run and path; the worst path is read alone."""
    path = _folder(spark, "paths")
    R.write_path_rows(path_rows(setups(spark, d)), path, "one")
    one = R.read_path_rows(spark, path, "one", MS.worst_path(R.read_path_rows(spark, path, "one")))
    return _out(one.groupBy("path_id", "market_state").agg(F.count(F.lit(1)).alias("trades"), F.sum("executed_pnl_r").alias("total_pnl_r")))


@query("source_ledger_cache", f"{_UNI}, n AS (SELECT variant, count(*) AS candidates FROM cands GROUP BY 1) SELECT variant, candidates, hit FROM n, (VALUES (false), (true)) v(hit)")
def source_ledger_cache(spark, d):
    """A candidate ledger built on the first call and found on the second."""
    path = _folder(spark, "ledger")
    parts = []
    for _ in range(2):
        rows, hit = R.load_or_build(spark, path, "k", lambda: R.to_ledger(U.universe_candidates(study_bars(spark, d), STUDY, EXTENDED)))
        parts.append(rows.groupBy(F.col("ledger_variant").alias("variant")).agg(F.count(F.lit(1)).alias("candidates")).withColumn("hit", F.lit(hit)))
    return parts[0].unionByName(parts[1])


@query("source_report", f"{W0} SELECT setup_subtype, count(*) AS trades, {O.r6('sum(pnl_r)', 'total_pnl_r')} FROM setups GROUP BY 1")
def source_report(spark, d):
    """A summary written as a JSON report and read back."""
    path = _folder(spark, "report")
    R.write_report(setups(spark, d).groupBy("setup_subtype").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl_r").alias("total_pnl_r")), path)
    return _out(spark.read.schema("setup_subtype string, trades bigint, total_pnl_r double").json(path))


@query("source_manual_examples", "SELECT direction, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS high_quality, count(*) AS examples, CAST(min(ts) AS VARCHAR) AS first_anchor FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction FROM events WHERE event_id % 7 <> 0) GROUP BY 1")
def source_manual_examples(spark, d):
    """Ticks written as a sheet of hand-marked trades; rows without a readable anchor are dropped."""
    path = _folder(spark, "manual")
    pick = lambda rule, a, b: F.when(rule, F.lit(a)).otherwise(F.lit(b))
    sheet = ticks(spark, d).select(
        F.col("event_id").cast("string").alias("example_id"), F.to_date("ts").cast("string").alias("open_date"), pick(F.col("event_id") % 2 == 0, "LONG", "Short").alias("side"),
        F.when(F.col("event_id") % 7 == 0, F.lit("no time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("entry_anchor_timestamp"),
        pick(F.col("event_id") % 3 == 0, "Yes", "no").alias("setup_valid_normalized"), pick(F.col("event_id") % 5 == 0, "high_quality", "valid").alias("quality_bucket"))
    sheet.write.option("header", True).csv(path)
    m = R.read_manual_examples(spark, path, "UTC")
    first = F.min("anchor_local").cast("string")
    return m.groupBy("direction").agg(F.sum(F.col("manual_validity_label").cast("bigint")).alias("valid"), F.sum(F.col("manual_high_quality_label").cast("bigint")).alias("high_quality"),
                                      F.count(F.lit(1)).alias("examples"), first.alias("first_anchor"))


@query("source_registry", f"{W0} SELECT 'subtype' AS family, count(DISTINCT setup_subtype) AS trials, count(*) AS rows FROM setups")
def source_registry(spark, d):
    """Trials appended to a registry in two batches beside lines that are no JSON, which are skipped."""
    path = _folder(spark, "registry")
    n = cut(setups(spark, d).groupBy("setup_subtype").agg(F.count(F.lit(1)).alias("n")))
    trials = n.select(F.col("setup_subtype").alias("experiment_id"), F.col("n").cast("string").alias("result"), F.lit("subtype").alias("phase"), F.create_map(F.lit("rows"), F.col("n").cast("string")).alias("data_slice"))
    for half in (0, 1):
        R.append_experiments(trials.filter(F.length("experiment_id") % 2 == half), path)
    n.select(F.concat(F.lit("{broken "), "setup_subtype").alias("value")).write.mode("append").text(path)
    back = R.read_experiments(spark, path)
    return back.groupBy(F.col("phase").alias("family")).agg(F.countDistinct("experiment_id").alias("trials"), F.sum(F.col("data_slice")["rows"].cast("bigint")).alias("rows"))
