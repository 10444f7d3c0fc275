"""Sources and sinks: round trips, guards, time zones, streaming twins."""

import random
from dataclasses import replace

import pytest
from market_fixtures import SPEC, bars_frame, random_session
from pyspark.sql import functions as F

from barloom.operators import candidates as C
from barloom.operators.attempts import event_driven_candidates, event_stream
from barloom.operators.features import apply_feature_family, numeric_feature_columns
from barloom.operators.sessions import resample
from barloom.operators.zones import opening_zones
from barloom.sources import bars as SB
from barloom.sources import manifest as SM
from barloom.sources import records as SR
from barloom.streaming.bars import stream_attempts, stream_resample


def test_csv_with_offsets_and_local_times(spark, tmp_path):
    p = tmp_path / "x_30s_.csv"
    p.write_text("Timestamp, OPEN ,high,Low,CLOSE,volume,extra\n2024-07-01T13:30:00Z,1,2,0.5,1.5,10,z\n2024-01-02T09:30:00-05:00,1,2,0.5,1.5,10,z\n2024-01-02 09:31:00,1,2,0.5,1.5,10,z\n")
    b = SB.load_bars(spark, str(p), symbol="M", timeframe="30s")
    rows = sorted((str(r.session_date), r.sod, r.symbol, r.open) for r in b.collect())
    assert rows == [("2024-01-02", 34200, "M", 1.0), ("2024-01-02", 34260, "M", 1.0), ("2024-07-01", 34200, "M", 1.0)]
    with pytest.raises(ValueError, match="misses columns"):
        SB.normalize_columns(spark.createDataFrame([(1, 2)], "open int, high int"))
    with pytest.raises(ValueError):
        SB.load_bars(spark, str(p), fmt="numbers")


def _random(spark, n=6, seed=4):
    rng = random.Random(seed)
    return bars_frame(spark, [r for i in range(n) for r in random_session(rng, "S", "2024-05-%02d" % (i + 1), minutes=40)])


def test_bar_cache_prunes_by_date(spark, tmp_path):
    b = _random(spark)
    SB.write_bars(b, str(tmp_path / "bars"))
    back = spark.read.parquet(str(tmp_path / "bars"))
    one = back.filter("session_date = '2024-05-03'")
    assert back.count() == b.count()
    assert "PartitionFilters: [isnotnull(session_date" in one._jdf.queryExecution().toString()
    w = SB.opening_window(b, SPEC, 34200 + 600)
    assert w.agg(F.max("sod")).first()[0] <= 34800


def test_boundary_caches(spark, tmp_path):
    b = _random(spark)
    bd = spark.sql("SELECT 'exploration' AS boundary_role, DATE'2024-05-01' AS date_start, DATE'2024-05-04' AS date_end UNION ALL SELECT 'validation', DATE'2024-05-05', DATE'2024-05-09'")
    SB.write_boundary_caches(b, bd, str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "c")).groupBy("boundary_role").agg(F.countDistinct("session_date").alias("n")).collect()
    assert {r.boundary_role: r.n for r in got} == {"exploration": 4, "validation": 2}


def test_manifest_selection_and_holdout_guard(spark):
    m = spark.createDataFrame([("a", "30s", "exploration", 1, 10, 5), ("b", "30s", "exploration", 2, 1, 1), ("h", "30s", "holdout", 9, 9, 9), ("c", "1m", "exploration", 9, 9, 9)],
                              "source_path string, timeframe string, boundary_role string, stage2_priority int, rows int, sessions int")
    pick = lambda **k: SM.select_source(m, **k).first().source_path
    assert pick(role="exploration") == "b" and pick() == "h" and pick(role="validation") == "h" and pick(timeframe="1m") == "c"
    for bad in ("/x/HOLDOUT_30s.parquet", "h"):
        with pytest.raises(PermissionError):
            SM.refuse_holdout(bad, m)
    SM.refuse_holdout("a", m)
    assert sorted(r.source_path for r in SM.without_holdout(m, m).collect()) == ["a", "b", "c"]
    up = SM.register(m.drop("boundary_role"), m.drop("boundary_role").filter("source_path = 'a'").withColumn("rows", F.lit(99)))
    assert [r.source_path for r in up.collect()] == ["h", "a", "b", "c"]


def test_manual_examples_drop_bad_anchors(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("example_id,open_date,side,entry_anchor_timestamp,setup_valid_normalized,quality_bucket\n1,2026-01-02,Long,2026-01-02T14:31:00Z,Yes,high_quality\n2,2026-01-02,short,nonsense,no,avoid\n")
    r = SR.read_manual_examples(spark, str(p)).collect()
    assert len(r) == 1 and (r[0].direction, r[0].manual_validity_label, r[0].manual_high_quality_label) == ("long", 1, 1)


def test_registry_appends_and_skips_bad_lines(spark, tmp_path):
    path = str(tmp_path / "reg")
    row = spark.createDataFrame([("e1", "h", "cfg", {"source": "x"}, "{}", "accept", "exploration")], "experiment_id string, hypothesis string, config_ref string, data_slice map<string,string>, result string, decision string, phase string")
    for _ in range(2):
        SR.append_experiments(row.withColumn("created_at", F.current_timestamp()), path)
    (tmp_path / "reg" / "bad.json").write_text("{not json\n")
    back = SR.read_experiments(spark, path)
    assert back.filter("decision = 'accept'").count() == 2


def test_path_rows_and_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("cpcv_001", "a", 1.0), ("cpcv_002", "b", -1.0)], "path_id string, candidate_id string, executed_pnl_r double")
    SR.write_path_rows(rows, str(tmp_path / "p"), "r1")
    assert SR.read_path_rows(spark, str(tmp_path / "p"), "r1", "cpcv_002").count() == 1
    spec = replace(SPEC, latest=34200 + 2400)
    c = C.canonical(_random(spark), spec).withColumn("variant", F.lit("v"))
    rec = SR.to_ledger(c).cache()
    back = SR.from_ledger(rec, c.drop("variant").schema)
    assert sorted(map(str, back.select(*c.drop("variant").columns).collect())) == sorted(map(str, c.drop("variant").collect()))
    key = SR.ledger_key("src", "S", "30s", ["b", "a"], c, "g1").first()[0]
    assert len(key) == 16 and key == SR.ledger_key("src", "S", "30s", ["a", "b"], c, "g1").first()[0]
    first, hit = SR.load_or_build(spark, str(tmp_path / "l"), key, lambda: rec)
    again, hit2 = SR.load_or_build(spark, str(tmp_path / "l"), key, lambda: rec)
    assert (hit, hit2) == (False, True) and first.count() == again.count() == rec.count()


def test_feature_columns(spark):
    df = spark.createDataFrame([("a", 1.0, None, 2, "x", 0.5)], "candidate_id string, zone_width double, empty double, reclaim_count int, setup_subtype string, eng_rsi double")
    assert numeric_feature_columns(df, {"zone_width"}) == ["reclaim_count", "eng_rsi"]
    assert apply_feature_family(df, "bnr_core").columns == ["candidate_id", "zone_width", "reclaim_count", "setup_subtype"]
    assert apply_feature_family(df, "engineer_indicators").columns == ["candidate_id", "setup_subtype", "eng_rsi"]
    assert apply_feature_family(df, "all_features").columns == df.columns


def _drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_streaming_twins_equal_batch(spark, tmp_path):
    b = _random(spark, 4, seed=8)
    spec = replace(SPEC, latest=34200 + 2400)
    z = opening_zones(b, spec)
    ev = event_stream(b, z, spec)
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    src = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    _drain(stream_attempts(src, spec), "attempts_out")
    want = sorted(map(tuple, event_driven_candidates(b, z, spec).collect()))
    got = sorted(map(tuple, spark.table("attempts_out").collect()))
    assert got == want and len(want) > 0
    tb = b.withColumn("event_time", F.col("ts").cast("timestamp"))
    tail = tb.limit(1).withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 400 DAYS"))
    tb.coalesce(1).write.parquet(str(tmp_path / "b"))
    tail.coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    s = spark.readStream.schema(tb.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b"))
    _drain(stream_resample(s, 60), "bars_out")
    got = {(r.event_time.timestamp(), r.close, r.high) for r in spark.table("bars_out").filter("year(event_time) = 2024").collect()}
    want = {(r.t.timestamp(), r.close, r.high) for r in resample(b, spec).withColumn("t", F.col("ts").cast("timestamp")).collect()}
    assert got == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_bars_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-01-02T14:30:00Z", "2024-01-02 09:30:00-05:00", "2024-01-02 09:30:00", "2024-07-02T13:30:00Z"]
        raw = spark.createDataFrame([(t, 1.0, 1.0, 1.0, 1.0, 1.0) for t in texts], "timestamp string, open double, high double, low double, close double, volume double")
        whole = raw.where("timestamp like '%Z'").withColumn("timestamp", F.to_timestamp("timestamp"))
        wall = raw.where("length(timestamp) = 19").withColumn("timestamp", F.to_timestamp_ntz("timestamp"))
        for part in (raw, whole, wall):
            got = SB.canonical_bars(part, symbol="A").selectExpr("date_format(ts, 'HH:mm')", "unix_timestamp(ts_event_utc) % 86400").collect()
            assert {r[0] for r in got} == {"09:30"} and {r[1] for r in got} <= {52200, 48600}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
