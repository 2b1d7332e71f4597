import datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import baselines, timeline
from pulsegrid.operators.core import slot_start
from pulsegrid.streaming import carried, rollups


def run(spark, df, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    d = str(tmp_path / "in")
    e.repartition(3).write.parquet(d)
    return e, spark.readStream.schema(e.schema).parquet(d)


def test_streamed_grid_equals_batch(spark, sf, tmp_path):
    e, s = source(spark, sf, tmp_path)
    got = run(spark, rollups.slot_grid(s, ["user_id"], "ts", "value", 21600), "grid", str(tmp_path / "c"))
    want = timeline.slot_grid(e, ["user_id"], "ts", "value", 21600).where("hrv_n > 0").select("user_id", slot_start("slot", 21600).alias("slot_start"), F.round("hrv", 6), "hrv_n")
    got = got.select("user_id", F.col("slot_start").cast("timestamp_ntz"), F.round("hrv", 6), "hrv_n")
    assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_streamed_blocks_are_sessions(spark, tmp_path):
    m = spark.range(12).where("id not in (3, 4, 8)").select(F.lit("p").alias("pid"), slot_start(F.col("id") + 29_000_000, 60).alias("ts"))
    d = str(tmp_path / "m")
    m.write.parquet(d)
    out = run(spark, rollups.blocks(spark.readStream.schema(m.schema).parquet(d), ["pid"], "ts"), "blocks", str(tmp_path / "c2"))
    assert sorted(r.minutes for r in out.collect()) == [3, 3, 3]


def test_streamed_intervals_merge_by_start(spark, tmp_path):
    m = spark.createDataFrame([("p", 1, 1.0, None), ("p", 1, 2.0, 4.0), ("p", 2, None, None)], "pid string, k long, deep double, steps double").select(
        "pid", slot_start(F.col("k") + 29_000_000, 60).alias("start"), "deep", "steps")
    d = str(tmp_path / "i")
    m.write.parquet(d)
    out = run(spark, rollups.merged_intervals(spark.readStream.schema(m.schema).parquet(d), ["pid"], "start", ["deep"], ["steps"]), "iv", str(tmp_path / "c3"))
    assert sorted((r.deep, r.steps or -1.0) for r in out.collect()) == [(0.0, -1.0), (3.0, 4.0)]


def carried_rows(spark, rows, folder, **settings):
    """Each list of rows is one file, hence one micro-batch; what the stream emits."""
    schema = "pid string, ts timestamp_ntz, hrv double"
    for k, part in enumerate(rows):
        spark.createDataFrame([(p, datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m), v) for p, m, v in part], schema).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")
    q = carried.last_value(stream, ["pid"], "ts", "hrv", 3, **settings).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
    return spark.read.schema("pid string, origin timestamp_ntz, h long, pred double").parquet(f"{folder}/out")


@pytest.fixture
def keyed_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", carried.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


END = [("end", 100_000, 1.0)]


def test_streamed_last_value_equals_batch(spark, tmp_path, keyed_store):
    parts = [[("a", 0, 5.0), ("a", 20, 7.0), ("b", 3, 1.0)], [("a", 15, 9.0), ("b", 40, None), ("c", 30, None)], [("a", 31, 8.0), ("a", 31, 6.0), ("b", 12, 2.0)], END]
    got = carried_rows(spark, parts, str(tmp_path), quiet="2 hours")
    flat = [(p, m, v) for part in parts[:-1] for p, m, v in part]
    want = baselines.last_value(spark.createDataFrame(flat, "pid string, slot long, hrv double"), "pid", "slot", "hrv", 3).where("pid <> 'a'").select("pid", F.col("h").cast("long"), "pred")
    rows = got.where("pid <> 'end'").select("pid", "h", "pred")
    assert sorted(map(tuple, rows.where("pid <> 'a'").collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, rows.where("pid = 'a'").collect())) == [("a", h, 8.0) for h in (1, 2, 3)]
    assert {str(r.origin) for r in got.where("pid = 'a'").collect()} == {"2026-01-01 00:31:00"}


def test_late_readings_are_dropped_and_a_quiet_series_starts_afresh(spark, tmp_path, keyed_store):
    parts = [[("a", 0, 5.0), ("x", 500, 1.0)], [("a", 10, 99.0), ("x", 501, 1.0)], [("a", 700, 6.0), ("x", 701, 2.0)], END]
    got = carried_rows(spark, parts, str(tmp_path), quiet="1 hour", late="30 minutes")
    a = sorted((str(r.origin), r.pred) for r in got.where("pid = 'a' and h = 1").collect())
    assert a == [("2026-01-01 00:00:00", 5.0), ("2026-01-01 11:40:00", 6.0)]
    assert [r.pred for r in got.where("pid = 'x' and h = 3").collect()].count(2.0) == 1
