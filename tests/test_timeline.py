import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import timeline
from pulsegrid.operators.core import slot_start
from pulsegrid.sources import readings as R
from pulsegrid.sources import stage

T = "2026-01-05 "


def points(spark, rows):
    return spark.createDataFrame(rows, "pid string, vital string, t string, value double").select("pid", "vital", F.col("t").cast("timestamp_ntz").alias("ts"), "value")


def spans(spark, rows):
    return spark.createDataFrame(rows, "pid string, a string, b string").select("pid", F.col("a").cast("timestamp_ntz").alias("start"), F.col("b").cast("timestamp_ntz").alias("end"))


def test_duplicate_intervals_blank_rules(spark):
    df = spark.createDataFrame([("p", 1, None, None), ("p", 1, None, None), ("p", 2, 1.0, 5.0), ("p", 2, 2.0, 3.0)], "pid string, start int, deep double, steps double")
    out = {r.start: (r.deep, r.steps) for r in timeline.merge_duplicates(df, ["pid"], "start", ["deep"], ["steps"]).collect()}
    assert out == {1: (0.0, None), 2: (3.0, 5.0)}  # a sum of blanks is 0, a maximum of blanks stays blank


def test_minute_table_is_dense_and_widened_by_flags(spark):
    p = points(spark, [("p", "hr", T + "00:02:10", 60.0), ("p", "hr", T + "00:02:50", 70.0), ("p", "hrv", T + "00:05:00", 40.0)])
    m = timeline.minute_table(p, {"asleep": spans(spark, [("p", T + "00:00:30", T + "00:03:10"), ("p", T + "00:06:00", T + "00:06:00")])}, ["hr", "hrv"])
    rows = [(str(r.m)[11:16], r.hr, r.hrv, r.asleep) for r in m.withColumn("m", slot_start("slot", 60)).orderBy("slot").collect()]
    assert rows == [("00:00", None, None, 1), ("00:01", None, None, 1), ("00:02", 65.0, None, 1), ("00:03", None, None, 1), ("00:04", None, None, 0),
                    ("00:05", None, 40.0, 0), ("00:06", None, None, 1)]


def test_grid_from_sparse_minutes_equals_grid_from_dense(spark):
    p = points(spark, [("p", "hr", T + "00:03:00", 60.0), ("p", "hrv", T + "00:17:00", 40.0), ("p", "hrv", T + "01:04:00", 50.0), ("p", "steps", T + "00:21:00", 7.0), ("p", "steps", T + "00:22:00", 5.0), ("p", "hr", T + "01:30:00", 80.0),
                       ("q", "hr", T + "00:00:00", 1.0), ("r", "hrv", T + "00:05:00", 9.0)])
    iv = {"asleep": spans(spark, [("p", T + "00:10:00", T + "00:43:00"), ("p", T + "01:01:00", T + "02:00:00")])}
    args = (["pid"], "hrv", ["hr"], ["steps"], ["asleep"])
    a = timeline.multi_grid(timeline.sparse_minutes(p, iv, ["hr", "hrv", "steps"]), *args)
    dense = timeline.minute_table(p, iv, ["hr", "hrv", "steps"])
    b = timeline.multi_grid(dense, *args)
    a = sorted(map(tuple, a.collect()), key=str)
    assert a == sorted(map(tuple, b.collect()), key=str)
    assert {r[0] for r in a} == {"p", "r"}  # without the main signal there is no grid
    fr = {r[1]: r[-1] for r in a if r[0] == "p"}
    first = min(fr)
    assert fr[first] == 1.0 and fr[first + 3] == pytest.approx(0.4) and fr[first + 4] == 0.0
    assert fr[max(fr)] == pytest.approx(4 / 5)  # the last slot ends with the last main reading


def test_daily_rollup_rules(spark):
    start = (dt.datetime(2026, 1, 5) - dt.datetime(1970, 1, 1)).days * 144
    g = spark.createDataFrame([("p", start + i, float(i) if i < 3 else None, 200 if i == 0 else int(i < 3), None, 0.5) for i in range(144)] +
                              [("p", start + 144, None, 0, 1.0, 0.0)], "pid string, slot long, hrv double, hrv_n long, steps double, rest double")
    out = timeline.daily_rollup(g, ["pid"], 600, totals=["steps"], fractions=["rest"]).collect()
    assert len(out) == 1  # the day without a reading goes
    r = out[0]
    assert (r.hrv_median, r.hrv_n, r.steps_total, r.rest_hours) == (1.0, 202, 0.0, 12.0) and r.coverage_pct == 100.0


def test_export_tree_by_subject_folder_and_missing_signal(spark, tmp_path):
    for pid in ("p1", "p2"):
        d = tmp_path / pid / "hr"
        d.mkdir(parents=True)
        (d / f"{pid}_hr.csv").write_text("logDateTime,lastRate\n2026-01-05T00:00:59,60\n2026-01-05 00:01:59.000,bad\n2019-01-01 00:00:00,50\n")
    raw = R.read_export(spark, str(tmp_path), "hr", ["logDateTime", "lastRate"], pid_pattern=r"/([^/]+)/hr/")
    p = R.points(raw, R.PointMap("hr", "logDateTime", "lastRate"), earliest="2025-01-01 00:00:00")
    assert sorted((r.pid, str(r.ts), r.value) for r in p.collect()) == sorted(
        (q, t, v) for q in ("p1", "p2") for t, v in (("2026-01-05 00:00:59", 60.0), ("2026-01-05 00:01:59", None)))
    assert p.where("value is null").count() == 2 and p.count() == 4
    none = R.read_export(spark, str(tmp_path), "ecg", ["t", "v"], pid_pattern=r"/([^/]+)/ecg/")
    assert none.count() == 0 and none.columns == ["t", "v", "pid"]


def test_early_filter_reaches_the_scan(spark, sf):
    e = R.drop_before(spark.read.parquet(f"{sf}/events.parquet"), "ts", "2024-01-10 00:00:00").select("user_id")
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_short_text_is_rounded_on_the_exact_value(spark):
    df = spark.createDataFrame([(104.05,), (0.0001234,), (123456.0,), (1.0,), (None,)], "x double")
    assert [r.x for r in R.short_text(df).collect()] == ["104", "0.0001234", "1.235e+05", "1", None]


def test_stage_reads_the_session_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert stage.new_path(spark, "x").startswith(root.rstrip("/"))
    df = stage.materialise(spark.range(5).toDF("a"), "t")
    assert df.count() == 5 and "FileScan" in df._jdf.queryExecution().executedPlan().toString()


def test_last_run_wins_and_table_equality(spark):
    from pulsegrid.operators import joins

    led = spark.createDataFrame([("m", 1, 5.0), ("m", 2, 7.0), ("n", 1, 1.0)], "model string, finished int, mae double")
    assert {r.model: r.mae for r in R.last_run(led, ["model"]).collect()} == {"m": 7.0, "n": 1.0}
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0), (4, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.00005), (2, None), (3, None), (5, 1.0)], "k int, v double")
    r = joins.same_tables(a, b, ["k"], ["v"]).first()
    assert (r.matched, r.left_only, r.right_only, r.diff_v) == (3, 1, 1, 1)
