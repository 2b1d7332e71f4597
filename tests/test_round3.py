"""Decays as composed prefixes, truncated densities, pair statistics without pairs of rows, committed runs, pruned reads."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import cohort, fills, joins
from pulsegrid.sources import readings as R


@pytest.mark.parametrize("rate, span", [(1e-6, 60_000_000), (1e-3, 200_000), (0.004, 60_000), (0.3, 2_000)])
def test_decay_over_pieces_of_pieces(spark, rate, span):
    rng = np.random.default_rng(4)
    rows = [(k, int(p), None if rng.random() < 0.3 else float(rng.normal())) for k in ("a", None) for p in np.unique(rng.integers(-span // 2, span // 2, 250))]
    df = spark.createDataFrame(rows, "k string, slot long, v double")
    got = {(r.k, r.slot): (r.decayed_mean, r.decayed_count) for r in fills.decayed_average(df, ["k"], rate, "v").collect()}
    assert len(got) == len(rows)
    for key in ("a", None):
        mine = [(p, v) for k, p, v in rows if k == key]
        at, value = np.array([p for p, v in mine if v is not None]), np.array([v for _, v in mine if v is not None])
        for p, _ in mine:
            w = np.exp(-rate * (p - at[at <= p]))
            mean, count = (w * value[at <= p]).sum() / (w.sum() + 1e-6), math.log1p(w.sum())
            assert got[key, p][0] == pytest.approx(mean, rel=1e-8, abs=1e-10) and got[key, p][1] == pytest.approx(count, rel=1e-9, abs=1e-12)


def test_decay_collects_no_history(spark):
    df = spark.range(10).select(F.lit("a").alias("k"), (F.col("id") * 5000).alias("slot"), F.lit(1.0).alias("v"))
    plan = fills.decayed_average(df, ["k"], 1e-6, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part_up" in line for line in plan.splitlines() if "Window" in line and "collect_list" in line)


@pytest.mark.parametrize("rate", [0.01, 0.9, 50.0])
def test_hourly_state_of_any_rate(spark, rate):
    rows = [("d", 5, 3.0), ("d", 64, 2.0), ("d", 600, -1.0), ("d", 1439, 7.0), (None, 100, None), ("e", 0, 1.0)]
    got = {(r.day, r.hour): r.state for r in fills.hourly_state(spark.createDataFrame(rows, "day string, minute long, v double"), ["day"], "minute", "v", rate).collect()}
    assert len(got) == 72
    for (day, hour), state in got.items():
        seen = [v * math.exp(-rate * (60 * hour + 59 - m)) for d, m, v in rows if d == day and v is not None and m < 60 * (hour + 1)]
        assert state is None if not seen else state == pytest.approx(sum(seen), rel=1e-9, abs=1e-300)


def test_density_reaches_only_near_points(spark):
    rng = np.random.default_rng(6)
    values = {"a": [*rng.normal(50, 4, 400), 5000.0, -900.0], "b": list(np.repeat([1.0, 2.0, 3.5], 90)), "c": [1.0] * 300, "d": [1.0, 2.0], "e": list(rng.normal(0, 1e-3, 250))}
    points = [-900.0, -0.002, 0.0, 0.0005, 1.0, 1.5, 2.0, 3.0, 40.0, 48.7, 50.0, 70.0, 1234.5, 5000.0]
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("b", None)], "k string, v double")
    got = {(r.k, r.x): r.density for r in joins.kernel_density(df, "k", "v", points).collect()}
    assert set(got) == {(k, x) for k in "abe" for x in points}  # constant and short keys have none
    for (k, x), d in got.items():
        v = np.array(values[k])
        h = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
        assert d == pytest.approx(want, abs=1e-11 / h)


def test_correlations_of_many_columns_with_their_own_blanks(spark):
    rng = np.random.default_rng(7)
    n, names = 300, ["x", "n", "p0", "c0", "flat"]
    data = {c: [None if rng.random() < 0.25 else float(rng.integers(0, 9)) for _ in range(n)] for c in names[:-1]} | {"flat": [2.0] * n}
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in names))
    got = {(r.a, r.b): r for r in cohort.correlations(df, names).collect()}
    assert len(got) == 10

    def ranks(v):
        return np.array([(np.sum(v < a) + np.sum(v <= a) + 1) / 2 for a in v])

    for (a, b), r in got.items():
        x, y = (np.array(z) for z in zip(*[(p, q) for p, q in zip(data[a], data[b]) if p is not None and q is not None]))
        assert r.n == len(x)
        if "flat" in (a, b):
            assert r.pearson is None and r.spearman is None
        else:
            assert r.pearson == pytest.approx(np.corrcoef(x, y)[0, 1]) and r.spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert cohort.correlations(df.limit(0), names).count() == 0


def test_a_killed_run_is_written_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    preds = spark.createDataFrame([(1, 50.0, 48.0), (2, 50.0, 53.0)], "id long, truth double, pred double")
    score = lambda p: p.agg(F.avg(F.abs(F.col("pred") - F.col("truth"))).alias("mae"))

    def killed(p):
        raise RuntimeError("lost after the predictions were written")

    with pytest.raises(RuntimeError):
        R.write_run(preds, killed, path, {"model": "m"})
    assert R.committed(spark, path).count() == 0
    assert R.write_run(preds, score, path, {"model": "m"}) and not R.write_run(preds, score, path, {"model": "m"})
    assert R.write_run(preds.limit(1), score, path, {"model": "other"}) and R.write_run(preds, score, path, {"model": "m"}, run="2")
    assert sorted(r.model for r in R.read_run(spark, path).collect()) == ["m", "m", "m", "m", "other"]
    assert sorted((r.model, r.mae) for r in R.read_run(spark, path, "ledger").collect()) == [("m", 2.5), ("m", 2.5), ("other", 2.0)]
    assert len(list((tmp_path / "runs" / "predictions").glob("run=*/attempt=*"))) == 4


def test_asked_subjects_prune_the_folders(spark, tmp_path):
    path = str(tmp_path / "minutes")
    rows = spark.range(4000).select((F.col("id") % 50).alias("pid"), F.col("id").alias("minute"), F.lit(1.5).alias("value"))
    R.write_minutes(rows, path, buckets=16)
    files = list((tmp_path / "minutes").glob("buckets=16/bucket=*/*.parquet"))
    assert len(files) == len({f.parent for f in files}) <= 16
    roster = spark.createDataFrame([(3, "x"), (7, "x"), (8, "y"), (None, "x")], "pid long, ward string").where("ward = 'x'")
    got = R.read_minutes(spark, path, ["pid", "value"], roster)
    assert sorted({r.pid for r in got.collect()}) == [3, 7] and got.count() == 160 and got.columns == ["pid", "value"]
    assert [r.pid for r in R.patients(spark, path).collect()] == list(range(50))
    stored = str(tmp_path / "roster")
    spark.range(50).select(F.col("id").alias("pid"), F.when(F.col("id") < 2, "x").otherwise("y").alias("ward")).write.parquet(stored)
    pruned = R.read_minutes(spark, path, ["pid", "value"], spark.read.parquet(stored).where("ward = 'x'"))
    assert "dynamicpruning" in pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == 160


def test_short_numbers_of_a_batch(spark):
    values = [1234.5, 0.00012345, None, -2.5, 1e20, 0.0, float("inf"), 12345678.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    want = sorted([None if v is None else "%.4g" % v for v in values] + [None], key=str)
    assert sorted([r.v for r in R.short_text(df).collect()], key=str) == want
    assert R.short_text(df.where("v is null")).collect() == [(None,)] * 2 and R.short_text(df.limit(0)).count() == 0
