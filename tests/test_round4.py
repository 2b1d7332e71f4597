"""What no longer goes through the driver or one task whole (round 3's findings)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import core, daystore, metrics, picks, sampling, timeline
from pulsegrid.plans import features, grid, models, neighbours


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables that `sampling` writes."""
    plans, write = [], sampling.materialise
    monkeypatch.setattr(sampling, "materialise", lambda df, *a: (plans.append(plan(df)), write(df, *a))[1])
    return plans


@pytest.fixture
def labelled(spark, tmp_path):
    """A stored grid of 40 segments of 50 slots; every tenth slot is blank."""
    n = F.col("id")
    hole = n % 10 == 5
    df = spark.range(2000).select(
        F.format_string("s%02d", F.floor(n / 50)).alias("segment"), (n % 50).alias("slot"), F.lit(0).cast("long").alias("a"), F.lit(49).cast("long").alias("b"),
        F.when(~hole, n.cast("double")).alias("hrv"), F.when(hole, 1).otherwise(0).cast("long").alias("missing_run"))
    df.write.parquet(str(tmp_path / "labelled"))
    return spark.read.parquet(str(tmp_path / "labelled"))


def test_block_mask_broadcasts_no_table_of_readings(labelled, written):
    mask = sampling.block_mask(labelled, sampling.run_pool(labelled), 2)
    assert len(written) >= 3 and not [p for p in written if "Broadcast" in p]
    assert {r["n"] for r in mask.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()} == {9}  # 20 % of 45 readings, one at a time
    assert mask.distinct().count() == 40 * 9


def test_block_mask_counts_candidates_in_order(spark):
    """The last candidate may overshoot, the ones after it hide nothing."""
    seg = spark.createDataFrame([("s", 0, 30, 3, 40)], "segment string, _a long, _n long, _target long, _tries long")
    obs = spark.range(30).select(F.lit("s").alias("segment"), F.col("id").alias("slot"))
    got = {r["slot"] for r in sampling._first_runs(seg, obs, [(4, 1)], 5, "slot").collect()}
    import hashlib

    want = set()
    for i in range(1, 41):
        if len(want) >= 3:
            break
        start = int(hashlib.md5(f"5|s|{i}".encode()).hexdigest()[8:16], 16) % 26
        want |= set(range(start, start + 4))
    assert got == want


def test_masks_are_merged_with_their_readings(spark, labelled, tmp_path):
    labelled.where("slot % 7 = 0").select("segment", "slot").write.parquet(str(tmp_path / "mask"))
    mask = spark.read.parquet(str(tmp_path / "mask"))
    assert "Broadcast" not in plan(features.hidden(labelled, mask))
    assert "Broadcast" not in plan(picks.best_window(labelled, mask, 8, 4))


def test_day_windows_and_onsets_are_merged(spark, tmp_path):
    days = spark.range(300).select((F.col("id") % 10).alias("pid"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 10).cast("int")).alias("date"),
                                   (F.col("id") % 7 == 0).cast("int").alias("label"), F.col("id").cast("double").alias("v"))
    days.write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    assert "BroadcastHashJoin" not in plan(daystore.day_window(days, 3, ["v"]))
    assert "LeftOuter, BuildRight" not in plan(grid.onset_labels(days, 2))
    assert grid.onset_labels(days, 2).count() == days.where("label = 0 and date <= date'2024-01-28'").count()


def test_dense_table_shuffles_only_its_rows(spark):
    """Blank slots are made after the last shuffle; null keys and repeated slots are as in the join."""
    rows = spark.createDataFrame([("a", 3, 1.0), ("a", 9, 2.0), ("a", 9, 3.0), ("b", -5, 4.0), (None, 1, 5.0), (None, 2, 6.0), ("c", None, 7.0)], "k string, slot long, v double")
    also = spark.createDataFrame([("a", 1), ("b", 9000), ("d", 4)], "k string, slot long")
    out = timeline.dense(rows, ["k"], also=also)
    span = rows.select("k", "slot").unionByName(also)
    want = core.spine(span, ["k"], "slot").join(rows, ["k", "slot"], "left")
    assert out.columns == want.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert "Join" not in plan(out)


def test_a_days_minutes_are_built_from_its_cells(spark):
    cells = spark.createDataFrame([(1, "x", 0, 1.0), (1, "x", 3, 2.0), (1, "x", 4, None), (2, "x", 9, 5.0), (2, "y", 99, 5.0)], "pid int, date string, minute int, v double")
    view = daystore.array_view(cells, "pid", "v", 10)
    got = {(r["pid"], r["date"]): r["minutes"] for r in view.collect()}
    assert got == {(1, "x"): [1.0, None, None, 2.0, *[None] * 6], (2, "x"): [None] * 9 + [5.0], (2, "y"): [None] * 10}
    assert "sequence(0, 9" not in plan(view)


def test_a_values_range_is_found_by_halving(spark):
    points = [float(i) for i in range(1000)]
    df = spark.range(1).select(F.explode(F.array(*map(F.lit, (-1.0, 0.5, 511.5, 998.5, 5000.0)))).alias("x"), F.array(*map(F.lit, points)).alias("p"))
    out = df.select("x", core.bucket_by("x", F.col("p"), 30).alias("b"))
    assert {r.x: r.b for r in out.collect()} == {-1.0: 0, 0.5: 1, 511.5: 512, 998.5: 999, 5000.0: 1000}
    assert "filter(" not in plan(out)


def test_bootstrap_copies_no_row_for_a_replicate(spark, monkeypatch):
    """Weights are multiplied inside a block's task; null units, labels and scores count as in the joined form."""
    rows = [(p if p < 29 else None, [0, 1, None][(p * i) % 3], (i * 7 % 5) / 4 if i < 6 else None, f"{p}_{i % 2}") for p in range(30) for i in range(7)]
    d = spark.createDataFrame(rows, "pid long, label int, score double, event string")
    plans, write = {}, metrics.materialise
    monkeypatch.setattr(metrics, "materialise", lambda df, name: (plans.update({name: plan(df)}), write(df, name))[1])
    monkeypatch.setattr(metrics, "BLOCK", 8)
    got = {b.replicate: b for b in metrics.bootstrap(d, "s", 6).collect()}
    assert "FlatMapCoGroupsInPandas" in plans["resample-sums"]
    w = metrics.resample_weights(d, 6, "s")
    merged = d.groupBy("pid", "score").agg(F.sum("label").alias("_p"), F.count(F.lit(1)).alias("_c")).join(w, "pid")
    x = merged.groupBy("replicate", "score").agg(F.sum(F.col("_p") * F.col("w")).alias("p"), F.sum(F.col("_c") * F.col("w")).alias("c"))
    x = x.select("replicate", "score", F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("p").alias("wt")), F.struct(F.lit(0).alias("label"), (F.col("c") - F.col("p")).alias("wt")))).alias("z"))
    want = metrics.detection_scores(x.select("replicate", "score", "z.*").where("wt > 0"), ["replicate"], weight=F.col("wt")).collect()
    assert len(want) == 6
    for r in want:
        assert got[r.replicate].auroc == pytest.approx(r.auroc) and got[r.replicate].n_pos == r.n_pos
    ev = metrics.event_scores(d, ["pid"]).join(w, "pid").groupBy("replicate").agg((F.sum(F.col("events_caught") * F.col("w")) / F.sum(F.col("events") * F.col("w"))).alias("s"))
    assert {r.replicate: r.s for r in ev.collect()} == pytest.approx({k: b.event_sensitivity for k, b in got.items()})


def test_a_shuffles_draws_are_worded_once_per_row(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (None, None)], "pid long, date string")
    got = metrics._shuffles(rows, 3, 5, ["pid", "date"])
    want = rows.withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(3)))).select("permutation", core.draw_key(5, "permutation", "pid", "date").alias("_draw"))
    assert sorted(map(tuple, got.select("permutation", "_draw").collect())) == sorted(map(tuple, want.collect()))
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate") < text.index("cast(pid")


def test_screened_neighbours_are_those_of_the_differences():
    r = np.random.default_rng(1)
    q, t = np.round(r.normal(size=(300, 5)), 1), np.round(r.normal(size=(400, 5)), 1)
    t[200:] = t[:200]  # ties go by rid
    rid, limit = r.permutation(400), np.where(np.arange(300) % 7 == 0, 0.9, 99.0)
    row, other, d = neighbours.k_best(q, t, rid, limit, 4)
    for i in range(300):
        e = ((t - q[i]) ** 2).sum(1)
        near = np.flatnonzero(np.sqrt(e) <= limit[i])
        o = near[np.lexsort((rid[near], e[near]))[:4]]
        assert other[row == i].tolist() == o.tolist() and d[row == i].tolist() == e[o].tolist()
    t[0] = np.nan
    assert 0 not in neighbours.k_best(q, t, rid, limit, 400)[1]


def test_families_share_their_features(spark, monkeypatch):
    n = F.col("id")
    rows = spark.range(400).select((n % 4).alias("pid"), F.format_string("s%d", n % 4).alias("segment"), F.floor(n / 4).alias("slot"), (50 + n % 16).cast("double").alias("hrv"), (n % 7 == 3).alias("scored"))
    rows = models.materialise(rows.withColumn("visible", F.when(~F.col("scored"), F.col("hrv"))), "rows")
    built, build = [], models.PF.fill_features
    monkeypatch.setattr(models.PF, "fill_features", lambda *a, **kw: (built.append(1), build(*a, **kw))[1])
    got = {r.dropped: r.mae for r in models.drop_one_family(rows, 1, 4, {"time of day": ["sin", "cos"]}, maxIter=2).collect()}
    assert len(built) == 1
    alone = models.fill_error(models.predict_fill(models.fit_filler(rows, 1, 4, drop=["sin", "cos"], maxIter=2))).first().mae
    assert got["time of day"] == pytest.approx(alone)
