"""The grid that trains: labels by hand, a signal it must find, one row per cell, and a second call that fits nothing."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import grid, models

START = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def days(spark):
    """60 subjects of 20 days, some missing; `warmth` is high on event days and the two days before."""
    rng, rows = np.random.default_rng(3), []
    for p in range(60):
        event = {int(x) for x in rng.choice(20, 2, replace=False)}
        for i in range(20):
            if rng.random() < 0.1:
                continue
            near = any(i <= e <= i + 2 for e in event)
            rows.append((p, START + dt.timedelta(i), int(i in event), float(near) + rng.normal() * 0.05, None if rng.random() < 0.2 else float(rng.normal())))
    return spark.createDataFrame(rows, "pid long, date date, label int, warmth double, noise double")


def test_onset_labels_by_hand(days):
    rows = [tuple(r) for r in days.select("pid", "date", "label").collect()]
    event = {(p, d) for p, d, y in rows if y}
    last = {}
    for p, d, _ in rows:
        last[p] = max(last.get(p, d), d)
    want = {(p, d, int(any((p, d + dt.timedelta(i)) in event for i in range(1, 4)))) for p, d, y in rows if not y and d + dt.timedelta(3) <= last[p]}
    assert {tuple(r) for r in grid.onset_labels(days, 3).collect()} == want


def test_window_features_by_hand(days, spark):
    static = spark.createDataFrame([(0, 7.0), (1, None)], "pid long, age double")
    out, names = grid.window_features(days, 3, ["warmth", "noise"], static)
    rows = {(r.pid, r.date): r for r in days.collect()}
    got = out.collect()
    assert len(got) == len(rows) and names[-1] == "age" and {r.age for r in got if r.pid == 0} == {7.0} and {r.age for r in got if r.pid == 5} == {None}
    for r in got[:200]:
        mine = [rows[r.pid, r.date - dt.timedelta(i)] for i in range(3) if (r.pid, r.date - dt.timedelta(i)) in rows]
        assert r.days_there == len(mine) and r.warmth_mean == pytest.approx(np.mean([m.warmth for m in mine])) and r.noise_last == rows[r.pid, r.date].noise
        assert r.noise_max == max((m.noise for m in mine if m.noise is not None), default=None)


def test_grid_learns_and_is_repeated_for_nothing(spark, days, tmp_path, monkeypatch):
    units = days.groupBy("pid").agg((F.col("pid") % 2).alias("grp"))
    among = [models.contender(n, models.light()) for n in ("constant", "logit, squared penalty")]
    ask = lambda seeds: grid.trained_grid(days, units, ["grp"], ["warmth", "noise"], among, str(tmp_path / "runs"), shares=[0.3], seeds=seeds, windows=[1, 3], horizons=[2])
    first = ask([0]).collect()
    assert len(first) == 8 and len({(r.task, r.window, r.horizon, r.model) for r in first}) == 8
    for r in first:
        assert 0 < r.n_pos < r.n and (r.auroc == 0.5 if r.model == "constant" else r.auroc > 0.9)
    monkeypatch.setattr(grid, "fit_contender", lambda *a: pytest.fail("fitted again"))
    assert sorted(map(str, ask([0]).collect())) == sorted(map(str, first))
