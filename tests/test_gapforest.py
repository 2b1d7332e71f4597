"""The merge forest against a scan of every candidate, across pieces of every level."""

import random

import pytest

from pulsegrid.operators import gapforest, segments


def brute(slots, x, least):
    parts, slots = [], sorted(slots)
    for s in slots:
        if parts and s - parts[-1][-1] - 1 <= x:
            parts[-1].append(s)
        else:
            parts.append([s])
    kept = [p for p in parts if p[-1] - p[0] + 1 >= least]
    return sum(p[-1] - p[0] + 1 for p in kept), sum(map(len, kept))


def series(seed):
    rng = random.Random(seed)
    out = {}
    for key in range(40):
        at, slots = rng.randrange(-60, 60), []
        for _ in range(rng.choice([1, 2, 5, 60, 300])):
            slots.append(at)
            at += 1 + rng.choice([0, 0, 0, 1, 1, 2, 3, rng.randrange(12), rng.randrange(90)])
        out[key] = slots
    out[None] = list(range(500))
    out[100] = list(range(-300, 300, 2))
    out[101] = [k * k for k in range(60)]
    out[102] = [-k * k for k in range(60)]
    return out


@pytest.mark.parametrize("levels", [(4, 16, 64), (8,), (1, 2), gapforest.LEVELS])
@pytest.mark.parametrize("least", [1, 2, 7])
def test_all_candidates_at_once(spark, monkeypatch, levels, least):
    monkeypatch.setattr(gapforest, "LEVELS", levels)
    got, xs = series(len(levels) + least), [0, 1, 2, 3, 5, 8, 40, 1000]
    df = spark.createDataFrame([(k, s) for k, v in got.items() for s in v], "pid long, slot long").repartition(5)
    rows = {(r.pid, r.x): (r.slots, r.kept) for r in gapforest.kept_by_gap(df, ["pid"], xs, least).collect()}
    assert rows == {(k, x): brute(v, x, least) for k, v in got.items() for x in xs}


def test_what_a_piece_hands_on_is_short():
    rng = random.Random(5)
    slots, at = [], 0
    while at < 4096:
        slots.append(at)
        at += 1 + rng.choice([0, 0, 1, 2, 3, 7, 20])
    import numpy as np

    steps = gapforest.Steps(np.array([0, 1, 5]), 1)
    left = gapforest.merge([(s, s, 1, 0) for s in slots], steps, False)
    assert len(left) <= 2 * 2 * 4096 ** 0.5 and sum(a[2] for a in left) == len(slots)


def test_threshold_scan_has_keys_and_all(spark):
    df = spark.createDataFrame([("a", s, 1.0) for s in (0, 1, 2, 6, 7)] + [("a", 4, None), ("b", 3, 2.0)], "pid string, slot long, hrv double")
    rows = {(r.x, r.pid): (r.kept_pct, r.missing_inside_pct) for r in segments.threshold_scan(df, ["pid"], [0, 3], 3).collect()}
    assert rows[(0, "a")] == pytest.approx((60.0, 0.0)) and rows[(3, "a")] == pytest.approx((100.0, 100 * 3 / 8))
    assert rows[(0, "b")] == (0.0, None) and rows[(3, None)] == pytest.approx((100 * 5 / 6, 100 * 3 / 8))
    with pytest.raises(ValueError):
        segments.threshold_scan(df, ["pid"], [-1], 3)
    assert gapforest.kept_by_gap(df.where("pid = 'none'"), ["pid"], [1], 2).count() == 0
