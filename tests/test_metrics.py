import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import cohort, core, ledger, metrics


def frame(spark, y, s, **more):
    cols = list(more)
    rows = [(int(a), float(b), *[more[c][i] for c in cols]) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, ["label", "score", *cols])


def auroc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def auprc(y, s):
    out, last = 0.0, 0
    for c in sorted(set(s), reverse=True):
        tp, n = sum(a for a, b in zip(y, s) if b >= c), sum(b >= c for b in s)
        out += (tp - last) / sum(y) * tp / n
        last = tp
    return out


def test_scores_equal_plain_definitions_with_ties(spark):
    r = random.Random(3)
    rows, want = [], {}
    for case in range(40):
        n = r.randint(4, 30)
        y = [1, 0] + [r.randint(0, 1) for _ in range(n)]
        s = [r.randint(0, 6) / 6 for _ in y]
        rows += [(case, a, b) for a, b in zip(y, s)]
        want[case] = (auroc(y, s), auprc(y, s), np.mean([(b - a) ** 2 for a, b in zip(y, s)]))
    df = spark.createDataFrame(rows, "case long, label int, score double")
    got = {g["case"]: (g.auroc, g.auprc, g.brier) for g in metrics.detection_scores(df, ["case"]).collect()}
    for c, w in want.items():
        assert got[c] == pytest.approx(w)


def test_constant_score_and_single_class(spark):
    r = metrics.detection_scores(frame(spark, [1, 0, 0, 1], [0.2] * 4), []).first()
    assert r.auroc == 0.5 and r.auprc == 0.5 and r.sensitivity == 0.0 and r.ppv is None and r.f1 == 0.0
    r = metrics.detection_scores(frame(spark, [0, 0, 0], [0.1, 0.2, 0.9]), []).first()
    assert r.auroc is None and r.sensitivity is None and r.specificity == pytest.approx(2 / 3) and r.false_alarms_per_30 == pytest.approx(10)


def test_calibration_keeps_empty_bands(spark):
    out = {r.band: (r.n, r.predicted, r.observed) for r in metrics.calibration(frame(spark, [1, 0, 1], [1.0, 0.95, 0.3]), []).collect()}
    assert len(out) == 10 and out[9] == (2, pytest.approx(0.975), 0.5) and out[3] == (1, 0.3, 1.0) and out[0] == (0, None, None)


def test_events_and_lead_time(spark):
    d = spark.createDataFrame([(1, 0.9, "p_20260110", "2026-01-07"), (1, 0.9, "p_20260110", "2026-01-08"), (1, 0.1, "p_20260110", "2026-01-06"),
                               (1, 0.2, "q_20260120", "2026-01-19"), (0, 0.9, None, "2026-01-01")], "label int, score double, event string, d string").withColumn("date", F.to_date("d"))
    e = metrics.event_scores(d, []).first()
    assert (e.events, e.events_caught, e.event_sensitivity) == (2, 1, 0.5)
    assert metrics.lead_times(d, []).first().lead_days_median == 3.0


def test_resampling_draws_as_many_units_as_there_are(spark):
    u = spark.range(17).select(F.col("id").alias("pid"))
    w = metrics.resample_weights(u, 6, "s")
    assert {r.n for r in w.groupBy("replicate").agg(F.sum("w").alias("n")).collect()} == {17}
    assert w.exceptAll(metrics.resample_weights(u.repartition(5), 6, "s")).count() == 0


def test_bootstrap_equals_scoring_the_repeated_rows(spark):
    r = random.Random(5)
    rows = [(p, r.randint(0, 1), r.randint(0, 4) / 4, f"{p}_{i % 2}") for p in range(9) for i in range(6)]
    d = spark.createDataFrame(rows, "pid long, label int, score double, event string")
    got = {b.replicate: b for b in metrics.bootstrap(d, "s", 4).collect()}
    w = metrics.resample_weights(d, 4, "s").collect()
    for rep, b in got.items():
        mult = {x.pid: x.w for x in w if x.replicate == rep}
        big = [(y, s) for p, y, s, _ in rows for _ in range(mult.get(p, 0))]
        assert b.auroc == pytest.approx(auroc(*zip(*big))) and b.n == len(big)
        ev = {}
        for p, y, s, e in rows:
            if y:
                ev[p, e] = max(ev.get((p, e), 0), s >= 0.5)
        tot = sum(mult.get(p, 0) for p, _ in ev)
        assert b.event_sensitivity == pytest.approx(sum(mult.get(p, 0) * h for (p, _), h in ev.items()) / tot)


def test_permuting_a_constant_score_gives_one_half(spark):
    d = frame(spark, [1, 0, 0, 1, 0], [0.4] * 5, pid=[1, 2, 3, 4, 5])
    r = metrics.permutation_test(d, "s", ["pid"], 5).first()
    assert (r.observed, r.null_mean, r.p_value, r.permutations) == (0.5, 0.5, 1.0, 5)


def test_thirds_merge_equal_cuts(spark):
    d = frame(spark, [0, 1, 0, 1], [0.1, 0.2, 0.3, 0.4], cov=[5.0, 5.0, 5.0, 9.0])
    assert sorted(r.part for r in metrics.thirds(d, ["cov"]).collect()) == [1, 1, 1, 1]
    d = frame(spark, [0, 1, 0, 1], [0.1, 0.2, 0.3, 0.4], cov=[1.0, 2.0, 3.0, 4.0])
    assert [r.part for r in metrics.thirds(d, ["cov"]).orderBy("info").collect()] == [0, 1, 2, 2]


def test_error_scores(spark):
    p = spark.createDataFrame([("a", 10.0, 12.0), ("a", 130.0, None), ("a", 130.0, 100.0), ("b", 20.0, -1.0), ("b", 20.0, float("inf")), ("b", 50.0, 140.0)], "pid string, truth double, pred double")
    r = metrics.error_scores(p, [], 120, 129).first()
    assert (r.n, r.n_missing, r.n_nonfinite, r.n_nonpositive) == (6, 1, 1, 1) and r.pct_above_max == pytest.approx(100 * 2 / 6) and r.mae_above == 30.0


def test_usability_notes(spark):
    spine = spark.createDataFrame([(m, "t") for m in "abcde"], "model string, test string")
    last = spark.createDataFrame([("a", "t", 10.0, 0, 0, 1.0), ("b", "t", 5000.0, 0, 0, 0.0), ("c", "t", 9.0, 0, 2, 0.0), ("d", "t", 8.0, 0, 0, 6.0)],
                                 "model string, test string, mae double, n_nonfinite int, n_nonpositive int, pct_above double")
    out = {r.model: (r.usable, r.note, r.mae) for r in ledger.usability(spine, last, ["model", "test"]).collect()}
    assert out == {"a": (True, "", 10.0), "b": (False, "not_finite_or_huge", None), "c": (False, "zero_or_less", None),
                   "d": (False, "too_high", None), "e": (False, "absent", None)}


def test_correlations_on_complete_pairs(spark):
    r = np.random.default_rng(2)
    x, y, z = r.integers(0, 5, 80).astype(float), r.normal(size=80), r.normal(size=80)
    df = spark.createDataFrame([(float(a), None if i % 4 == 0 else float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z))], "x double, y double, z double")
    out = {(o.a, o.b): o for o in cohort.correlations(df, ["x", "y", "z"]).collect()}

    def ranks(v):
        return np.array([(np.sum(v < a) + np.sum(v <= a) + 1) / 2 for a in v])

    keep = np.arange(80) % 4 != 0
    o = out["x", "y"]
    assert o.n == 60 and o.pearson == pytest.approx(np.corrcoef(x[keep], y[keep])[0, 1])
    assert o.spearman == pytest.approx(np.corrcoef(ranks(x[keep]), ranks(y[keep]))[0, 1])
    assert cohort.correlations(df, ["x", "y"], min_n=100).first().spearman is None


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.9, 2.0, 4.0, 4.1, -0.1)], "v double")
    assert {r.bin: r.n for r in cohort.histogram(df, [], "v", 0, 2, 2).collect()} == {0: 2, 1: 2}


def test_rhythm_fit_equals_least_squares(spark):
    r = np.random.default_rng(4)
    t = np.array([i for i in range(50) if i % 3])
    y = 1 + 0.5 * np.cos(2 * np.pi * t / 8) - 0.2 * np.sin(2 * np.pi * t / 8) + r.normal(size=len(t)) / 10
    f = cohort.rhythm_fit(spark.createDataFrame([("p", float(a), int(b)) for a, b in zip(y, t)], "pid string, y double, t long"), ["pid"], "y", "t", 8).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(len(t)), np.cos(2 * np.pi * t / 8), np.sin(2 * np.pi * t / 8)]), y, rcond=None)[0]
    assert [f.b0, f.b_cos, f.b_sin] == pytest.approx(list(want))




def test_model_tag_parts(spark):
    df = spark.createDataFrame([("lstm_d7_h1",), ("tree",), ("tree_d3",)], "tag string")
    base, days, horizon = ledger.parse_tag(F.col("tag"))
    assert [tuple(r) for r in df.select(base.alias("b"), days.alias("d"), horizon.alias("h")).collect()] == [("lstm", 7, 1), ("tree", None, None), ("tree", 3, None)]
