"""Batched logistic fits against one-by-one Newton steps in numpy; the permutation test as a whole."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import metrics
from pulsegrid.plans import refit


def table(n=90, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * r.normal(size=n) > 0.2).astype(int)
    x[r.random((n, 3)) < 0.1] = np.nan
    return x, y, np.arange(n) % 3


@pytest.fixture(scope="module")
def rows(spark):
    x, y, fold = table()
    cells = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], int(y[i]), int(fold[i])) for i in range(len(y))]
    return spark.createDataFrame(cells, "pid long, a double, b double, c double, label int, fold int").repartition(4)


def shuffled(y, p, seed=5):
    order = sorted(range(len(y)), key=lambda i: hashlib.md5(f"{seed}|{p}|{i}".encode()).hexdigest())
    out = np.zeros(len(y))
    out[order[:int(y.sum())]] = 1
    return out


def prepared(x, fold, k):
    t = x[fold != k]
    med = np.nanmedian(t, axis=0)
    full = np.where(np.isnan(t), med, t)
    z = (np.where(np.isnan(x), med, x) - full.mean(0)) / full.std(0)
    return np.column_stack([np.ones(len(x)), z])


def newton(z, y, ridge):
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    pen, b = ridge * np.diag([0.0] + [1.0] * (z.shape[1] - 1)), np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + pen, z.T @ (w * (y - p)) - pen @ b)
    return b


def auroc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_all_models_equal_single_fits(spark, rows):
    x, y, fold = table()
    labels = [y, *[shuffled(y, p) for p in (1, 2, 3)]]
    t = refit.labelled(rows, ["a", "b", "c"], ["pid"], 3, 5)
    assert {r.pid: r.y for r in t.collect()} == {i: [bool(v[i]) for v in labels] for i in range(len(y))}
    scaling = refit.fold_scaling(rows, ["a", "b", "c"], 3)
    fits = refit.fit_all(t, scaling, 3, 4, 3)
    assert fits.steps < 25
    for k in range(3):
        z = prepared(x, fold, k)
        for p, v in enumerate(labels):
            assert fits.weights[k, p] == pytest.approx(newton(z[fold != k], v[fold != k], 1.0), abs=1e-6)
    got = {r.labelling: r.auroc for r in refit.permutation_scores(rows, ["a", "b", "c"], ["pid"], 3, 5, 3).collect()}
    for p, v in enumerate(labels):
        want = [auroc(prepared(x, fold, k)[fold == k] @ newton(prepared(x, fold, k)[fold != k], v[fold != k], 1.0), v[fold == k]) for k in range(3)]
        assert got[p] == pytest.approx(np.mean(want))


def test_held_out_rows_change_no_fitted_value(spark, rows):
    a = refit.fold_scaling(rows, ["a", "b", "c"], 3)
    changed = rows.withColumn("a", F.when(F.col("fold") == 1, 1e6).otherwise(F.col("a")))
    b = refit.fold_scaling(changed, ["a", "b", "c"], 3)
    assert (a.median[1] == b.median[1]).all() and np.allclose(a.mean[1], b.mean[1]) and not np.allclose(a.mean[0], b.mean[0])
    fit = lambda r, s: refit.fit_all(refit.labelled(r, ["a", "b", "c"], ["pid"], 2, 5), s, 3, 3, 3).weights
    assert np.allclose(fit(rows, a)[1], fit(changed, b)[1])


def test_signal_stands_out_and_noise_does_not(spark, rows):
    real = refit.refit_test(rows, ["a", "b"], ["pid"], 40, 5, 3).first()
    assert real.observed > 0.85 and real.p_value == 0 and abs(real.null_mean - 0.5) < 0.1 and real.permutations == 40
    noise = refit.refit_test(rows.withColumn("label", (F.hash("pid") % 2 == 0).cast("int")), ["a", "b"], ["pid"], 40, 5, 3).first()
    assert noise.p_value > 0.02


def test_one_class_and_constant_feature(spark):
    df = spark.createDataFrame([(i, 1.0, 1 if i % 2 else 0, i % 3) for i in range(30)], "pid long, a double, label int, fold int")
    flat = {r.labelling: r.auroc for r in refit.permutation_scores(df, ["a"], ["pid"], 3, 5, 3).collect()}
    assert all(v == 0.5 for v in flat.values())
    ones = refit.permutation_scores(df.withColumn("label", F.lit(1)), ["a"], ["pid"], 2, 5, 3).collect()
    assert all(r.auroc is None for r in ones)


def test_cuts_give_the_old_number_of_positives(spark):
    df = spark.range(3000).select(F.col("id").alias("pid"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    for digits in (1, 3):
        cuts = {r.permutation: r.cut for r in metrics.permutation_cuts(df, 4, 9, ["pid"], digits).collect()}
        for p, cut in cuts.items():
            draws = sorted(hashlib.md5(f"9|{p}|{i}".encode()).hexdigest() for i in range(3000))
            assert cut == draws[428]
    assert metrics.permutation_cuts(df.withColumn("label", F.lit(0)), 4, 9, ["pid"]).count() == 0


def test_permuted_auroc_by_ranks(spark):
    r = np.random.default_rng(2)
    s = r.integers(0, 6, 200) / 10
    y = (r.random(200) < 0.3).astype(int)
    df = spark.createDataFrame([(i, float(s[i]), int(y[i])) for i in range(200)], "pid long, score double, label int")
    got = {r.permutation: r.auroc for r in metrics.permuted_auroc(df, 5, 5, ["pid"]).collect()}
    assert got == {p: pytest.approx(auroc(s, shuffled(y, p))) for p in range(1, 6)}
