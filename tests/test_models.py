import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pulsegrid.plans import models, registry


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(v) for v in r.normal(size=4) + (i % 2)], i % 2) for i in range(160)]
    df = spark.createDataFrame(rows, "pid long, x array<double>, label int").withColumn("features", array_to_vector("x"))
    out = models.class_weights(df, "label", "balanced").cache()
    out.count()
    return rows, out


@pytest.mark.parametrize("block", [16, 4096])
@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_nearest_vote_equals_brute_force(spark, blobs, block, weights):
    rows, df = blobs
    test, train = [r for r in rows if r[0] % 4 == 0], [r for r in rows if r[0] % 4]
    got = {r.id: r.score for r in models.nearest_vote(df.where("pid % 4 = 0"), df.where("pid % 4 <> 0"), "pid", "x", "label", 5, weights, block).collect()}
    for i, x, _ in test:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, q)), j, y) for j, q, y in train)[:5]
        w = [1.0 if weights == "uniform" else 1 / d ** 0.5 for d, _, _ in near]
        assert got[i] == pytest.approx(sum(a * y for a, (_, _, y) in zip(w, near)) / sum(w))


def test_discriminant_equals_numpy(spark, blobs):
    rows, df = blobs
    w, b = models.fit_discriminant(df.repartition(5), "x", "label", shrinkage=0.2)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    mu = {c: x[y == c].mean(0) for c in (0, 1)}
    s = sum((x[y == c] - mu[c]).T @ (x[y == c] - mu[c]) for c in (0, 1)) / len(x)
    s = 0.8 * s + 0.2 * np.trace(s) / 4 * np.eye(4)
    assert w == pytest.approx(np.linalg.solve(s, mu[1] - mu[0]))


def test_scaling_uses_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, 2.0), (None, 4.0), (5.0, 9.0)], "a double, b double")
    out = models.apply_scaling(spark.createDataFrame([(None, 4.0), (100.0, None)], "a double, b double"), models.fit_scaling(train, ["a", "b"]), ["a", "b"]).collect()
    a, b = np.array([1, 3, 3, 5.0]), np.array([4, 2, 4, 9.0])
    assert out[0].a == pytest.approx((3 - a.mean()) / a.std()) and out[1].a == pytest.approx((100 - a.mean()) / a.std()) and out[1].b == pytest.approx((4 - b.mean()) / b.std())


def test_class_weights(spark, blobs):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    assert {r.label: r.weight for r in models.class_weights(df, "label").collect()} == {1: 3.0, 0: 1.0}
    assert {r.label: round(r.weight, 6) for r in models.class_weights(df, "label", "balanced").collect()} == {1: 2.0, 0: 0.666667}


def test_registry_contracts(spark):
    assert registry.names(registry.FILLERS, "fill") == ["straight_line", "rhythm", "tree"]
    with pytest.raises(ValueError):
        registry.get(registry.FILLERS, "tree", "forecast")
    with pytest.raises(ValueError):
        registry.register(registry.FILLERS, "tree", "x", ("fill",), None)


def test_tree_filler_learns_a_rhythm(spark):
    rows = [("s1", "p", i, float(60 + 20 * np.sin(2 * np.pi * i / 8) + (i % 3)), i % 7 == 3) for i in range(240)]
    df = spark.createDataFrame(rows, "segment string, pid string, slot long, hrv double, scored boolean").withColumn("visible", F.when(~F.col("scored"), F.col("hrv")))
    e = models.fill_error(models.predict_fill(models.fit_filler(df, 2, 8))).first()
    const = np.mean([abs(r[3] - np.mean([q[3] for q in rows])) for r in rows if r[4]])
    assert e.n_missing == 0 and e.n_nonpositive == 0 and e.mae < const / 2


def test_rhythm_filler_keeps_readings_and_fills_blanks(spark):
    rows = [("s1", i, None if i % 5 == 2 else float(50 + 10 * np.cos(2 * np.pi * i / 8))) for i in range(80)]
    df = spark.createDataFrame(rows, "segment string, slot long, visible double")
    out = registry.get(registry.FILLERS, "rhythm", "fill")(df, 8).collect()
    assert len(out) == 80
    for r in out:
        assert r.filled == pytest.approx(r.visible) if r.visible is not None else abs(r.filled - (50 + 10 * np.cos(2 * np.pi * r.slot / 8))) < 2


def test_per_series_refuses_a_series_that_is_too_long(spark):
    df = spark.range(20).select((F.col("id") * 0).alias("k"), "id")
    with pytest.raises(ValueError):
        models.per_series(df, ["k"], lambda p: p, "k long, id long", longest=10)


@pytest.mark.parametrize("block", [1, 720])
def test_day_window_vector(spark, block):
    from pulsegrid.plans.features import BLANK, day_window_vector

    m = spark.createDataFrame([("p", "2026-01-01", 3, 5.0, None), ("p", "2026-01-01", 730, 7.0, 1.0), ("p", "2026-01-03", 1439, 9.0, None)],
                              "pid string, d string, minute int, hr double, hrv double").withColumn("date", F.to_date("d"))
    days = spark.createDataFrame([("p", "2026-01-03")], "pid string, d string").select("pid", F.to_date("d").alias("date"))
    x = day_window_vector(m, days, 3, block, ["hr", "hrv"]).first().x
    b = 1440 // block
    want = [BLANK] * (3 * 2 * b)
    want[3 // block], want[730 // block], want[b + 730 // block], want[2 * 2 * b + 1439 // block] = 5.0, 7.0, 1.0, 9.0
    assert x[: len(want)] == want and x[len(want):] == [float(v != BLANK) for v in want]


def test_tree_forecaster_follows_the_rhythm(spark):
    wave = lambda i: float(60 + 20 * np.sin(2 * np.pi * i / 8))
    rows = [("s1", "p", i, None if i % 9 == 4 else wave(i)) for i in range(240)]
    train = spark.createDataFrame(rows, "segment string, pid string, slot long, hrv double")
    model, feats, names = models.fit_forecaster(train, 3, 8, 4, 200, 1)
    out = {r.h: r.pred for r in models.predict_forecast(model, feats, names, 8, 4).collect()}
    assert sorted(out) == [1, 2, 3, 4] and all(abs(out[h] - wave(239 + h)) < 8 for h in out)
