"""Stages fitted per fold: values, leakage, saving, and the nested cross-validation that uses them."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pulsegrid.operators import sampling
from pulsegrid.plans import models, registry
from pulsegrid.plans.preparation import ClassWeights, MedianScaler, MedianScalerModel, Prior


def table(n=120, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 5, -3]
    y = (x[:, 0] + 0.4 * r.normal(size=n) > 0.5).astype(int)
    x[r.random((n, 3)) < 0.15] = np.nan
    return x, y


@pytest.fixture(scope="module")
def rows(spark):
    x, y = table()
    cells = [(i, int(y[i]), *[float(v) if i % 2 or not np.isnan(v) else None for v in x[i]], None) for i in range(len(y))]
    return spark.createDataFrame(cells, "pid long, label int, f_a double, f_b double, f_c double, f_blank double")


def test_stages_equal_numpy(spark, rows):
    x, y = table()
    names = ["f_a", "f_b", "f_c", "f_blank"]
    pipe = Pipeline(stages=[MedianScaler(inputCols=names, outputCol="features"), ClassWeights(labelCol="label", weightCol="weight")])
    fitted = pipe.fit(rows.where("pid < 80"))
    t = x[:80]
    med = np.nanmedian(t, axis=0)
    full = np.where(np.isnan(t), med, t)
    want = (np.where(np.isnan(x), med, x) - full.mean(0)) / full.std(0)
    got = {r.pid: r for r in fitted.transform(rows).select("pid", vector_to_array("features").alias("x"), "weight").collect()}
    p = y[:80].sum()
    for i in range(len(y)):
        assert got[i].x[:3] == pytest.approx(want[i]) and got[i].x[3] == 0.0
        assert got[i].weight == pytest.approx(80 / (2 * (p if y[i] else 80 - p)))


def test_saved_and_loaded_again(spark, rows, tmp_path):
    names = ["f_a", "f_b"]
    fitted = Pipeline(stages=[MedianScaler(inputCols=names, outputCol="features"), ClassWeights(), Prior()]).fit(rows)
    fitted.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    assert isinstance(again.stages[0], MedianScalerModel) and again.stages[0].getOrDefault("medians") == fitted.stages[0].getOrDefault("medians")
    same = lambda m: sorted(tuple(r) for r in models.score_column(m.transform(rows)).select("pid", vector_to_array("features"), "weight", "score").collect())
    assert same(fitted) == same(again)
    Pipeline(stages=[MedianScaler(inputCols=names, outputCol="features")]).save(f"{tmp_path}/p")
    assert Pipeline.load(f"{tmp_path}/p").getStages()[0].getInputCols() == names


def test_a_test_row_changes_no_fitted_value(spark, rows):
    names = ["f_a", "f_b", "f_c"]
    held = F.col("pid") % 4 == 0
    wild = rows.select("pid", F.when(held, 1 - F.col("label")).otherwise(F.col("label")).alias("label"), *[F.when(held, F.lit(1e9)).otherwise(F.col(c)).alias(c) for c in names])
    a, b = (models.preparation(names).fit(r.where(~held)) for r in (rows, wild))
    for stage, fields in ((0, ("medians", "means", "scales")), (1, ("positive", "negative"))):
        assert all(a.stages[stage].getOrDefault(f) == b.stages[stage].getOrDefault(f) for f in fields)
    assert a.stages[0].getOrDefault("means") != models.preparation(names).fit(wild).stages[0].getOrDefault("means")


def test_one_class_weighs_one_and_no_label_gives_no_weight(spark, rows):
    one = ClassWeights().fit(rows.where("label = 1"))
    assert one.getOrDefault("positive") == one.getOrDefault("negative") == 1.0
    assert "weight" not in one.transform(rows.drop("label")).columns
    assert Prior().fit(rows.where("false")).getOrDefault("share") == 0.0


def test_nested_cv_lists_every_model_repeat_and_fold(spark, rows):
    among = [models.contender(n, models.light()) for n in ("constant", "logit, squared penalty", "one tree")]
    folded = sampling.folds(rows.select("pid", "label"), "label", 3, 7, repeats=2)
    got = {(r.model, r.repeat, r.fold): r for r in models.nested_cv(rows, ["f_a", "f_b", "f_c"], among, folded, "pid", inner_folds=2).collect()}
    assert set(got) == {(c.name, rep, k) for c in among for rep in (0, 1) for k in (0, 1, 2)}
    assert all(r.auroc == 0.5 for (m, _, _), r in got.items() if m == "constant")
    assert all(sum(r.n for (m, rep, _), r in got.items() if m == c.name and rep == 0) == 120 for c in among)
    assert np.mean([r.auroc for (m, _, _), r in got.items() if m.startswith("logit")]) > 0.8


def test_the_full_settings_are_the_defaults():
    full = {c.name: c for c in models.contenders()}
    assert len(full) == 9 and len(full["boosted trees"].settings) == 8 and len(full["many trees"].settings) == 9 and full["many trees"].make().getNumTrees() == 300
    assert {s["maxIter"] for s in full["boosted trees"].settings} == {50, 150}


def test_trained_models_are_registered(spark, rows):
    names = registry.names(registry.CLASSIFIERS, "detect")
    assert names[:2] == ["never", "prior"] and {c.name for c in models.contenders()} < set(names)
    out = registry.get(registry.CLASSIFIERS, "normal densities", "detect")(rows.where("pid < 30"), rows.where("pid >= 30"))
    assert out.columns == [*rows.columns, "score"] and all(0 <= r.score <= 1 for r in out.collect()) and out.count() == 30
