"""Queries that did part of their job (round 4's findings)."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.catalog import models as queries
from pulsegrid.operators import sampling
from pulsegrid.plans import models, registry


@pytest.fixture
def vectors(spark, tmp_path):
    rows = [(i, [float((i * 37 + j * 11) % 23 - 11) + (4.0 if i % 10 < 5 else 0.0) for j in range(64)], i % 10) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_nested_cv_query_takes_every_setting_and_repeat(spark, vectors, monkeypatch):
    seen = {}
    monkeypatch.setattr(models, "nested_cv", lambda rows, names, among, folded, unit, **more: seen.update(among=among, folded=folded, more=more) or folded.selectExpr("'x' as model", "repeat", "0.5 as auroc"))
    queries.h11(spark, vectors).collect()
    full = models.contenders()
    assert [(c.name, c.settings) for c in seen["among"]] == [(c.name, c.settings) for c in full] and not seen["more"]
    assert {c.name: c.make().getNumTrees() for c in seen["among"] if c.name == "many trees"} == {"many trees": 300}
    assert {(r.repeat, r.fold) for r in seen["folded"].collect()} == {(r, f) for r in range(20) for f in range(5)}


def test_scores_of_all_folds_are_one_scan(spark, vectors, monkeypatch):
    """A union of them would be planned anew for each of 900."""
    monkeypatch.setattr(models.metrics, "detection_scores", lambda scores, keys: scores)
    rows, names = queries.feature_columns(spark, vectors)
    folded = sampling.folds(rows.select("pid", "label"), "label", 3, 3)
    out = models.nested_cv(rows, names[:2], [models.contender("constant")], folded, "pid")
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.fold for r in out.collect()) == [f for f in range(3) for _ in range(30)]


@pytest.mark.parametrize("wrong", [None, "boosted trees, sampled"])
def test_every_trained_classifier_scores(spark, vectors, monkeypatch, wrong):
    called, real = [], registry.get
    stub = lambda n: lambda test, train: test.withColumn("score", F.lit(1.5 if n == wrong else 0.25))
    monkeypatch.setattr(registry, "get", lambda kind, name, task: called.append(name) or (real(kind, name, task) and stub(name)))
    out = queries.i02b(spark, vectors).collect()
    assert sorted(called) == sorted(c.name for c in models.contenders())
    assert sorted(r.pid for r in out) == list(range(0, 90, 3)) and {(r.scored, r.constant) for r in out} == {(int(wrong is None), 0.25)}
