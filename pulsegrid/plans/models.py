"""Model jobs: fitting and prediction run in MLlib or as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scaling import from_z, log_stats, to_z
from pulsegrid.operators import features as feat
from pulsegrid.operators import fills, ledger, metrics, sampling
from pulsegrid.operators.core import draw_key
from pulsegrid.plans import features as PF
from pulsegrid.plans.neighbours import neighbour_votes
from pulsegrid.plans.preparation import ClassWeights, MedianScaler, Prior, apply_scaling, class_weights, fit_scaling  # noqa: F401  used as models.*
from pulsegrid.sources.stage import materialise, new_path


# ------------------------------------------------------------------- tree models
def gbt(names: Sequence[str], label: str, **settings) -> Pipeline:
    params = dict(maxIter=10, maxDepth=4, stepSize=0.2, seed=0) | settings
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="features"),
                            GBTRegressor(featuresCol="features", labelCol=label, predictionCol="z_pred", **params)])


@dataclass
class Fitted:
    """A fitted pipeline with its training table and feature names."""

    model: Transformer
    table: DataFrame
    names: list[str]


def filler_table(rows: DataFrame, k: int, period: int, covs: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The stored features of the tree gap-filler and their names."""
    table, names = PF.fill_features(rows, k, period, covs=covs)
    return materialise(table, "fill-features"), names


def fit_filler(rows: DataFrame, k: int, period: int, drop: Sequence[str] = (), covs: Sequence[str] = (), features: tuple[DataFrame, list[str]] | None = None, **settings) -> Fitted:
    """Tree gap-filler on the visible readings of all series together; `covs` are other signals of the same slot. `features` may serve several fits."""
    table, names = features or filler_table(rows, k, period, covs)
    names = [n for n in names if n not in drop]
    return Fitted(gbt(names, "z", **settings).fit(table.where("z is not null")), table, names)


def predict_fill(f: Fitted) -> DataFrame:
    """The visible value where there is one, else the model's, back in signal units."""
    p = f.model.transform(f.table)
    return p.withColumn("filled", F.coalesce("visible", from_z(F.col("z_pred"))))


def fit_forecaster(train: DataFrame, k: int, period: int, horizons: int, pairs: int, seed, covs: Sequence[str] = (), **settings):
    """Direct multi-step forecaster: one model for all steps, the step is a feature.

    History gaps are filled on a straight line for the features; targets are
    real readings only.
    """
    each, every = log_stats(train, "pid", "hrv")
    filled = fills.straight_line(fills.nearest(train, ["segment"]))
    z = to_z(filled, each, every, "pid", "hrv")
    z = materialise(z.withColumn("z_filled", (F.ln("filled") - F.col("_m")) / F.col("_s")), "z")
    feats, names = PF.forecast_features(z, k, period, covs=covs)
    feats = materialise(feats, "forecast-features")
    rows, cols = PF.training_rows(feats, feats, names, horizons, pairs, period, seed)
    rows = materialise(rows, "pairs")
    return gbt(cols, "target", **settings).fit(rows), feats, names


def predict_forecast(model: Transformer, feats: DataFrame, names: Sequence[str], period: int, horizon: int) -> DataFrame:
    rows, _ = PF.test_rows(feats, names, period, horizon)
    return model.transform(rows).withColumn("pred", from_z(F.col("z_pred"))).select("segment", "origin", "h", "pred")


# ------------------------------------------------------------------- classifiers
@dataclass(frozen=True)
class Contender:
    """A classifier of (features, label, weight) and the settings among which inner folds choose."""

    name: str
    make: Callable[[], Estimator]
    settings: tuple[dict[str, float], ...] = ({},)

    def maps(self, estimator: Estimator) -> list[dict]:
        return [{estimator.getParam(k): v for k, v in s.items()} for s in self.settings]


def all_of(**values: Sequence[float]) -> tuple[dict[str, float], ...]:
    """Every combination of the values."""
    return tuple(dict(zip(values, v, strict=True)) for v in product(*values.values()))


def contenders(seed: int = 0, trees: int = 300, rounds: Sequence[int] = (50, 150)) -> list[Contender]:
    """The constant reference, three linear models, a density model and four of trees; the defaults are the full settings."""
    weighed = {"weightCol": "weight"}
    return [
        Contender("constant", Prior),
        Contender("logit, squared penalty", lambda: LogisticRegression(elasticNetParam=0.0, maxIter=100, **weighed), all_of(regParam=(0.001, 0.01, 0.1, 1.0))),
        Contender("logit, absolute penalty", lambda: LogisticRegression(elasticNetParam=1.0, maxIter=100, **weighed), all_of(regParam=(0.001, 0.01, 0.1))),
        Contender("linear margin", lambda: LinearSVC(maxIter=100, **weighed), all_of(regParam=(0.001, 0.01, 0.1, 1.0))),
        Contender("normal densities", lambda: NaiveBayes(modelType="gaussian", **weighed)),
        Contender("one tree", lambda: DecisionTreeClassifier(seed=seed, **weighed), all_of(maxDepth=(2, 3, 4), minInstancesPerNode=(2, 4))),
        Contender("many trees", lambda: RandomForestClassifier(numTrees=trees, seed=seed, **weighed), all_of(maxDepth=(2, 3, 10), minInstancesPerNode=(1, 2, 4))),
        Contender("boosted trees", lambda: GBTClassifier(seed=seed, **weighed), all_of(maxIter=tuple(rounds), maxDepth=(1, 2), stepSize=(0.05, 0.1))),
        Contender("boosted trees, sampled", lambda: GBTClassifier(seed=seed, subsamplingRate=0.8, **weighed), all_of(maxIter=tuple(rounds), maxDepth=(1, 2), stepSize=(0.05, 0.1))),
    ]


def light(settings: int = 2, trees: int = 20, rounds: int = 8, seed: int = 0) -> list[Contender]:
    """All contenders with fewer trees and rounds, the first few settings each, and one setting for those of many trees."""
    return [replace(c, settings=c.settings[:1 if "trees" in c.name else settings]) for c in contenders(seed, trees, (rounds,))]


def contender(name: str, among: Sequence[Contender] | None = None) -> Contender:
    return next(c for c in among or contenders() if c.name == name)


def score_column(scored: DataFrame, out: str = "score") -> DataFrame:
    """Probability of the positive class; a linear machine has only its margin, squeezed so that margin 0 is 0.5."""
    if "probability" in scored.columns:
        return scored.withColumn(out, vector_to_array("probability")[1])
    return scored.withColumn(out, 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def fit_contender(train: DataFrame, c: Contender, settings: dict[str, float] | None = None) -> Transformer:
    est = c.make()
    return est.fit(train, params={est.getParam(k): v for k, v in (settings or c.settings[0]).items()})


def preparation(columns: Sequence[str]) -> Pipeline:
    """What stands before every contender: blanks filled, features scaled, classes weighed, all from the rows it is fitted on."""
    return Pipeline(stages=[MedianScaler(inputCols=list(columns), outputCol="features"), ClassWeights(labelCol="label", weightCol="weight")])


def in_threads(spark, jobs: Sequence[Callable], threads: int) -> list:
    """Results of jobs that run side by side: a single small fit leaves most of a cluster idle."""
    with ThreadPool(max(1, threads)) as pool:
        return pool.map(lambda job: inheritable_thread_target(spark)(job)(), list(jobs))


def nested_cv(rows: DataFrame, columns: Sequence[str], among: Sequence[Contender], folded: DataFrame, unit: str, seed: int = 0, inner_folds: int = 3,
              threads: int = 8) -> DataFrame:
    """(model, repeat, fold) with the held-out scores: outer folds score, inner folds choose, and folds are never pooled.

    `rows` has the feature `columns` and `label`, `folded` each unit's fold per repeat. Blanks, scales and class weights are fitted anew on every set of training rows, outer
    and inner, and serve all contenders. Fits run side by side; tables stay distributed.
    """
    table = materialise(rows.select(unit, "label", *columns).join(folded.select(unit, "repeat", "fold"), unit), "cv-rows")
    plan = [(r["repeat"], r["fold"]) for r in table.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]

    def outer(rep: int, fold: int) -> tuple[DataFrame, DataFrame]:
        one = table.where(F.col("repeat") == rep)
        inner = sampling.folds(one.where(F.col("fold") != fold).drop("repeat", "fold"), "label", inner_folds, f"{seed}|inner|{rep}|{fold}", unit=unit)
        return materialise(inner.withColumnRenamed("fold", "inner"), "cv-train"), one.where(F.col("fold") == fold)

    def prepared(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both tables as (unit, features, label, weight), with the values of the training rows."""
        fitted = preparation(columns).fit(train)
        sides = [materialise(fitted.transform(t).select(unit, "features", "label", "weight"), "cv-prepared") for t in (train, test)]
        return sides[0].sortWithinPartitions(unit), sides[1]

    outers = in_threads(table.sparkSession, [lambda p=p: outer(*p) for p in plan], threads)
    tuned = any(len(c.settings) > 1 for c in among)
    wanted = [(k, j) for k in range(len(plan)) for j in ([-1, *range(inner_folds)] if tuned else [-1])]

    def sides(k: int, j: int) -> tuple[DataFrame, DataFrame]:
        train, test = outers[k]
        return prepared(train, test) if j < 0 else prepared(train.where(F.col("inner") != j), train.where(F.col("inner") == j))

    ready = dict(zip(wanted, in_threads(table.sparkSession, [lambda w=w: sides(*w) for w in wanted], threads), strict=True))
    evaluator, path = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label"), new_path(table.sparkSession, "cv-scores")

    def run(c: Contender, k: int) -> str:
        best = c.settings[0]
        if len(c.settings) > 1:
            aurocs = [sum(evaluator.evaluate(fit_contender(ready[k, j][0], c, s).transform(ready[k, j][1])) for j in range(inner_folds)) for s in c.settings]
            best = c.settings[max(range(len(aurocs)), key=lambda i: (aurocs[i], -i))]
        train, test = ready[k, -1]
        scored = score_column(fit_contender(train, c, best).transform(test)).select("score", "label")
        rep, fold = plan[k]
        own = f"{path}/{among.index(c)}-{k}"
        scored.select(F.lit(c.name).alias("model"), F.lit(rep).alias("repeat"), F.lit(fold).alias("fold"), "score", F.col("label").cast("int").alias("label")).write.parquet(own)
        return own

    written = in_threads(table.sparkSession, [lambda c=c, k=k: run(c, k) for c in among for k in range(len(plan))], threads)
    scores = table.sparkSession.read.schema("model string, repeat int, fold int, score double, label int").parquet(*written)
    return metrics.detection_scores(scores, ["model", "repeat", "fold"])


# -------------------------------------------------------- linear discriminant
def moment_sums(rows: DataFrame, features: str, label: str) -> DataFrame:
    """(label, i, j, s): count, sums and cross products of the features, added up inside each task.

    Index 0 stands for the constant 1. What leaves a task is d * d numbers
    per label, whatever the number of rows.
    """
    def per_task(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.stack(b["x"].to_numpy()) if len(b) else np.zeros((0, 1))
            x = np.column_stack([np.ones(len(x)), x])
            y = b["y"].to_numpy()
            for c in np.unique(y):
                g = x[y == c]
                acc[int(c)] = acc.get(int(c), 0) + g.T @ g
        import pandas as pd

        for c, m in acc.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({"label": c, "i": i.ravel(), "j": j.ravel(), "s": m.ravel()})

    x = F.col(features)
    part = rows.select(x.alias("x"), F.col(label).cast("long").alias("y")).mapInPandas(per_task, "label long, i int, j int, s double")
    return part.groupBy("label", "i", "j").agg(F.sum("s").alias("s"))


def fit_discriminant(rows: DataFrame, features: str, label: str, shrinkage: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and offset of the two-class linear discriminant with shrunken pooled covariance.

    The d x d moment table (features, not rows) is solved on the driver.
    """
    t = moment_sums(rows, features, label).toPandas()
    d = int(t["i"].max())
    m = {int(c): g.pivot(index="i", columns="j", values="s").to_numpy() for c, g in t.groupby("label")}
    n = {c: m[c][0, 0] for c in (0, 1)}
    mu = {c: m[c][0, 1:] / n[c] for c in (0, 1)}
    pooled = sum(m[c][1:, 1:] - n[c] * np.outer(mu[c], mu[c]) for c in (0, 1)) / (n[0] + n[1])
    pooled = (1 - shrinkage) * pooled + shrinkage * np.trace(pooled) / d * np.eye(d)
    w = np.linalg.solve(pooled, mu[1] - mu[0])
    b = -0.5 * float(w @ (mu[1] + mu[0])) + float(np.log(n[1] / n[0]))
    return w, b


def apply_discriminant(rows: DataFrame, features: str, w: np.ndarray, b: float, out: str = "score") -> DataFrame:
    dot = F.aggregate(F.zip_with(F.col(features), F.array(*[F.lit(float(v)) for v in w]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn(out, 1 / (1 + F.exp(-(dot + b))))


# ------------------------------------------------------------ nearest neighbours
def nearest_vote(test: DataFrame, train: DataFrame, unit: str, features: str, label: str, k: int, weights: str = "uniform", block: int = 2048) -> DataFrame:
    """(id, score): share of positive votes among the k nearest training rows; both kinds of vote come from `neighbour_votes` in one pass."""
    votes = neighbour_votes(test, train, unit, features, label, k, group=block)
    return votes.select("id", F.col("uniform" if weights == "uniform" else "by_distance").alias("score"))


# ----------------------------------------------------------------- target, heads
def event_target(roster: DataFrame, events: DataFrame, watched: DataFrame, undated: DataFrame, pid: str = "pid") -> DataFrame:
    """1: a dated event; 0: watched and no event; null: only undated events, or never watched. With days of follow-up."""
    mark = lambda df, n: df.select(pid).distinct().withColumn(n, F.lit(True))
    span = watched.groupBy(pid).agg((F.datediff(F.max("date"), F.min("date")) + 1).alias("followup_days"))
    j = roster.select(pid).join(mark(events, "_e"), pid, "left").join(mark(undated, "_u"), pid, "left").join(span, pid, "left")
    target = F.when(F.col("_e"), 1).when(F.col("_u"), None).when(F.col("followup_days").isNotNull(), 0)
    return j.select(pid, target.alias("target"), "followup_days")


def vector_head(train: DataFrame, vector: str = "vector", label: str = "label", reg: float = 0.01) -> Transformer:
    """Logistic head on precomputed vectors (arrays)."""
    t = train.withColumn("features", array_to_vector(F.col(vector)))
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, maxIter=30).fit(t)


# --------------------------------------------------------------- search, ablation
def fill_error(pred: DataFrame) -> DataFrame:
    p = pred.where("scored").select("pid", F.col("hrv").alias("truth"), F.col("filled").alias("pred"))
    return metrics.error_scores(p, [], 120, 129)


def settings_search(rows: DataFrame, k: int, period: int, space: dict[str, Sequence], tries: int, seed: int) -> DataFrame:
    """Default settings and `tries` random ones on the practice set; a broken run scores 1000.

    Features are built once; each setting is one MLlib fit. Draws are md5-based.
    """
    import hashlib

    base = fit_filler(rows, k, period, maxIter=3)
    table, names = base.table, base.names
    pick = lambda i, n, vals: vals[int(hashlib.md5(f"{seed}|{i}|{n}".encode()).hexdigest()[:8], 16) % len(vals)]
    settings = [{}] + [{n: pick(i, n, v) for n, v in space.items()} for i in range(1, tries + 1)]
    out = None
    for i, s in enumerate(settings):
        model = gbt(names, "z", **({"maxIter": 5} | s)).fit(table.where("z is not null"))
        p = model.transform(table.where("scored")).withColumn("filled", from_z(F.col("z_pred")))
        e = fill_error(p)
        ok = F.col("mae").isNotNull() & (F.col("n_nonfinite") == 0) & (F.col("n_nonpositive") == 0)
        m = e.select(F.lit(i).alias("trial"), F.lit(str(sorted(s.items()))).alias("settings"), F.when(ok, F.col("mae")).otherwise(1000.0).alias("mae"))
        out = m if out is None else out.unionByName(m)
    return out


def drop_one_family(rows: DataFrame, k: int, period: int, families: dict[str, Sequence[str]], **settings) -> DataFrame:
    """Error of the tree filler without each family, and the change against all features. Features are built once."""
    features, out = filler_table(rows, k, period), None
    for name, drop in {"none": (), **families}.items():
        m = fill_error(predict_fill(fit_filler(rows, k, period, drop=drop, features=features, **settings))).select(F.lit("tree").alias("model"), F.lit(name).alias("dropped"), "mae")
        out = m if out is None else out.unionByName(m)
    return ledger.ablation(materialise(out, "ablation"), ["model"], "dropped")


def importance(f: Fitted) -> DataFrame:
    """Share of the tree model's importance per feature family."""
    values = f.model.stages[-1].featureImportances.toArray()
    spark = f.table.sparkSession
    imp = spark.createDataFrame([(n, float(v)) for n, v in zip(f.names, values)], "feature string, value double")
    family, _ = feat.feature_family(F.col("feature"))
    return ledger.importance_by_family(imp.select(F.lit("tree").alias("model"), family.alias("family"), "value"), ["model"], "family", "value")


# --------------------------------------------------------------- experiment grid
def experiment_grid(days: DataFrame, units: DataFrame, strata: Sequence[str], shares: Sequence[float], seeds: Sequence[int], unit: str = "pid",
                    threshold: float = 0.5) -> DataFrame:
    """Scores for every (test share, seed) at once: the splits are columns, not a loop."""
    from pulsegrid.operators.core import draw_order

    u = units.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    u = draw_order(u.withColumn("_md5", draw_key("grid", "seed", unit)), ["share", "seed", *strata], "_md5")
    test = u.where(F.col("draw_rank") <= F.floor(F.col("draw_rank_total") * F.col("share") + 0.5)).select("share", "seed", unit)
    return metrics.detection_scores(days.join(test, unit), ["share", "seed"], threshold)


# ------------------------------------------------------------------- extension
def per_series(rows: DataFrame, keys: Sequence[str], fn: Callable, schema: str, longest: int = 200_000) -> DataFrame:
    """Run a pandas function on each whole series: the extension point for custom models.

    A series is one task here, so its length is checked first; longer ones
    must be cut by the caller.
    """
    top = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if top > longest:
        raise ValueError(f"a series has {top} rows, more than {longest}: add a piece column to the keys")
    return rows.groupBy(*keys).applyInPandas(fn, schema)
