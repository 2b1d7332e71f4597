"""Is a cross-validated score better than chance? Labels are shuffled and the whole procedure is fitted again, for all shuffles at once.

Every labelling (the observed one and each shuffle) and every fold is one logistic model. All of them advance together: a Newton step is one pass over
the rows, in which a task adds up the gradient and the curvature of every model for its rows, and what leaves a task is one small vector per model.
Blanks are filled with the median and features standardised with values of the fold's training rows.

The models' number (labellings x folds) and the features', not the rows', decide what comes to the driver: `MOST_NUMBERS` at most, else an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import metrics
from pulsegrid.operators.core import exact_quantiles
from pulsegrid.sources.stage import materialise

MOST_NUMBERS = 20_000_000


@dataclass(frozen=True)
class Scaling:
    """Median, mean and standard deviation per (fold, feature), from the rows outside the fold."""

    median: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def apply(self, x: np.ndarray, fold: int) -> np.ndarray:
        """Filled and standardised rows with a leading 1."""
        full = np.where(np.isnan(x), self.median[fold], x)
        return np.column_stack([np.ones(len(x)), (full - self.mean[fold]) / self.sd[fold]])


def fold_scaling(rows: DataFrame, features: Sequence[str], folds: int) -> Scaling:
    """One row per (fold, feature) comes to the driver. A feature without a reading outside the fold counts as constant 0."""
    cells = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(features)]))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold")))
    long = rows.select(F.col("fold"), cells.alias("c")).select(others.alias("k"), "c.j", F.when(~F.isnan("c.v"), F.col("c.v")).alias("v"))
    median = exact_quantiles(long, ["k", "j"], "v", {"median": 0.5}).select("k", "j", "median")
    full = long.join(median, ["k", "j"]).withColumn("v", F.coalesce("v", "median"))
    out = Scaling(np.zeros((folds, len(features))), np.zeros((folds, len(features))), np.ones((folds, len(features))))
    for r in full.groupBy("k", "j").agg(F.max("median").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).collect():
        out.median[r["k"], r["j"]], out.mean[r["k"], r["j"]], out.sd[r["k"], r["j"]] = r["median"], r["mean"], r["sd"] or 1.0
    return out


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


@dataclass
class Fits:
    """Weights of all models: (fold, labelling, 1 + features)."""

    scaling: Scaling
    weights: np.ndarray
    steps: int


def _sums(rows: DataFrame, width: int, labellings: int, folds: int, values: int, per_fold) -> np.ndarray:
    """Add up over all rows, per (fold, labelling), the `values` numbers that `per_fold(x, y, fold)` gives for the rows outside the fold."""
    size = folds * labellings * values
    if size > MOST_NUMBERS:
        raise ValueError(f"{size} numbers per step: fewer labellings, folds or features, please")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, labellings, values))
        for batch in batches:
            x, y, fold = _matrix(batch, "x", width), _matrix(batch, "y", labellings), batch.column("fold").to_numpy()
            for k in range(folds):
                out = fold != k
                if out.any():
                    total[k] += per_fold(x[out], y[out], k)
        models = total.reshape(-1, values)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), pa.array(list(models), pa.list_(pa.float64()))], names=["model", "v"])

    parts = rows.select("x", "y", "fold").mapInArrow(run, "model long, v array<double>")
    sums = parts.groupBy("model").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    got = np.zeros((folds * labellings, values))
    for r in sums.collect():
        got[r["model"]] = r["v"]
    return got.reshape(folds, labellings, values)


def fit_all(rows: DataFrame, scaling: Scaling, width: int, labellings: int, folds: int, ridge: float = 1.0, balanced: bool = True, most_steps: int = 25, tolerance: float = 1e-8) -> Fits:
    """Ridge logistic weights of every (fold, labelling) by Newton's method; `rows` has x (numbers), y (one truth value per labelling) and fold.

    With `balanced` both classes weigh the same. A model whose training rows are all of one class keeps weights of 0.
    """
    counts = _sums(rows, width, labellings, folds, 2, lambda x, y, k: np.stack([y.sum(0), len(y) - y.sum(0)], axis=1))
    both = (counts > 0).all(axis=2)
    n = counts.sum(axis=2)
    with np.errstate(divide="ignore"):
        weigh = np.where(both[..., None], n[..., None] / (2 * counts), 0.0) if balanced else np.repeat(both[..., None].astype(float), 2, axis=2)
    d = width + 1
    weights = np.zeros((folds, labellings, d))
    penalty = ridge * np.diag([0.0] + [1.0] * width)
    for step in range(1, most_steps + 1):
        now = weights

        def one(x: np.ndarray, y: np.ndarray, k: int, now=now) -> np.ndarray:
            z = scaling.apply(x, k)
            p = 1 / (1 + np.exp(-np.clip(z @ now[k].T, -500, 500)))
            w = np.where(y > 0.5, weigh[k, :, 0], weigh[k, :, 1])
            gradient = (w * (y - p)).T @ z
            pairs = (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
            return np.concatenate([gradient, (w * p * (1 - p)).T @ pairs], axis=1)

        got = _sums(rows, width, labellings, folds, d + d * d, one)
        gradient, curve = got[..., :d] - now @ penalty, got[..., d:].reshape(folds, labellings, d, d) + penalty
        curve = np.where(both[..., None, None], curve, np.eye(d))
        change = np.where(both[..., None], np.linalg.solve(curve, gradient[..., None])[..., 0], 0.0)
        weights = now + change
        if np.abs(change).max() < tolerance:
            break
    return Fits(scaling, weights, step)


def held_out(rows: DataFrame, fits: Fits, unit: Sequence[str], width: int, labellings: int) -> DataFrame:
    """(unit, fold, labelling, label, score): every row scored, per labelling, by the model that did not see its fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = _matrix(batch, "x", width), batch.column("fold").to_numpy()
            z = np.empty((len(x), labellings))
            for k in np.unique(fold).tolist():
                own = fold == k
                z[own] = np.round(fits.scaling.apply(x[own], k) @ fits.weights[k].T, 9)
            scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            keep = [batch.column(c) for c in (*unit, "fold", "y")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(list(scores), pa.list_(pa.float64()))], names=[*unit, "fold", "y", "z"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*unit, "fold", "y").schema)
    out = rows.select(*unit, "fold", "y", "x").mapInArrow(run, f"{fields}, z array<double>")
    return out.select(*unit, "fold", F.posexplode(F.arrays_zip("y", "z")).alias("labelling", "c")).select(
        *unit, "fold", "labelling", F.col("c.y").cast("int").alias("label"), F.col("c.z").alias("score"))


def labelled(rows: DataFrame, features: Sequence[str], unit: Sequence[str], permutations: int, seed: str | int) -> DataFrame:
    """(unit, fold, x, y): x the features (blank: NaN), y the observed label and the label of every shuffle.

    A shuffle gives as many positives as before to the rows with the smallest md5 draws; `unit` tells rows apart.
    """
    cuts = metrics.permutation_cuts(rows, permutations, seed, unit)
    by_number = {r["permutation"]: r["cut"] for r in cuts.collect()}
    draws = [metrics.draw_key(seed, F.lit(str(p)), *unit) <= F.lit(by_number.get(p, "")) for p in range(1, permutations + 1)]
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    return materialise(rows.select(*unit, F.col("fold").cast("int").alias("fold"), x.alias("x"), F.array(F.col("label") == 1, *draws).alias("y")), "labellings")


def permutation_scores(rows: DataFrame, features: Sequence[str], unit: Sequence[str], permutations: int = 200, seed: str | int = 0, folds: int = 5,
                       ridge: float = 1.0, balanced: bool = True) -> DataFrame:
    """(labelling, auroc): the mean over folds of the held-out AUROC; labelling 0 is the observed one.

    `rows` has the features, `label` (0 / 1) and `fold` (0 … folds - 1). A fold whose held-out rows are all of one class under a labelling is left out of its mean.
    """
    table = labelled(rows, features, unit, permutations, seed)
    scaling = fold_scaling(rows, features, folds)
    fits = fit_all(table, scaling, len(features), permutations + 1, folds, ridge, balanced)
    per_fold = metrics.detection_scores(held_out(table, fits, unit, len(features), permutations + 1), ["labelling", "fold"])
    return per_fold.groupBy("labelling").agg(F.avg("auroc").alias("auroc"))


def refit_test(rows: DataFrame, features: Sequence[str], unit: Sequence[str], permutations: int = 200, seed: str | int = 0, folds: int = 5, ridge: float = 1.0,
               balanced: bool = True) -> DataFrame:
    """Observed AUROC, mean and 95 % point of the shuffles', and the share of shuffles that reach the observed one."""
    per = materialise(permutation_scores(rows, features, unit, permutations, seed, folds, ridge, balanced), "refit-scores")
    observed = per.where("labelling = 0").select("auroc").scalar()
    null = per.where("labelling > 0").withColumn("_obs", observed)
    return null.agg(F.max("_obs").alias("observed"), F.avg("auroc").alias("null_mean"), F.percentile("auroc", F.lit(0.95)).alias("null_p95"),
                    F.avg((F.col("auroc") >= F.col("_obs")).cast("double")).alias("p_value"), F.count(F.lit(1)).alias("permutations"))
