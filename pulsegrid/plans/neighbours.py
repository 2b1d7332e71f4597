"""Exact nearest neighbours through pivots: most blocks of rows are ruled out by the triangle inequality before a row is looked at.

Every training row belongs to its nearest pivot, and there to a ring of like distance: a block. What is known of a block is its size and its least and
largest distance r to the pivot p. For a row q at distance D from p, the block's rows are at least max(D - r_max, r_min - D) and at most D + r_max away. The at-most sides of
enough blocks to hold k rows bound the k-th distance; blocks whose at-least side exceeds that bound cannot take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.operators.core import draw_key
from pulsegrid.sources.stage import materialise

PIVOTS = 64
RINGS = 8
GROUP = 8192
"""Rows of either side that meet in one task, about."""

SCREEN = 256
"""Asking rows screened at a time."""


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    n = batch.num_rows
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all rows of y, one row of y at a time."""
    return np.sqrt(np.stack([((x - r) ** 2).sum(axis=1) for r in y], axis=1)) if len(x) else np.zeros((0, len(y)))


def blocked(train: DataFrame, pivots: np.ndarray, rings: int) -> tuple[DataFrame, np.ndarray]:
    """Training rows with `block`, and per block (number, rows, least distance, largest distance): at most pivots x rings lines."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(_matrix(b), pivots)
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int64)), pa.array(d[np.arange(len(d)), cell])], names=[*b.schema.names, "cell", "far"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.schema) + ", cell long, far double"
    rows = materialise(train.mapInArrow(near, schema), "pivot-cells")
    width = {r["cell"]: (r["m"] or 1.0) / rings for r in rows.groupBy("cell").agg(F.max("far").alias("m")).collect()}
    widths = F.element_at(F.create_map(*[v for c, w in width.items() for v in (F.lit(c), F.lit(w or 1.0))]), F.col("cell")) if width else F.lit(1.0)
    ring = F.least(F.floor(F.col("far") / widths), F.lit(rings - 1)).cast("long")
    rows = rows.withColumn("block", F.col("cell") * rings + ring)
    stats = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("a"), F.max("far").alias("b")).orderBy("block").collect()
    return rows, np.array([(r["block"], r["n"], r["a"], r["b"]) for r in stats], dtype=np.float64).reshape(-1, 4)


def needed(x: np.ndarray, pivots: np.ndarray, stats: np.ndarray, rings: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks each row has to look at (rows x blocks), and a bound of its k-th distance."""
    d = distances(x, pivots)[:, (stats[:, 0] // rings).astype(int)]
    most, least = d + stats[:, 3], np.maximum(0, np.maximum(d - stats[:, 3], stats[:, 2] - d))
    order = np.argsort(most, axis=1, kind="stable")
    held = np.cumsum(stats[:, 1][order], axis=1)
    enough = np.minimum((held < k).sum(axis=1), len(stats) - 1)
    bound = np.take_along_axis(most, np.take_along_axis(order, enough[:, None], axis=1), axis=1)[:, 0]
    bound = bound * (1 + 1e-9) + 1e-9  # room for rounding: a block too many costs time only
    return least <= bound[:, None], bound


def k_best(q: np.ndarray, r: np.ndarray, rid: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of r, squared distance) of the k nearest rows of r within each row's limit; of equally near ones the smaller `rid` goes first.

    Matrix products screen the pairs, with room for their rounding; what may be among the k best is measured again from the differences.
    """
    found, rr = [], (r * r).sum(axis=1)
    for lo in range(0, len(q), SCREEN):
        x, top = q[lo:lo + SCREEN], limit[lo:lo + SCREEN]
        xx = (x * x).sum(axis=1)
        if np.isfinite(xx).all() and np.isfinite(rr).all():
            about = xx[:, None] + rr - 2 * (x @ r.T)
            room = 1e-12 * x.shape[1] * (xx + rr.max())
            last = min(k, len(r)) - 1
            row, other = np.nonzero(about <= np.minimum(np.partition(about, last, axis=1)[:, last] + 2 * room, top ** 2 * (1 + 1e-12) + room)[:, None])
        else:
            row, other = (i.ravel() for i in np.indices((len(x), len(r))))
        d = np.concatenate([((r[other[s:s + 65536]] - x[row[s:s + 65536]]) ** 2).sum(1) for s in range(0, len(row), 65536)] or [np.zeros(0)])
        near = np.sqrt(d) <= top[row]
        row, other, d = row[near], other[near], d[near]
        order = np.lexsort((rid[other], d, row))
        row, other, d = row[order], other[order], d[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[first] + lo, other[first], d[first]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def neighbour_votes(test: DataFrame, train: DataFrame, unit: str, features: str, label: str, k: int, pivots: int = PIVOTS, rings: int = RINGS, group: int = GROUP) -> DataFrame:
    """(id, uniform, by_distance, pairs): shares of positive votes among the k nearest training rows, each counted once or by 1 / distance, and
    how many training rows were looked at. Of equally near rows the smaller unit counts first.

    Pivots are a draw of training rows; their number, not the rows', bounds what the driver and the tasks hold. A block and the rows that ask for it are
    cut into groups of about `group` rows each; of a group only the k best per asking row leave the task.
    """
    t = materialise(train.select(F.col(unit).cast("long").alias("rid"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")), "neighbours-train")
    drawn = t.withColumn("_md5", draw_key("pivot", "rid")).orderBy("_md5").limit(pivots).select("x").collect()
    if not drawn:
        return test.select(F.col(unit).cast("long").alias("id"), F.lit(None).cast("double").alias("uniform"), F.lit(None).cast("double").alias("by_distance"), F.lit(0).cast("long").alias("pairs"))
    points = np.array([r["x"] for r in drawn], dtype=np.float64)
    rows, stats = blocked(t, points, rings)
    parts = dict(zip(stats[:, 0].astype(int).tolist(), (-(-stats[:, 1] // group)).astype(int).tolist(), strict=True))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want, bound = needed(_matrix(b), points, stats, rings, k) if b.num_rows else (np.zeros((0, len(stats)), dtype=bool), np.zeros(0))
            row, block = np.nonzero(want)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("x").take(pa.array(row)), pa.array(stats[block, 0].astype(np.int64)), pa.array(bound[row])],
                                             names=["id", "x", "block", "bound"])

    asked = test.select(F.col(unit).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x")).mapInArrow(ask, "id long, x array<double>, block long, bound double")
    asked = materialise(asked, "neighbours-asked")
    crowds = {r["block"]: -(-r["n"] // group) for r in asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per block at most
    number = lambda m: F.element_at(F.create_map(*[v for c, n in m.items() for v in (F.lit(c), F.lit(n))]), F.col("block")) if m else F.lit(1)
    place = lambda c, m: F.pmod(F.xxhash64(c), number(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.coalesce(number(m), F.lit(1)) - 1))
    left = asked.withColumns({"qp": place("id", crowds)}).withColumn("tp", every(parts))
    right = rows.where(F.col("block").isin(list(crowds)) if crowds else F.lit(False)).withColumns({"tp": place("rid", parts)}).withColumn("qp", every(crowds))
    keys = ["block", "tp", "qp"]

    def best(a, b):
        import pandas as pd

        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "d": [], "y": [], "rid": [], "n": []})
        q, r = np.stack(a["x"].to_numpy()).astype(float), np.stack(b["x"].to_numpy()).astype(float)
        y, rid, limit = b["y"].to_numpy(), b["rid"].to_numpy(), a["bound"].to_numpy()
        row, other, d = k_best(q, r, rid, limit, k)
        none = np.setdiff1d(np.arange(len(q)), row)  # a row without a find still tells how many were looked at
        return pd.DataFrame({
            "id": a["id"].to_numpy()[np.r_[row, none]], "d": np.r_[d, np.full(len(none), np.inf)], "y": np.r_[y[other], np.zeros(len(none))], "rid": np.r_[rid[other], np.full(len(none), -1)],
            "n": np.where(np.r_[np.diff(row, prepend=-1) > 0, np.ones(len(none), dtype=bool)], len(r), 0)})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "id long, d double, y double, rid long, n long")
    found = materialise(found, "neighbours-found")
    pairs = found.groupBy("id").agg(F.sum("n").alias("pairs"))
    real = found.where(F.col("d") < float("inf"))
    top = real.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("d", "rid"))).where(F.col("_n") <= k)
    w = 1 / F.greatest(F.sqrt("d"), F.lit(1e-12))
    return top.groupBy("id").agg(F.avg("y").alias("uniform"), (F.sum(w * F.col("y")) / F.sum(w)).alias("by_distance")).join(pairs, "id")
