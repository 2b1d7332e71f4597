"""Joins the cohort tables share. Sizes decide the physical join: static tables are
broadcast by Spark while they are small and merged (with skew splitting) beyond that."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.core import join_null_safe


def with_static(rows: DataFrame, static: DataFrame, pid: str = "pid", prefix: str = "c_") -> DataFrame:
    """Static attributes on every row, names prefixed; subjects without any keep nulls."""
    named = static.withColumnsRenamed({c: prefix + c for c in static.columns if c != pid})
    return rows.join(named, pid, "left")


def only(rows: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(chosen.select(*keys), list(keys), "left_semi")


def without(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(other.select(*keys), list(keys), "left_anti")


def at_scored(truth: DataFrame, predictions: DataFrame, keys: Sequence[str], scored: str = "scored") -> DataFrame:
    """Truth and prediction at the scored positions; a missing prediction stays as null."""
    return truth.where(F.col(scored)).join(predictions, list(keys), "left")


def complete_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    return left.join(right, list(keys), "left").where(F.col(a).isNotNull() & F.col(b).isNotNull())


def side_by_side(tables: dict[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """One value per key from several result tables, as columns; the first table leads."""
    out = None
    for name, t in tables.items():
        one = t.select(*keys, F.col(value).alias(name))
        out = one if out is None else out.join(one, list(keys), "left")
    return out


def fill_cache(wanted: DataFrame, cache: DataFrame, keys: Sequence[str], compute) -> tuple[DataFrame, DataFrame]:
    """(rows to append, vectors of all wanted keys): only keys absent from the cache are computed."""
    fresh = compute(wanted.join(cache.select(*keys), list(keys), "left_anti"))
    return fresh, wanted.select(*keys).join(cache.unionByName(fresh), list(keys))


def pair_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which both columns of a pair are filled: one aggregate for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    both = lambda a, b: F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
    row = df.agg(*[both(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("n")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


KERNEL_REACH = 8.0
"""Bandwidths beyond which a value adds nothing: its term there is below 1.3e-14 of its peak."""

KERNEL_ORDER = 13
"""Moments kept per bin of half a bandwidth: the terms left out add up to less than 1e-12 of a peak."""


def hermite(order: int) -> list[list[int]]:
    """Coefficients, lowest power first, of the polynomials with He(k+1) = x He(k) - k He(k-1)."""
    table = [[1], [0, 1]]
    for k in range(1, order - 1):
        up, low = [0, *table[k]], [k * c for c in table[k - 1]]
        table.append([c - (low[i] if i < len(low) else 0) for i, c in enumerate(up)])
    return table[:order]


def kernel_density(values: DataFrame, key: str, value: str, points: Sequence[float], min_n: int = 200) -> DataFrame:
    """Gaussian kernel density per key on a fixed grid (bandwidth sd * n^(-1/5)).

    Values go into bins of half a bandwidth, of which only the moments around the middle are kept: a value is one row
    whatever the grid. A bin then adds to the grid points within `KERNEL_REACH` bandwidths, through the expansion of the
    kernel in Hermite polynomials. Both cuts together stay below 1e-12 of the kernel's peak.
    """
    st = values.groupBy(key).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd")).where(
        (F.col("_n") >= min_n) & (F.col("_sd") > 0))
    h = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    merged = values.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
    t = merged.join(st.select(key, "_n", h.alias("_h")), key).withColumn("_bin", F.floor(F.col("_v") / (F.col("_h") / 2)))
    middle = (F.col("_bin") + 0.5) * (F.col("_h") / 2)
    t = t.withColumn("_t", (F.col("_v") - middle) / F.col("_h"))
    moment = lambda k: F.sum(F.col("_w") * F.pow("_t", F.lit(float(k)))) / math.factorial(k)
    bins = t.groupBy(key, "_n", "_h", "_bin").agg(*[moment(k).alias(f"_m{k}") for k in range(KERNEL_ORDER)])
    he = hermite(KERNEL_ORDER)
    power = lambda j: reduce(Column.__add__, [F.col(f"_m{k}") * float(c[j]) for k, c in enumerate(he) if j < len(c) and c[j]])
    bins = bins.select(key, "_n", "_h", middle.alias("_c"), *[power(j).alias(f"_a{j}") for j in range(KERNEL_ORDER)])
    grid = F.array(*[F.lit(float(p)) for p in points])
    near = bins.withColumn("x", F.explode(F.filter(grid, lambda p: F.abs(p - F.col("_c")) <= KERNEL_REACH * F.col("_h"))))
    u = (F.col("x") - F.col("_c")) / F.col("_h")
    near = near.withColumn("_u", u)
    poly = reduce(lambda total, j: total * F.col("_u") + F.col(f"_a{j}"), range(KERNEL_ORDER - 2, -1, -1), F.col(f"_a{KERNEL_ORDER - 1}"))
    sums = near.groupBy(key, "x").agg(F.sum(poly * F.exp(-F.col("_u") * F.col("_u") / 2)).alias("_s"))
    # grid points that no value reaches
    every = st.select(key, "_n", h.alias("_h"), F.explode(grid).alias("x"))
    whole = join_null_safe(every, sums, [key, "x"], "left")
    return whole.select(key, "x", (F.coalesce("_s", F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def same_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], tol: float = 1e-4) -> DataFrame:
    """One row: keys on both sides, on one only, and per value the number of differing rows.

    Two blanks are equal; one blank or a difference above `tol` is not.
    """
    lf = left.select(*keys, F.struct(*values).alias("_l"), F.lit(1).alias("_hl"))
    rt = right.select(*keys, F.struct(*values).alias("_r"), F.lit(1).alias("_hr"))
    j = lf.join(rt, list(keys), "full_outer")
    both = F.col("_hl").isNotNull() & F.col("_hr").isNotNull()

    def differs(c: str) -> Column:
        a, b = F.col(f"_l.{c}"), F.col(f"_r.{c}")
        return both & ~F.coalesce(F.when(a.isNull() & b.isNull(), True).otherwise(F.abs(a - b) <= tol), F.lit(False))

    return j.agg(F.count_if(both).alias("matched"), F.count_if(F.col("_hr").isNull()).alias("left_only"),
                 F.count_if(F.col("_hl").isNull()).alias("right_only"), *[F.count_if(differs(c)).alias(f"diff_{c}") for c in values])
