"""Top-k reports and arg-max picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def stable_sort(df: DataFrame, order: Sequence[Column], ties: Sequence[str]) -> DataFrame:
    """A total order: the wanted keys, then names that settle every tie (range-partitioned sort)."""
    return df.orderBy(*order, *ties)


def strongest_pairs(correlations: DataFrame, k: int = 3, min_n: int = 10, score: str = "spearman") -> DataFrame:
    return correlations.where((F.col("n") >= min_n) & F.col(score).isNotNull()).orderBy(F.desc(F.abs(score)), "a", "b").limit(k)


def best_per(results: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """Lowest-scoring usable row per key; merged on the map side by a struct minimum."""
    rest = [c for c in results.columns if c not in keys]
    b = results.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(score, tie)).alias("_b"))
    return b.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def top_n(results: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key. Spark keeps only n rows per key and task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return results.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def longest_series(rows: DataFrame, series: str, k: int = 6) -> DataFrame:
    return rows.groupBy(series).agg(F.count(F.lit(1)).alias("length")).orderBy(F.desc("length"), series).limit(k)


def best_window(labelled: DataFrame, masked: DataFrame, width: int, step: int, min_run: int = 3, slot: str = "slot", value: str = "hrv") -> DataFrame:
    """The example window: most hidden runs of at least `min_run` slots wholly counted inside it, then most readings.

    Every slot is handed to the window starts that cover it (width / step of
    them), so no segment is scanned in one piece.
    """
    from pulsegrid.operators.core import floor_div

    inside = labelled.where(F.col("segment").isNotNull()).select("segment", "a", "b", slot, value)
    # a stored mask packs well: merged, as its size on disk would have it broadcast
    m = inside.join(masked.select("segment", slot, F.lit(1).alias("_m")).hint("merge"), ["segment", slot], "left")
    place = F.col(slot) - F.col("a")
    first, last = F.greatest(F.lit(0), -floor_div(F.lit(width - 1) - place, step)), floor_div(place, step)
    w = m.withColumn("_start", F.explode_outer(F.when(first <= last, F.sequence(first, last)))).where(
        F.col("_start").isNotNull() & (F.col("a") + F.col("_start") * step + width - 1 <= F.col("b")))
    # hidden runs of a window: consecutive masked slots (a window holds `width` slots)
    run = W.partitionBy("segment", "_start").orderBy(slot)
    w = w.withColumn("_grp", F.when(F.col("_m") == 1, F.col(slot) - F.sum(F.coalesce("_m", F.lit(0))).over(run)))
    runs = w.groupBy("segment", "_start", "_grp").agg(F.count(F.lit(1)).alias("_len"), F.count(value).alias("_seen"))
    score = runs.groupBy("segment", "_start").agg(
        F.count_if(F.col("_grp").isNotNull() & (F.col("_len") >= min_run)).alias("runs"), F.sum("_seen").alias("readings"))
    best = score.agg(F.max_by(F.struct("segment", "_start", "runs", "readings"), F.struct("runs", "readings", "segment", (-F.col("_start")).alias("s"))).alias("w"))
    return best.select("w.segment", (F.col("w._start") * step).alias("start"), "w.runs", "w.readings")


def busiest(rows: DataFrame, series: str) -> DataFrame:
    n = rows.groupBy(series).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max_by(F.struct(series, "n"), F.struct(F.col("n"), F.col(series))).alias("b")).select("b.*")


def longest_hidden_run(masked: DataFrame, slot: str = "slot") -> DataFrame:
    """The longest unbroken stretch of hidden slots (blanks between hidden readings break it): its series, start and length."""
    from pulsegrid.operators.core import islands

    runs = islands(masked.select("segment", slot), ["segment"], slot, F.lit(0)).groupBy("segment", "a").agg(F.count(F.lit(1)).alias("length"))
    r = runs.agg(F.max_by(F.struct("segment", "a", "length"), F.struct(F.col("length"), F.col("segment"), F.col("a"))).alias("r"))
    return r.select("r.segment", F.col("r.a").alias("start_slot"), "r.length")
