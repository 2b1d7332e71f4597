"""Connected components of an edge list, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.stage import materialise


def _stars(e: DataFrame) -> DataFrame:
    """Both steps below need, per vertex, the least of its neighbours and itself."""
    return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
    return both.join(_stars(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    m = _stars(down)
    hung = down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.unionByName(m.select("u", F.col("m").alias("v")).where("u <> v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between numbers -> (u, root): the least number that u reaches. Vertices without a link are absent.

    Large and small stars in turn: each round links every vertex to the least of its neighbours. The rounds grow with the
    logarithm of the component, not with its diameter. Each round is a written table, so no lineage piles up and a
    lost executor costs one round. A vertex with very many links is pre-aggregated before the shuffle, and the joins
    are ones that adaptive execution can split.
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    sums = None
    while True:
        if now.isEmpty():
            return now.select("u", F.col("v").alias("root"))
        now = materialise(_small(_large(now)), "edges")
        was, sums = sums, now.agg(F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if was == sums:
            return now.select("u", F.col("v").alias("root"))
