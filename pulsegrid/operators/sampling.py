"""Seeded masks, splits and folds. Every draw ranks rows by an md5 of seed and key,
so it repeats on any cluster and any partitioning."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.core import CHUNK, draw_key, draw_order
from pulsegrid.sources.stage import materialise


def random_mask(labelled: DataFrame, seed: str | int, pct: int = 20, value: str = "hrv", slot: str = "slot") -> DataFrame:
    """Hide round-half-even(pct %) of the observed slots of every segment: (segment, slot) of the hidden ones."""
    obs = labelled.where(F.col("segment").isNotNull() & F.col(value).isNotNull())
    # a segment that fits one piece is ordered whole: sixteen parts of it would be nearly as many as its rows
    long = F.col("b") - F.col("a") >= CHUNK if {"a", "b"} <= set(labelled.columns) else F.lit(True)
    obs = obs.select("segment", slot, F.coalesce(long.cast("int"), F.lit(1)).alias("_digits"))
    obs = draw_order(obs.withColumn("_md5", draw_key(seed, "segment", slot)), ["segment"], "_md5", digits=F.col("_digits"))
    return obs.where(F.col("draw_rank") <= F.bround(F.col("draw_rank_total") * pct / 100)).select("segment", slot)


def run_pool(labelled: DataFrame, distinct: bool = True, longest: int | None = None) -> DataFrame:
    """Lengths of the missing runs inside segments with how often each occurs.

    `distinct` counts a length once per segment. Runs inside segments are no
    longer than the cut, so the table has at most that many rows.
    """
    runs = labelled.where(F.col("segment").isNotNull() & (F.col("missing_run") > 0))
    if longest is not None:
        runs = runs.where(F.col("missing_run") <= longest)
    per = runs.groupBy("segment", "missing_run").agg(F.count(F.lit(1)).alias("_slots"))
    weight = F.count(F.lit(1)) if distinct else F.sum(F.col("_slots") / F.col("missing_run")).cast("long")
    return per.groupBy(F.col("missing_run").alias("length")).agg(weight.alias("n"))


def hex_number(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")


def block_mask(labelled: DataFrame, pool: DataFrame, seed: str | int, *, pct: int = 20, value: str = "hrv", slot: str = "slot") -> DataFrame:
    """Hide whole runs, with lengths drawn from the pool, until pct % of a segment's readings are hidden.

    Candidate runs 1, 2, 3 ... are drawn per segment; a reading belongs to the first candidate that covers it; candidates
    count in order while the readings hidden so far are below the target (the last may overshoot). No run shorter than the
    segment covers its last slot, so the target is at most the readings that some candidate can cover, and is always met.
    The first round draws as many candidates as the target should need; segments that fall short draw four times as many
    in the next. Returns (segment, slot) of the hidden readings.
    """
    inside = labelled.where(F.col("segment").isNotNull())
    # the pool has at most `longest gap` rows: read once and written into the plan as a list
    lengths = sorted((int(r["length"]), int(r["n"])) for r in pool.collect()) or [(1, 1)]
    longest, mean = lengths[-1][0], sum(k * n for k, n in lengths) / sum(n for _, n in lengths)
    seg = inside.groupBy("segment").agg(F.min(slot).alias("_a"), F.count(F.lit(1)).alias("_n"), F.count(value).alias("_known"),
                                        F.max(F.struct(slot, F.col(value).isNotNull().cast("long").alias("known"))).alias("_end"))
    reach = F.col("_known") - F.when(F.col("_n") > longest, F.col("_end.known")).otherwise(0)
    target = F.least(F.bround(F.col("_known") * pct / 100).cast("long"), reach)
    todo = materialise(seg.select("segment", "_a", "_n", target.alias("_target")).where("_target > 0"), "mask-segments")
    obs = inside.where(F.col(value).isNotNull()).select("segment", slot)
    # a random place is hit once with probability 1 - 1/e by as many places as there are: twice the target's share is ample mostly
    tries = F.ceil(F.lit(2 * pct / 100 / mean) * F.col("_n")) + 16
    hidden: list[DataFrame] = []
    while True:
        got = materialise(_first_runs(todo.withColumn("_tries", tries), obs, lengths, seed, slot), "mask-round")
        hidden.append(got.select("segment", slot))
        met = got.groupBy("segment", "_target").agg(F.count(F.lit(1)).alias("_got")).where("_got >= _target")
        # all of these tables grow with the readings and pack well: merged, as their size on disk would have them broadcast
        todo = materialise(todo.join(met.hint("merge"), "segment", "left_anti"), "mask-segments")
        if todo.isEmpty():
            break
        hidden[-1] = hidden[-1].join(todo.select("segment").hint("merge"), "segment", "left_anti")
        tries = tries * 4
    return functools.reduce(DataFrame.unionByName, hidden)


def _first_runs(seg: DataFrame, obs: DataFrame, lengths: list[tuple[int, int]], seed: str | int, slot: str) -> DataFrame:
    """Readings (segment, _target, slot) that the candidates 1 ... _tries hide before the target is met."""
    from pyspark.sql import Window as W

    blocks = seg.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_tries") - 1) / 1024))).alias("_b"))
    cand = blocks.select("*", F.explode(F.sequence(F.col("_b") * 1024 + 1, F.least(F.col("_tries"), F.col("_b") * 1024 + 1024))).alias("_i"))
    cand = cand.withColumn("_md5", draw_key(seed, "segment", "_i"))
    pick = F.pmod(hex_number(F.col("_md5")), F.lit(sum(n for _, n in lengths)))
    length, upto = F.lit(lengths[-1][0]), sum(n for _, n in lengths)
    for size, n in reversed(lengths):
        length = F.when(F.col("_pick") < upto, size).otherwise(length)
        upto -= n
    cand = cand.withColumn("_pick", pick).withColumn("_len", length)
    start = F.pmod(hex_number(F.substring("_md5", 9, 8)), F.greatest(F.lit(1), F.col("_n") - F.col("_len")))
    spans = cand.select("segment", "_target", "_i", F.explode(F.sequence(
        F.col("_a") + start, F.col("_a") + F.least(start + F.col("_len"), F.col("_n")) - 1)).alias(slot))
    first = obs.join(spans.groupBy("segment", "_target", slot).agg(F.min("_i").alias("_i")).hint("merge"), ["segment", slot])
    # a reading's rank counts the readings of all earlier candidates of its segment
    return first.withColumn("_before", F.rank().over(W.partitionBy("segment").orderBy("_i")) - 1).where("_before < _target").select("segment", "_target", slot)


def stratified_draw(units: DataFrame, strata: Sequence[str], share: float, seed: str | int, unit: str = "pid") -> DataFrame:
    """`share` of every stratum, rounded half up."""
    u = draw_order(units.withColumn("_md5", draw_key(seed, unit)), strata, "_md5")
    return u.where(F.col("draw_rank") <= F.floor(F.col("draw_rank_total") * share + 0.5)).drop("_md5", "draw_rank", "draw_rank_total")


def nested_draw(units: DataFrame, strata: Sequence[str], test_share: float, held_share: float, seed: str | int, unit: str = "pid") -> DataFrame:
    """Units labelled test, held (drawn from the rest) or train; the three never overlap."""
    test = stratified_draw(units, strata, test_share, f"{seed}-test", unit).select(unit).withColumn("_t", F.lit(1))
    rest = units.join(test, unit, "left_anti")
    held = stratified_draw(rest, strata, held_share, f"{seed}-held", unit).select(unit).withColumn("_h", F.lit(1))
    return units.join(test, unit, "left").join(held, unit, "left").withColumn(
        "part", F.when(F.col("_t") == 1, "test").when(F.col("_h") == 1, "held").otherwise("train")).drop("_t", "_h")


def folds(units: DataFrame, label: str, k: int, seed: str | int, repeats: int = 1, unit: str = "pid") -> DataFrame:
    """Stratified fold 0 … k-1 of every unit for each repeat."""
    r = units.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    r = r.withColumn("_md5", draw_key(seed, "repeat", unit))
    out = draw_order(r, ["repeat", label], "_md5")
    return out.withColumn("fold", ((F.col("draw_rank") - 1) % k).cast("int")).drop("_md5", "draw_rank", "draw_rank_total")


def small_subset(rows: DataFrame, label: str, n: int, seed: str | int, unit: Sequence[str]) -> DataFrame:
    """At most n rows: every positive is kept up to half of them, the rest are other rows.

    Rows beyond the positives' quota compete with the negatives' only through
    the remainder, as sizes come from the label counts alone.
    """
    r = draw_order(rows.withColumn("_md5", draw_key(seed, *unit)), [label], "_md5")
    pos = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    quota = F.least(pos.select("p").scalar(), F.lit(n // 2))
    room = F.when(pos.select("n").scalar() <= n, F.lit(1 << 60)).otherwise(F.when(F.col(label) == 1, quota).otherwise(F.lit(n) - quota))
    return r.where(F.col("draw_rank") <= room).drop("_md5", "draw_rank", "draw_rank_total")


def training_pairs(train: DataFrame, series: str, slot: str, horizons: int, pairs: int, seed: str | int, min_history: int = 0,
                   target: str = "hrv") -> DataFrame:
    """(origin, h) pairs inside the train part whose target slot holds a real reading; `pairs` per series."""
    span = train.groupBy(series).agg(F.min(slot).alias("_a"), F.max(slot).alias("_b"))
    origins = train.join(span, series).where(F.col(slot) - F.col("_a") >= min_history)
    p = origins.select(series, F.col(slot).alias("origin"), "_b", F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("h"))
    p = p.where(F.col("origin") + F.col("h") <= F.col("_b")).drop("_b")
    real = train.where(F.col(target).isNotNull()).select(series, F.col(slot).alias("_t"), F.col(target).alias("target"))
    p = p.withColumn("_t", F.col("origin") + F.col("h")).join(real, [series, "_t"])
    p = draw_order(p.withColumn("_md5", draw_key(seed, series, "origin", "h")), [series], "_md5", digits=1)
    return p.where(F.col("draw_rank") <= pairs).select(series, "origin", "h", "target")


def sample_rows(rows: DataFrame, n: int, seed: str | int, unit: Sequence[str]) -> DataFrame:
    """A reproducible sample of at most n rows (a top-n per task, merged)."""
    return rows.withColumn("_md5", draw_key(seed, *unit)).orderBy("_md5", *unit).limit(n).drop("_md5")
