"""Missing runs, usable segments, blocks, and chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.operators.core import CHUNK, Seen, floor_div, islands, join_null_safe, sweep
from pulsegrid.operators.gapforest import kept_by_gap


def missing_runs(grid: DataFrame, keys: Sequence[str], value: str = "hrv", slot: str = "slot", size: int = CHUNK) -> DataFrame:
    """Length of the missing run every slot sits in (0 where observed).

    The grid has every slot, so a run's length is the distance between the
    readings around it; a run at an edge ends at the edge of the grid.
    """
    seen = F.col(value).isNotNull()
    out = sweep(grid, keys, slot, size=size, bounds=True, before={"_prev": Seen(seen)}, after={"_next": Seen(seen)})
    run = F.coalesce(F.col("_next.pos"), F.col("pos_max") + 1) - F.coalesce(F.col("_prev.pos"), F.col("pos_min") - 1) - 1
    return out.withColumn("missing_run", F.when(seen, F.lit(0)).otherwise(run).cast("long")).withColumns(
        {"prev_slot": F.col("_prev.pos"), "next_slot": F.col("_next.pos")}).drop("_prev", "_next", "pos_min", "pos_max")


def observed_islands(grid: DataFrame, keys: Sequence[str], longest_gap: Column | int, value: str = "hrv",
                     slot: str = "slot", size: int = CHUNK) -> DataFrame:
    """Observed slots with `a`, the first slot of their stretch.

    A stretch ends where more than `longest_gap` slots in a row are missing.
    Only observed slots are read: the missing ones follow from the positions.
    """
    gap = longest_gap if isinstance(longest_gap, Column) else F.lit(longest_gap)
    obs = grid.where(F.col(value).isNotNull()).select(*keys, slot)
    return islands(obs, keys, slot, gap, "a", size)


def segment_table(grid: DataFrame, keys: Sequence[str], longest_gap: Column | int, min_slots: int, value: str = "hrv",
                  slot: str = "slot", size: int = CHUNK) -> DataFrame:
    """Usable stretches: a first and b last reading, `seen` readings, number k from 0 per key.

    Cut at missing runs longer than `longest_gap`, trimmed to readings, kept
    when at least `min_slots` long. Short pieces take no number.
    """
    parts = observed_islands(grid, keys, longest_gap, value, slot, size).groupBy(*keys, "a").agg(
        F.max(slot).alias("b"), F.count(F.lit(1)).alias("seen"))
    kept = parts.where(F.col("b") - F.col("a") + 1 >= min_slots)
    return sweep(kept, keys, "a", sums={"_k": F.lit(1)}, size=size * min_slots).withColumn("k", F.col("_k") - 1).drop("_k", "_k_total")


def label_segments(grid: DataFrame, segments: DataFrame, keys: Sequence[str], slot: str = "slot", size: int = CHUNK,
                   train_pct: int = 80) -> DataFrame:
    """Every slot with its segment (null outside) and the chronological train/test part inside it.

    Segments are cut into pieces of `size` slots, which makes the range join
    an equi join on (key, piece) and spreads a long segment over many tasks.
    """
    # a segment is named once, not once per slot
    name = F.concat(F.concat_ws("_", *[F.col(c).cast("string") for c in keys]), F.format_string("_s%02d", F.col("k")))
    pieces = segments.select(*keys, "a", "b", "k", F.when(F.col("k").isNotNull(), name).alias("segment"),
                             F.explode(F.sequence(floor_div("a", size), floor_div("b", size))).alias("_pc"))
    g = grid.withColumn("_pc", floor_div(slot, size))
    # a piece may touch several segments; match the one holding the slot
    hit = [g[c] == pieces[c] for c in [*keys, "_pc"]]
    j = g.join(pieces, [*hit, g[slot].between(pieces["a"], pieces["b"])], "left").select(
        *[g[c] for c in grid.columns], pieces["a"], pieces["b"], pieces["k"], pieces["segment"])
    length = F.col("b") - F.col("a") + 1
    return j.withColumn("split", F.when(F.col("k").isNull(), None)
                        .when(F.col(slot) - F.col("a") < F.floor(length * train_pct / 100), "train").otherwise("test"))


def segment_summary(labelled: DataFrame, keys: Sequence[str], hours_per_slot: float, value: str = "hrv", slot: str = "slot") -> DataFrame:
    seen = F.col(value).isNotNull()
    return labelled.where(F.col("segment").isNotNull()).groupBy(*keys, "segment").agg(
        F.min(slot).alias("start_slot"), F.max(slot).alias("end_slot"), (F.count(F.lit(1)) * hours_per_slot).alias("hours"),
        F.count_if(seen).alias("readings"), (100 * (1 - F.avg(seen.cast("double")))).alias("missing_pct"),
        F.count_if(F.col("split") == "train").alias("train_slots"), F.count_if(F.col("split") == "test").alias("test_slots"))


def subject_summary(labelled: DataFrame, keys: Sequence[str], value: str = "hrv") -> DataFrame:
    seen = F.col(value).isNotNull()
    inside = F.col("segment").isNotNull()
    # one segment holds many slots: its first slot alone counts it
    starts = F.count_if(inside & (F.col("slot") == F.col("a")))
    return labelled.groupBy(*keys).agg(
        F.count_if(seen).alias("readings"), F.count(F.lit(1)).alias("slots"), (100 * F.avg(seen.cast("double"))).alias("coverage_pct"),
        starts.alias("segments"), (100 * F.count_if(seen & inside) / F.count_if(seen)).alias("kept_pct"))


def threshold_scan(grid: DataFrame, keys: Sequence[str], candidates: Sequence[int], min_slots: int, value: str = "hrv") -> DataFrame:
    """For each candidate gap: % of readings kept and % missing inside, per key and for all keys.

    All candidates are read off the merge forest of the readings, which is built once.
    The all-keys row has a null key (rollup).
    """
    obs = grid.where(F.col(value).isNotNull())
    per = kept_by_gap(obs, keys, candidates, min_slots)
    seen = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"))
    t = join_null_safe(per, seen, keys, "inner")
    t = t.groupingSets([[F.col("x"), *[F.col(k) for k in keys]], [F.col("x")]], F.col("x"), *[F.col(k) for k in keys]).agg(
        F.sum("slots").alias("slots"), F.sum("kept").alias("kept"), F.sum("seen").alias("seen"))
    return t.select("x", *keys, (100 * F.try_divide("kept", "seen")).alias("kept_pct"),
                    (100 * (1 - F.try_divide("kept", "slots"))).alias("missing_inside_pct"))


def flag_blocks(minutes: DataFrame, keys: Sequence[str], flag: str, slot: str = "slot", size: int = CHUNK) -> DataFrame:
    """Rows inside a flag with `a`, the first slot of their unbroken block.

    Only flagged rows are read; a block starts where the slot before is not one.
    """
    return islands(minutes.where(F.col(flag) == 1), keys, slot, F.lit(0), "a", size)


def number_blocks(blocks: DataFrame, keys: Sequence[str], start: str = "a", size: int = CHUNK) -> DataFrame:
    """Number the blocks of each key from 1 in time order."""
    return sweep(blocks, keys, start, sums={"block": F.lit(1)}, size=size).drop("block_total")


def split_days(daily: DataFrame, keys: Sequence[str], date: str = "date", train_pct: int = 80) -> DataFrame:
    """First floor(80 %) of each subject's reading days train, the rest test.

    One row per calendar day, so a subject's group is bounded by the calendar.
    """
    w = W.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(date)) - 1
    cut = F.floor(F.count(F.lit(1)).over(w) * train_pct / 100)
    return daily.withColumn("split", F.when(place < cut, "train").otherwise("test"))


def practice_forecast(labelled: DataFrame, keys: Sequence[str], slot: str = "slot", value: str = "hrv", *, frac_pct: int = 80,
                      min_train: int = 60, min_val: int = 10) -> DataFrame:
    """Second cut inside each train part: first 80 % learn, the rest validate.

    Series that are too short, or without a reading to validate on, are left out.
    """
    train = labelled.where(F.col("split") == "train")
    first = F.floor((F.col("b") - F.col("a") + 1) * 80 / 100)
    cut = F.floor(first * frac_pct / 100)
    t = train.withColumns({"_n": first, "_cut": cut, "place": F.col(slot) - F.col("a")})
    has = t.where((F.col("place") >= F.col("_cut")) & F.col(value).isNotNull()).select("segment").distinct()
    t = t.where((F.col("_cut") >= min_train) & (F.col("_n") - F.col("_cut") >= min_val)).join(has, "segment", "left_semi")
    return t.withColumn("part", F.when(F.col("place") < F.col("_cut"), "learn").otherwise("validate")).drop("_n", "_cut")


# --------------------------------------------------------------- staged blocks
def block_stages(minutes: DataFrame, keys: Sequence[str], stages: Sequence[str], value: str, start: str = "a") -> DataFrame:
    """Per block: stage minutes, readings, their mean, length, and stage shares; blocks without stages go."""
    b = minutes.groupBy(*keys, start).agg(
        *[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in stages], F.count(value).alias(f"n_{value}"), F.avg(value).alias(value),
        F.count(F.lit(1)).alias("minutes"))
    total = sum((F.col(s) for s in stages[1:]), F.col(stages[0]))
    b = b.withColumn("scored", total).where("scored > 0")
    return b.withColumns({f"{s}_pct": 100 * F.col(s) / F.col("scored") for s in stages})


def stage_shares(blocks: DataFrame, pid: str, stages: Sequence[str]) -> DataFrame:
    """Share of each stage per subject and, with a null subject, over all."""
    t = blocks.rollup(pid).agg(*[F.sum(s).alias(s) for s in stages], F.sum("scored").alias("scored"))
    return t.select(pid, *[(100 * F.col(s) / F.col("scored")).alias(f"{s}_pct") for s in stages])


def dominant_contrast(blocks: DataFrame, pid: str, stages: Sequence[str], value: str, min_pct: float, min_readings: int) -> DataFrame:
    """Median value in blocks dominated by each of two stages, for subjects that have both."""
    from pulsegrid.operators.core import exact_quantiles

    name = F.lit(None).cast("string")
    for s in reversed(stages):
        name = F.when(F.col(f"{s}_pct") >= min_pct, s).otherwise(name)
    d = blocks.where(F.col(f"n_{value}") >= min_readings).withColumn("dominant", name).where("dominant is not null")
    m = exact_quantiles(d, [pid, "dominant"], value, {"m": 0.5})
    wide = m.groupBy(pid).pivot("dominant", list(stages)).agg(F.first("m")).dropna(subset=list(stages))
    return wide.withColumn("diff", F.col(stages[0]) - F.col(stages[1]))
