"""Covered time by event differences: intervals are never turned into minutes.

An interval adds one where it begins and takes one away after its end. The running sum of these differences says how many intervals are open between two events; where it is
not 0 the stretch is covered, however many intervals overlap there. The stretches of one key do not overlap, so what a slot holds of them is a plain sum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.core import Seen, floor_div, join_null_safe, on_axis, slot_of, sweep
from pulsegrid.operators.timeline import widen
from pulsegrid.sources.stage import materialise


def stretches(intervals: DataFrame, keys: Sequence[str], first: Column, last: Column) -> DataFrame:
    """(keys, a, b): disjoint stretches of positions that tile what the intervals [first, last] cover, both ends included.

    Overlapping intervals make more than one stretch, cut where one begins or ends. An interval that ends before it begins covers nothing.
    """
    ends = intervals.select(*keys, first.alias("_a"), last.alias("_b")).where("_a <= _b")
    events = ends.select(*keys, F.explode(F.array(F.struct(F.col("_a").alias("at"), F.lit(1).alias("d")), F.struct((F.col("_b") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    net = events.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    net = materialise(net, "event-differences")
    open_ = sweep(net, keys, "at", sums={"open": F.col("d")}, after={"next": Seen(F.lit(True))})
    return open_.where("open > 0").select(*keys, F.col("at").alias("a"), (F.col("next.pos") - 1).alias("b"))


def covered_per_slot(pieces: DataFrame, keys: Sequence[str], per_slot: int, out: str = "covered") -> DataFrame:
    """(keys, slot, covered): positions of each slot that the stretches cover; slots without any are left out."""
    touched = pieces.select(*keys, "a", "b", F.explode(F.sequence(floor_div("a", per_slot), floor_div("b", per_slot))).alias("slot"))
    part = F.least("b", F.col("slot") * per_slot + (per_slot - 1)) - F.greatest("a", F.col("slot") * per_slot) + 1
    return touched.groupBy(*keys, "slot").agg(F.sum(part).alias(out))


def slot_hub(points: DataFrame, intervals: Mapping[str, DataFrame], vitals: Sequence[str], keys: Sequence[str], main: str, means: Sequence[str],
             sums: Sequence[str], per_slot: int = 10, width_s: int = 60) -> DataFrame:
    """The slot grid of `timeline.multi_grid` straight from readings and intervals: no minute table in between.

    From the main signal's first slot to its last reading: means, counts and sums of minute means, and per flag the share of a slot's minutes that its
    intervals cover. A slot's minutes run from the key's first minute with a reading or flag to the last reading of the main signal.
    """
    minutes = materialise(widen(points, keys, "ts", vitals), "minute-means")
    flagged = reduce(DataFrame.unionByName, [iv.select(*keys, F.lit(n).alias("_flag"), "start", "end") for n, iv in intervals.items()])
    covered = materialise(stretches(flagged.where(F.col("start") <= F.col("end")), [*keys, "_flag"], slot_of("start", width_s), slot_of("end", width_s)), "stretches")
    seen = F.col(main).isNotNull()
    ends = minutes.select(*keys, "slot", F.when(seen, F.col("slot")).alias("_s")).unionByName(covered.select(*keys, F.col("a").alias("slot")), allowMissingColumns=True)
    span = ends.groupBy(*keys).agg(F.min("slot").alias("_lo"), F.min("_s").alias("_first"), F.max("_s").alias("_hi")).where("_first is not null")
    span = materialise(span.select(*keys, "_lo", floor_div("_first", per_slot).alias("_a"), "_hi"), "spans")
    inside = join_null_safe(minutes, span, keys, "inner").where((F.col("slot") >= F.col("_a") * per_slot) & (F.col("slot") <= F.col("_hi")))
    cut = join_null_safe(covered, span, keys, "inner").select(*keys, "_flag", F.greatest("a", F.col("_a") * per_slot).alias("a"), F.least("b", "_hi").alias("b")).where("a <= b")
    per_flag = covered_per_slot(cut, [*keys, "_flag"], per_slot)
    rows = inside.select(*keys, floor_div("slot", per_slot).alias("slot"), *vitals).unionByName(per_flag, allowMissingColumns=True)
    counted = [main, *means[:1]]
    got = rows.groupBy(*keys, "slot").agg(
        *[F.avg(m).alias(m) for m in [main, *means]], *[F.count(m).alias(f"{m}_n") for m in counted], *[F.sum(s).alias(s) for s in sums],
        *[F.sum(F.when(F.col("_flag") == n, F.col("covered"))).alias(f"_{n}") for n in intervals])
    grid = on_axis(span.withColumn("_b", floor_div("_hi", per_slot)), got, keys, "_a", "_b", "slot", keep=["_lo", "_hi"], null_safe=True)
    width = F.least(F.col("slot") * per_slot + (per_slot - 1), F.col("_hi")) - F.greatest(F.col("slot") * per_slot, F.col("_lo")) + 1
    return grid.select(*keys, "slot", main, *means, *[F.coalesce(f"{m}_n", F.lit(0)).alias(f"{m}_n") for m in counted], *sums,
                       *[F.coalesce(F.col(f"_{n}") / width, F.lit(0.0)).alias(f"{n}_frac") for n in intervals])
