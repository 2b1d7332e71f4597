"""Readings and intervals to minute tables, slot grids and daily roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.core import epoch_seconds, floor_div, on_axis, slot_of, slot_start


def minute_means(points: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean of the point readings in each minute (minute number since 1970)."""
    return points.groupBy(*keys, slot_of(ts, 60).alias("minute")).agg(
        F.avg(value).alias(value), F.count(value).alias("n"))


def merge_duplicates(intervals: DataFrame, keys: Sequence[str], start: str, sums: Sequence[str] = (),
                     maxima: Sequence[str] = ()) -> DataFrame:
    """Intervals of one signal that start together: some values add (all blank gives 0),
    others take the largest (all blank stays blank)."""
    return intervals.groupBy(*keys, start).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def covered_minutes(intervals: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end",
                    width_s: int = 60) -> DataFrame:
    """Distinct slots that any interval touches, both ends included.

    Intervals are cut by day first, then into slots, so one long interval is
    shared between tasks before it grows.
    """
    a, b = slot_of(start, width_s), slot_of(end, width_s)
    per_day = max(1, 86400 // width_s)
    days = intervals.where(F.col(start) <= F.col(end)).select(*keys, a.alias("_a"), b.alias("_b")).distinct().select(
        "*", F.explode(F.sequence(floor_div("_a", per_day), floor_div("_b", per_day))).alias("_day"))
    return days.select(*keys, F.explode(F.sequence(
        F.greatest(F.col("_a"), F.col("_day") * per_day), F.least(F.col("_b"), F.col("_day") * per_day + (per_day - 1)),
    )).alias("slot")).distinct()


def widen(points: DataFrame, keys: Sequence[str], ts: str, vitals: Sequence[str], *, width_s: int = 60,
          vital: str = "vital", value: str = "value", counts: Sequence[str] = ()) -> DataFrame:
    """Full outer join of all signals on (keys, slot), done as one aggregation:
    one shuffle however many signals there are."""
    return points.groupBy(*keys, slot_of(ts, width_s).alias("slot")).agg(
        *[F.avg(F.when(F.col(vital) == v, F.col(value))).alias(v) for v in vitals],
        *[F.count(F.when(F.col(vital) == v, F.col(value))).alias(f"{v}_n") for v in counts])


def outer_join_signals(signals: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The same as chained full outer joins, for signals already held in separate tables."""
    out = signals[0]
    for s in signals[1:]:
        out = out.join(s, [*keys], "full_outer")
    return out


def dense(table: DataFrame, keys: Sequence[str], slot: str = "slot", also: DataFrame | None = None) -> DataFrame:
    """Every slot of each key from first to last; slots without a row hold nulls.

    `also` (keys, slot) widens the span, for flag minutes outside the readings.
    """
    span = table.select(*keys, slot) if also is None else table.select(*keys, slot).unionByName(also.select(*keys, slot))
    ends = span.groupBy(*keys).agg(F.min(slot).alias("_a"), F.max(slot).alias("_b"))
    return on_axis(ends, table, keys, "_a", "_b", slot)


def sparse_minutes(points: DataFrame, intervals: Mapping[str, DataFrame], vitals: Sequence[str],
                   keys: Sequence[str] = ("pid",)) -> DataFrame:
    """Only the minutes that hold a reading or a flag: what the dense hub is made from.

    `intervals` maps a flag name to the intervals that set it. Readings and
    flags meet in one aggregation.
    """
    rows = widen(points, keys, "ts", vitals)
    if not intervals:
        return rows
    flags = None
    for name, iv in intervals.items():
        one = covered_minutes(iv, keys).select(*keys, "slot", *[F.lit(1 if n == name else 0).alias(n) for n in intervals])
        flags = one if flags is None else flags.unionByName(one)
    both = rows.unionByName(flags, allowMissingColumns=True)
    return both.groupBy(*keys, "slot").agg(*[F.max(v).alias(v) for v in vitals],
                                           *[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in intervals])


def minute_table(points: DataFrame, intervals: Mapping[str, DataFrame], vitals: Sequence[str],
                 keys: Sequence[str] = ("pid",)) -> DataFrame:
    """The minute hub: one row for every minute from the first to the last reading or flag."""
    out = dense(sparse_minutes(points, intervals, vitals, keys), keys)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in intervals}) if intervals else out


def slot_grid(points: DataFrame, keys: Sequence[str], ts: str, value: str, width_s: int) -> DataFrame:
    """Gap-free grid of one signal: mean and count per slot, empty slots kept blank."""
    rows = points.groupBy(*keys, slot_of(ts, width_s).alias("slot")).agg(
        F.avg(value).alias("hrv"), F.count(value).alias("hrv_n"))
    return dense(rows, keys).withColumn("hrv_n", F.coalesce("hrv_n", F.lit(0)))


def multi_grid(minutes: DataFrame, keys: Sequence[str], main: str, means: Sequence[str], sums: Sequence[str],
               fractions: Sequence[str], per_slot: int = 10) -> DataFrame:
    """Minutes to slot grid, from the main signal's first slot to its last reading.

    Means, counts, sums that stay blank when all is blank, and shares of
    minutes with a flag. The minutes may be sparse or dense: blank minutes add
    nothing to means and sums, and how many minutes a slot spans follows from
    the bounds, so the per-minute table never has to be expanded.
    """
    span = minutes.groupBy(*keys).agg(
        F.min("slot").alias("_lo"), F.min(F.when(F.col(main).isNotNull(), F.col("slot"))).alias("_first"),
        F.max(F.when(F.col(main).isNotNull(), F.col("slot"))).alias("_hi")).where("_first is not null")
    span = span.select(*keys, "_lo", floor_div("_first", per_slot).alias("_a"), "_hi")
    inside = minutes.join(span, list(keys)).where((F.col("slot") >= F.col("_a") * per_slot) & (F.col("slot") <= F.col("_hi")))
    got = inside.groupBy(*keys, floor_div("slot", per_slot).alias("slot")).agg(
        *[F.avg(m).alias(m) for m in [main, *means]],
        *[F.count(m).alias(f"{m}_n") for m in [main, *means[:1]]],
        *[F.sum(s).alias(s) for s in sums],
        *[F.sum(f).alias(f"_{f}") for f in fractions])
    g = on_axis(span.withColumn("_b", floor_div("_hi", per_slot)), got, keys, "_a", "_b", "slot", keep=["_lo", "_hi"])
    width = (F.least(F.col("slot") * per_slot + (per_slot - 1), F.col("_hi")) - F.greatest(F.col("slot") * per_slot, F.col("_lo")) + 1)
    return g.select(*keys, "slot", main, *means, *[F.coalesce(f"{m}_n", F.lit(0)).alias(f"{m}_n") for m in [main, *means[:1]]], *sums,
                    *[F.coalesce(F.col(f"_{f}") / width, F.lit(0.0)).alias(f"{f}_frac") for f in fractions])


def daily_rollup(grid: DataFrame, keys: Sequence[str], width_s: int, *, value: str = "hrv", n: str = "hrv_n",
                 means: Sequence[str] = (), totals: Sequence[str] = (), fractions: Sequence[str] = ()) -> DataFrame:
    """Per day: median of slot means (a day has few slots), totals with all-blank as 0,
    hours from shares, coverage clipped at one reading per slot. Days without readings go."""
    per_day = 86400 // width_s
    hour = 3600 / width_s
    # an empty slot adds nothing to a day, and a day without readings goes
    told = reduce(lambda a, b: a | b, [*[F.col(c).isNotNull() for c in (value, *means, *totals)], F.col(n) != 0, *[F.col(f) != 0 for f in fractions]])
    return grid.where(told).groupBy(*keys, F.to_date(slot_start("slot", width_s)).alias("date")).agg(
        F.median(value).alias(f"{value}_median"), F.sum(n).alias(n),
        *[F.avg(m).alias(f"{m}_mean") for m in means],
        *[F.coalesce(F.sum(t), F.lit(0.0)).alias(f"{t}_total") for t in totals],
        *[(F.sum(f) / hour).alias(f"{f}_hours") for f in fractions],
    ).withColumn("coverage_pct", 100 * F.least(F.col(n), F.lit(per_day)) / per_day).where(F.col(n) > 0)


def daily_counts(points: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Readings per calendar day, zero days included."""
    per = points.groupBy(*keys, slot_of(ts, 86400).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return dense(per, keys).select(*keys, F.to_date(slot_start("slot", 86400)).alias("date"), F.coalesce("n", F.lit(0)).alias("n"))


def seconds_between(a: str | Column, b: str | Column) -> Column:
    return epoch_seconds(b) - epoch_seconds(a)
