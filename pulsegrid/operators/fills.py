"""Nearest readings, straight-line fills, lags, decays and blends on a gap-free slot axis."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.operators.core import CHUNK, Seen, drop_halo, floor_div, join_null_safe, sweep, with_halo


def reading_gaps(readings: DataFrame, keys: Sequence[str], ts: str = "ts", piece_s: int = 6 * 3600) -> DataFrame:
    """Minutes since the subject's previous reading (null at the first).

    Readings are ordered in pieces of `piece_s` seconds; make it shorter where
    a single subject sends very many.
    """
    from pulsegrid.operators.core import slot_of

    out = sweep(readings, keys, ts, before={"_p": Seen(F.col(ts).isNotNull())}, piece=slot_of(ts, piece_s))
    micros = F.timestamp_diff("MICROSECOND", F.col("_p.pos"), F.col(ts))
    return out.withColumn("gap", micros / 60e6).drop("_p")


def nearest(grid: DataFrame, keys: Sequence[str], value: str = "hrv", slot: str = "slot", size: int = CHUNK) -> DataFrame:
    """Value of, and distance to, the nearest real reading strictly before and after each slot."""
    seen = F.col(value).isNotNull()
    out = sweep(grid, keys, slot, size=size, before={"_b": Seen(seen, (value,))}, after={"_f": Seen(seen, (value,))})
    return out.withColumns({
        "prev": F.col(f"_b.{value}"), "dprev": F.col(slot) - F.col("_b.pos"),
        "next": F.col(f"_f.{value}"), "dnext": F.col("_f.pos") - F.col(slot)}).drop("_b", "_f")


def capped_distances(near: DataFrame, cap: int = 1000) -> DataFrame:
    """Slots since the last and until the next reading, capped; none at all counts as the cap."""
    far = F.lit(cap)
    return near.withColumns({"since": F.least(F.coalesce("dprev", far), far), "until": F.least(F.coalesce("dnext", far), far)})


def straight_line(near: DataFrame, value: str = "hrv", out: str = "filled") -> DataFrame:
    """Blanks on the line between the readings around them, flat at both ends."""
    line = F.col("prev") + (F.col("next") - F.col("prev")) * F.col("dprev") / (F.col("dprev") + F.col("dnext"))
    return near.withColumn(out, F.coalesce(value, line, "prev", "next"))


def blend_two_sided(near: DataFrame, forward: str = "prev", backward: str = "next", *, how: str = "position",
                    out: str = "blend") -> DataFrame:
    """Forward and backward fill weighted by place in the missing run or by inverse distance."""
    if how == "position":
        w = F.col("dprev") / (F.col("dprev") + F.col("dnext"))  # (i + 1) / (L + 1)
    else:
        w = (1 / F.col("dnext")) / (1 / F.col("dprev") + 1 / F.col("dnext"))
    both = (1 - w) * F.col(forward) + w * F.col(backward)
    return near.withColumn(out, F.coalesce(both, F.col(forward), F.col(backward)))


def lags_leads(grid: DataFrame, keys: Sequence[str], k: int, value: str = "hrv", slot: str = "slot", size: int = CHUNK) -> DataFrame:
    """K values before and after each slot, with the neighbour pieces' rows copied in."""
    h, own, part = with_halo(grid, keys, slot, back=k, ahead=k, size=size)
    w = W.partitionBy(*part).orderBy(slot)
    return drop_halo(h.select(
        "*", *[F.lag(value, i).over(w).alias(f"lag{i}") for i in range(1, k + 1)],
        *[F.lead(value, i).over(w).alias(f"lead{i}") for i in range(1, k + 1)]), own)


def trailing_stats(grid: DataFrame, keys: Sequence[str], width: int, value: str = "hrv", slot: str = "slot", size: int = CHUNK) -> DataFrame:
    """Mean and population sd of the last `width` slots at each slot."""
    h, own, part = with_halo(grid, keys, slot, back=width - 1, size=size)
    w = W.partitionBy(*part).orderBy(slot).rangeBetween(-(width - 1), 0)
    return drop_halo(h.select("*", F.avg(value).over(w).alias("mean_cycle"), F.stddev_pop(value).over(w).alias("sd_cycle")), own)


def rolling_total(daily: DataFrame, keys: Sequence[str], width: int, n: str = "n", slot: str = "slot", size: int = CHUNK) -> DataFrame:
    h, own, part = with_halo(daily, keys, slot, back=width - 1, size=size)
    w = W.partitionBy(*part).orderBy(slot).rangeBetween(-(width - 1), 0)
    return drop_halo(h.withColumn("rolling", F.sum(n).over(w)), own)


def fullest_window(rolled: DataFrame, keys: Sequence[str], slot: str = "slot") -> DataFrame:
    """End of the window with the most readings; the earliest on ties."""
    best = rolled.groupBy(*keys).agg(F.max(F.struct("rolling", (-F.col(slot)).alias("_neg"))).alias("_b"))
    return best.select(*keys, F.col("_b.rolling").alias("rolling"), (-F.col("_b._neg")).alias("end_slot"))


def consecutive_pairs(grid: DataFrame, keys: Sequence[str], max_gap: int, value: str = "hrv", slot: str = "slot", size: int = CHUNK) -> DataFrame:
    """Each reading with the next one, if at most `max_gap` slots apart."""
    obs = grid.where(F.col(value).isNotNull())
    p = sweep(obs, keys, slot, size=size, after={"_n": Seen(F.lit(True), (value,))})
    return p.withColumns({"next_value": F.col(f"_n.{value}"), "gap": F.col("_n.pos") - F.col(slot)}).drop("_n").where(F.col("gap") <= max_gap)


# ------------------------------------------------------------ within one day
def since_last(tokens: DataFrame, day_keys: Sequence[str], minute: str, signals: Sequence[str]) -> DataFrame:
    """At each token minute: minutes since every signal's last reading (itself counts), or
    since before the window's start if there is none; and minutes since the previous token.

    A window is one day, at most 1,440 tokens, so it is ordered in one piece.
    """
    w = W.partitionBy(*day_keys).orderBy(minute)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    last = lambda s: F.last(F.when(F.col(s).isNotNull(), F.col(minute)), ignorenulls=True).over(upto)
    return tokens.select(
        "*", *[F.coalesce(F.col(minute) - last(s), F.col(minute) + 1).alias(f"{s}_since") for s in signals],
        (F.col(minute) - F.coalesce(F.lag(minute).over(w), F.lit(-1))).alias("elapsed"))


def hourly_state(tokens: DataFrame, day_keys: Sequence[str], minute: str, value: str, rate: float, hours: int = 24) -> DataFrame:
    """Carried state at the end of every hour: each reading fades by exp(-rate per minute); null before the first.

    Readings are first summed per hour (faded to the hour's last minute); a day
    then holds at most `hours` sums, which are folded hour by hour.
    """
    hour = floor_div(minute, 60)
    to_end = hour * 60 + 59 - F.col(minute)
    per = tokens.groupBy(*day_keys, hour.alias("hour")).agg(F.sum(F.col(value) * F.exp(-rate * to_end)).alias("_add"))
    days = per.groupBy(*day_keys).agg(F.map_from_entries(F.collect_list(F.struct("hour", "_add"))).alias("_adds"))
    fade = F.lit(math.exp(-60.0 * rate))  # at most 1, however fast a reading fades

    def state(h: Column) -> Column:
        def step(before: Column, j: Column) -> Column:
            here = F.try_element_at("_adds", j)
            return F.coalesce(before * fade + F.coalesce(here, F.lit(0.0)), here)

        return F.aggregate(F.sequence(F.lit(0).cast("long"), h), F.lit(None).cast("double"), step)

    states = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(hours - 1).cast("long")), lambda h: F.struct(h.alias("hour"), state(h).alias("state")))
    return days.select(*day_keys, F.explode(states).alias("_s")).select(*day_keys, "_s.hour", "_s.state")


# --------------------------------------------------------- decay on any span
REACH = 745.0
"""Exponent at which a double weight becomes zero."""

GROWTH = 30.0
"""Exponent up to which weights are grown inside a piece."""


def decayed_before(ends: DataFrame, keys: Sequence[str], part: str, step: float, sums: Sequence[str]) -> DataFrame:
    """Add `<sum>_before`: the sums of all earlier parts, faded by `step` a part, as they stand at the end of the part before.

    A prefix of (factor, sums) pairs, which compose: (f, s) then (g, t) is (fg, sg + t). Parts are scanned in groups
    short enough for their weights to stay finite; the groups' own ends go through the same scan one level up, until a
    part fades so far that a few dozen before it are all that counts. No window holds all parts of a key.
    """
    width = min(CHUNK, int(GROWTH / step))
    fresh = [f"{s}_before" for s in sums]
    if width < 2:
        back = int(REACH / step) + 1
        h, own, group = with_halo(ends, keys, part, back=back)
        w = W.partitionBy(*group).orderBy(part).rangeBetween(-back, -1)
        h = h.withColumn("_past", F.collect_list(F.struct(F.col(part).alias("at"), *sums)).over(w)).where(own)  # at most `back` rows

        def faded(s: str) -> Column:
            return F.aggregate("_past", F.lit(0.0), lambda a, x: a + x[s] * F.exp(-step * (F.col(part) - 1 - x["at"])))

        return h.select(*ends.columns, *[faded(s).alias(n) for s, n in zip(sums, fresh, strict=True)])
    up = f"{part}_up"
    rows = ends.withColumn(up, floor_div(part, width))
    place = F.col(part) - F.col(up) * width
    tops = rows.groupBy(*keys, up).agg(*[F.sum(F.col(s) * F.exp(-step * (width - 1 - place))).alias(s) for s in sums])
    tops = decayed_before(tops, keys, up, step * width, sums).select(*keys, up, *[F.col(n).alias(f"{n}_up") for n in fresh])
    earlier = W.partitionBy(*keys, up).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(F.col(s) * F.exp(step * place)).over(earlier), F.lit(0.0)) * F.exp(-step * (place - 1)) for s, n in zip(sums, fresh, strict=True)})
    return join_null_safe(rows, tops, [*keys, up], "inner").select(*ends.columns, *[(F.col(n) + F.col(f"{n}_up") * F.exp(-step * place)).alias(n) for n in fresh])


def decayed_average(grid: DataFrame, keys: Sequence[str], rate: float, value: str = "hrv", slot: str = "slot",
                    eps: float = 1e-6) -> DataFrame:
    """Time-decayed mean of the real readings up to each slot, and the decayed count.

    Weights are exp(-rate * slots ago), for any rate above zero. They are grown from the start of a
    piece that is short enough not to overflow; earlier pieces come in through `decayed_before`.
    """
    size = max(1, min(CHUNK, int(GROWTH / rate)))
    seen = F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)
    x = F.coalesce(F.col(value), F.lit(0.0))
    df = grid.withColumn("_part", floor_div(slot, size))
    place = F.col(slot) - F.col("_part") * size
    to_end = F.exp(-rate * (size - 1 - place))
    ends = df.groupBy(*keys, "_part").agg(F.sum(x * to_end).alias("_num"), F.sum(seen * to_end).alias("_den"))
    ends = decayed_before(ends, keys, "_part", rate * size, ["_num", "_den"]).select(*keys, "_part", "_num_before", "_den_before")
    w = W.partitionBy(*keys, "_part").orderBy(slot).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({"_n": F.sum(x * F.exp(rate * place)).over(w), "_d": F.sum(seen * F.exp(rate * place)).over(w)})
    j = join_null_safe(local, ends, [*keys, "_part"], "inner")
    num = F.col("_n") * F.exp(-rate * place) + F.col("_num_before") * F.exp(-rate * (place + 1))
    den = F.col("_d") * F.exp(-rate * place) + F.col("_den_before") * F.exp(-rate * (place + 1))
    return j.select(*grid.columns, (num / (den + eps)).alias("decayed_mean"), F.log1p(den).alias("decayed_count"))
