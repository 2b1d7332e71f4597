"""Feature tables of the tree fillers, forecasters and day classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.dates import phase
from pulsegrid.functions.scaling import log_stats, to_z
from pulsegrid.operators import fills, sampling
from pulsegrid.operators.baselines import over_horizon
from pulsegrid.sources.stage import materialise

BLANK = -1e6
"""Stands for a missing feature: lower than any reading, which is how the trees then treat it."""


def hidden(labelled: DataFrame, masked: DataFrame, value: str = "hrv") -> DataFrame:
    """Slots inside segments with the truth kept and the masked readings blanked in `visible`."""
    # a stored mask packs well: merged, as its size on disk would have it broadcast
    m = masked.select("segment", "slot", F.lit(1).alias("_m")).hint("merge")
    t = labelled.where(F.col("segment").isNotNull()).join(m, ["segment", "slot"], "left")
    scored = F.col("_m").isNotNull()
    return t.withColumn("scored", scored).withColumn("visible", F.when(~scored, F.col(value))).drop("_m")


def fill_features(rows: DataFrame, k: int, period: int, pid: str = "pid", drop: Sequence[str] = (), covs: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """z-scored log value of the visible readings, its neighbours, nearest readings, daily phase and other signals.

    `rows` must be a stored table. Returns the table and the feature names.
    """
    each, every = log_stats(rows, pid, "visible")
    z = materialise(to_z(rows, each, every, pid, "visible"), "z")
    near = fills.nearest(z, ["segment"], value="z")
    lagged = fills.lags_leads(near, ["segment"], k, value="z")
    s, c = phase(F.pmod(F.col("slot"), F.lit(period)), period)
    out = lagged.withColumns({"sin": s, "cos": c})
    names = [f"{d}{i}" for d in ("lag", "lead") for i in range(1, k + 1)] + ["prev", "dprev", "next", "dnext", "sin", "cos", *covs]
    names = [n for n in names if n not in drop]
    return out.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(BLANK)) for n in names}), names


def forecast_features(rows: DataFrame, k: int, period: int, value: str = "z_filled", series: str = "segment", covs: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """What is known at each origin: the last k values, the last cycle's mean and sd, the phase now, other signals now."""
    lagged = fills.lags_leads(rows, [series], k - 1, value=value) if k > 1 else rows
    t = fills.trailing_stats(lagged, [series], period, value=value)
    s, c = phase(F.pmod(F.col("slot"), F.lit(period)), period)
    names = ["lag0", *[f"lag{i}" for i in range(1, k)], "mean_cycle", "sd_cycle", "sin_now", "cos_now", *covs]
    return t.withColumns({"lag0": F.col(value), "sin_now": s, "cos_now": c}), names


def at_horizon(origins: DataFrame, period: int, slot: str = "origin") -> tuple[DataFrame, list[str]]:
    s, c = phase(F.pmod(F.col(slot) + F.col("h"), F.lit(period)), period)
    return origins.withColumns({"sin_target": s, "cos_target": c}), ["h", "sin_target", "cos_target"]


def training_rows(train: DataFrame, feats: DataFrame, names: Sequence[str], horizons: int, pairs: int, period: int, seed, series: str = "segment",
                  target: str = "z") -> tuple[DataFrame, list[str]]:
    """Sampled (origin, h) pairs with the origin's features and the target's phase."""
    history = sum(n.startswith("lag") for n in names) - 1
    p = sampling.training_pairs(train, series, "slot", horizons, pairs, seed, min_history=history, target=target)
    p, extra = at_horizon(p, period)
    j = p.join(feats.select(series, F.col("slot").alias("origin"), *names), [series, "origin"])
    every = [*names, *extra]
    return j.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(BLANK)) for n in every}), every


def test_rows(feats: DataFrame, names: Sequence[str], period: int, horizon: int, series: str = "segment") -> tuple[DataFrame, list[str]]:
    """One row per series and step ahead of its last train slot."""
    last = feats.groupBy(series).agg(F.max_by(F.struct("slot", "_m", "_s", *names), "slot").alias("_o"))
    o = last.select(series, F.col("_o.slot").alias("origin"), *[F.col(f"_o.{n}").alias(n) for n in ["_m", "_s", *names]])
    h, extra = at_horizon(over_horizon(o, horizon), period)
    every = [*names, *extra]
    return h.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(BLANK)) for n in every}), every


def day_window_vector(minutes: DataFrame, days: DataFrame, width: int, block: int, signals: Sequence[str], pid: str = "pid", date: str = "date") -> DataFrame:
    """Per sample day one array `x`: block means of the `width` days ending with it, then their presence flags.

    Minutes are merged to `block`-minute means before the window join, and a
    day travels as one array, so the plan stays small at any block size (1 is
    every raw minute). A collected group is one day's cells or `width` days.
    """
    blocks = 1440 // block
    n = blocks * len(signals)
    place = F.floor(F.col("minute") / block).cast("int")
    cells = minutes.groupBy(pid, date, place.alias("_b")).agg(*[F.avg(s).alias(s) for s in signals])
    pairs = cells.select(pid, date, F.explode(F.array(*[
        F.struct((F.lit(i * blocks) + F.col("_b")).alias("at"), F.col(s).alias("v")) for i, s in enumerate(signals)])).alias("_c")).where("_c.v is not null")
    per_day = pairs.groupBy(pid, date).agg(F.map_from_entries(F.collect_list("_c")).alias("_m"))
    back = days.select(pid, F.col(date).alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_k"))
    j = back.withColumn(date, F.date_sub("sample", F.col("_k"))).join(per_day, [pid, date])
    w = j.groupBy(pid, "sample").agg(F.map_from_entries(F.collect_list(F.struct((F.lit(width - 1) - F.col("_k")).alias("d"), F.col("_m").alias("m")))).alias("_w"))
    flat = F.sequence(F.lit(0), F.lit(width * n - 1))

    def value(i):
        return F.try_element_at(F.try_element_at(F.col("_w"), F.floor(i / n).cast("int")), F.pmod(i, F.lit(n)).cast("int"))

    w = w.select(pid, F.col("sample").alias(date), F.transform(flat, value).alias("_v"))
    return w.select(pid, date, F.concat(
        F.transform("_v", lambda v: F.coalesce(v, F.lit(BLANK))), F.transform("_v", lambda v: v.isNotNull().cast("double"))).alias("x"))
