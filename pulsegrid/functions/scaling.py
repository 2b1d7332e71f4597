"""Standardising, elapsed-time features and plausibility flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_stats(df: DataFrame, pid: str, value: str, floor: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(per subject, over all): mean and sample sd of the log value; a single reading has sd 1."""
    x = F.ln(F.when(F.col(value) > 0, F.col(value)))
    seen = df.where(x.isNotNull()).select(pid, x.alias("_x"))
    each = seen.groupBy(pid).agg(F.avg("_x").alias("log_mean"),
                                 F.greatest(F.coalesce(F.stddev_samp("_x"), F.lit(1.0)), F.lit(floor)).alias("log_sd"))
    every = seen.agg(F.avg("_x").alias("log_mean"), F.greatest(F.coalesce(F.stddev_samp("_x"), F.lit(1.0)), F.lit(floor)).alias("log_sd"))
    return each, every


def to_z(df: DataFrame, stats: DataFrame, overall: DataFrame, pid: str, value: str, out: str = "z") -> DataFrame:
    """Log value in subject units; a subject without stats uses the overall ones.

    The stats table has one row per subject: Spark broadcasts it while it is
    small and merges otherwise. Adds `_m` and `_s`, which `from_z` reads.
    """
    j = df.join(stats.withColumnsRenamed({"log_mean": "_m", "log_sd": "_s"}), pid, "left")
    j = j.withColumns({"_m": F.coalesce("_m", overall.select("log_mean").scalar()),
                       "_s": F.coalesce("_s", overall.select("log_sd").scalar())})
    return j.withColumn(out, (F.ln(F.when(F.col(value) > 0, F.col(value))) - F.col("_m")) / F.col("_s"))


def from_z(z: Column) -> Column:
    return F.exp(z * F.col("_s") + F.col("_m"))


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-score over all rows (sample sd; a zero or missing sd counts as 1)."""
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                *[F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in columns])
    return df.withColumns({c: (F.col(c) - st.select(f"m_{c}").scalar()) / st.select(f"s_{c}").scalar() for c in columns})


def capped_log(elapsed: Column, cap: float = 1000, scale: float = 7) -> Column:
    return F.log1p(F.least(elapsed, F.lit(float(cap)))) / scale


def impossible(v: Column, top: float) -> dict[str, Column]:
    """0/1 flags: not finite, not positive, above the device maximum."""
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return {"nonfinite": bad.cast("int"), "nonpositive": (~F.isnan(v) & (v <= 0)).cast("int"),
            "above": (~F.isnan(v) & (v > top)).cast("int")}
