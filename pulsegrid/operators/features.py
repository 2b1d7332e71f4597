"""Small table-level feature helpers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(df: DataFrame, signal: str, low: float, high: float) -> DataFrame:
    """Rows whose gate signal is present and plausible."""
    return df.where(F.col(signal).between(low, high))


def half_open(df: DataFrame, day: str, first: int, stop: int) -> DataFrame:
    return df.where((F.col(day) >= first) & (F.col(day) < stop))


def presence_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every column as (value with blanks 0, 0/1 seen)."""
    return df.withColumns({**{f"{c}_seen": F.col(c).isNotNull().cast("int") for c in columns}}).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop columns whose name matches (the reduced feature set)."""
    return df.select(*[c for c in df.columns if not re.search(pattern, c)])


def feature_family(name: Column) -> tuple[Column, Column]:
    """(family, lag or lead number) of a model feature."""
    # Plain names of the feature families.
    step = F.regexp_extract(name, r"^(?:lag|lead)(\d+)$", 1)
    family = (F.when(step != "", "neighbours")
              .when(name.isin("prev", "next", "dprev", "dnext"), "nearest reading")
              .when(name.isin("sin", "cos"), "time of day")
              .when(name.isin("hr", "temp", "spo2", "steps"), "other signals")
              .when(name.isin("mean_day", "sd_day"), "last day")
              .when(name == "h", "horizon"))
    return family, F.when(step != "", step.cast("int"))


def longest_day_gap(observed: DataFrame, day_keys: Sequence[str], minute: str, days: DataFrame | None = None, minutes: int = 1440) -> DataFrame:
    """Longest stretch of a day without a reading, counted from both day edges.

    Minutes are made distinct first, so a day has at most `minutes` rows.
    """
    from pyspark.sql import Window as W

    seen = observed.select(*day_keys, F.col(minute).cast("int").alias("_m")).distinct()
    edges = (seen if days is None else days).select(*day_keys).distinct().withColumn("_m", F.explode(F.array(F.lit(-1), F.lit(minutes))))
    w = W.partitionBy(*day_keys).orderBy("_m")
    steps = seen.unionByName(edges).withColumn("_d", F.col("_m") - F.lag("_m").over(w))
    return steps.groupBy(*day_keys).agg((F.max("_d") - 1).alias("longest_gap"))
