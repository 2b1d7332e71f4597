"""Hub roll-ups on a stream of readings; on-time data gives the batch result.

Rows later than the watermark are dropped. State is held per open window and
subject and ends with the watermark, so it does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _clocked(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermarks want zoned timestamps: naive ones are read in the session zone, which should be UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _naive(c: str, name: str):
    return F.col(c).cast("timestamp_ntz").alias(name)


def slot_grid(readings: DataFrame, keys: Sequence[str], ts: str, value: str, width_s: int, late: str = "1 hour") -> DataFrame:
    """Mean and count per tumbling slot: the observed rows of the batch grid."""
    w = F.window(ts, f"{width_s} seconds")
    return _clocked(readings, ts, late).groupBy(*keys, w.alias("_w")).agg(
        F.avg(value).alias("hrv"), F.count(value).alias("hrv_n")).select(*keys, _naive("_w.start", "slot_start"), "hrv", "hrv_n")


def merged_intervals(intervals: DataFrame, keys: Sequence[str], start: str, sums: Sequence[str], maxima: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Intervals that start together, merged as in batch; a start is an event-time key, so its state expires."""
    return _clocked(intervals, start, late).groupBy(*keys, start).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima],
    ).select(*keys, _naive(start, start), *sums, *maxima)


def blocks(flagged: DataFrame, keys: Sequence[str], ts: str, gap: str = "1 minute 1 second", late: str = "1 hour") -> DataFrame:
    """Unbroken stretches of flagged minutes as session windows."""
    return _clocked(flagged, ts, late).groupBy(*keys, F.session_window(ts, gap).alias("_w")).agg(
        F.min(ts).alias("first_minute"), F.count(F.lit(1)).alias("minutes")).select(*keys, _naive("first_minute", "first_minute"), "minutes")
