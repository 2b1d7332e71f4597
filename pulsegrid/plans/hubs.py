"""The shared hub tables built from the benchmark events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.operators import segments, timeline
from pulsegrid.sources.stage import materialise

SLOT = 21600
LONGEST_GAP = 2
MIN_SLOTS = 4


def main_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour grid of every user's values."""
    from pulsegrid.catalog.standins import readings

    return timeline.slot_grid(readings(spark, sf), ["pid"], "ts", "value", SLOT)


def grid_table(spark: SparkSession, sf: str) -> DataFrame:
    """The grid as a stored table: the operators after it read it several times."""
    return materialise(main_grid(spark, sf), "grid")


def segment_hub(grid: DataFrame, keys=("pid",), longest_gap: int = LONGEST_GAP, min_slots: int = MIN_SLOTS) -> DataFrame:
    """A stored grid to missing runs, segments and the chronological split."""
    keys = list(keys)
    return segments.label_segments(segments.missing_runs(grid, keys), segments.segment_table(grid, keys, longest_gap, min_slots), keys)


def main_segments(spark: SparkSession, sf: str) -> DataFrame:
    return segment_hub(grid_table(spark, sf))


def segment_table(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled grid as a stored table."""
    return materialise(main_segments(spark, sf), "segments")
