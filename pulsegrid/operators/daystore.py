"""Minute cells per stored day, windows of days, and cohort selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_cells(df: DataFrame, pid: str, ts: str, signals: Sequence[str], gate: str = "hr",
                 low: float = 0, high: float = 300) -> DataFrame:
    """Mean per (subject, day, minute) of every signal, only in minutes whose gate signal is plausible."""
    return df.where(F.col(gate).between(low, high)).groupBy(
        pid, F.to_date(ts).alias("date"), (F.hour(ts) * 60 + F.minute(ts)).alias("minute")
    ).agg(*[F.avg(s).alias(s) for s in signals])


def array_view(cells: DataFrame, pid: str, signal: str, minutes: int = 1440) -> DataFrame:
    """One row per stored day with an array of `minutes` values, null where blank.

    A day holds at most 1,440 cells, so the collected group is bounded.
    """
    got = cells.groupBy(pid, "date").agg(F.map_from_entries(F.collect_list(F.struct("minute", signal))).alias("_m"))
    # the few cells of a day with the blanks between them, rather than a look at the map for every minute
    cell = F.filter(F.array_sort(F.map_entries("_m")), lambda c: c["key"].between(0, minutes - 1))
    blanks = lambda n: F.array_repeat(F.lit(None).cast(cells.schema[signal].dataType), n.cast("int"))
    got = got.select(pid, "date", F.transform(F.array(cell), lambda cs: F.concat(
        F.flatten(F.transform(cs, lambda c, i: F.concat(blanks(c["key"] - F.coalesce(F.get(cs, i - 1)["key"], F.lit(-1)) - 1), F.array(c["value"])))),
        blanks(F.lit(minutes - 1) - F.coalesce(F.get(cs, F.size(cs) - 1)["key"], F.lit(-1))))).alias("_v"))
    return got.select(pid, "date", F.get("_v", F.lit(0)).alias("minutes"))


def select_set(days: DataFrame, cohort: str, cohorts: Sequence, static: DataFrame | None = None, pid: str = "pid") -> DataFrame:
    """Days of the chosen cohorts; with `static`, only of subjects that have static values."""
    out = days.where(F.col(cohort).isin(*cohorts))
    return out if static is None else out.join(static.select(pid), pid, "left_semi")


def day_window(days: DataFrame, width: int, values: Sequence[str], pid: str = "pid", date: str = "date") -> DataFrame:
    """The `width` calendar days ending at each day, oldest first; absent days keep null values.

    Sample days are exploded to (day wanted, offset) and joined on (subject,
    day), so no subject is ever gathered into one task.
    """
    wanted = days.select(pid, F.col(date).alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("back"))
    wanted = wanted.withColumn(date, F.date_sub("sample", F.col("back")))
    got = wanted.join(days.select(pid, date, *values, F.lit(True).alias("_there")).hint("merge"), [pid, date], "left")
    return got.select(pid, "sample", (F.lit(width - 1) - F.col("back")).alias("place"), date,
                      F.coalesce("_there", F.lit(False)).alias("present"), *values)


def day_max(cells: DataFrame, signals: Sequence[str], pid: str = "pid", date: str = "date") -> DataFrame:
    """Largest absolute value of every signal per stored day."""
    return cells.groupBy(pid, date).agg(*[F.max(F.abs(s)).alias(s) for s in signals])


def scales(day_maxima: DataFrame, train: DataFrame, signals: Sequence[str], pid: str = "pid") -> DataFrame:
    """One row: each signal's largest absolute value among the training subjects, 1 if none."""
    top = day_maxima.join(train.select(pid), pid, "left_semi").agg(*[F.max(s).alias(s) for s in signals])
    return top.select(*[F.when(F.col(s) > 0, F.col(s)).otherwise(1.0).alias(s) for s in signals])


def scaled(df: DataFrame, scale: DataFrame, signals: Sequence[str]) -> DataFrame:
    return df.withColumns({s: F.col(s) / scale.select(s).scalar() for s in signals})


def narrow_horizon(days: DataFrame, horizon: int, event: str = "event", date: str = "date", label: str = "label") -> DataFrame:
    """Keep an onset label only if the onset lies within `horizon` days; the samples stay the same."""
    from pulsegrid.functions.dates import id_date

    lead = F.datediff(id_date(F.col(event)), F.col(date))
    keep = (F.col(label) == 1) & F.coalesce(lead <= horizon, F.lit(False))
    return days.withColumns({"lead": lead, label: keep.cast("int"), event: F.when(keep, F.col(event))})
