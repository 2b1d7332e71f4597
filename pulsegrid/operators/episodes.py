"""Readings and days against dated episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.core import interval_days


def event_day_flag(rows: DataFrame, events: DataFrame, date: str = "date", pid: str = "pid", flag: str = "event_day") -> DataFrame:
    """1 on the days a subject has an event."""
    days = events.select(pid, date).distinct().withColumn("_hit", F.lit(1))
    return rows.join(days, [pid, date], "left").withColumn(flag, F.coalesce("_hit", F.lit(0))).drop("_hit")


def episode_of_day(days: DataFrame, episodes: DataFrame, order: str = "ordinal", pid: str = "pid", date: str = "date") -> DataFrame:
    """The episode a day lies in; where episodes overlap the first listed one wins.

    Episodes are cut into days, which turns the range join into an equi join
    on (subject, day).
    """
    cut = interval_days(episodes, F.col("start"), F.col("end"), date).groupBy(pid, date).agg(
        F.min_by("episode", F.struct(F.col(order))).alias("episode"))
    return days.join(cut, [pid, date], "left")


def next_onset(days: DataFrame, episodes: DataFrame, horizon: int, pid: str = "pid", date: str = "date") -> DataFrame:
    """Nearest onset within 1 … horizon days after each day, and its episode.

    Every onset is handed to the `horizon` days before it; starts are unique per subject.
    """
    starts = episodes.groupBy(pid, "start").agg(F.min("episode").alias("onset_id"))
    ahead = starts.select(pid, "start", "onset_id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"))
    near = ahead.withColumn(date, F.date_sub("start", F.col("_h"))).groupBy(pid, date).agg(F.min_by("onset_id", "start").alias("onset_id"))
    return days.join(near, [pid, date], "left").withColumn("onset_label", F.col("onset_id").isNotNull().cast("int"))


def onset_valid(days: DataFrame, horizon: int, sample: str = "sample", inside: str = "episode", pid: str = "pid", date: str = "date") -> DataFrame:
    """Days usable for onset prediction: a sample, outside episodes, with the whole horizon recorded."""
    last = days.groupBy(pid).agg(F.max(date).alias("last_day"))
    out = days.join(last, pid)
    return out.withColumn("onset_valid", F.col(sample) & F.col(inside).isNull() & (F.col(date) <= F.date_sub("last_day", horizon)))


def around_events(rows: DataFrame, events: DataFrame, before: int, after: int, keep: Sequence[str], pid: str = "pid",
                  date: str = "date", anchor: str = "anchor") -> DataFrame:
    """Rows from `before` days before an event's date to `after` days after it, with the relative day.

    Events are handed to each day of their window, so the join is an equi
    join on (subject, day): a subject with very many rows is spread over days.
    """
    days = events.select(pid, anchor, *[k for k in keep if k in events.columns],
                         F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("rel_day"))
    days = days.withColumn(date, F.date_add(anchor, F.col("rel_day")))
    return days.join(rows, [pid, date])
