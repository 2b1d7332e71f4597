"""Reference predictors that need no fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.core import exact_quantiles


def over_horizon(one_per_series: DataFrame, horizon: int | str) -> DataFrame:
    """Every series with every step of its horizon (a number, or a column holding it)."""
    last = F.lit(horizon) if isinstance(horizon, int) else F.col(horizon)
    return one_per_series.withColumn("h", F.explode(F.sequence(F.lit(1), last.cast("int"))))


def last_value(history: DataFrame, series: str, ts: str, value: str, horizon: int) -> DataFrame:
    """The last real reading, carried over the horizon."""
    last = history.where(F.col(value).isNotNull()).groupBy(series).agg(F.max_by(value, ts).alias("pred"))
    return over_horizon(last, horizon)


def subject_median(history: DataFrame, pid: str, value: str, horizon: int) -> DataFrame:
    """The median of everything seen of a subject, carried over the horizon."""
    return over_horizon(exact_quantiles(history, [pid], value, {"pred": 0.5}), horizon)


def never(rows: DataFrame, out: str = "score") -> DataFrame:
    return rows.withColumn(out, F.lit(0.0))


def prior(rows: DataFrame, train: DataFrame, label: str, out: str = "score") -> DataFrame:
    """The training share of positives for every row."""
    return rows.withColumn(out, train.agg(F.avg(F.col(label).cast("double")).alias("p")).scalar())
