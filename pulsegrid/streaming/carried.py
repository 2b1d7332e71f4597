"""The last real reading of every series on a stream, carried over a horizon: value state and event-time timers.

One value per series is kept, the latest real reading. A timer stands at that reading's time plus `quiet`; every newer reading moves it. When the
watermark passes the timer the series has gone quiet: its forecast is emitted and its state removed, so state holds open series only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
"""The keyed state store that value state and timers need (`spark.sql.streaming.stateStore.providerClass`)."""


class LastReading(StatefulProcessor):
    """Keeps (time, value) of a series' latest real reading; of readings at one time the largest value counts."""

    def __init__(self, keys: Sequence[str], horizon: int, quiet_ms: int) -> None:
        self.keys, self.horizon, self.quiet_ms = list(keys), horizon, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, value double")

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        import pandas as pd

        best = old = self.last.get() if self.last.exists() else None
        watermark = timerValues.getCurrentWatermarkInMs()  # the engine's own test for late rows lags a batch behind
        for chunk in rows:
            real = chunk[chunk["value"].notna() & (chunk["at"] >= watermark)]
            if len(real):
                top = real.sort_values(["at", "value"]).iloc[-1]
                best = max(best or (int(top["at"]), float(top["value"])), (int(top["at"]), float(top["value"])))
        if best is not None and best != old:
            if old is not None:
                self.handle.deleteTimer(old[0] + self.quiet_ms)
            self.last.update((int(best[0]), float(best[1])))
            self.handle.registerTimer(int(best[0]) + self.quiet_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Any]:
        import pandas as pd

        at, value = self.last.get()
        self.last.clear()
        own = {k: [v] * self.horizon for k, v in zip(self.keys, key, strict=True)}
        yield pd.DataFrame({**own, "origin": [at] * self.horizon, "h": range(1, self.horizon + 1), "pred": [value] * self.horizon})

    def close(self) -> None:
        pass


def last_value(readings: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int, quiet: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(keys, origin, h, pred) for h = 1 … horizon, once per series and silence of at least `quiet`.

    On-time data gives, for series without such a silence before their end, the rows of the batch `baselines.last_value`. Rows later than the watermark
    (the newest time seen less `late`) are dropped; a reading out of order but on time counts only if none is newer. Blanks keep nothing and move no
    timer. A series that speaks again after its forecast starts afresh. `origin` is the time of the last real reading. The session must use the `PROVIDER` state store.
    """
    spark = readings.sparkSession
    quiet_ms = spark.sql(f"select unix_millis(timestamp_seconds(0) + interval '{quiet}') as ms").first()["ms"]
    clocked = readings.withColumn("_clock", F.col(ts).cast("timestamp")).withWatermark("_clock", late)
    rows = clocked.select(*keys, "_clock", F.unix_millis("_clock").alias("at"), F.col(value).cast("double").alias("value"))
    own = [f for f in readings.select(*keys).schema.fields]
    schema = StructType([*own, StructField("origin", LongType()), StructField("h", LongType()), StructField("pred", DoubleType())])
    out = rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=LastReading(keys, horizon, int(quiet_ms)), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumn("origin", F.timestamp_millis("origin").cast("timestamp_ntz"))
