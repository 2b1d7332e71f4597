"""Query registry: one entry gives the Spark side, the SQL side and the output columns.

`cols` is a text such as ``"pid:l day:d mean:f"``. Letters: l whole number,
f double (6 decimals), s text, d date as text, t timestamp as text. Both
sides are cast by it, so column names and types agree by construction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    cols: tuple[tuple[str, str], ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}

NUDGE = 1e-9
"""Added on both sides before rounding. Means of short decimals often lie exactly
half-way between two roundings, where the order of a sum would decide."""


def _spark_cast(name: str, kind: str):
    c = F.col(name)
    if kind == "l":
        return c.cast("long").alias(name)
    if kind == "f":
        d = c.cast("double")
        return F.when(~F.isnan(d), F.round(d + F.lit(NUDGE), 6) + F.lit(0.0)).alias(name)
    if kind == "d":
        return c.cast("date").cast("string").alias(name)
    return c.cast("string").alias(name)


def _sql_cast(name: str, kind: str) -> str:
    if kind == "l":
        return f"cast({name} as bigint) as {name}"
    if kind == "f":
        return (f"case when isnan(cast({name} as double)) then null "
                f"else round(cast({name} as double) + {NUDGE}, 6) + 0.0 end as {name}")
    if kind == "d":
        return f"cast(cast({name} as date) as varchar) as {name}"
    return f"cast({name} as varchar) as {name}"


def query(name: str, cols: str, sql: str | None = None):
    """Register `build(spark, sf_dir) -> DataFrame` under `name`."""
    spec = tuple((c.split(":")[0], c.split(":")[1]) for c in cols.split())

    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(spark, sf_dir).select(*[_spark_cast(c, k) for c, k in spec])

        text = None
        if sql is not None:
            body = sql.strip()
            at = _final_select(body)
            head, tail = body[:at], body[at:]
            picks = ", ".join(_sql_cast(c, k) for c, k in spec)
            text = f"{head} select {picks} from ({tail}) as final_rows"
        REGISTRY[name] = Query(name, spec, run, text)
        return build

    return register


def _final_select(body: str) -> int:
    """Where the last top-level SELECT of a WITH text starts."""
    depth, at, low = 0, 0, body.lower()
    if not low.startswith("with"):
        return 0
    i = 0
    while i < len(low):
        ch = low[i]
        if ch == "'":
            i = low.index("'", i + 1)
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif depth == 0 and low.startswith("select", i) and not low[i - 1].isalnum():
            return i
        i += 1
    return at
