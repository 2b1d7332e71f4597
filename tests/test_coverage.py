"""Covered time by event differences against sets of minutes, and the slot hub against the minute table."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import coverage, timeline


def intervals(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a = rng.randrange(-300, 9000)
        rows.append((rng.choice(["p", "q", None]), a, a + rng.choice([-1, 0, 3, 9, 40, 700, 5000])))
    return [*rows, rows[0], ("long", 0, 60_000), ("long", 60_001, 60_002), ("none", 5, 4)]


def test_stretches_tile_what_intervals_cover(spark):
    rows = intervals(1)
    df = spark.createDataFrame(rows, "pid string, s long, e long").repartition(3)
    got = {}
    for r in coverage.stretches(df, ["pid"], F.col("s"), F.col("e")).collect():
        new = set(range(r.a, r.b + 1))
        assert new and not new & got.setdefault(r.pid, set())
        got[r.pid] |= new
    want = {}
    for p, a, b in rows:
        if a <= b:
            want.setdefault(p, set()).update(range(a, b + 1))
    assert got == want
    slots = {(r.pid, r.slot): r.covered for r in coverage.covered_per_slot(coverage.stretches(df, ["pid"], F.col("s"), F.col("e")), ["pid"], 10).collect()}
    count = {}
    for p, m in want.items():
        for x in m:
            count[p, x // 10] = count.get((p, x // 10), 0) + 1
    assert slots == count
    assert coverage.stretches(df.where("pid = 'none'"), ["pid"], F.col("s"), F.col("e")).count() == 0


def at(minute):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minute)


def test_slot_hub_equals_the_minute_table(spark):
    rng = random.Random(2)
    points = [(p, v, at(rng.randrange(0, 4000)), float(rng.randrange(40, 90))) for p in "ab" for v in ("hrv", "hr", "temp", "steps") for _ in range(60)]
    points += [("c", "hr", at(5), 60.0), ("d", "hrv", at(77), 50.0)]
    flags = {n: [(p, at(a), at(a + k)) for p in "abcd" for a, k in ((rng.randrange(-500, 4500), rng.choice([0, 5, 90, 800])) for _ in range(12))] for n in ("rest", "active")}
    pts = spark.createDataFrame(points, "pid string, vital string, ts timestamp_ntz, value double")
    ivs = {n: spark.createDataFrame(v, "pid string, start timestamp_ntz, end timestamp_ntz") for n, v in flags.items()}
    vitals = ["hrv", "hr", "temp", "steps"]
    got = coverage.slot_hub(pts, ivs, vitals, ["pid"], "hrv", ["hr", "temp"], ["steps"])
    want = timeline.multi_grid(timeline.sparse_minutes(pts, ivs, vitals), ["pid"], "hrv", ["hr", "temp"], ["steps"], ["rest", "active"])
    assert got.columns == want.columns
    key = lambda r: (r.pid, r.slot)
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(a) == len(b) > 100
    for x, y in zip(a, b, strict=True):
        assert key(x) == key(y)
        for c in got.columns[2:]:
            assert x[c] == (None if y[c] is None else pytest.approx(y[c])), (c, x, y)
