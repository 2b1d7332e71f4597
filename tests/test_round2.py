"""Null keys, exports read by name, stored date cells."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import core, sheet
from pulsegrid.sources import readings


@pytest.mark.parametrize("size", [1, 4096])
def test_null_keys_are_a_key_of_their_own(spark, size):
    rows = [(None, 1, 1.0), (None, 2, 2.0), (None, 9, 4.0), ("a", 1, 5.0), ("a", 2, 6.0)]
    df = spark.createDataFrame(rows, "k string, pos long, v double")
    got = {(r.k, r.pos): r.a for r in core.islands(df, ["k"], "pos", F.lit(1), size=size).collect()}
    assert got == {(None, 1): 1, (None, 2): 1, (None, 9): 9, ("a", 1): 1, ("a", 2): 1}
    out = core.sweep(df, ["k"], "pos", sums={"s": F.col("v")}, bounds=True, size=size).collect()
    assert {(r.k, r.pos): (r.s, r.s_total, r.pos_min, r.pos_max) for r in out} == {
        (None, 1): (1.0, 7.0, 1, 9), (None, 2): (3.0, 7.0, 1, 9), (None, 9): (7.0, 7.0, 1, 9), ("a", 1): (5.0, 11.0, 1, 2), ("a", 2): (11.0, 11.0, 1, 2)}
    q = {r.k: r.m for r in core.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert q == {None: 2.0, "a": 5.5}


def test_exports_are_read_by_name(spark, tmp_path):
    for pid, text in (("p1", "seq,lastRate,logDateTime\n7,61,2025-01-01T00:00:00Z\n"), ("p2", "logDateTime,extra,lastRate\n2025-01-02T00:00:00Z,x,62\n")):
        (tmp_path / pid / "hr").mkdir(parents=True)
        (tmp_path / pid / "hr" / "a.csv").write_text(text)
    df = readings.read_export(spark, str(tmp_path), "hr", ["logDateTime", "lastRate"], pid_pattern=r"/([^/]+)/hr/")
    assert sorted(tuple(r) for r in df.collect()) == [("2025-01-01T00:00:00Z", "61", "p1"), ("2025-01-02T00:00:00Z", "62", "p2")]
    with pytest.raises(ValueError, match="no column"):
        readings.read_export(spark, str(tmp_path), "hr", ["absent"])


def test_stored_dates_are_one_day(spark):
    cells = spark.createDataFrame([(1, "2026-01-21"), (2, "2026-01-21 00:00:00"), (3, "19 to 20-11-2025")], "i long, cell string")
    got = {r.i: (str(r.start), str(r.end), r.accepted) for r in sheet.parse_episodes(cells, "cell", ["i"], (2020, 2030)).collect()}
    assert got == {1: ("2026-01-21", "2026-01-21", True), 2: ("2026-01-21", "2026-01-21", True), 3: ("2025-11-19", "2025-11-20", True)}
