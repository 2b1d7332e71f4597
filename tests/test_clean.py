import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import clean, dates
from pulsegrid.operators import sheet


def column(spark, values, fn, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_yes_no(spark):
    assert column(spark, ["2", "7", "1", None, "0", "", "yes"], clean.yes_no) == [0.0, None, 1.0, None, 0.0, None, None]


def test_grades_at_their_midpoint(spark):
    assert column(spark, ["iii", None, "I-II", "VI", "  I", "III-IV", "2"], clean.grade_midpoint) == [3.0, None, 1.5, None, 1.0, 3.5, None]


def test_durations(spark):
    assert column(spark, [None, "3 TO 4", "12 DAYS", "40MIN", "7", "  "], clean.duration_days) == [None, 3.5, 12.0, None, 7.0, None]


def test_missing_tokens_and_numbers(spark):
    assert column(spark, ["-3.25", None, "na", "7e-1", " 41 ", "-", "6 kg", "0"], clean.clean_number) == [-3.25, None, None, 0.7, 41.0, None, None, 0.0]


def test_decode(spark):
    assert column(spark, [None, "2", "0", "1", "12"], lambda c: clean.decode(c, "sex")) == [None, "female", None, "male", None]


def test_severity_score(spark):
    df = spark.createDataFrame([(24.5, 55.0, "I", 380.0), (17.0, 30.0, "IV", 90.0), (26.0, 61.0, None, 300.0), (None, 70.0, "III", 260.0)], "b double, f double, g string, w double")
    out = [r.s for r in df.select(clean.severity_score(F.col("b"), F.col("f"), clean.grade_midpoint(F.col("g")), F.col("w")).alias("s")).collect()]
    assert out == [1.0, 10.0, None, 3.0]


def D(s):
    return dt.date.fromisoformat(s)


CELLS = [
    ("30-06-2025", [("2025-06-30", "2025-06-30")], []),
    ("01-02-2025 - 03-02-2025,9-3-2025", [("2025-02-01", "2025-02-03"), ("2025-03-09", "2025-03-09")], []),
    ("2 TO 6-05-2026; 30-06-2026 to 02-07-2026", [("2026-05-02", "2026-05-06"), ("2026-06-30", "2026-07-02")], []),
    ("2025-07-08", [("2025-07-08", "2025-07-08")], []),
    ("2026-01-31T00:00:00", [("2026-01-31", "2026-01-31")], []),
    ("see letter; 15-15-2025; 16-10-2025", [("2025-10-16", "2025-10-16")], ["15-15-2025", "see letter"]),
    ("08-08-2025 to 07-08-2025", [], ["08-08-2025 to 07-08-2025"]),
    ("11-11-2031", [], ["11-11-2031"]),
    (" ;, ", [], []),
    (None, [], []),
]


@pytest.mark.parametrize("cell,episodes,bad", CELLS)
def test_episode_text(spark, cell, episodes, bad):
    parts = sheet.parse_episodes(spark.createDataFrame([("p1", cell)], "pid string, cell string"), "cell", ["pid"], (2025, 2026))
    good, rejected = sheet.accepted_rejected(parts)
    assert sorted((r.start, r.end) for r in good.collect()) == sorted((D(a), D(b)) for a, b in episodes)
    assert sorted(r.part for r in rejected.collect()) == bad
    assert {r.why for r in rejected.collect()} <= {"unreadable"}


def test_swapped_and_slashed_dates(spark):
    df = spark.createDataFrame([(0, None, "5/6/2025"), (1, D("2025-07-02"), None), (2, None, "later"), (3, None, "30/11/26"), (4, D("2026-04-29"), None)], "i int, d date, t string")
    out = [r.x for r in df.select("i", dates.swapped_or_slashed(F.col("d"), F.col("t"), 2025, 2026).alias("x")).orderBy("i").collect()]
    assert out == [D("2025-06-05"), D("2025-02-07"), None, D("2026-11-30"), None]


def test_iso_text_with_and_without_fraction(spark):
    got = column(spark, ["2026-01-02T03:04:59", "2026-01-02 03:04:59.000", "nonsense", None], lambda c: dates.floor_minute(dates.parse_iso(c)))
    assert [str(x) if x else None for x in got] == ["2026-01-02 03:04:00", "2026-01-02 03:04:00", None, None]


def test_enrolment_falls_back_to_the_second_date(spark):
    df = spark.createDataFrame([(0, "01-06-20260", "02-06-2026"), (1, "03/06/2026", "04-06-2026")], "i int, a string, b string")
    when, source = sheet.enrolment_date("a", "b", dates.day_first)
    out = [(r.w, r.s) for r in df.select("i", when.alias("w"), source.alias("s")).orderBy("i").collect()]
    assert out == [(D("2026-06-02"), 2), (D("2026-06-03"), 1)]


def test_visit_check_gives_a_code(spark):
    df = spark.createDataFrame([(0, D("2026-01-01"), D("2026-02-15")), (1, D("2026-01-01"), D("2026-02-16")), (2, D("2026-01-02"), D("2026-01-01")), (3, None, D("2026-01-01"))], "i int, onset date, visit date")
    out = {r.i: (r.accepted, r.why) for r in sheet.check_visits(df).collect()}
    assert out == {0: (True, None), 1: (False, "late"), 2: (False, "early"), 3: (False, "no_onset")}


def test_swapped_headers_are_repaired_only_when_nearly_all_rows_agree(spark):
    bad = spark.createDataFrame([(i, 70.0, 120.0) for i in range(19)] + [(19, 120.0, 70.0), (20, None, 1.0)], "i int, lo double, hi double")
    r = {x.i: (x.lo, x.hi) for x in sheet.repair_swapped(bad, "lo", "hi").collect()}
    assert r[0] == (120.0, 70.0) and r[20] == (1.0, None)
    few = bad.where("i > 17")
    assert {x.i: (x.lo, x.hi) for x in sheet.repair_swapped(few, "lo", "hi").collect()}[18] == (70.0, 120.0)
