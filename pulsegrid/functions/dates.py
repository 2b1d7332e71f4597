"""Timestamps and calendar parts on naive local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.operators.core import epoch_seconds, floor_div, slot_start


def parse_iso(text: Column) -> Column:
    """ISO-8601 with or without a fraction or a 'T'; null if unreadable."""
    return F.regexp_replace(F.trim(text), "T", " ").try_cast("timestamp_ntz")


def floor_minute(ts: Column) -> Column:
    return slot_start(floor_div(epoch_seconds(ts), 60), 60)


def calendar_day(year: Column, month: Column, day: Column) -> Column:
    """Date from whole numbers; null if there is no such day."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, zero, zero, zero.cast("decimal(16,6)")).cast("date")


def day_first(text: Column) -> Column:
    """Day-first date with -, / or . between the parts."""
    pat = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
    part = lambda i: F.regexp_extract(F.trim(text), pat, i).try_cast("int")
    return calendar_day(part(3), part(2), part(1))


def make_day(day: Column, month: Column, year: Column, first_year: int, last_year: int) -> Column:
    """Date from its parts; null if it does not exist or lies outside the years."""
    return F.when(year.between(first_year, last_year), calendar_day(year, month, day))


def swapped_or_slashed(stored: Column, text: Column, first_year: int, last_year: int) -> Column:
    """A stored date has day and month exchanged; text is dd/mm/yy or dd/mm/yyyy."""
    t = F.trim(text)
    pat = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
    part = lambda i: F.regexp_extract(t, pat, i).try_cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    from_text = F.when(t.rlike(pat), make_day(part(1), part(2), year, first_year, last_year))
    from_cell = make_day(F.month(stored), F.dayofmonth(stored), F.year(stored), first_year, last_year)
    return F.when(stored.isNotNull(), from_cell).otherwise(from_text)


def relative_day(ts: Column, anchor: Column) -> Column:
    """Whole days from the anchor, rounded down (the anchor's own day is 0)."""
    return F.floor((ts.cast("timestamp_ntz").cast("timestamp").cast("double")
                    - anchor.cast("timestamp_ntz").cast("timestamp").cast("double")) / 86400.0).cast("long")


def slot_of_day(ts: Column, minutes: int = 10) -> Column:
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int")


def monday_zero(ts: Column) -> Column:
    return F.weekday(ts)


def phase(t: Column, period: float) -> tuple[Column, Column]:
    a = t * F.lit(2 * 3.141592653589793 / period)
    return F.sin(a), F.cos(a)


def id_date(event_id: Column) -> Column:
    """Date held in the suffix of an event id such as p17_20240131."""
    n = F.substring_index(event_id, "_", -1)
    part = lambda a, k: F.substring(n, a, k).try_cast("int")
    return F.when(n.rlike(r"^\d{8}$"), calendar_day(part(1, 4), part(5, 2), part(7, 2)))
