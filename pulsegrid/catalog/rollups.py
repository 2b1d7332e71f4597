"""Hub roll-ups and segment summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import standins as S
from pulsegrid.catalog.registry import query
from pulsegrid.operators import coverage, segments, timeline
from pulsegrid.operators.core import slot_start
from pulsegrid.plans import hubs
from pulsegrid.sources.stage import materialise


@query("d01_minute_mean", "pid:l vital:s minute:t value:f n:l", f"""with {S.SIGNALS}
select pid, vital, date_trunc('minute', ts) as minute, avg(value) as value, count(value) as n from signals group by 1, 2, 3""")
def d01(spark, sf):
    m = timeline.minute_means(S.signals(spark, sf), ["pid", "vital"])
    return m.withColumn("minute", slot_start("minute", 60))


@query("d02_duplicate_intervals", "pid:l start_h:t deep:f steps:f", f"""with {S.STRETCHES}
select pid, date_trunc('day', start_ts) as start_h, coalesce(sum(case when vital = 'rest' then value end), 0) as deep,
 max(case when vital = 'active' then value end) as steps from stretches group by 1, 2""")
def d02(spark, sf):
    st = S.stretches(spark, sf).select(
        "pid", F.to_date("start").cast("timestamp_ntz").alias("start_h"), F.when(F.col("vital") == "rest", F.col("value")).alias("deep"),
        F.when(F.col("vital") == "active", F.col("value")).alias("steps"))
    return timeline.merge_duplicates(st, ["pid"], "start_h", ["deep"], ["steps"])


@query("d03_slot_grid", "pid:l slot_ts:t hrv:f hrv_n:l", f"with {S.GRID} select pid, make_timestamp(slot * {S.SLOT} * 1000000) as slot_ts, hrv, hrv_n from grid")
def d03(spark, sf):
    return hubs.main_grid(spark, sf).withColumn("slot_ts", slot_start("slot", S.SLOT))


# the full minute hub of all signals and flags, then the ten-minute grid
HUB = f"""{S.SIGNALS}, {S.STRETCHES},
 m0 as (select pid, cast(floor(epoch(ts) / 60) as bigint) as slot, avg(value) filter (vital = 'hr') as hr, avg(value) filter (vital = 'hrv') as hrv,
  avg(value) filter (vital = 'temp') as temp, avg(value) filter (vital = 'spo2') as spo2 from signals group by 1, 2),
 fl0 as (select pid, vital, unnest(range(cast(floor(epoch(start_ts) / 60) as bigint), cast(floor(epoch(end_ts) / 60) as bigint) + 1)) as slot from stretches),
 fl as (select pid, slot, max(case when vital = 'rest' then 1 else 0 end) as rest, max(case when vital = 'active' then 1 else 0 end) as active from fl0 group by 1, 2),
 sp as (select pid, min(slot) as a, max(slot) as b from (select pid, slot from m0 union all select pid, slot from fl) u group by 1),
 ax as (select pid, unnest(range(a, b + 1)) as slot from sp),
 minutes as (select x.pid, x.slot, hr, hrv, temp, spo2, coalesce(rest, 0) as rest, coalesce(active, 0) as active
  from ax x left join m0 on m0.pid = x.pid and m0.slot = x.slot left join fl on fl.pid = x.pid and fl.slot = x.slot)"""


def minute_hub(spark, sf):
    st = S.stretches(spark, sf)
    return timeline.minute_table(S.signals(spark, sf), {"rest": st.where("vital = 'rest'"), "active": st.where("vital = 'active'")},
                                 ["hr", "hrv", "temp", "spo2"])


def sparse_hub(spark, sf):
    """The minutes that hold anything, stored: the grid reads them twice."""
    st = S.stretches(spark, sf)
    return materialise(timeline.sparse_minutes(S.signals(spark, sf), {"rest": st.where("vital = 'rest'"), "active": st.where("vital = 'active'")},
                                               ["hr", "hrv", "temp", "spo2"]), "minutes")


def slot_hub(spark, sf):
    """Ten-minute slots from readings and intervals; spo2 stands for steps."""
    st = S.stretches(spark, sf)
    points = S.signals(spark, sf).withColumn("vital", F.when(F.col("vital") == "spo2", "steps").otherwise(F.col("vital")))
    flags = {n: st.where(F.col("vital") == n) for n in ("rest", "active")}
    return coverage.slot_hub(points, flags, ["hr", "hrv", "temp", "steps"], ["pid"], "hrv", ["hr", "temp"], ["steps"])


@query("c02_minute_hub", "pid:l date:d minutes:l hr:l hrv:f rest:l active:l", f"""with {HUB} select pid, cast(make_timestamp(slot * 60 * 1000000) as date) as date, count(*) as minutes, count(hr) as hr, sum(hrv) as hrv, sum(rest) as rest, sum(active) as active from minutes group by 1, 2""")
def c02b(spark, sf):
    return minute_hub(spark, sf).groupBy("pid", F.to_date(slot_start("slot", 60)).alias("date")).agg(
        F.count(F.lit(1)).alias("minutes"), F.count("hr").alias("hr"), F.sum("hrv").alias("hrv"), F.sum("rest").alias("rest"), F.sum("active").alias("active"))


GRID10 = HUB + """, ms as (select pid, (min(slot) // 10) as a, max(slot) as b from minutes where hrv is not null group by 1),
 grid10 as (select m.pid, m.slot // 10 as slot, avg(hrv) as hrv, count(hrv) as hrv_n, avg(hr) as hr, count(hr) as hr_n, avg(temp) as temp,
  sum(spo2) as steps, avg(rest) as rest_frac, avg(active) as active_frac from minutes m join ms on m.pid = ms.pid and m.slot // 10 >= ms.a and m.slot <= ms.b group by 1, 2)"""


@query("d03_ten_minute_hub", "pid:l date:d slots:l hrv:f hrv_n:l hr_n:l temp:f steps:f rest:f active:f", f"""with {GRID10}
select pid, cast(make_timestamp(slot * 600 * 1000000) as date) as date, count(*) as slots, avg(hrv) as hrv, sum(hrv_n) as hrv_n, sum(hr_n) as hr_n, avg(temp) as temp,
 sum(steps) as steps, sum(rest_frac) as rest, sum(active_frac) as active from grid10 group by 1, 2""")
def d03b(spark, sf):
    g = slot_hub(spark, sf)
    return g.groupBy("pid", F.to_date(slot_start("slot", 600)).alias("date")).agg(
        F.count(F.lit(1)).alias("slots"), F.avg("hrv").alias("hrv"), F.sum("hrv_n").alias("hrv_n"), F.sum("hr_n").alias("hr_n"),
        F.avg("temp").alias("temp"), F.sum("steps").alias("steps"), F.sum("rest_frac").alias("rest"), F.sum("active_frac").alias("active"))


DAILY = GRID10 + """, daily as (select pid, cast(make_timestamp(slot * 600 * 1000000) as date) as date, median(hrv) as hrv_median, sum(hrv_n) as hrv_n,
 avg(hr) as hr_mean, avg(temp) as temp_mean, coalesce(sum(steps), 0) as steps_total, sum(rest_frac) / 6 as rest_hours from grid10 group by 1, 2 having sum(hrv_n) > 0)"""


@query("d04_daily", "pid:l date:d hrv_median:f hrv_n:l hr_mean:f temp_mean:f steps_total:f rest_frac_hours:f coverage_pct:f split:s", f"""with {DAILY},
 n as (select *, row_number() over (partition by pid order by date) - 1 as i, count(*) over (partition by pid) as c from daily)
select pid, date, hrv_median, hrv_n, hr_mean, temp_mean, steps_total, rest_hours as rest_frac_hours, 100.0 * least(hrv_n, 144) / 144 as coverage_pct,
 case when i < (c * 80) // 100 then 'train' else 'test' end as split from n""")
def d04(spark, sf):
    g = slot_hub(spark, sf)
    d = timeline.daily_rollup(g, ["pid"], 600, means=["hr", "temp"], totals=["steps"], fractions=["rest_frac"])
    return segments.split_days(d, ["pid"])


@query("d29_threshold_scan", "x:l pid:l kept_pct:f missing_inside_pct:f", f"""with {S.RUN_LEN}, xs(x) as (values (0), (1), (2), (4), (8)),
 c as (select x, g.*, sum(case when missing_run > x then 1 else 0 end) over (partition by x, pid order by slot) as part from gaps g, xs),
 p as (select x, pid, part, max(slot) - min(slot) + 1 as slots, count(*) as kept from c where hrv is not null group by 1, 2, 3),
 k as (select x, pid, sum(slots) filter (slots >= 4) as slots, sum(kept) filter (slots >= 4) as kept, sum(kept) as seen from p group by 1, 2)
select x, pid, 100.0 * coalesce(kept, 0) / seen as kept_pct, case when slots > 0 then 100 * (1 - kept / slots) end as missing_inside_pct from k
union all select x, null, 100.0 * coalesce(sum(kept), 0) / sum(seen), case when sum(slots) > 0 then 100 * (1 - sum(kept) / sum(slots)) end from k group by x""")
def d29(spark, sf):
    return segments.threshold_scan(hubs.grid_table(spark, sf), ["pid"], [0, 1, 2, 4, 8], hubs.MIN_SLOTS)


@query("d30_segment_summary", "pid:l segment:s start_ts:t end_ts:t hours:f readings:l missing_pct:f train_slots:l test_slots:l", f"""with {S.SEGMENTS}
select pid, segment, make_timestamp(min(slot) * {S.SLOT} * 1000000) as start_ts, make_timestamp(max(slot) * {S.SLOT} * 1000000) as end_ts, count(*) * 6.0 as hours,
 count(hrv) as readings, 100 * (1 - count(hrv) / count(*)) as missing_pct, count(*) filter (split = 'train') as train_slots, count(*) filter (split = 'test') as test_slots
 from labelled where segment is not null group by 1, 2""")
def d30(spark, sf):
    s = segments.segment_summary(hubs.main_segments(spark, sf), ["pid"], S.SLOT / 3600)
    return s.withColumns({"start_ts": slot_start("start_slot", S.SLOT), "end_ts": slot_start("end_slot", S.SLOT)})


@query("d30_subject_summary", "pid:l readings:l slots:l coverage_pct:f segments:l kept_pct:f", f"""with {S.SEGMENTS}
select pid, count(hrv) as readings, count(*) as slots, 100.0 * count(hrv) / count(*) as coverage_pct, count(distinct segment) as segments,
 100.0 * count(hrv) filter (segment is not null) / count(hrv) as kept_pct from labelled group by 1""")
def d30b(spark, sf):
    return segments.subject_summary(hubs.main_segments(spark, sf), ["pid"])
