"""Sorts, limits and top-k (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import standins as S
from pulsegrid.catalog.cohort import PAIRS, STATE, measures
from pulsegrid.catalog.metrics import VERDICT, verdicts
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.sampling import block_sql
from pulsegrid.operators import cohort, picks, sampling
from pulsegrid.plans import hubs
from pulsegrid.sources.stage import materialise


@query("f01_stable_sort", "name:s n:l", "select p_type as name, count(*) as n from part group by 1 order by n desc, name")
def f01(spark, sf):
    c = cohort.value_counts(S.table(spark, sf, "part"), ["p_type"]).withColumnRenamed("p_type", "name")
    return picks.stable_sort(c, [F.desc("n")], ["name"])


@query("f02_strongest_pairs", "a:s b:s n:l spearman:f", f"with {PAIRS} select a, b, n, spearman from cr where n >= 10 and spearman is not null order by abs(spearman) desc, a, b limit 2")
def f02(spark, sf):
    return picks.strongest_pairs(cohort.correlations(measures(spark, sf), ["q", "p", "d"]), 2)


@query("f03_best_usable", "test:s model:s mae:f", f"with {VERDICT}, r as (select *, row_number() over (partition by test order by mae, model) as i from verdict where mae is not null) select test, model, mae from r where i = 1")
def f03(spark, sf):
    return picks.best_per(verdicts(spark, sf).select("test", "model", "mae"), ["test"], "mae", "model")


@query("f04_top_n", "test:s model:s mae:f place:l", f"with {S.RUNS}, m as (select test, model, min(mae) as mae from runs group by 1, 2), r as (select *, row_number() over (partition by test order by mae, model) as place from m) select test, model, mae, place from r where place <= 4")
def f04(spark, sf):
    m = S.runs(spark, sf).groupBy("test", "model").agg(F.min("mae").alias("mae"))
    return picks.top_n(m, ["test"], [F.col("mae"), F.col("model")], 4)


@query("f05_longest_series", "segment:s length:l", f"with {S.SEGMENTS} select segment, count(*) as length from labelled where segment is not null group by 1 order by 2 desc, 1 limit 6")
def f05(spark, sf):
    return picks.longest_series(hubs.main_segments(spark, sf).where("segment is not null"), "segment", 6)


@query("f06_sample_rows", "event_id:l value:f", "select event_id, value from events order by md5('0|' || cast(event_id as varchar)), event_id limit 500")
def f06(spark, sf):
    return sampling.sample_rows(S.table(spark, sf, "events").select("event_id", "value"), 500, 0, ["event_id"])


@query("f07_best_window", "segment:s start:l runs:l readings:l", f"""with {block_sql(2, 20, 'count(*)')}, mk as (select l.segment, l.slot, l.a, l.b, l.hrv, case when x.slot is null then 0 else 1 end as m from labelled l left join block x on x.segment = l.segment and x.slot = l.slot where l.segment is not null),
 ws as (select segment, a, b, unnest(range(a, b - 8 + 2, 4)) as s from (select distinct segment, a, b from mk) z where b - a + 1 >= 8), wr as (select w.segment, w.s - w.a as start, k.slot, k.hrv, k.m from ws w join mk k on k.segment = w.segment and k.slot between w.s and w.s + 7),
 rn as (select segment, start, slot - sum(m) over (partition by segment, start order by slot) as g, hrv, m from wr), rlen as (select segment, start, g, m, count(*) as len, count(hrv) as seen from rn group by 1, 2, 3, 4), sc as (select segment, start, count(*) filter (m = 1 and len >= 1) as runs, sum(seen) as readings from rlen group by 1, 2)
select segment, start, runs, readings from sc order by runs desc, readings desc, segment desc, start limit 1""")
def f07(spark, sf):
    t = hubs.segment_table(spark, sf)
    m = materialise(sampling.block_mask(t, sampling.run_pool(t), 2, pct=20), "mask")
    return picks.best_window(t, m, 8, 4, min_run=1)


@query("f07_longest_hidden_run", "segment:s start_slot:l length:l", f"""with {block_sql(2, 20, 'count(*)')}, g as (select segment, slot, slot - row_number() over (partition by segment order by slot) as g from block)
select segment, min(slot) as start_slot, count(*) as length from g group by segment, g order by 3 desc, 1 desc, 2 desc limit 1""")
def f07c(spark, sf):
    t = hubs.segment_table(spark, sf)
    return picks.longest_hidden_run(materialise(sampling.block_mask(t, sampling.run_pool(t), 2, pct=20), "mask"))


@query("f07_busiest_series", "pid:l n:l", "select user_id as pid, count(*) as n from events group by 1 order by 2 desc, 1 desc limit 1")
def f07b(spark, sf):
    return picks.busiest(S.readings(spark, sf), "pid")
