"""Masks, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import standins as S
from pulsegrid.catalog.registry import query
from pulsegrid.operators import cohort, fills, sampling, segments
from pulsegrid.plans import hubs

MASK = S.SEGMENTS + """, ob as (select segment, slot, row_number() over (partition by segment order by md5('1|' || segment || '|' || cast(slot as varchar))) as i, count(*) over (partition by segment) as n from labelled where segment is not null and hrv is not null),
 mask as (select segment, slot from ob where i <= round_even(n * 20 / 100, 0))"""


@query("e25_random_mask", "segment:s slot:l", f"with {MASK} select segment, slot from mask")
def e25(spark, sf):
    return sampling.random_mask(hubs.segment_table(spark, sf), 1)


def block_sql(seed, pct, pool):
    return S.SEGMENTS + f""", rl as (select segment, missing_run, count(*) as s from labelled where segment is not null and missing_run > 0 group by 1, 2), pool as (select missing_run as len, {pool} as n from rl group by 1),
 cum as (select len, n, sum(n) over (order by len) as upto, sum(n) over () as tot from pool),
 sz as (select segment, min(slot) as a, count(*) as n, count(hrv) as known, arg_max(case when hrv is null then 0 else 1 end, slot) as last_known from labelled where segment is not null group by 1),
 sg as (select segment, a, n, least(cast(round_even(known * {pct} / 100, 0) as bigint), known - case when n > (select max(len) from pool) then last_known else 0 end) as target from sz),
 ci as (select *, unnest(range(1, 20 * n + 200)) as i from sg where target > 0),
 cd as (select segment, a, n, target, i, ('0x' || substr(md5('{seed}|' || segment || '|' || cast(i as varchar)), 1, 8))::bigint as h1, ('0x' || substr(md5('{seed}|' || segment || '|' || cast(i as varchar)), 9, 8))::bigint as h2 from ci),
 cl as (select cd.*, c.len from cd join cum c on cd.h1 % c.tot >= c.upto - c.n and cd.h1 % c.tot < c.upto), cs as (select *, h2 % greatest(1, n - len) as st from cl),
 sp as (select segment, target, i, unnest(range(a + st, a + least(st + len, n))) as slot from cs), fi as (select segment, target, slot, min(i) as i from sp group by 1, 2, 3),
 oh as (select f.* from fi f join labelled l on l.segment = f.segment and l.slot = f.slot and l.hrv is not null), nw as (select segment, target, i, count(*) as k from oh group by 1, 2, 3),
 kp as (select segment, i from (select *, coalesce(sum(k) over (partition by segment order by i rows between unbounded preceding and 1 preceding), 0) as b from nw) q where b < target), block as (select o.segment, o.slot from oh o join kp on kp.segment = o.segment and kp.i = o.i)"""


@query("e26_block_mask", "segment:s slot:l", f"with {block_sql(2, 20, 'count(*)')} select segment, slot from block")
def e26(spark, sf):
    t = hubs.segment_table(spark, sf)
    return sampling.block_mask(t, sampling.run_pool(t), 2, pct=20)


@query("e27_practice_mask", "segment:s slot:l", f"with {block_sql(123, 15, 'sum(s // missing_run)')} select segment, slot from block")
def e27(spark, sf):
    t = hubs.segment_table(spark, sf)
    return sampling.block_mask(t, sampling.run_pool(t, distinct=False, longest=18), 123, pct=15)


@query("e28_practice_forecast", "segment:s slot:l part:s filled:f", f"""with {S.SEGMENTS}, tr as (select *, ((b - a + 1) * 80) // 100 as n, slot - a as place from labelled where split = 'train'), ct as (select *, (n * 80) // 100 as cut from tr),
 ok as (select segment from ct group by 1 having min(cut) >= 4 and min(n - cut) >= 2 and count(hrv) filter (place >= cut) > 0), pf as (select ct.*, case when place < cut then 'learn' else 'validate' end as part from ct where segment in (select segment from ok)),
 kn as (select pid, segment, slot, hrv from pf where part = 'learn'), ne as (select *, max(case when hrv is not null then slot end) over (partition by segment order by slot rows between unbounded preceding and 1 preceding) as p, min(case when hrv is not null then slot end) over (partition by segment order by slot rows between 1 following and unbounded following) as x from kn),
 fl as (select n.segment, n.slot, coalesce(n.hrv, a.hrv + (b.hrv - a.hrv) * (n.slot - n.p) / (n.x - n.p), a.hrv, b.hrv) as filled from ne n left join kn a on a.segment = n.segment and a.slot = n.p left join kn b on b.segment = n.segment and b.slot = n.x)
select pf.segment, pf.slot, part, case when part = 'learn' then filled else hrv end as filled from pf left join fl on fl.segment = pf.segment and fl.slot = pf.slot""")
def e28(spark, sf):
    from pulsegrid.sources.stage import materialise
    p = materialise(segments.practice_forecast(hubs.segment_table(spark, sf), ["pid"], min_train=4, min_val=2), "practice")
    learn = fills.straight_line(fills.nearest(p.where("part = 'learn'"), ["segment"])).select("segment", "slot", "part", "filled")
    return learn.unionByName(p.where("part = 'validate'").select("segment", "slot", "part", F.col("hrv").alias("filled")))


UNITS = S.SCORED + ", un as (select pid, min(grp) as grp, max(label) as pos from scored group by 1)"


def units(spark, sf):
    return cohort.subject_strata(S.scored_days(spark, sf))


@query("e29_stratified_draw", "pid:l", f"with {UNITS}, r as (select *, row_number() over (partition by grp, pos order by md5('4|' || cast(pid as varchar))) as i, count(*) over (partition by grp, pos) as n from un) select pid from r where i <= floor(n * 0.3 + 0.5)")
def e29(spark, sf):
    return sampling.stratified_draw(units(spark, sf), ["grp", "pos"], 0.3, 4)


@query("e30_nested_draw", "pid:l part:s", f"""with {UNITS}, r as (select *, row_number() over (partition by grp, pos order by md5('6-test|' || cast(pid as varchar))) as i, count(*) over (partition by grp, pos) as n from un), te as (select pid from r where i <= floor(n * 0.3 + 0.5)),
 q as (select *, row_number() over (partition by grp, pos order by md5('6-held|' || cast(pid as varchar))) as i, count(*) over (partition by grp, pos) as n from un where pid not in (select pid from te)), he as (select pid from q where i <= floor(n * 0.2 + 0.5))
select pid, case when pid in (select pid from te) then 'test' when pid in (select pid from he) then 'held' else 'train' end as part from un""")
def e30(spark, sf):
    return sampling.nested_draw(units(spark, sf), ["grp", "pos"], 0.3, 0.2, 6)


@query("e31_stratified_folds", "repeat:l pid:l fold:l", f"""with {UNITS} select repeat, pid, (row_number() over (partition by repeat, pid % 2 order by md5('3|' || cast(repeat as varchar) || '|' || cast(pid as varchar))) - 1) % 5 as fold from un, (select unnest(range(0, 3)) as repeat) r""")
def e31(spark, sf):
    return sampling.folds(units(spark, sf).withColumn("cls", F.col("pid") % 2), "cls", 5, 3, repeats=3)


@query("e32_small_subset", "pid:l date:d label:l", f"""with {S.SCORED}, r as (select *, row_number() over (partition by label order by md5('8|' || cast(pid as varchar) || '|' || cast(d as varchar))) as i, count(*) filter (label = 1) over () as p, count(*) over () as n from scored)
select pid, d as date, label from r where n <= 100 or i <= case when label = 1 then least(p, 50) else 100 - least(p, 50) end""")
def e32(spark, sf):
    return sampling.small_subset(S.scored_days(spark, sf), "label", 100, 8, ["pid", "date"])


PAIRS = S.SEGMENTS + """, tr as (select *, max(slot) over (partition by segment) as z, min(slot) over (partition by segment) as y from labelled where split = 'train'), og as (select segment, slot as origin, z, unnest(range(1, 5)) as h from tr where slot - y >= 2),
 pt as (select o.segment, o.origin, o.h, t.hrv as target from og o join tr t on t.segment = o.segment and t.slot = o.origin + o.h and t.hrv is not null where o.origin + o.h <= o.z),
 rk as (select *, row_number() over (partition by segment order by md5('11|' || segment || '|' || cast(origin as varchar) || '|' || cast(h as varchar))) as i from pt)"""


@query("e33_training_pairs", "segment:s origin:l h:l target:f", f"with {PAIRS} select segment, origin, h, target from rk where i <= 10")
def e33(spark, sf):
    return sampling.training_pairs(hubs.segment_table(spark, sf).where("split = 'train'"), "segment", "slot", 4, 10, 11, min_history=2)
