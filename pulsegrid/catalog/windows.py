"""Ordered analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import standins as S
from pulsegrid.catalog.registry import query
from pulsegrid.functions import dates
from pulsegrid.operators import core, episodes, features, fills, segments, timeline
from pulsegrid.plans import hubs

GAPS = "rg as (select user_id as pid, ts, value, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 60e6 as gap from events)"


@query("e01_reading_gaps", "pid:l ts:t gap:f", f"with {GAPS} select pid, date_trunc('second', ts) as ts, gap from rg")
def e01(spark, sf):
    g = fills.reading_gaps(S.readings(spark, sf), ["pid"])
    return g.withColumn("ts", core.slot_start(core.epoch_seconds("ts"), 1))


@query("e02_missing_runs", "pid:l slot:l missing_run:l", f"with {S.RUN_LEN} select pid, slot, missing_run from gaps")
def e02(spark, sf):
    return segments.missing_runs(hubs.grid_table(spark, sf), ["pid"])


@query("e03_segments", "pid:l slot:l segment:s", f"with {S.SEGMENTS} select pid, slot, segment from labelled")
def e03(spark, sf):
    return hubs.main_segments(spark, sf)


ON = f"""{S.STRETCHES}, fl as (select distinct pid, unnest(range(cast(floor(epoch(start_ts) / 60) as bigint), cast(floor(epoch(end_ts) / 60) as bigint) + 1)) as slot from stretches where vital = 'rest'),
 bl as (select pid, slot, slot - row_number() over (partition by pid order by slot) as isl from fl),
 blocks as (select pid, isl, min(slot) as a, max(slot) as b, count(*) as minutes from bl group by 1, 2)"""


@query("e04_blocks", "pid:l block:l first_minute:l minutes:l", f"with {ON} select pid, row_number() over (partition by pid order by a) as block, a as first_minute, minutes from blocks")
def e04(spark, sf):
    st = S.stretches(spark, sf).where("vital = 'rest'")
    on = timeline.covered_minutes(st, ["pid"]).withColumn("rest", F.lit(1))
    blocks = segments.flag_blocks(on, ["pid"], "rest").groupBy("pid", "a").agg(F.count(F.lit(1)).alias("minutes"))
    return segments.number_blocks(blocks, ["pid"]).withColumnRenamed("a", "first_minute")


@query("e05_chronological_split", "pid:l slot:l split:s", f"with {S.SEGMENTS} select pid, slot, split from labelled where segment is not null")
def e05(spark, sf):
    return hubs.main_segments(spark, sf).where("segment is not null")


@query("e06_day_split", "pid:l date:d split:s", f"""with {S.DAYS}, n as (select pid, d, row_number() over (partition by pid order by d) - 1 as i, count(*) over (partition by pid) as c from days)
select pid, d as date, case when i < (c * 80) // 100 then 'train' else 'test' end as split from n""")
def e06(spark, sf):
    return segments.split_days(S.day_table(spark, sf), ["pid"])


@query("e07_forward_fill", "conv_id:l turn:l carried:s", """select conv_id, turn, last_value(case when role = 'user' then text end ignore nulls)
 over (partition by conv_id order by turn rows between unbounded preceding and current row) as carried from conversations""")
def e07(spark, sf):
    c = S.table(spark, sf, "conversations").withColumn("label", F.when(F.col("role") == "user", F.col("text")))
    out = core.sweep(c, ["conv_id"], "turn", before={"_c": core.Seen(F.col("label").isNotNull(), ("label",), own=True)})
    return out.withColumn("carried", F.col("_c.label"))


LINE = S.RUN_LEN + """, ends as (select g.*, p.hrv as prev, n.hrv as next, g.slot - g.prev_slot as dprev, g.next_slot - g.slot as dnext from gaps g
 left join gaps p on p.pid = g.pid and p.slot = g.prev_slot left join gaps n on n.pid = g.pid and n.slot = g.next_slot)"""


@query("e08_straight_line", "pid:l slot:l filled:f", f"with {LINE} select pid, slot, coalesce(hrv, prev + (next - prev) * dprev / (dprev + dnext), prev, next) as filled from ends")
def e08(spark, sf):
    return fills.straight_line(fills.nearest(hubs.grid_table(spark, sf), ["pid"]))


@query("e09_lags_leads", "pid:l slot:l lag1:f lag2:f lead1:f lead2:f", f"""with {S.GRID} select pid, slot, lag(hrv, 1) over w as lag1, lag(hrv, 2) over w as lag2,
 lead(hrv, 1) over w as lead1, lead(hrv, 2) over w as lead2 from grid window w as (partition by pid order by slot)""")
def e09(spark, sf):
    return fills.lags_leads(hubs.main_grid(spark, sf), ["pid"], 2)


@query("e10_nearest", "pid:l slot:l prev:f dprev:l next:f dnext:l", f"with {LINE} select pid, slot, prev, dprev, next, dnext from ends")
def e10(spark, sf):
    return fills.nearest(hubs.grid_table(spark, sf), ["pid"])


@query("e11_capped_distances", "pid:l slot:l since:l until:l", f"with {LINE} select pid, slot, least(coalesce(dprev, 3), 3) as since, least(coalesce(dnext, 3), 3) as until from ends")
def e11(spark, sf):
    return fills.capped_distances(fills.nearest(hubs.grid_table(spark, sf), ["pid"]), 3)


TOKENS = """tok as (select user_id as pid, cast(ts as date) as date, hour(ts) * 60 + minute(ts) as minute, avg(value) filter (event_type in ('click', 'purchase', 'error')) as hr,
 avg(value) filter (event_type = 'view') as hrv from events group by 1, 2, 3)"""


def tokens(spark, sf):
    e = S.table(spark, sf, "events")
    pick = lambda *t: F.avg(F.when(F.col("event_type").isin(*t), F.col("value")))
    return e.groupBy(F.col("user_id").alias("pid"), F.to_date("ts").alias("date"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute")).agg(
        pick("click", "purchase", "error").alias("hr"), pick("view").alias("hrv"))


@query("e12_since_last", "pid:l date:d minute:l hr_since:l hrv_since:l", f"""with {TOKENS}
select pid, date, minute, coalesce(minute - max(case when hr is not null then minute end) over w, minute + 1) as hr_since,
 coalesce(minute - max(case when hrv is not null then minute end) over w, minute + 1) as hrv_since from tok
 window w as (partition by pid, date order by minute rows between unbounded preceding and current row)""")
def e12(spark, sf):
    return fills.since_last(tokens(spark, sf), ["pid", "date"], "minute", ["hr", "hrv"])


@query("e13_since_token", "pid:l date:d minute:l elapsed:l", f"with {TOKENS} select pid, date, minute, minute - lag(minute, 1, -1) over (partition by pid, date order by minute) as elapsed from tok")
def e13(spark, sf):
    return fills.since_last(tokens(spark, sf), ["pid", "date"], "minute", [])


@query("e14_trailing_cycle", "pid:l slot:l mean_cycle:f sd_cycle:f", f"""with {S.GRID} select pid, slot, avg(hrv) over w as mean_cycle, stddev_pop(hrv) over w as sd_cycle from grid
 window w as (partition by pid order by slot rows between 3 preceding and current row)""")
def e14(spark, sf):
    return fills.trailing_stats(hubs.main_grid(spark, sf), ["pid"], 4)


@query("e15_fullest_window", "end_day:d rolling:l", """with d as (select cast(ts as date) as d, count(*) as n from events group by 1),
 ax as (select cast(unnest(range(min(d)::timestamp, max(d)::timestamp + interval 1 day, interval 1 day)) as date) as d from d),
 r as (select ax.d, sum(coalesce(n, 0)) over (order by ax.d rows between 6 preceding and current row) as rolling from ax left join d on d.d = ax.d)
select arg_max(d, struct_pack(a := rolling, b := -datediff('day', date '1970-01-01', d))) as end_day, max(rolling) as rolling from r""")
def e15(spark, sf):
    per = S.readings(spark, sf).groupBy(core.slot_of("ts", 86400).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    best = fills.fullest_window(fills.rolling_total(timeline.dense(per, []), [], 7), [])
    return best.withColumn("end_day", core.slot_start("end_slot", 86400))


@query("e16_last_value", "pid:l h:l pred:f", """with l as (select user_id as pid, arg_max(value, ts) as v from events group by 1) select pid, unnest(range(1, 7)) as h, v as pred from l""")
def e16(spark, sf):
    from pulsegrid.operators import baselines
    return baselines.last_value(S.readings(spark, sf), "pid", "ts", "value", 6)


@query("e17_subject_median", "pid:l h:l pred:f", """with l as (select user_id as pid, median(value) as v from events group by 1) select pid, unnest(range(1, 7)) as h, v as pred from l""")
def e17(spark, sf):
    from pulsegrid.operators import baselines
    return baselines.subject_median(S.readings(spark, sf), "pid", "value", 6)


RANKS = S.SCORED + """, ranks as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as avg_rank from scored)"""


@query("e18_average_rank", "pid:l date:d score:f avg_rank:f", f"with {RANKS} select pid, d as date, score, avg_rank from ranks")
def e18(spark, sf):
    s = S.scored_days(spark, sf)
    return s.join(core.average_ranks(s, [], "score"), "score")


@query("e19_cumulative_positives", "score:f tp:l n:l", f"""with {S.SCORED}, d as (select score, sum(label) as p, count(*) as c from scored group by 1)
select score, sum(p) over (order by score desc) as tp, sum(c) over (order by score desc) as n from d""")
def e19(spark, sf):
    from pulsegrid.operators import metrics
    return metrics.score_table(S.scored_days(spark, sf), []).select("score", "tp", F.col("flagged").alias("n"))


@query("e20_longest_gap", "pid:l date:d longest_gap:l", f"""with {TOKENS}, u as (select pid, date, minute from tok where hr is not null union select pid, date, -1 from tok union select pid, date, 1440 from tok),
 g as (select pid, date, minute - lag(minute) over (partition by pid, date order by minute) as d from u) select pid, date, max(d) - 1 as longest_gap from g group by 1, 2""")
def e20(spark, sf):
    return features.longest_day_gap(tokens(spark, sf).where("hr is not null"), ["pid", "date"], "minute", tokens(spark, sf).select("pid", "date").distinct())


INSIDE = S.EPISODES + ", " + S.DAYS + """, epd as (select pid, cast(unnest(range(start_d::timestamp, end_d::timestamp + interval 1 day, interval 1 day)) as date) as d, ordinal, episode from episodes),
 inside as (select pid, d, arg_min(episode, ordinal) as episode from epd group by 1, 2)"""


@query("e21_onset_valid", "pid:l date:d onset_valid:l", f"""with {INSIDE}, l as (select *, max(d) over (partition by pid) as last_d from days)
select l.pid, l.d as date, case when l.hrv_n > 0 and i.episode is null and l.d <= l.last_d - 3 then 1 else 0 end as onset_valid from l left join inside i on i.pid = l.pid and i.d = l.d""")
def e21(spark, sf):
    d = S.day_table(spark, sf).withColumn("sample", F.col("hrv_n") > 0)
    return episodes.onset_valid(episodes.episode_of_day(d, S.episodes(spark, sf)), 3)


@query("e22_decayed_average", "pid:l slot:l decayed_mean:f decayed_count:f", f"""with {S.GRID}
select g.pid, g.slot, sum(h.hrv * exp(-0.2 * (g.slot - h.slot))) / (sum(case when h.hrv is not null then exp(-0.2 * (g.slot - h.slot)) end) + 1e-6) as decayed_mean,
 ln(1 + sum(case when h.hrv is not null then exp(-0.2 * (g.slot - h.slot)) end)) as decayed_count from grid g join grid h on g.pid = h.pid and h.slot <= g.slot group by 1, 2""")
def e22(spark, sf):
    return fills.decayed_average(hubs.grid_table(spark, sf), ["pid"], 0.2)


@query("e23_hourly_state", "pid:l date:d hour:l state:f", f"""with {TOKENS}, ax as (select distinct pid, date, unnest(range(0, 24)) as hour from tok)
select a.pid, a.date, a.hour, sum(t.hr * exp(-0.01 * (a.hour * 60 + 59 - t.minute))) as state from ax a left join tok t on t.pid = a.pid and t.date = a.date and t.minute <= a.hour * 60 + 59 group by 1, 2, 3""")
def e23(spark, sf):
    return fills.hourly_state(tokens(spark, sf), ["pid", "date"], "minute", "hr", 0.01)


@query("e24_two_sided_blend", "pid:l slot:l by_place:f by_distance:f", f"""with {LINE}
select pid, slot, coalesce((1 - dprev / (dprev + dnext)) * prev + dprev / (dprev + dnext) * next, prev, next) as by_place,
 coalesce((prev / dprev + next / dnext) / (1 / dprev + 1 / dnext), prev, next) as by_distance from ends where hrv is null""")
def e24(spark, sf):
    n = fills.nearest(hubs.grid_table(spark, sf), ["pid"]).where("hrv is null")
    return fills.blend_two_sided(fills.blend_two_sided(n, how="position", out="by_place"), how="distance", out="by_distance")
