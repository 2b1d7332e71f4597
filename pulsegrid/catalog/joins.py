"""Joins (C) and set operations (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import standins as S
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.windows import INSIDE, LINE, TOKENS, tokens
from pulsegrid.functions import dates
from pulsegrid.operators import baselines, cohort, core, daystore, episodes, fills, joins, timeline
from pulsegrid.plans import hubs


@query("c01_outer_join_signals", "pid:l hour_slot:l hr:f hrv:f temp:f spo2:f", f"""with {S.SIGNALS}, s as (select pid, cast(floor(epoch(ts) / 3600) as bigint) as k, vital, avg(value) as v from signals group by 1, 2, 3),
 a as (select pid, k, v as hr from s where vital = 'hr'), b as (select pid, k, v as hrv from s where vital = 'hrv'), c as (select pid, k, v as temp from s where vital = 'temp'), d as (select pid, k, v as spo2 from s where vital = 'spo2')
select pid, k as hour_slot, hr, hrv, temp, spo2 from a full join b using (pid, k) full join c using (pid, k) full join d using (pid, k)""")
def c01(spark, sf):
    return timeline.widen(S.signals(spark, sf), ["pid"], "ts", ["hr", "hrv", "temp", "spo2"], width_s=3600).withColumnRenamed("slot", "hour_slot")


@query("c01_chained_outer_joins", "pid:l hour_slot:l hr:f hrv:f", f"""with {S.SIGNALS}, s as (select pid, cast(floor(epoch(ts) / 3600) as bigint) as k, vital, avg(value) as v from signals group by 1, 2, 3),
 a as (select pid, k, v as hr from s where vital = 'hr'), b as (select pid, k, v as hrv from s where vital = 'hrv')
select pid, k as hour_slot, hr, hrv from a full join b using (pid, k)""")
def c01b(spark, sf):
    sig = S.signals(spark, sf).withColumn("hour_slot", core.slot_of("ts", 3600))
    one = lambda v: sig.where(F.col("vital") == v).groupBy("pid", "hour_slot").agg(F.avg("value").alias(v))
    return timeline.outer_join_signals([one("hr"), one("hrv")], ["pid", "hour_slot"])


@query("c02_dense_spine", "pid:l slot:l hrv:f", f"""with {S.SIGNALS}, {S.STRETCHES}, v as (select pid, cast(floor(epoch(ts) / 3600) as bigint) as slot, avg(value) as hrv from signals where vital = 'hrv' group by 1, 2),
 f as (select pid, cast(floor(epoch(start_ts) / 3600) as bigint) as slot from stretches), sp as (select pid, min(slot) as a, max(slot) as b from (select pid, slot from v union all select * from f) u group by 1),
 ax as (select pid, unnest(range(a, b + 1)) as slot from sp) select ax.pid, ax.slot, v.hrv from ax left join v on v.pid = ax.pid and v.slot = ax.slot""")
def c02(spark, sf):
    sig = S.signals(spark, sf).where("vital = 'hrv'")
    v = timeline.widen(sig, ["pid"], "ts", ["hrv"], width_s=3600)
    also = S.stretches(spark, sf).select("pid", core.slot_of("start", 3600).alias("slot"))
    return timeline.dense(v, ["pid"], also=also)


@query("c03_interval_flag", "pid:l slot:l", f"""with {S.STRETCHES} select distinct pid, unnest(range(cast(floor(epoch(start_ts) / 60) as bigint), cast(floor(epoch(end_ts) / 60) as bigint) + 1)) as slot from stretches""")
def c03(spark, sf):
    return timeline.covered_minutes(S.stretches(spark, sf), ["pid"])


@query("c04_static_attributes", "pid:l slot:l hrv:f c_acctbal:f c_region:s", f"""with {S.GRID} select g.pid, slot, hrv, c_acctbal, r_name as c_region from grid g left join customer c on c.c_custkey = g.pid
 left join nation n on n.n_nationkey = c.c_nationkey left join region r on r.r_regionkey = n.n_regionkey""")
def c04(spark, sf):
    c, n, r = (S.table(spark, sf, t) for t in ("customer", "nation", "region"))
    static = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("c_custkey").alias("pid"), F.col("c_acctbal").alias("acctbal"), F.col("r_name").alias("region"))
    return joins.with_static(hubs.main_grid(spark, sf), static)


@query("c05_semi_join", "event_id:l", "select event_id from events where user_id in (select c_custkey from customer where c_acctbal > 5000)")
def c05(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", F.col("user_id").alias("pid"))
    return joins.only(e, S.table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("pid")), ["pid"])


@query("c06_anti_join", "pid:l", "select c_custkey as pid from customer where c_custkey not in (select user_id from events)")
def c06(spark, sf):
    roster = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"))
    return joins.without(roster, S.readings(spark, sf), ["pid"])


@query("c07_event_day", "pid:l date:d event_day:l", f"with {S.DAYS} select pid, d as date, case when exists (select 1 from events e where e.user_id = pid and cast(e.ts as date) = d and event_type = 'error') then 1 else 0 end as event_day from days")
def c07(spark, sf):
    ev = S.table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("pid"), F.to_date("ts").alias("date"))
    return episodes.event_day_flag(S.day_table(spark, sf), ev)


@query("c08_day_in_episode", "pid:l date:d episode:s", f"with {INSIDE} select l.pid, l.d as date, i.episode from days l left join inside i on i.pid = l.pid and i.d = l.d")
def c08(spark, sf):
    return episodes.episode_of_day(S.day_table(spark, sf), S.episodes(spark, sf))


@query("c09_next_onset", "pid:l date:d onset_id:s onset_label:l", f"""with {S.EPISODES}, {S.DAYS}, st as (select pid, start_d, min(episode) as episode from episodes group by 1, 2),
 n as (select d.pid, d.d, arg_min(s.episode, s.start_d) as onset_id from days d left join st s on s.pid = d.pid and s.start_d > d.d and s.start_d <= d.d + 3 group by 1, 2)
select pid, d as date, onset_id, case when onset_id is null then 0 else 1 end as onset_label from n""")
def c09(spark, sf):
    return episodes.next_onset(S.day_table(spark, sf), S.episodes(spark, sf), 3)


@query("c10_event_window", "pid:l episode:s rel_day:l n:l total:f", f"""with {S.EPISODES} select e.pid, e.ordinal::varchar as episode, cast(r.ts as date) - e.start_d as rel_day, count(*) as n, sum(r.value) as total
 from episodes e join events r on r.user_id = e.pid and cast(r.ts as date) - e.start_d >= -14 and cast(r.ts as date) - e.start_d < 15 group by 1, 2, 3""")
def c10(spark, sf):
    # days are merged before the join, so an event meets days, not readings
    days = S.readings(spark, sf).groupBy("pid", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    ev = S.episodes(spark, sf).select("pid", F.col("start").alias("anchor"), F.col("ordinal").cast("string").alias("episode"))
    return episodes.around_events(days, ev, 14, 14, ["episode"])


@query("c11_history_window", "pid:l sample:d place:l date:d present:l n:l", f"""with {S.DAYS}, w as (select pid, d as sample, unnest(range(0, 7)) as back from days)
select w.pid, w.sample, 6 - back as place, cast(w.sample - back as date) as date, case when x.n is null then 0 else 1 end as present, x.n from w left join days x on x.pid = w.pid and x.d = cast(w.sample - back as date)""".replace("w.sample - back as date", "w.sample - cast(back as integer) as date"))
def c11(spark, sf):
    return daystore.day_window(S.day_table(spark, sf), 7, ["n"])


@query("c12_as_of_both_ways", "pid:l slot:l prev:f dprev:l next:f dnext:l", f"with {LINE} select pid, slot, prev, dprev, next, dnext from ends where hrv is null")
def c12(spark, sf):
    return fills.nearest(hubs.grid_table(spark, sf), ["pid"]).where("hrv is null")


@query("c13_as_of_hour", "pid:l date:d hour:l state:f", f"""with {TOKENS}, ax as (select distinct pid, date, unnest(range(0, 24)) as hour from tok)
select a.pid, a.date, a.hour, arg_max(t.hr, t.minute) filter (t.hr is not null) as state from ax a left join tok t on t.pid = a.pid and t.date = a.date and t.minute <= a.hour * 60 + 59 group by 1, 2, 3""")
def c13(spark, sf):
    return cohort.as_of_hours(tokens(spark, sf), ["pid", "date"], "minute", "hr")


@query("c14_series_horizon", "pid:l h:l t:l", "with l as (select user_id as pid, max(ts) as t from events group by 1), x as (select pid, hour(t) as t0, unnest(range(1, 13)) as h from l) select pid, h, (t0 + h) % 24 as t from x")
def c14(spark, sf):
    last = S.readings(spark, sf).groupBy("pid").agg(F.hour(F.max("ts")).alias("t0"))
    return baselines.over_horizon(last, 12).withColumn("t", F.pmod(F.col("t0") + F.col("h"), F.lit(24)))


POINTS = [i * 5.0 for i in range(0, 60)]
DENSITY = """st as (select user_id as pid, count(*) as n, stddev_samp(value) as sd from events group by 1 having count(*) >= 60 and stddev_samp(value) > 0),
 gx as (select unnest(range(0, 60)) * 5.0 as x), bw as (select pid, n, sd * pow(n, -0.2) as h from st)"""


@query("c15_values_grid", "pid:l x:f density:f", f"""with {DENSITY} select b.pid, x, sum(exp(-0.5 * pow((x - e.value) / h, 2))) / (n * h * sqrt(2 * pi())) as density
 from bw b join events e on e.user_id = b.pid, gx group by b.pid, x, n, h""")
def c15(spark, sf):
    return joins.kernel_density(S.readings(spark, sf), "pid", "value", POINTS, min_n=60)


@query("c16_scored_positions", "pid:l slot:l truth:f pred:f", f"""with {LINE} select pid, slot, hrv as truth, case when slot % 4 = 0 then null else coalesce(prev, next) end as pred from ends where hrv is not null and slot % 2 = 0""")
def c16(spark, sf):
    near = fills.nearest(hubs.grid_table(spark, sf), ["pid"])
    truth = near.select("pid", "slot", F.col("hrv").alias("truth"), ((F.col("slot") % 2 == 0) & F.col("hrv").isNotNull()).alias("scored"))
    return joins.at_scored(truth, near.where("slot % 4 <> 0").select("pid", "slot", F.coalesce("prev", "next").alias("pred")), ["pid", "slot"])


@query("c17_complete_pairs", "pid:l balance:f watch:f", "with m as (select user_id as pid, median(value) as watch from events group by 1 having count(*) >= 60) select c_custkey as pid, c_acctbal as balance, watch from customer join m on pid = c_custkey")
def c17(spark, sf):
    med = core.exact_quantiles(S.readings(spark, sf), ["pid"], "value", {"watch": 0.5}).where("n >= 60")
    c = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_acctbal").alias("balance"))
    return joins.complete_pairs(c, med, ["pid"], "balance", "watch")


@query("c18_consecutive_pairs", "pid:l slot:l hrv:f next_value:f gap:l", f"with {S.GRID}, o as (select pid, slot, hrv, lead(hrv) over w as next_value, lead(slot) over w - slot as gap from grid where hrv is not null window w as (partition by pid order by slot)) select * from o where gap <= 3")
def c18(spark, sf):
    return fills.consecutive_pairs(hubs.grid_table(spark, sf), ["pid"], 3)


@query("c19_default_tuned_reference", "model:s test:s default_mae:f tuned_mae:f reference_mae:f", f"""with {S.RUNS}, m as (select model, test, seed, min(mae) as mae from runs group by 1, 2, 3)
select a.model, a.test, a.mae as default_mae, b.mae as tuned_mae, r.mae as reference_mae from m a left join m b on a.model = b.model and a.test = b.test and b.seed = 1
 left join m r on r.model = 'm0' and r.test = a.test and r.seed = 0 where a.seed = 0""")
def c19(spark, sf):
    m = S.runs(spark, sf).groupBy("model", "test", "seed").agg(F.min("mae").alias("mae"))
    pair = joins.side_by_side({"default_mae": m.where("seed = 0"), "tuned_mae": m.where("seed = 1")}, ["model", "test"], "mae")
    return pair.join(m.where("model = 'm0' and seed = 0").select("test", F.col("mae").alias("reference_mae")), "test", "left")


@query("c20_vector_cache", "vec_id:l cached:l norm:f", "select vec_id, case when vec_id % 3 <> 0 then 1 else 0 end as cached, sqrt(list_sum([cast(x as double) * cast(x as double) for x in embedding])) as norm from embeddings")
def c20(spark, sf):
    e = S.table(spark, sf, "embeddings")
    norm = lambda d: d.select("vec_id", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm"))
    cache = norm(e.where("vec_id % 3 <> 0")).withColumn("cached", F.lit(1))
    fresh, everything = joins.fill_cache(e.select("vec_id"), cache, ["vec_id"], lambda miss: norm(e.join(miss, "vec_id", "left_semi")).withColumn("cached", F.lit(0)))
    return everything


@query("c21_pair_counts", "a:s b:s n:l", """with w as (select case when l_linenumber % 2 = 0 then l_quantity end as q, case when l_linenumber % 3 = 0 then l_discount end as d, case when l_linenumber % 5 = 0 then l_tax end as t from lineitem)
select 'q' as a, 'd' as b, count(*) filter (q is not null and d is not null) as n from w union all select 'q', 't', count(*) filter (q is not null and t is not null) from w union all select 'd', 't', count(*) filter (d is not null and t is not null) from w""")
def c21(spark, sf):
    n = F.col("l_linenumber")
    w = S.table(spark, sf, "lineitem").select(F.when(n % 2 == 0, F.col("l_quantity")).alias("q"), F.when(n % 3 == 0, F.col("l_discount")).alias("d"), F.when(n % 5 == 0, F.col("l_tax")).alias("t"))
    return joins.pair_counts(w, ["q", "d", "t"])


# ------------------------------------------------------------------ set operations
@query("g01_union_cohorts", "cohort:s pid:l n:l", "select case when user_id % 2 = 0 then 'even' else 'odd' end as cohort, user_id as pid, count(*) as n from events group by 1, 2")
def g01(spark, sf):
    r = S.readings(spark, sf)
    both = r.where("pid % 2 = 0").withColumn("cohort", F.lit("even")).unionByName(r.where("pid % 2 <> 0").withColumn("cohort", F.lit("odd")))
    return both.groupBy("cohort", "pid").agg(F.count(F.lit(1)).alias("n"))


@query("g02_distinct_starts", "pid:l start_d:d", f"with {S.EPISODES} select distinct pid, start_d from episodes")
def g02(spark, sf):
    return S.episodes(spark, sf).dropDuplicates(["pid", "start"]).select("pid", F.col("start").alias("start_d"))


@query("g03_except", "pid:l", "select c_custkey as pid from customer except select user_id from events where event_type = 'error'")
def g03(spark, sf):
    return S.table(spark, sf, "customer").select(F.col("c_custkey").alias("pid")).subtract(
        S.table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("pid")))


@query("g04_disjoint_parts", "pair:s shared:l", "select unnest(['train/held', 'train/test', 'held/test']) as pair, 0 as shared from (select 1) x")
def g04(spark, sf):
    from pulsegrid.operators import quality, sampling
    units = cohort.subject_strata(S.scored_days(spark, sf))
    parts = sampling.nested_draw(units, ["grp", "pos"], 0.3, 0.2, 7)
    return quality.shared_subjects({p: parts.where(F.col("part") == p) for p in ("train", "held", "test")}, "pid")
