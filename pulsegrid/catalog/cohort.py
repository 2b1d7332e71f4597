"""Cohort statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import standins as S
from pulsegrid.catalog.joins import DENSITY, POINTS
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.windows import GAPS
from pulsegrid.functions import clean, scaling
from pulsegrid.operators import cohort, core, episodes, fills, joins, segments, sheet, timeline
from pulsegrid.plans import hubs
from pulsegrid.sources.stage import materialise

ROSTER = "roster as (select c_custkey as pid, date '2024-01-05' + cast(c_custkey % 10 as integer) as enrolled from customer)"


def roster(spark, sf):
    return S.table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), F.date_add(F.lit("2024-01-05").cast("date"), (F.col("c_custkey") % 10).cast("int")).alias("enrolled"))


@query("d05_presence", "pid:l readings:l span_days:l hr:l hrv:l hr_since:l hrv_since:l days_with_data:l before_enrolment:l last_reading:t days_since_enrolment:l", f"""with {S.SIGNALS}, {ROSTER}, e as (select max(cast(ts as date)) as e from signals)
select r.pid, count(s.ts) as readings, case when count(s.ts) = 0 then 0 else floor((floor(epoch(max(s.ts))) - floor(epoch(min(s.ts)))) / 86400) + 1 end as span_days, count(*) filter (vital = 'hr') as hr, count(*) filter (vital = 'hrv') as hrv,
 count(*) filter (vital = 'hr' and s.ts >= enrolled) as hr_since, count(*) filter (vital = 'hrv' and s.ts >= enrolled) as hrv_since, count(distinct case when s.ts >= enrolled then cast(s.ts as date) end) as days_with_data,
 count(*) filter (s.ts < enrolled) as before_enrolment, date_trunc('second', max(s.ts)) as last_reading, (select e from e) - enrolled + 1 as days_since_enrolment from roster r left join signals s on s.pid = r.pid group by r.pid, enrolled""")
def d05(spark, sf):
    p = cohort.presence(S.signals(spark, sf), roster(spark, sf), ["hr", "hrv"])
    return p.withColumn("last_reading", core.slot_start(core.epoch_seconds("last_reading"), 1))


@query("d06_since_enrolment", "pid:l rel_day:l n:l", f"""with {ROSTER}, d as (select e.user_id as pid, cast(ts as date) - enrolled as k, count(*) as n from events e join roster r on r.pid = e.user_id where ts >= enrolled group by 1, 2),
 ax as (select pid, unnest(range(min(k), max(k) + 1)) as k from d group by 1) select ax.pid, ax.k as rel_day, coalesce(n, 0) as n from ax left join d on d.pid = ax.pid and d.k = ax.k""")
def d06(spark, sf):
    return cohort.since_enrolment(S.readings(spark, sf), roster(spark, sf))


def gap_table(spark, sf):
    return materialise(fills.reading_gaps(S.readings(spark, sf), ["pid"]), "gaps")


@query("d07_missingness", "pid:l readings:l days:l coverage:f median_gap:f p90_gap:f longest_gap_h:f", f"""with {ROSTER}, {GAPS}, m as (select pid, count(*) as readings, count(distinct cast(ts as date)) as days,
 100.0 * count(*) / nullif((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60 / 600, 0) as coverage, median(gap) as median_gap, quantile_cont(gap, 0.9) as p90_gap, max(gap) / 60 as longest_gap_h from rg group by 1)
select r.pid, coalesce(readings, 0) as readings, case when readings >= 2 then days else 0 end as days, case when readings >= 2 then coverage end as coverage, median_gap, p90_gap, longest_gap_h from roster r left join m on m.pid = r.pid""")
def d07(spark, sf):
    return cohort.missingness(gap_table(spark, sf), roster(spark, sf), 600)


@query("d08_gap_histogram", "bin:l n:l", f"with {GAPS} select least(floor(gap / 60), 23) as bin, count(*) as n from rg where gap between 0 and 1440 group by 1")
def d08(spark, sf):
    return cohort.histogram(fills.reading_gaps(S.readings(spark, sf), ["pid"]), [], "gap", 0, 60, 24)


@query("d08_gap_log_histogram", "bin:l n:l", f"""with {GAPS}, l as (select log10(gap) as v from rg where gap > 0), e as (select min(v) as a, max(v) as b from l)
select least(floor((v - a) * 80 / (b - a)), 79) as bin, count(*) as n from l, e group by 1""")
def d08b(spark, sf):
    g = gap_table(spark, sf).where("gap > 0").select(F.log10("gap").alias("v"))
    return cohort.spread_histogram(g, "v", 80)


@query("d09_gap_shares", "threshold:f at_most:f above:f exact:f", f"""with {GAPS}, g as (select floor(gap) as gap from rg where gap is not null), t as (select unnest([10.0, 60.0, 360.0, 1440.0]) as threshold)
select threshold, 100 * avg(case when gap <= threshold then 1.0 else 0 end) as at_most, 100 - 100 * avg(case when gap <= threshold then 1.0 else 0 end) as above, 100 * avg(case when gap = 600 then 1.0 else 0 end) as exact from g, t group by 1""")
def d09(spark, sf):
    g = fills.reading_gaps(S.readings(spark, sf), ["pid"]).select(F.floor("gap").alias("gap"))
    return cohort.shares(g, "gap", [10, 60, 360, 1440], 600)


@query("d10_daily_counts", "pid:l date:d n:l coverage:f", """with d as (select user_id as pid, cast(ts as date) as d, count(*) as n from events group by 1, 2),
 ax as (select pid, cast(unnest(range(min(d)::timestamp, max(d)::timestamp + interval 1 day, interval 1 day)) as date) as d from d group by 1)
select ax.pid, ax.d as date, coalesce(n, 0) as n, 100.0 * coalesce(n, 0) / 144 as coverage from ax left join d on d.pid = ax.pid and d.d = ax.d""")
def d10(spark, sf):
    return timeline.daily_counts(S.readings(spark, sf), ["pid"]).withColumn("coverage", 100 * F.col("n") / 144)


@query("d11_kept_at_cuts", "cut:f kept:l", """with m as (select user_id, 100.0 * count(*) / nullif((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60 / 600, 0) as coverage from events group by 1), c as (select unnest(range(0, 101, 5)) * 1.0 as cut)
select cut, count(*) filter (coverage >= cut) as kept from m, c group by 1""")
def d11(spark, sf):
    r = S.readings(spark, sf)
    per = r.groupBy("pid").agg((100 * F.count(F.lit(1)) / F.try_divide((core.epoch_seconds(F.max("ts")) - core.epoch_seconds(F.min("ts"))) / 60, F.lit(600))).alias("coverage"))
    return cohort.kept_at_cuts(per, "coverage", [float(c) for c in range(0, 101, 5)])


@query("d12_fixed_histogram", "kind:s bin:l n:l total:l median:f", """with v as (select event_type as kind, value from events), m as (select kind, count(*) as total, median(value) as median from v group by 1),
 h as (select kind, least(floor((value - 0) / 10), 19) as bin, count(*) as n from v where value between 0 and 200 group by 1, 2) select h.kind, bin, n, total, median from h join m on m.kind = h.kind""")
def d12(spark, sf):
    v = S.table(spark, sf, "events").select(F.col("event_type").alias("kind"), "value")
    med = core.exact_quantiles(v, ["kind"], "value", {"median": 0.5}).withColumnRenamed("n", "total")
    return cohort.histogram(v, ["kind"], "value", 0, 10, 20).join(med, "kind")


FINE = [i * 1.0 for i in range(0, 300)]


@query("d13_density", "pid:l x:f density:f", "with " + DENSITY.replace("range(0, 60)) * 5.0", "range(0, 300)) * 1.0").replace(">= 60", ">= 70") + """
select b.pid, x, sum(exp(-0.5 * pow((x - e.value) / h, 2))) / (n * h * sqrt(2 * pi())) as density from bw b join events e on e.user_id = b.pid, gx group by b.pid, x, n, h""")
def d13(spark, sf):
    return joins.kernel_density(S.readings(spark, sf), "pid", "value", FINE, min_n=70)


@query("d14_rich_medians", "pid:l n:l median:f", "select user_id as pid, count(*) as n, median(value) as median from events group by 1 having count(*) >= 60")
def d14(spark, sf):
    return cohort.rich_medians(S.readings(spark, sf), ["pid"], "value", 60)


STATE = f"""{S.STRETCHES}, fl as (select distinct pid, unnest(range(cast(floor(epoch(start_ts) / 60) as bigint), cast(floor(epoch(end_ts) / 60) as bigint) + 1)) as slot from stretches),
 st as (select e.user_id as pid, e.value, case when f.slot is null then 0 else 1 end as s from events e left join fl f on f.pid = e.user_id and f.slot = cast(floor(epoch(e.ts) / 60) as bigint))"""


@query("d15_inside_outside", "pid:l inside:f outside:f n_inside:l n_outside:l diff:f", f"""with {STATE}, m as (select pid, median(value) filter (s = 1) as inside, median(value) filter (s = 0) as outside, count(*) filter (s = 1) as n_inside, count(*) filter (s = 0) as n_outside from st group by 1)
select *, inside - outside as diff from m where n_inside >= 3 and n_outside >= 10""".replace("n_outside >= 10", "n_outside >= 3"))
def d15(spark, sf):
    on = timeline.covered_minutes(S.stretches(spark, sf), ["pid"]).withColumn("rest", F.lit(1))
    r = S.table(spark, sf, "events").select(F.col("user_id").alias("pid"), core.slot_of("ts", 60).alias("slot"), "value")
    return cohort.two_states(r.join(on, ["pid", "slot"], "left"), ["pid"], "rest", "value", 3).orderBy("diff", "pid")


DAY0 = f"""{S.EPISODES}, u as (select user_id as pid, median(value) filter (event_type <> 'purchase') as usual from events group by 1),
 dm as (select user_id as pid, cast(ts as date) as d, median(value) filter (event_type <> 'purchase') as med, count(*) filter (event_type = 'purchase') / 6.0 as hours from events group by 1, 2),
 uh as (select pid, median(hours) as usual_hours from dm where hours > 0 group by 1)"""


def _day_facts(spark, sf):
    e = S.table(spark, sf, "events").withColumnRenamed("user_id", "pid").withColumn("date", F.to_date("ts"))
    hours = e.groupBy("pid", "date").agg((F.count_if(F.col("event_type") == "purchase") / 6.0).alias("hours"))
    med = core.exact_quantiles(e.where("event_type <> 'purchase'"), ["pid", "date"], "value", {"med": 0.5}).drop("n")
    return hours.join(med, ["pid", "date"], "left")


@query("d16_day0_vs_usual", "pid:l event:l day0:f usual:f hours_day0:f hours_usual:f above:l", f"""with {DAY0}
select e.pid, e.ordinal as event, dm.med as day0, u.usual, nullif(dm.hours, 0) as hours_day0, uh.usual_hours as hours_usual, case when dm.med > u.usual then 1 else 0 end as above
 from episodes e left join dm on dm.pid = e.pid and dm.d = e.start_d left join u on u.pid = e.pid left join uh on uh.pid = e.pid""")
def d16(spark, sf):
    days = _day_facts(spark, sf)
    ev = S.episodes(spark, sf).select("pid", F.col("start").alias("date"), F.col("ordinal").alias("event"))
    r = S.table(spark, sf, "events").where("event_type <> 'purchase'").select(F.col("user_id").alias("pid"), "value")
    usual = core.exact_quantiles(r, ["pid"], "value", {"usual": 0.5}).drop("n")
    hours = core.exact_quantiles(days.where("hours > 0"), ["pid"], "hours", {"hours_usual": 0.5}).drop("n")
    j = ev.join(days, ["pid", "date"], "left").join(usual, "pid", "left").join(hours, "pid", "left")
    return j.select("pid", "event", F.col("med").alias("day0"), "usual", F.nullif("hours", F.lit(0.0)).alias("hours_day0"), "hours_usual",
                    F.coalesce(F.col("med") > F.col("usual"), F.lit(False)).alias("above"))


@query("d17_around_events", "event:l rel_day:l med:f hours:f", f"with {DAY0} select e.ordinal as event, dm.d - e.start_d as rel_day, dm.med, dm.hours from episodes e join dm on dm.pid = e.pid and dm.d - e.start_d between -14 and 14")
def d17(spark, sf):
    ev = S.episodes(spark, sf).select("pid", F.col("start").alias("anchor"), F.col("ordinal").alias("event"))
    return episodes.around_events(_day_facts(spark, sf), ev, 14, 14, ["event"])


BLOCKS = f"""{S.STRETCHES}, rest as (select * from stretches where vital = 'rest'),
 fl as (select distinct pid, unnest(range(cast(floor(epoch(start_ts) / 60) as bigint), cast(floor(epoch(end_ts) / 60) as bigint) + 1)) as slot from rest),
 stg as (select pid, cast(floor(epoch(start_ts) / 60) as bigint) as slot, sum(case when k % 3 = 0 then value else 0 end) as deep, sum(case when k % 3 = 1 then value else 0 end) as light, sum(case when k % 3 = 2 then value else 0 end) as awake from rest group by 1, 2),
 rd as (select user_id as pid, cast(floor(epoch(ts) / 60) as bigint) as slot, avg(value) as hrv from events group by 1, 2),
 bl as (select pid, slot, slot - row_number() over (partition by pid order by slot) as isl from fl),
 bk as (select b.pid, min(b.slot) as a, sum(coalesce(deep, 0)) as deep, sum(coalesce(light, 0)) as light, sum(coalesce(awake, 0)) as awake, count(hrv) as n_hrv, avg(hrv) as hrv, count(*) as minutes
  from bl b left join stg s on s.pid = b.pid and s.slot = b.slot left join rd r on r.pid = b.pid and r.slot = b.slot group by b.pid, isl),
 blocks as (select *, deep + light + awake as scored from bk where deep + light + awake > 0)"""


def sleep_blocks(spark, sf):
    rest = S.stretches(spark, sf).where("vital = 'rest'")
    on = timeline.covered_minutes(rest, ["pid"]).withColumn("rest", F.lit(1))
    part = lambda i: F.when(F.col("k") % 3 == i, F.col("value")).otherwise(0.0)
    stages = rest.select("pid", core.slot_of("start", 60).alias("slot"), part(0).alias("deep"), part(1).alias("light"), part(2).alias("awake"))
    stages = timeline.merge_duplicates(stages, ["pid"], "slot", ["deep", "light", "awake"])
    rd = S.readings(spark, sf).groupBy("pid", core.slot_of("ts", 60).alias("slot")).agg(F.avg("value").alias("hrv"))
    marked = segments.flag_blocks(on, ["pid"], "rest")
    return segments.block_stages(marked.join(stages, ["pid", "slot"], "left").join(rd, ["pid", "slot"], "left"), ["pid"], ["deep", "light", "awake"], "hrv")


@query("d18_block_stages", "pid:l a:l deep:f light:f awake:f n_hrv:l hrv:f minutes:l scored:f deep_pct:f", f"with {BLOCKS} select pid, a, deep, light, awake, n_hrv, hrv, minutes, scored, 100 * deep / scored as deep_pct from blocks")
def d18(spark, sf):
    return sleep_blocks(spark, sf)


@query("d19_stage_shares", "pid:l deep_pct:f light_pct:f awake_pct:f", f"with {BLOCKS} select pid, 100 * sum(deep) / sum(scored) as deep_pct, 100 * sum(light) / sum(scored) as light_pct, 100 * sum(awake) / sum(scored) as awake_pct from blocks group by rollup(pid)")
def d19(spark, sf):
    return segments.stage_shares(sleep_blocks(spark, sf), "pid", ["deep", "light", "awake"])


@query("d20_dominant_stage", "pid:l deep:f light:f diff:f", f"""with {BLOCKS}, d as (select pid, case when 100 * deep / scored >= 70 then 'deep' when 100 * light / scored >= 70 then 'light' end as dom, hrv from blocks where n_hrv >= 1),
 p as (select pid, median(hrv) filter (dom = 'deep') as deep, median(hrv) filter (dom = 'light') as light from d group by 1) select *, deep - light as diff from p where deep is not null and light is not null""")
def d20(spark, sf):
    return segments.dominant_contrast(sleep_blocks(spark, sf), "pid", ["deep", "light"], "hrv", 70, 1)


@query("d21_section_completeness", "section:s columns:l pct:f sheet_order:l", f"""with {S.SHEET}, c as (select section, col_no, avg(case when txt is not null and upper(trim(txt)) not in ('ND','NK','NA','NIL','-','','NAN') then 1.0 else 0 end) as f from sheet where name <> 'id' group by 1, 2)
select section, count(*) as columns, 100 * avg(f) as pct, min(col_no) as sheet_order from c group by 1""")
def d21(spark, sf):
    return sheet.section_completeness(sheet.decode_sheet(S.sheet_cells(spark, sf)), skip=["id"])


FIND = "with f as (select case o_orderkey % 4 when 0 then 1 when 1 then 0 when 2 then 0 end as cough, case o_orderkey % 3 when 0 then 1 when 1 then 0 end as smoke, case when o_orderstatus = 'P' then 1 else 0 end as club from orders)"


@query("d22_yes_counts", "grp:s finding:s yes:l known:l", FIND + """ select 'symptoms' as grp, 'cough' as finding, sum(cough) as yes, count(cough) as known from f
 union all select 'history', 'smoke', sum(smoke), count(smoke) from f union all select 'examination', 'club', sum(club), count(club) from f""")
def d22(spark, sf):
    k = F.col("o_orderkey")
    code = F.when(k % 4 == 0, "1").when(k % 4 == 1, "2").when(k % 4 == 2, "0").otherwise("NK")
    f = S.table(spark, sf, "orders").select(clean.yes_no(code).alias("cough"), F.when(k % 3 == 0, 1).when(k % 3 == 1, 0).alias("smoke"), (F.col("o_orderstatus") == "P").cast("int").alias("club"))
    return cohort.yes_counts(f, {"cough": "symptoms", "smoke": "history", "club": "examination"})


@query("d23_category_counts", "category:s n:l place:l", """with c as (select case trim(case when o_orderkey % 10 = 0 then '' else o_orderstatus end) when 'F' then 'finished' when 'O' then 'open' when '' then 'not recorded' end as category from orders)
select category, count(*) as n, case category when 'finished' then 0 when 'open' then 1 else 3 end as place from c where category is not null group by 1""")
def d23(spark, sf):
    o = S.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.lower("o_orderstatus")).alias("s"))
    return cohort.category_counts(o, F.col("s"), {"F": "finished", "O": "open", "X": "none of them"})


@query("d24_test_status", "test:s available:l normal:l abnormal:l coded_0:l blank:l", """with t as (select l_linenumber as av, case l_orderkey % 4 when 0 then '0' when 1 then '1 ' when 2 then '2' else '' end as r1, case when l_suppkey % 2 = 0 then '1' end as r2 from lineitem)
select 'xray' as test, count(*) filter (av = 1) as available, count(*) filter (trim(r1) = '1') as normal, count(*) filter (trim(r1) = '2') as abnormal, count(*) filter (trim(r1) = '0') as coded_0, count(*) filter (coalesce(trim(r1), '') = '') as blank from t
 union all select 'echo', count(*) filter (av = 1), count(*) filter (r2 = '1'), count(*) filter (r2 = '2'), count(*) filter (r2 = '0'), count(*) filter (r2 is null) from t""")
def d24(spark, sf):
    k = F.col("l_orderkey")
    t = S.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("av"), F.when(k % 4 == 0, "0").when(k % 4 == 1, "1 ").when(k % 4 == 2, "2").otherwise("").alias("r1"), F.when(F.col("l_suppkey") % 2 == 0, "1").alias("r2"))
    return cohort.test_status(t, {"xray": ("av", "r1"), "echo": ("av", "r2")})


ITEMS = "with i as (select p_partkey as pid, upper(split_part(p_name, ' ', 1)) as t1, case when p_size % 2 = 0 then p_type else '0' end as t2, case when p_size % 3 = 0 then p_brand else '' end as t3 from part), n as (select t1, (case when t1 not in ('', '0', 'NAN') then 1 else 0 end) + (case when t2 not in ('', '0', 'NAN') then 1 else 0 end) + (case when t3 not in ('', '0', 'NAN') then 1 else 0 end) as items from i)"


def _items(spark, sf):
    p = S.table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("t1"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("0").alias("t2"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise("").alias("t3"))
    return cohort.items_listed(p, ["t1", "t2", "t3"])


@query("d25_items_listed", "items:l n:l", ITEMS + " select items, count(*) as n from n group by 1")
def d25(spark, sf):
    return cohort.value_counts(_items(spark, sf), ["items"])


@query("d25_first_listed", "first_listed:s n:l", ITEMS + " select t1 as first_listed, count(*) as n from n group by 1")
def d25b(spark, sf):
    return cohort.value_counts(_items(spark, sf), ["first_listed"]).orderBy(F.desc("n"), "first_listed")


@query("d26_value_counts", "segment:s nation:l n:l", "select c_mktsegment as segment, c_nationkey as nation, count(*) as n from customer group by 1, 2")
def d26(spark, sf):
    return cohort.value_counts(S.table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"]).withColumnsRenamed({"c_mktsegment": "segment", "c_nationkey": "nation"})


@query("d26_events_per_subject", "pid:l events:l", "select c_custkey as pid, count(user_id) as events from customer left join (select user_id from events where event_type = 'error') e on user_id = c_custkey group by 1")
def d26b(spark, sf):
    ev = S.table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("pid"))
    return cohort.events_per_subject(S.table(spark, sf, "customer").select(F.col("c_custkey").alias("pid")), ev)


MEASURES = "w as (select case when l_linenumber % 2 = 0 then l_quantity end as q, l_extendedprice as p, case when l_linenumber % 3 > 0 then l_discount end as d from lineitem)"


def measures(spark, sf):
    n = F.col("l_linenumber")
    return S.table(spark, sf, "lineitem").select(F.when(n % 2 == 0, F.col("l_quantity")).alias("q"), F.col("l_extendedprice").alias("p"), F.when(n % 3 > 0, F.col("l_discount")).alias("d"))


PAIRS = f"""{MEASURES}, pr as (select 'q' as a, 'p' as b, q as x, p as y from w union all select 'q', 'd', q, d from w union all select 'p', 'd', p, d from w),
 rk as (select *, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0 as rx, rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2.0 as ry from pr where x is not null and y is not null),
 cr as (select a, b, count(*) as n, corr(x, y) as pearson, corr(rx, ry) as spearman from rk group by 1, 2)"""


@query("d27_correlations", "a:s b:s n:l pearson:f spearman:f", f"with {PAIRS} select * from cr")
def d27(spark, sf):
    return cohort.correlations(measures(spark, sf), ["q", "p", "d"])


@query("d28_agreement", "r:f n:l median_diff:f", f"with {MEASURES} select corr(q, d) as r, count(*) as n, median(d - q) as median_diff from w where q is not null and d is not null")
def d28(spark, sf):
    return cohort.agreement(measures(spark, sf), "q", "d")


@query("d31_log_stats", "pid:l log_mean:f log_sd:f", """select user_id as pid, avg(ln(value)) as log_mean, greatest(coalesce(stddev_samp(ln(value)), 1.0), 1e-3) as log_sd from events where value > 0 group by 1
 union all select null, avg(ln(value)), greatest(stddev_samp(ln(value)), 1e-3) from events where value > 0""")
def d31(spark, sf):
    each, every = scaling.log_stats(S.readings(spark, sf), "pid", "value")
    return each.unionByName(every.withColumn("pid", F.lit(None).cast("long")))


RHYTHM = S.GRID + """, ly as (select pid, slot, slot % 4 as t, case when hrv > 0 then ln(hrv) end as y from grid),
 q as (select pid, count(*) as n, avg(y) as my, avg(cos(2 * pi() * t / 4)) as mc, avg(sin(2 * pi() * t / 4)) as ms, covar_pop(cos(2 * pi() * t / 4), cos(2 * pi() * t / 4)) as cc, covar_pop(cos(2 * pi() * t / 4), sin(2 * pi() * t / 4)) as cs,
  covar_pop(sin(2 * pi() * t / 4), sin(2 * pi() * t / 4)) as ss, covar_pop(y, cos(2 * pi() * t / 4)) as cy, covar_pop(y, sin(2 * pi() * t / 4)) as sy from ly where y is not null group by 1),
 b as (select *, case when abs(cc * ss - cs * cs) > 1e-9 then (cy * ss - sy * cs) / (cc * ss - cs * cs) else 0 end as b_cos, case when abs(cc * ss - cs * cs) > 1e-9 then (sy * cc - cy * cs) / (cc * ss - cs * cs) else 0 end as b_sin from q),
 fit as (select pid, n, my - b_cos * mc - b_sin * ms as b0, b_cos, b_sin from b),
 res as (select l.pid, l.slot, l.y - (b0 + b_cos * cos(2 * pi() * t / 4) + b_sin * sin(2 * pi() * t / 4)) as r from ly l join fit f on f.pid = l.pid),
 lagged as (select *, lag(r) over (partition by pid order by slot) as p from res),
 ar as (select pid, case when count(*) filter (p is not null and r is not null) > 3 then least(greatest(corr(p, r) filter (p is not null and r is not null), 0), 0.99) else 0.5 end as rho, greatest(var_pop(r), 1e-4) as variance from lagged group by 1)"""


@query("d33_rhythm_fit", "pid:l n:l b0:f b_cos:f b_sin:f", f"with {RHYTHM} select * from fit")
def d33(spark, sf):
    from pulsegrid.plans import rhythm
    return rhythm.fit(rhythm.log_grid(hubs.main_grid(spark, sf), 4), ["pid"], 4)


@query("d32_lag_one", "pid:l rho:f variance:f", f"with {RHYTHM} select * from ar")
def d32(spark, sf):
    from pulsegrid.plans import rhythm
    g = rhythm.log_grid(hubs.grid_table(spark, sf), 4)
    return cohort.lag_one(rhythm.residuals(g, rhythm.fit(g, ["pid"], 4), ["pid"], 4), ["pid"], "residual")


@query("d34_step_variance", "pid:l steps:l step_var:f", f"with {S.GRID}, o as (select pid, hrv, lead(hrv) over (partition by pid order by slot) as nx from grid where hrv is not null) select pid, count(*) as steps, var_pop(nx - hrv) as step_var from o where nx is not null group by 1")
def d34(spark, sf):
    return cohort.step_variance(hubs.grid_table(spark, sf), ["pid"])
