"""Projections, filters and scalar functions (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import standins as S
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.sources import DATE_PARTS, date_parts
from pulsegrid.functions import clean, dates, scaling
from pulsegrid.operators import daystore, sheet
from pulsegrid.operators import features as feat
from pulsegrid.sources import readings as R


@query("b01_floor_minute", "event_id:l minute:t", "select event_id, date_trunc('minute', ts) as minute from events")
def b01(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss.SSS"))
    text = F.when(F.col("event_id") % 2 == 0, text).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    e = S.table(spark, sf, "events").select("event_id", text.alias("iso"))
    return e.select("event_id", dates.floor_minute(dates.parse_iso(F.col("iso"))).alias("minute"))


@query("b02_earliest", "pid:l n:l", "select user_id as pid, count(*) as n from events where ts >= timestamp '2024-01-10 12:00:00' group by 1")
def b02(spark, sf):
    return R.drop_before(S.readings(spark, sf), "ts", "2024-01-10 12:00:00").groupBy("pid").agg(F.count(F.lit(1)).alias("n"))


@query("b03_numeric", "id:l x:f", f"""with {S.CELLS} select id, case when regexp_full_match(trim(cell), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
 then try_cast(trim(cell) as double) end as x from cells""")
def b03(spark, sf):
    return S.sheet_text(spark, sf).select("id", clean.numeric(F.col("cell")).alias("x"))


@query("b04_missing_tokens", "id:l x:f filled:l", f"""with {S.CELLS} select id, {S.NUM} as x,
 case when cell is not null and upper(trim(cell)) not in ('ND','NK','NA','NIL','-','','NAN') then 1 else 0 end as filled from cells""")
def b04(spark, sf):
    return S.sheet_text(spark, sf).select("id", clean.clean_number(F.col("cell")).alias("x"), clean.is_filled(F.col("cell")).alias("filled"))


@query("b05_yes_no", "id:l x:f", f"""with {S.CELLS}, c as (select id, {S.NUM} as v from cells)
select id, case when v = 1 then 1.0 when v in (0, 2) then 0.0 end as x from c""")
def b05(spark, sf):
    return S.sheet_text(spark, sf).select("id", clean.yes_no(F.col("cell")).alias("x"))


_GRADE = """case o_orderpriority when '1-URGENT' then ' iv' when '2-HIGH' then 'III-iv' when '3-MEDIUM' then 'II' when '5-LOW' then '0-I ' else 'x' end"""


@query("b06_grade_midpoint", "id:l x:f", f"""with g as (select o_orderkey as id, upper(trim({_GRADE})) as t from orders)
select id, case t when '0' then 0.0 when '0-I' then 0.5 when 'I' then 1.0 when 'I-II' then 1.5 when 'II' then 2.0 when 'II-III' then 2.5
 when 'III' then 3.0 when 'III-IV' then 3.5 when 'IV' then 4.0 end as x from g""")
def b06(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_GRADE).alias("t"))
    return o.select("id", clean.grade_midpoint(F.col("t")).alias("x"))


@query("b07_decode", "id:l sex:s control:s plan:s", """with c as (select o_orderkey as id, o_orderkey % 5 as k from orders)
select id, case k when 1 then 'male' when 2 then 'female' when 3 then 'other' end as sex,
 case k when 1 then 'controlled' when 2 then 'partly' when 3 then 'uncontrolled' end as control,
 case k when 1 then 'step_up' when 2 then 'step_down' when 3 then 'same' end as plan from c""")
def b07(spark, sf):
    c = (F.col("o_orderkey") % 5).cast("string")
    return S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), *[clean.decode(c, f).alias(f) for f in ("sex", "control", "plan")])


@query("b08_duration", "id:l x:f", f"""with {S.CELLS}, n as (select id, upper(trim(cell)) as t, regexp_extract_all(cell, '[0-9]+(?:\\.[0-9]+)?') as f from cells)
select id, case when t like '%MIN%' then null when len(f) > 0 then list_avg([cast(x as double) for x in f]) end as x from n""")
def b08(spark, sf):
    return S.sheet_text(spark, sf).select("id", clean.duration_days(F.col("cell")).alias("x"))


@query("b09_swapped_headers", "id:l low:f high:f swapped:l", """with p as (select l_orderkey * 10 + l_linenumber as id, l_quantity as sys, l_extendedprice as dia from lineitem),
 r as (select avg(case when sys < dia then 1.0 else 0.0 end) > 0.9 as s from p where sys is not null and dia is not null)
select id, case when s then dia else sys end as low, case when s then sys else dia end as high, cast(s as integer) as swapped from p, r""")
def b09(spark, sf):
    p = S.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                                              F.col("l_quantity").alias("low"), F.col("l_extendedprice").alias("high"))
    return sheet.repair_swapped(p, "low", "high")


@query("b10_plausible", "id:l age:f offending:l", """select p_partkey as id, case when p_retailprice / 10 between 95 and 120 then p_retailprice / 10 end as age,
 case when p_retailprice / 10 < 95 or p_retailprice / 10 > 120 then 1 else 0 end as offending from part""")
def b10(spark, sf):
    a = F.col("p_retailprice") / 10
    kept = clean.plausible(a, 95, 120)
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), kept.alias("age"), (a.isNotNull() & kept.isNull()).alias("offending"))


_TWO = """two as (select o_orderkey as id, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%d-%m-%Y') when 1 then '01-06-20260'
 when 2 then strftime(o_orderdate, '%d/%m/%Y') else null end as watch, strftime(o_orderdate, '%d.%m.%Y') as plan from orders)"""


@query("b11_enrolment", "id:l enrolment:d source:l", f"""with {_TWO}, p as (select id, case when regexp_full_match(replace(watch, '/', '-'), '[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}')
 then try_strptime(replace(watch, '/', '-'), '%d-%m-%Y') end as a, try_strptime(plan, '%d.%m.%Y') as b from two)
select id, coalesce(a, b) as enrolment, case when a is not null then 1 else 2 end as source from p""")
def b11(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    watch = F.when(k % 4 == 0, F.date_format(d, "dd-MM-yyyy")).when(k % 4 == 1, "01-06-20260").when(k % 4 == 2, F.date_format(d, "dd/MM/yyyy"))
    t = S.table(spark, sf, "orders").select(k.alias("id"), watch.alias("watch"), F.date_format(d, "dd.MM.yyyy").alias("plan"))
    when, source = sheet.enrolment_date("watch", "plan", dates.day_first)
    return t.select("id", when.alias("enrolment"), source.alias("source"))


@query("b12_severity", "id:l score:f", """with p as (select l_orderkey * 10 + l_linenumber as id, case when l_linenumber % 5 = 0 then null else l_quantity end as bmi,
 l_discount * 1000 as fev, l_linenumber % 5 as grade, l_extendedprice / 100 as walk from lineitem)
select id, case when bmi <= 21 then 1.0 else 0.0 end
 + case when fev >= 0 and fev <= 34 then 3 when fev > 34 and fev <= 49 then 2 when fev > 49 and fev <= 64 then 1 when fev > 64 then 0 end
 + case when grade < 0 then null when grade <= 1 then 0 when grade <= 2 then 1 when grade <= 3 then 2 when grade > 3 then 3 end
 + case when walk >= 0 and walk <= 149 then 3 when walk > 149 and walk <= 249 then 2 when walk > 249 and walk <= 349 then 1 when walk > 349 then 0 end as score from p""")
def b12(spark, sf):
    n = F.col("l_linenumber")
    return S.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("id"), clean.severity_score(
        F.when(n % 5 != 0, F.col("l_quantity")), F.col("l_discount") * 1000, (n % 5).cast("double"), F.col("l_extendedprice") / 100).alias("score"))


@query("b13_subject_id", "id:s n:l", """select lower(trim(' ' || c_name || ' ')) as id, 1 as n from customer where regexp_matches(lower(trim(c_name)), '^customer#[0-9]*[13579]$')""")
def b13(spark, sf):
    i = clean.subject_id(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    return S.table(spark, sf, "customer").select(i.alias("id"), F.lit(1).alias("n")).where(F.col("id").rlike(r"^customer#\d*[13579]$"))


@query("b14_gate", "pid:l minutes:l hrv_minutes:l", """with m as (select user_id as pid, date_trunc('hour', ts) as h, avg(value) filter (event_type = 'click') as hr,
 avg(value) filter (event_type = 'view') as hrv from events group by 1, 2)
select pid, count(*) as minutes, count(hrv) as hrv_minutes from m where hr between 0 and 300 group by 1""")
def b14(spark, sf):
    from pulsegrid.operators import timeline
    m = timeline.widen(S.signals(spark, sf), ["pid"], "ts", ["hr", "hrv"], width_s=3600)
    return feat.gate(m, "hr", 0, 300).groupBy("pid").agg(F.count(F.lit(1)).alias("minutes"), F.count("hrv").alias("hrv_minutes"))


@query("b15_episode_text", "id:l part:s start_d:d end_d:d accepted:l", f"with {DATE_PARTS} select id, part, start_d, end_d, accepted::int as accepted from parts")
def b15(spark, sf):
    return date_parts(spark, sf).withColumnsRenamed({"start": "start_d", "end": "end_d"})


@query("b16_swapped_dates", "id:l d:d", """with p as (select o_orderkey as id, case when o_orderkey % 3 = 0 then cast(o_orderdate as date) end as stored,
 case o_orderkey % 6 when 1 then strftime(o_orderdate, '%d/%m/%y') when 2 then strftime(o_orderdate, '%d/%m/%Y') when 4 then 'unknown' when 5 then '31/02/1996' end as txt from orders),
 q as (select id, case when stored is not null then case when day(stored) <= 12 then make_date(year(stored), day(stored), month(stored)) end
 when regexp_full_match(txt, '[0-9]{1,2}/[0-9]{1,2}/([0-9]{4})') then cast(try_strptime(txt, '%d/%m/%Y') as date)
 when regexp_full_match(txt, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}') then cast(try_strptime(left(txt, 6) || '20' || right(txt, 2), '%d/%m/%Y') as date) end as d from p)
select id, case when year(d) between 1993 and 2005 then d end as d from q""")
def b16(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 6 == 1, F.date_format(d, "dd/MM/yy")).when(k % 6 == 2, F.date_format(d, "dd/MM/yyyy")).when(k % 6 == 4, "unknown").when(k % 6 == 5, "31/02/1996")
    return S.table(spark, sf, "orders").select(k.alias("id"), dates.swapped_or_slashed(F.when(k % 3 == 0, d.cast("date")), text, 1993, 2005).alias("d"))


_VISIT = "with p as (select l_orderkey * 10 + l_linenumber as id, cast(o_orderdate as date) as onset, case when l_linenumber <> 7 then cast(l_shipdate as date) end as visit from lineitem join orders on l_orderkey = o_orderkey)"


@query("b17_cross_date", "id:l accepted:l why:s", _VISIT + """
select id, case when visit >= onset and visit <= onset + 45 then 1 else 0 end as accepted,
 case when onset is null then 'no_onset' when visit is null then 'no_visit' when visit < onset then 'early' when visit > onset + 45 then 'late' end as why from p""")
def b17(spark, sf):
    li, o = S.table(spark, sf, "lineitem"), S.table(spark, sf, "orders")
    p = li.join(o, li.l_orderkey == o.o_orderkey).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.to_date("o_orderdate").alias("onset"), F.when(F.col("l_linenumber") != 7, F.to_date("l_shipdate")).alias("visit"))
    return sheet.check_visits(p)


_ANCHOR = "with a as (select user_id as pid, max(cast(ts as date)) filter (event_type = 'error' and value > 100) as anchor from events group by 1)"


def _anchored(spark, sf):
    e = S.table(spark, sf, "events")
    a = e.groupBy(F.col("user_id").alias("pid")).agg(F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 100), F.to_date("ts"))).alias("anchor"))
    return S.readings(spark, sf).join(a, "pid")


@query("b18_event_window", "pid:l n:l first_day:l", _ANCHOR + """ select r.user_id as pid, count(*) as n, min(floor((epoch(ts) - epoch(anchor::timestamp)) / 86400)) as first_day
 from events r join a on r.user_id = a.pid where epoch(ts) - epoch(anchor::timestamp) >= -14 * 86400 and epoch(ts) - epoch(anchor::timestamp) < 15 * 86400 group by 1""")
def b18(spark, sf):
    r = _anchored(spark, sf).withColumn("rel", dates.relative_day(F.col("ts"), F.col("anchor")))
    return feat.half_open(r, "rel", -14, 15).groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.min("rel").alias("first_day"))


@query("b19_relative_day", "pid:l rel:l n:l", _ANCHOR + """ select r.user_id as pid, floor((epoch(ts) - epoch(anchor::timestamp)) / 86400) as rel, count(*) as n
 from events r join a on r.user_id = a.pid group by 1, 2""")
def b19(spark, sf):
    r = _anchored(spark, sf).withColumn("rel", dates.relative_day(F.col("ts"), F.col("anchor")))
    return r.groupBy("pid", "rel").agg(F.count(F.lit(1)).alias("n"))


_KEYS = {"metal": r"\bRING\b", "tool": r"\b(?:WIDGET|GADGET|BOLT)\b", "red": "RED", "small": r"^SMALL\b"}


@query("b20_keywords", "condition:s n:l", r"""with k(condition, pat) as (values ('metal', '\bRING\b'), ('tool', '\b(?:WIDGET|GADGET|BOLT)\b'), ('red', 'RED'), ('small', '^SMALL\b'))
select condition, (select sum(case when regexp_matches(upper(trim(p_name)), pat) then 1 else 0 end) from part) as n from k""")
def b20(spark, sf):
    f = clean.keyword_flags(F.col("p_name"), _KEYS)
    one = S.table(spark, sf, "part").agg(*[F.sum(c).alias(k) for k, c in f.items()])
    return one.unpivot([], list(_KEYS), "condition", "n")


@query("b21_calendar", "event_id:l hour:l date:d slot:l dow:l", """select event_id, hour(ts) as hour, cast(ts as date) as date,
 hour(ts) * 6 + minute(ts) // 10 as slot, isodow(ts) - 1 as dow from events""")
def b21(spark, sf):
    return S.table(spark, sf, "events").select("event_id", F.hour("ts").alias("hour"), F.to_date("ts").alias("date"),
        dates.slot_of_day(F.col("ts")).alias("slot"), dates.monday_zero(F.col("ts")).alias("dow"))


@query("b22_phase", "event_id:l s:f c:f fs:f fc:f", """with t as (select event_id, hour(ts) * 6 + minute(ts) // 10 as t from events)
select event_id, sin(2 * pi() * t / 144) as s, cos(2 * pi() * t / 144) as c, sin(2 * pi() * ((t + 20) % 144) / 144) as fs, cos(2 * pi() * ((t + 20) % 144) / 144) as fc from t""")
def b22(spark, sf):
    t = dates.slot_of_day(F.col("ts"))
    (s, c), (fs, fc) = dates.phase(t, 144), dates.phase(F.pmod(t + 20, F.lit(144)), 144)
    return S.table(spark, sf, "events").select("event_id", s.alias("s"), c.alias("c"), fs.alias("fs"), fc.alias("fc"))


@query("b23_log_standardise", "event_id:l z:f back:f", """with st as (select user_id, avg(ln(value)) as m, greatest(coalesce(stddev_samp(ln(value)), 1.0), 1e-3) as s from events where value > 0 group by 1)
select event_id, (ln(value) - m) / s as z, value as back from events join st using (user_id) where value > 0""")
def b23(spark, sf):
    r = S.table(spark, sf, "events").where("value > 0").withColumnRenamed("user_id", "pid")
    st, glob = scaling.log_stats(r, "pid", "value")
    z = scaling.to_z(r, st, glob, "pid", "value")
    return z.select("event_id", "z", scaling.from_z(F.col("z")).alias("back"))


@query("b24_one_hot", "id:l st_F:f st_O:f st_P:f sex:f", """select o_orderkey as id, case when o_orderstatus = 'F' then 1.0 else 0 end as st_F, case when o_orderstatus = 'O' then 1.0 else 0 end as st_O,
 case when o_orderstatus = 'P' then 1.0 else 0 end as st_P, case o_orderkey % 3 when 0 then 1.0 when 1 then 0.0 end as sex from orders""")
def b24(spark, sf):
    sex = F.when(F.col("o_orderkey") % 3 == 0, "male").when(F.col("o_orderkey") % 3 == 1, "female").otherwise("other")
    return S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), *clean.one_hot(F.col("o_orderstatus"), ["F", "O", "P"], "st"), clean.sex_flag(sex).alias("sex"))


@query("b25_scale_train_max", "pid:l date:d hr:f hrv:f", """with m as (select user_id as pid, cast(ts as date) as date, max(abs(case when event_type = 'click' then value end)) as hr,
 max(abs(case when event_type = 'view' then value end)) as hrv from events group by 1, 2),
 s as (select coalesce(max(hr), 1) as a, coalesce(max(hrv), 1) as b from m where pid % 5 <> 0)
select pid, date, hr / a as hr, hrv / b as hrv from m, s""")
def b25(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("pid"), F.to_date("ts").alias("date"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("hr"), F.when(F.col("event_type") == "view", F.col("value")).alias("hrv"))
    m = daystore.day_max(e, ["hr", "hrv"])
    train = m.select("pid").distinct().where("pid % 5 <> 0")
    return daystore.scaled(m, daystore.scales(m, train, ["hr", "hrv"]), ["hr", "hrv"])


@query("b26_presence_pair", "pid:l slot:l hrv:f hrv_seen:l", f"with {S.GRID} select pid, slot, coalesce(hrv, 0) as hrv, case when hrv is null then 0 else 1 end as hrv_seen from grid")
def b26(spark, sf):
    from pulsegrid.plans.hubs import main_grid
    return feat.presence_pairs(main_grid(spark, sf), ["hrv"])


@query("b27_covariate_z", "pid:l slot:l hrv:f hrv_seen:l", f"""with {S.GRID}, st as (select avg(hrv) as m, coalesce(nullif(stddev_samp(hrv), 0), 1) as s from grid)
select pid, slot, coalesce((hrv - m) / s, 0) as hrv, case when hrv is null then 0 else 1 end as hrv_seen from grid, st""")
def b27(spark, sf):
    from pulsegrid.plans.hubs import main_grid
    return feat.presence_pairs(scaling.standardise(main_grid(spark, sf), ["hrv"]), ["hrv"])


@query("b28_log_elapsed", "id:l a:f b:f", "select l_orderkey * 10 + l_linenumber as id, ln(1 + least(l_extendedprice, 1000)) / 7 as a, ln(1 + l_quantity) as b from lineitem")
def b28(spark, sf):
    return S.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        scaling.capped_log(F.col("l_extendedprice")).alias("a"), F.log1p("l_quantity").alias("b"))


@query("b29_impossible", "event_id:l nonfinite:l nonpositive:l above:l", """with p as (select event_id, case when event_id % 50 = 0 then 'inf'::double when event_id % 50 = 1 then 'nan'::double else value - 5 end as v from events)
select event_id, case when isinf(v) or isnan(v) then 1 else 0 end as nonfinite, case when v <= 0 then 1 else 0 end as nonpositive, case when v > 129 and not isnan(v) then 1 else 0 end as above from p""")
def b29(spark, sf):
    k = F.col("event_id") % 50
    v = F.when(k == 0, F.lit(float("inf"))).when(k == 1, F.lit(float("nan"))).otherwise(F.col("value") - 5)
    return S.table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in scaling.impossible(v, 129.0).items()])


@query("b30_drop_by_name", "l_orderkey:l l_partkey:l l_quantity:f l_returnflag:s", "select l_orderkey, l_partkey, l_quantity, l_returnflag from lineitem")
def b30(spark, sf):
    return feat.drop_matching(S.table(spark, sf, "lineitem"), r"^l_(supp|line|ext|dis|tax|ship)")


@query("b31_well_filled", "name:s", """with w as (select count(*) filter (event_type = 'click') * 1.0 / count(*) as a, count(*) filter (event_type <> 'view') * 1.0 / count(*) as b from events)
select 'not_view' as name from w where b >= 0.3 union all select 'click' from w where a >= 0.3""")
def b31(spark, sf):
    e = S.table(spark, sf, "events").select(F.when(F.col("event_type") == "click", F.col("value")).alias("click"),
                                            F.when(F.col("event_type") != "view", F.col("value")).alias("not_view"))
    kept = sheet.well_filled(e, ["click", "not_view"])
    return e.select(*kept).agg(*[F.count(F.lit(1)).alias(c) for c in kept]).unpivot([], kept, "name", "n").select("name")


_FEATS = "concat(case l_linenumber % 4 when 0 then 'lag' when 1 then 'lead' when 2 then 'prev' else 'sin' end, case when l_linenumber % 4 < 2 then cast(l_linenumber as {t}) else '' end)"


@query("b32_feature_family", "feature:s family:s step:l n:l", "with f as (select " + _FEATS.format(t="varchar") + """ as feature from lineitem)
select feature, case when regexp_full_match(feature, '(lag|lead)[0-9]+') then 'neighbours' when feature = 'prev' then 'nearest reading' when feature = 'sin' then 'time of day' end as family,
 case when regexp_full_match(feature, '(lag|lead)[0-9]+') then cast(regexp_extract(feature, '([0-9]+)$', 1) as integer) end as step, count(*) as n from f group by 1, 2, 3""")
def b32(spark, sf):
    f = S.table(spark, sf, "lineitem").select(F.expr(_FEATS.format(t="string")).alias("feature"))
    fam, step = feat.feature_family(F.col("feature"))
    return f.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).select("feature", fam.alias("family"), step.alias("step"), "n")


@query("b33_narrow_horizon", "pid:l date:d lead:l label:l event:s", f"""with {S.SCORED}
select pid, d as date, strptime(split_part(event, '_', 2), '%Y%m%d')::date - d as lead, case when label = 1 and strptime(split_part(event, '_', 2), '%Y%m%d')::date - d <= 1 + pid % 2 then 1 else 0 end as label,
 case when label = 1 and strptime(split_part(event, '_', 2), '%Y%m%d')::date - d <= 1 + pid % 2 then event end as event from scored""".replace("1 + pid % 2", "2"))
def b33(spark, sf):
    return daystore.narrow_horizon(S.scored_days(spark, sf), 2)


@query("b34_clinical_table", "pid:s balance:f nation:f segment_known:l", f"""with {S.SHEET}
select pid, max(case when name = 'balance' then try_cast(txt as double) end) as balance, max(case when name = 'code' and occurrence = 1 then try_cast(txt as double) end) as nation,
 max(case when name = 'code' and occurrence = 2 and txt <> 'NK' then 1 else 0 end) as segment_known from sheet group by 1""")
def b34(spark, sf):
    w = sheet.by_occurrence(sheet.decode_sheet(S.sheet_cells(spark, sf)), [("code", 1), ("code", 2), ("balance", 1)])
    return w.select("pid", clean.clean_number(F.col("balance_1")).alias("balance"), clean.clean_number(F.col("code_1")).alias("nation"),
                    clean.is_filled(F.col("code_2")).alias("segment_known"))


@query("b35_group_label", "pid:l grp:s", """select c_custkey as pid, case when c_mktsegment = 'BUILDING' then 'base' when c_name like '%1' then 'adult' else 'child' end as grp from customer""")
def b35(spark, sf):
    c = S.table(spark, sf, "customer")
    cohort = F.when(F.col("c_mktsegment") == "BUILDING", "base").otherwise("other")
    return c.select(F.col("c_custkey").alias("pid"), clean.group_label(cohort, F.reverse("c_name"), prefix="1").alias("grp"))
