"""Sources and sinks (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import standins as S
from pulsegrid.catalog.registry import query
from pulsegrid.functions.clean import subject_id
from pulsegrid.functions.dates import slot_of_day
from pulsegrid.operators import daystore, sheet
from pulsegrid.sources import readings as R
from pulsegrid.sources import stage


def _export_tree(spark, sf):
    """Write the signals as text files, one folder per signal, and return its root."""
    root = stage.new_path(spark, "export")
    (S.signals(spark, sf).select(F.col("pid").cast("string").alias("pid"), "vital",
                                 F.col("ts").cast("string").alias("time"), F.col("value").cast("string").alias("value"))
     .write.partitionBy("vital").option("header", True).csv(root))
    return root


_PT = "vital={vital}/*.csv"


@query("a01_read_export", "vital:s rows:l subjects:l total:f", f"""with {S.SIGNALS}
select vital, count(*) as rows, count(distinct pid) as subjects, sum(value) as total from signals group by 1""")
def a01(spark, sf):
    root = _export_tree(spark, sf)
    out = None
    for v in ("hr", "hrv", "temp", "spo2", "ecg"):  # there is no ecg file: an empty signal
        raw = R.read_export(spark, root, v, ["pid", "time", "value"], glob=_PT)
        p = R.points(raw, R.PointMap(v, "time", "value"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("vital").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("pid").alias("subjects"),
                                    F.sum("value").alias("total"))


@query("a02_column_maps", "kind:s pid:l vital:s rows:l total:f", f"""with {S.SIGNALS}, {S.STRETCHES}
select 'point' as kind, pid, vital, count(*) as rows, sum(value) as total from signals group by 2, 3
union all select 'interval', pid, vital, count(*), sum(value) from stretches group by 2, 3""")
def a02(spark, sf):
    sig = S.signals(spark, sf).select("pid", "vital", F.col("ts").cast("string").alias("createdTime"), F.col("value").cast("string").alias("v"))
    p = None
    for v in ("hr", "hrv", "temp", "spo2"):
        one = R.points(sig.where(F.col("vital") == v), R.PointMap(v, "createdTime", "v"))
        p = one if p is None else p.unionByName(one)
    st = S.stretches(spark, sf).select("pid", "vital", F.col("start").cast("string").alias("logDateTime"),
                                       F.col("end").cast("string").alias("logEndTime"), F.col("value").cast("string").alias("amount"))
    i = None
    for v in ("rest", "active"):
        one = R.intervals(st.where(F.col("vital") == v), R.IntervalMap(v, "logDateTime", "logEndTime", ("amount",)))
        i = one if i is None else i.unionByName(one)
    tot = lambda df, kind, c: df.groupBy(F.lit(kind).alias("kind"), "pid", "vital").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(c).alias("total"))
    return tot(p, "point", "value").unionByName(tot(i, "interval", "amount"))


@query("a03_read_minutes", "pid:l rows:l readings:l total:f", """select user_id as pid, count(*) as rows, count(value) as readings,
 sum(value) as total from events where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by 1""")
def a03(spark, sf):
    path = stage.new_path(spark, "minutes")
    R.write_minutes(S.readings(spark, sf), path, buckets=8)
    roster = S.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("pid"))
    m = R.read_minutes(spark, path, ["pid", "value"], roster)
    return m.groupBy("pid").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("readings"), F.sum("value").alias("total"))


@query("a04_write_minutes", "pid:l ts:t value:f", """select user_id as pid, date_trunc('minute', ts) as ts, value from events""")
def a04(spark, sf):
    path = stage.new_path(spark, "minutes-csv")
    src = S.readings(spark, sf).withColumn("ts", R.parse_iso(F.col("ts").cast("string")))
    from pulsegrid.functions.dates import floor_minute
    src = src.withColumn("ts", floor_minute(F.col("ts")))
    R.write_minutes(src.withColumn("ts", F.col("ts").cast("string")), path, buckets=4, fmt="csv")
    return spark.read.option("header", True).schema("pid long, ts timestamp_ntz, value double").csv(path)


@query("a05_decode_sheet", "row_no:l pid:s section:s name:s occurrence:l txt:s", f"""with {S.SHEET}
select row_no, pid, section, name, occurrence, txt from sheet where regexp_full_match(pid, 'c[0-9]+')""")
def a05(spark, sf):
    d = sheet.decode_sheet(S.sheet_cells(spark, sf), id_pattern=r"^c\d+$")
    return d.withColumnsRenamed({"row": "row_no", "text": "txt"})


@query("a06_kth_occurrence", "pid:s code_1:s code_2:s balance_1:s", f"""with {S.SHEET}
select pid, max(case when name = 'code' and occurrence = 1 then txt end) as code_1,
 max(case when name = 'code' and occurrence = 2 then txt end) as code_2,
 max(case when name = 'balance' then txt end) as balance_1 from sheet group by pid""")
def a06(spark, sf):
    return sheet.by_occurrence(sheet.decode_sheet(S.sheet_cells(spark, sf)), [("code", 1), ("code", 2), ("balance", 1)])


_WIDE = """wide as (select user_id as pid, max(case when event_type = 'error' and value > 150 then cast(ts as date) end) as d1,
 max(case when event_type = 'view' and value > 200 then cast(ts as date) end) as d2,
 max(case when event_type = 'click' and value > 250 then cast(ts as date) end) as d3 from events group by 1)"""


def _wide(spark, sf):
    e = S.table(spark, sf, "events")
    pick = lambda t, v: F.max(F.when((F.col("event_type") == t) & (F.col("value") > v), F.to_date("ts")))
    return e.groupBy(F.col("user_id").alias("subject")).agg(
        pick("error", 150).alias("Date-1"), pick("view", 200).alias("Date-2"), pick("click", 250).alias("Date-3"))


@query("a07_load_events", "pid:s date:d status:s", f"""with {_WIDE}, l as (select cast(pid as varchar) as pid, unnest([d1, d2, d3]) as date from wide)
select pid, date, 'dated' as status from l where date is not null
union all select cast(pid as varchar), null, 'undated' from wide where d1 is null and d2 is null and d3 is null""")
def a07(spark, sf):
    dated, undated = sheet.unpivot_events(_wide(spark, sf), "subject", ["Date-1", "Date-2", "Date-3"])
    return dated.withColumn("status", F.lit("dated")).unionByName(undated.withColumn("status", F.lit("undated")), True)


DATE_PARTS = S.DATE_CELLS + r""",
 parts0 as (select id, pid, cell, trim(unnest(regexp_split_to_array(cell, '[;,]'))) as part from date_cells),
 parts1 as (select *, regexp_extract_all(part, '[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}') as d,
  regexp_extract(part, '^([0-9]{1,2})\s*[tT][oO]\s*[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$', 1) as s from parts0 where length(part) > 0),
 parts2 as (select *, cast(try_strptime(d[1], '%d-%m-%Y') as date) as a0, cast(try_strptime(d[2], '%d-%m-%Y') as date) as b0 from parts1),
 parts3 as (select *, case when year(a0) between 1993 and 2000 then a0 end as a, case when year(b0) between 1993 and 2000 then b0 end as b from parts2),
 parts4 as (select *, case when len(d) = 2 then a when len(d) = 1 and s <> '' then cast(try_strptime(s || '-' || strftime(a, '%m-%Y'), '%d-%m-%Y') as date)
  when len(d) = 1 then a end as start_d, case when len(d) = 2 then b when len(d) = 1 then a end as end_d from parts3),
 parts as (select *, coalesce(start_d <= end_d, false) as accepted from parts4)"""


def date_parts(spark, sf):
    return sheet.parse_episodes(S.date_cells(spark, sf), "cell", ["id", "pid"], (1993, 2000))


@query("a08_date_sheets", "id:l pid:l part:s start_d:d end_d:d why:s", f"""with {DATE_PARTS}
select id, pid, part, case when accepted then start_d end as start_d, case when accepted then end_d end as end_d,
 case when not accepted then 'unreadable' end as why from parts""")
def a08(spark, sf):
    good, bad = sheet.accepted_rejected(stage.materialise(date_parts(spark, sf), "parts"))
    return good.unionByName(bad, True).withColumnsRenamed({"start": "start_d", "end": "end_d"})


@query("a09_short_text_csv", "id:l value:s big:s small:s", """select event_id as id, printf('%.4g', value) as value, printf('%.4g', value * 1234.5) as big,
 printf('%.4g', value / 54321) as small from events""")
def a09(spark, sf):
    path = stage.new_path(spark, "derived-csv")
    R.write_csv(S.table(spark, sf, "events").select(F.col("event_id").alias("id"), "value", (F.col("value") * 1234.5).alias("big"),
                                                    (F.col("value") / 54321).alias("small")), path)
    return spark.read.option("header", True).schema("id long, value string, big string, small string").csv(path)


@query("a10_run_sink", "model:s rows:l mae:f n:l ledger_rows:l", """select event_type as model, count(*) as rows, avg(abs(value - 50)) as mae,
 count(*) as n, 1 as ledger_rows from events group by 1""")
def a10(spark, sf):
    path = stage.new_path(spark, "runs")
    e = S.table(spark, sf, "events")
    score = lambda p: p.agg(F.avg(F.abs(F.col("pred") - F.col("truth"))).alias("mae"), F.count(F.lit(1)).alias("n"))
    for m in ("click", "view", "error", "signup", "purchase"):
        p = e.where(F.col("event_type") == m).select("event_id", F.lit(50.0).alias("truth"), F.col("value").alias("pred"))
        R.write_run(p, score, path, {"model": m})
    preds = R.read_run(spark, path).groupBy("model").agg(F.count(F.lit(1)).alias("rows"))
    ledger = R.read_run(spark, path, "ledger").groupBy("model").agg(F.count(F.lit(1)).alias("ledger_rows"), F.max("mae").alias("mae"), F.max("n").alias("n"))
    return preds.join(ledger, "model")


@query("a11_last_run_wins", "model:s test:s run:l mae:f", f"""with {S.RUNS}, r as (select *, row_number() over (partition by model, test order by finished desc, run desc) as n from runs)
select model, test, run, mae from r where n = 1""")
def a11(spark, sf):
    return R.last_run(S.runs(spark, sf), ["model", "test"], "finished", "run")


@query("a12_content_manifest", "doc_id:l length:l sha256:s", "select doc_id, octet_length(encode(text)) as length, sha256(text) as sha256 from documents")
def a12(spark, sf):
    return R.content_manifest(S.table(spark, sf, "documents"), "doc_id", "text")


@query("a12_file_manifest", "file:s length:l sha256:s")
def a12_files(spark, sf):
    return R.file_manifest(spark, sf, "*.parquet")


@query("a13_minute_store", "pid:l date:d filled:l first_minute:l last_minute:l total:f", """with m as (select user_id as pid, cast(ts as date) as date,
 hour(ts) * 60 + minute(ts) as minute, avg(value) as v from events where value between 0 and 300 group by 1, 2, 3)
select pid, date, count(*) as filled, min(minute) as first_minute, max(minute) as last_minute, sum(v) as total from m group by 1, 2""")
def a13(spark, sf):
    r = S.readings(spark, sf).withColumn("hr", F.col("value"))
    cells = daystore.minute_cells(r, "pid", "ts", ["value"], gate="hr")
    view = daystore.array_view(cells, "pid", "value")
    hit = F.array_compact(F.transform("minutes", lambda v, i: F.when(v.isNotNull(), i)))
    # a generator: the filled minutes are looked for once, not once per column
    facts = F.inline(F.transform(F.array(hit), lambda h: F.struct(
        F.size(h).alias("filled"), F.get(h, F.lit(0)).alias("first_minute"), F.element_at(h, -1).alias("last_minute"))))
    return view.select("pid", "date", facts, F.aggregate(F.array_compact("minutes"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("a14_select_set", "pid:l date:d n:l", f"""with {S.DAYS} select pid, d as date, n from days
 where pid % 3 in (0, 2) and pid in (select c_custkey from customer where c_acctbal > 0)""")
def a14(spark, sf):
    days = S.day_table(spark, sf).withColumn("cohort", F.col("pid") % 3)
    static = S.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("pid"))
    return daystore.select_set(days, "cohort", [0, 2], static)
