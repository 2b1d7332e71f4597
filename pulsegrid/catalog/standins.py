"""The benchmark tables seen as readings, intervals, episodes, sheets and runs.

Each DataFrame helper has an SQL text of the same meaning next to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT = 21600  # six hours: the events are sparse, about one per user every 10.7 hours


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("pid"), "ts", "value")


READINGS = "readings as (select user_id as pid, ts, value from events)"


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Point signals of several kinds in long form."""
    vital = (F.when(F.col("event_type") == "click", "hr").when(F.col("event_type") == "view", "hrv")
             .when(F.col("event_type") == "error", "temp").when(F.col("event_type") == "signup", "spo2"))
    return table(spark, sf, "events").select(F.col("user_id").alias("pid"), vital.alias("vital"), "ts", "value").where(
        "vital is not null")


SIGNALS = """signals as (select user_id as pid, case event_type when 'click' then 'hr' when 'view' then 'hrv'
 when 'error' then 'temp' when 'signup' then 'spo2' end as vital, ts, value from events where event_type <> 'purchase')"""


def stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals: a purchase lasts k minutes; even k is rest, odd k is activity."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").where("event_type = 'purchase'").select(
        F.col("user_id").alias("pid"), F.when(k % 2 == 0, "rest").otherwise("active").alias("vital"),
        F.col("ts").alias("start"), F.timestamp_add("MINUTE", k, F.col("ts")).alias("end"), F.col("value"), k.alias("k"))


STRETCHES = """stretches as (select user_id as pid, case when k % 2 = 0 then 'rest' else 'active' end as vital,
 ts as start_ts, ts + to_minutes(k) as end_ts, value, k from
 (select *, cast(json_extract_string(props, '$.k') as integer) as k from events where event_type = 'purchase') p)"""


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Dated episodes: an error with a high value lasts k mod 3 days more."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").where("event_type = 'error' and value > 150").select(
        F.col("user_id").alias("pid"), F.to_date("ts").alias("start"), (k % 3).alias("extra"), F.col("event_id").alias("ordinal"))
    return e.select("pid", "start", F.date_add("start", F.col("extra")).alias("end"), "ordinal",
                    F.concat(F.col("pid").cast("string"), F.lit("_"), F.date_format("start", "yyyyMMdd")).alias("episode"))


EPISODES = """episodes as (select user_id as pid, cast(ts as date) as start_d,
 cast(ts as date) + (cast(json_extract_string(props, '$.k') as integer) % 3) as end_d, event_id as ordinal,
 cast(user_id as varchar) || '_' || strftime(ts, '%Y%m%d') as episode
 from events where event_type = 'error' and value > 150)"""


def day_table(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user and day with counts of readings."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("pid"), F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "view").alias("hrv_n"))


DAYS = """days as (select user_id as pid, cast(ts as date) as d, count(*) as n,
 count(*) filter (event_type = 'view') as hrv_n from events group by 1, 2)"""


def scored_days(spark: SparkSession, sf: str) -> DataFrame:
    """Day-level predictions: did the user have an error that day, and a score for it.

    The score is a whole number of thousandths, so equal scores are really equal.
    """
    d = table(spark, sf, "events").groupBy(F.col("user_id").alias("pid"), F.to_date("ts").alias("date")).agg(
        F.max((F.col("event_type") == "error").cast("int")).alias("label"),
        F.max("value").alias("_v"), F.count(F.lit(1)).alias("coverage"))
    return d.select(
        "pid", "date", (F.col("pid") % 3).alias("grp"), "label",
        (F.floor(1000 * F.col("_v") / (F.col("_v") + 50)) / 1000).alias("score"), "coverage",
        F.concat(F.col("pid").cast("string"), F.lit("_"), F.date_format(F.date_add("date", 2), "yyyyMMdd")).alias("event"))


SCORED = """scored as (select pid, d, pid % 3 as grp, label, floor(1000 * v / (v + 50)) / 1000 as score, coverage,
 cast(pid as varchar) || '_' || strftime(d + 2, '%Y%m%d') as event from
 (select user_id as pid, cast(ts as date) as d, max(case when event_type = 'error' then 1 else 0 end) as label,
 max(value) as v, count(*) as coverage from events group by 1, 2) q)"""


def sheet_text(spark: SparkSession, sf: str) -> DataFrame:
    """Hand-typed looking cells made from the orders."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    n = (k % 97).cast("string")
    cell = (F.when(k % 8 == 0, "ND").when(k % 8 == 1, " na ").when(k % 8 == 2, "-").when(k % 8 == 3, F.concat(F.lit(" "), n))
            .when(k % 8 == 4, (k % 3).cast("string")).when(k % 8 == 5, F.concat((k % 9).cast("string"), F.lit(" TO "), n))
            .when(k % 8 == 6, F.concat(n, F.lit("MIN"))).otherwise(F.concat(n, F.lit(".5 days"))))
    return o.select(k.alias("id"), cell.alias("cell"), "o_orderpriority", "o_orderstatus", "o_custkey", "o_orderdate")


CELLS = """cells as (select o_orderkey as id, o_orderpriority, o_orderstatus, o_custkey, o_orderdate,
 case o_orderkey % 8 when 0 then 'ND' when 1 then ' na ' when 2 then '-' when 3 then ' ' || cast(o_orderkey % 97 as varchar)
 when 4 then cast(o_orderkey % 3 as varchar)
 when 5 then cast(o_orderkey % 9 as varchar) || ' TO ' || cast(o_orderkey % 97 as varchar)
 when 6 then cast(o_orderkey % 97 as varchar) || 'MIN' else cast(o_orderkey % 97 as varchar) || '.5 days' end as cell
 from orders)"""

NUM = r"""case when upper(trim(cell)) in ('ND','NK','NA','NIL','-','') then null
 when regexp_full_match(trim(cell), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim(cell) as double) end"""


def date_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Free-text date cells in the layouts people type."""
    o = table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    f = lambda x: F.date_format(x, "dd-MM-yyyy")
    later = F.date_add(d, (k % 5).cast("int"))
    cell = (F.when(k % 7 == 0, f(d))
            .when(k % 7 == 1, F.concat(f(d), F.lit(" to "), f(later)))
            .when(k % 7 == 2, F.concat(f(d), F.lit("; "), f(later), F.lit(" - "), f(F.date_add(later, 3))))
            .when(k % 7 == 3, F.concat(F.date_format(d, "d"), F.lit(" To "), f(d)))
            .when(k % 7 == 4, F.concat(F.lit("31-02-"), F.date_format(d, "yyyy")))
            .when(k % 7 == 5, F.concat(f(later), F.lit(" to "), f(d), F.lit(", "), f(d)))
            .otherwise("No symptoms"))
    return o.select(k.alias("id"), F.col("o_custkey").alias("pid"), cell.alias("cell"))


DATE_CELLS = """date_cells as (select o_orderkey as id, o_custkey as pid, case o_orderkey % 7
 when 0 then strftime(d, '%d-%m-%Y') when 1 then strftime(d, '%d-%m-%Y') || ' to ' || strftime(later, '%d-%m-%Y')
 when 2 then strftime(d, '%d-%m-%Y') || '; ' || strftime(later, '%d-%m-%Y') || ' - ' || strftime(later + 3, '%d-%m-%Y')
 when 3 then cast(day(d) as varchar) || ' To ' || strftime(d, '%d-%m-%Y')
 when 4 then '31-02-' || strftime(d, '%Y')
 when 5 then strftime(later, '%d-%m-%Y') || ' to ' || strftime(d, '%d-%m-%Y') || ', ' || strftime(d, '%d-%m-%Y')
 else 'No symptoms' end as cell from (select *, cast(o_orderdate as date) as d,
 cast(o_orderdate as date) + cast(o_orderkey % 5 as integer) as later from orders) o)"""


def sheet_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A three-header-row sheet in cell form over the customers; the name `code` occurs twice."""
    head = spark.createDataFrame(
        [(2, 1, "IDENTITY"), (2, 4, "ACCOUNT"), (3, 1, "id"), (3, 2, "label"), (3, 3, "code"), (3, 4, "balance"), (3, 5, "code")],
        "row long, col int, text string")
    c = table(spark, sf, "customer")
    seg = F.when(F.col("c_custkey") % 5 == 0, "NK").otherwise(F.col("c_mktsegment"))
    whole = F.floor("c_acctbal").cast("long")
    body = c.select((F.col("c_custkey") + 4).alias("row"), F.explode(F.array(
        F.struct(F.lit(1).alias("col"), F.concat(F.lit(" C"), F.col("c_custkey").cast("string")).alias("text")),
        F.struct(F.lit(2).alias("col"), F.col("c_name").alias("text")),
        F.struct(F.lit(3).alias("col"), F.col("c_nationkey").cast("string").alias("text")),
        F.struct(F.lit(4).alias("col"), F.when(whole >= 0, whole.cast("string")).alias("text")),
        F.struct(F.lit(5).alias("col"), seg.alias("text")))).alias("x")).select("row", "x.col", "x.text")
    return head.unionByName(body)


SHEET = """body as (select c_custkey + 4 as row_no, unnest([1, 2, 3, 4, 5]) as col_no, unnest([' C' || cast(c_custkey as varchar), c_name,
 cast(c_nationkey as varchar), case when floor(c_acctbal) >= 0 then cast(cast(floor(c_acctbal) as bigint) as varchar) end,
 case when c_custkey % 5 = 0 then 'NK' else c_mktsegment end]) as txt from customer),
 heads(col_no, section, name, occurrence) as (values (1, 'IDENTITY', 'id', 1), (2, 'IDENTITY', 'label', 1), (3, 'IDENTITY', 'code', 1),
 (4, 'ACCOUNT', 'balance', 1), (5, 'ACCOUNT', 'code', 2)),
 ids as (select row_no, lower(trim(txt)) as pid from body where col_no = 1),
 sheet as (select b.row_no, i.pid, b.col_no, h.section, h.name, h.occurrence, b.txt from body b join heads h using (col_no) join ids i using (row_no))"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run ledger: each order is a finished run of a model on a test, its price the error."""
    o = table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 40).cast("string")).alias("model"),
        F.col("o_orderpriority").alias("test"), F.col("o_orderdate").alias("finished"), F.col("o_orderkey").alias("run"),
        (F.col("o_totalprice") / 1000).alias("mae"), (F.col("o_orderkey") % 5).alias("seed"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("n_missing"),
        (F.col("o_orderkey") % 11 == 0).cast("int").alias("n_nonpositive"), (F.col("o_orderkey") % 13).cast("double").alias("pct_above"))


RUNS = """runs as (select 'm' || cast(o_custkey % 40 as varchar) as model, o_orderpriority as test, o_orderdate as finished, o_orderkey as run,
 o_totalprice / 1000 as mae, o_orderkey % 5 as seed, case when o_orderstatus = 'P' then 1 else 0 end as n_missing,
 case when o_orderkey % 11 = 0 then 1 else 0 end as n_nonpositive, cast(o_orderkey % 13 as double) as pct_above from orders)"""

# ---- six-hour grid of the main signal and its segments
GRID = f"""slots as (select user_id as pid, cast(floor(epoch(ts) / {SLOT}) as bigint) as slot, avg(value) as hrv, count(value) as hrv_n
 from events group by 1, 2),
 span as (select pid, min(slot) as a, max(slot) as b from slots group by 1),
 axis as (select pid, unnest(range(a, b + 1)) as slot from span),
 grid as (select x.pid, x.slot, s.hrv, coalesce(s.hrv_n, 0) as hrv_n from axis x left join slots s on s.pid = x.pid and s.slot = x.slot)"""

RUN_LEN = GRID + """,
 near as (select *, max(case when hrv is not null then slot end) over (partition by pid order by slot rows between unbounded preceding and 1 preceding) as prev_slot,
 min(case when hrv is not null then slot end) over (partition by pid order by slot rows between 1 following and unbounded following) as next_slot from grid),
 gaps as (select pid, slot, hrv, hrv_n, prev_slot, next_slot, case when hrv is null then next_slot - prev_slot - 1 else 0 end as missing_run from near)"""

SEGMENTS = RUN_LEN + """,
 cuts as (select *, sum(case when missing_run > 2 then 1 else 0 end) over (partition by pid order by slot) as part from gaps where true),
 parts as (select pid, part, min(slot) as a, max(slot) as b from cuts where missing_run <= 2 and hrv is not null group by 1, 2),
 kept as (select pid, a, b, row_number() over (partition by pid order by a) - 1 as k from parts where b - a + 1 >= 4),
 labelled as (select g.pid, g.slot, g.hrv, g.hrv_n, g.missing_run, s.a, s.b, s.k,
 case when s.k is not null then cast(g.pid as varchar) || '_s' || lpad(cast(s.k as varchar), 2, '0') end as segment,
 case when s.k is null then null when (g.slot - s.a) < ((s.b - s.a + 1) * 80) // 100 then 'train' else 'test' end as split
 from gaps g left join kept s on g.pid = s.pid and g.slot between s.a and s.b)"""
