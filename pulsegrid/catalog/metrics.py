"""Scores and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import standins as S
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.windows import INSIDE
from pulsegrid.operators import daystore, episodes, features, joins, ledger, metrics, quality
from pulsegrid.plans import hubs
from pulsegrid.sources import readings as R
from pulsegrid.sources.stage import materialise

PREDS = """preds as (select event_type as model, user_id as pid, event_id as step, value as truth, case event_id % 20 when 0 then null when 1 then -1.0 when 2 then 200.0 else cast(json_extract_string(props, '$.k') as double) end as pred from events)"""


def preds(spark, sf):
    k = F.col("event_id") % 20
    p = F.when(k == 0, None).when(k == 1, -1.0).when(k == 2, 200.0).otherwise(F.get_json_object("props", "$.k").cast("double"))
    return S.table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("pid"), F.col("event_id").alias("step"), F.col("value").alias("truth"), p.alias("pred"))


@query("d35_error_scores", "model:s n:l n_missing:l mae:f rmse:f mae_below:f mae_above:f mae_per_subject_median:f n_nonfinite:l n_nonpositive:l pct_above_max:f", f"""with {PREDS}, e as (select *, abs(pred - truth) as e from preds),
 s as (select model, pid, avg(e) as m from e group by 1, 2), md as (select model, median(m) as mae_per_subject_median from s group by 1)
select e.model, count(*) as n, count(*) - count(pred) as n_missing, avg(e) as mae, sqrt(avg(e * e)) as rmse, avg(e) filter (truth < 50) as mae_below, avg(e) filter (truth >= 50) as mae_above, any_value(mae_per_subject_median) as mae_per_subject_median,
 0 as n_nonfinite, count(*) filter (pred <= 0) as n_nonpositive, 100.0 * count(*) filter (pred > 129) / count(*) as pct_above_max from e join md on md.model = e.model group by 1""")
def d35(spark, sf):
    return metrics.error_scores(preds(spark, sf), ["model"], 50, 129)


LAST = f"{S.RUNS}, rk as (select *, row_number() over (partition by model, test order by finished desc, run desc) as rn from runs), last as (select * from rk where rn = 1)"


def last_runs(spark, sf):
    r = S.runs(spark, sf).withColumn("n_nonfinite", F.col("n_missing"))
    return R.last_run(r, ["model", "test"], "finished", "run")


def verdicts(spark, sf):
    last = last_runs(spark, sf)
    ran = S.runs(spark, sf).select("model", "test")
    spine = ran.unionByName(ran.select(F.lit("planned").alias("model"), "test")).distinct()
    return ledger.usability(spine, last, ["model", "test"], worst=400)


VERDICT = f"""{LAST}, sp as (select model, test from runs union select 'planned', test from runs), v0 as (select s.model, s.test, l.mae, case when l.run is null then 'absent' when l.mae > 400 or l.n_missing > 0 then 'not_finite_or_huge'
 when l.n_nonpositive > 0 then 'zero_or_less' when l.pct_above > 5 then 'too_high' else '' end as note from sp s left join last l on l.model = s.model and l.test = s.test),
 verdict as (select model, test, note, case when note = '' then mae end as mae from v0)"""


@query("d36_usability", "model:s test:s usable:l note:s mae:f", f"with {VERDICT} select model, test, case when note = '' then 1 else 0 end as usable, note, mae from verdict")
def d36(spark, sf):
    return verdicts(spark, sf)


@query("d37_against_reference", "test:s best:s best_score:f reference_score:f gain_pct:f beat:l worse:l ties:l beat_list:s", f"""with {S.RUNS}, m as (select model, test, avg(mae) as mae from runs group by 1, 2),
 t as (select test, arg_min(model, struct_pack(a := mae, b := model)) as best, min(mae) as best_score, min(mae) filter (model = 'm0') as reference_score from m group by 1)
select m.test, best, best_score, reference_score, 100 * (1 - best_score / reference_score) as gain_pct, count(*) filter (model <> 'm0' and mae < reference_score) as beat, count(*) filter (model <> 'm0' and mae >= reference_score) as worse,
 count(*) filter (model <> 'm0' and mae <= best_score + 1) as ties, coalesce(string_agg(model, ',' order by model) filter (model <> 'm0' and mae < reference_score), '') as beat_list from m join t on t.test = m.test group by 1, 2, 3, 4""")
def d37(spark, sf):
    m = S.runs(spark, sf).groupBy("model", "test").agg(F.avg("mae").alias("mae"))
    return ledger.against_reference(m, "test", "model", "m0")


@query("d38_tuned_changes", "test:s better:l same:l worse:l", f"""with {S.RUNS}, m as (select model, test, seed, avg(mae) as mae from runs group by 1, 2, 3)
select a.test, count(*) filter (b.mae - a.mae < -5) as better, count(*) filter (abs(b.mae - a.mae) <= 5) as same, count(*) filter (b.mae - a.mae > 5) as worse from m a left join m b on a.model = b.model and a.test = b.test and b.seed = 1 where a.seed = 0 group by 1""")
def d38(spark, sf):
    m = S.runs(spark, sf).groupBy("model", "test", "seed").agg(F.avg("mae").alias("mae"))
    p = joins.side_by_side({"a": m.where("seed = 0"), "b": m.where("seed = 1")}, ["model", "test"], "mae")
    return ledger.tuned_changes(p, "test", "a", "b", 5)


CONF = """cf as (select grp, count(*) as n, sum(label) as n_pos, count(*) filter (score >= 0.5 and label = 1) as tp, count(*) filter (score >= 0.5 and label = 0) as fp,
 count(*) filter (score < 0.5 and label = 0) as tn, count(*) filter (score < 0.5 and label = 1) as fn, avg(pow(score - label, 2)) as brier from sc group by 1),
 rk as (select *, rank() over (partition by grp order by score) + (count(*) over (partition by grp, score) - 1) / 2.0 as r from sc),
 au as (select grp, (sum(r) filter (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) as auroc from rk group by 1),
 ds as (select grp, score, sum(label) as p, count(*) as c from sc group by 1, 2),
 cu as (select grp, p, sum(p) over w as tp, sum(c) over w as fl, sum(p) over (partition by grp) as tot from ds window w as (partition by grp order by score desc)),
 ap as (select grp, sum(p / nullif(tot, 0) * tp / fl) as auprc from cu group by 1)"""
GROUPED = S.SCORED + ", sc as (select *, cast(grp as varchar) as g0 from scored), "


def _all_groups(text):
    return S.SCORED + ", sc as (select pid, d, label, score, event, coverage, unnest(['all', cast(grp as varchar)]) as grp from scored), " + text


RATES = "grp, n, n_pos, tp, fp, tn, fn, (tp + tn) / n as accuracy, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 as balanced_accuracy, tp / nullif(tp + fn, 0) as sensitivity, tn / nullif(tn + fp, 0) as specificity, tp / nullif(tp + fp, 0) as ppv, tn / nullif(tn + fn, 0) as npv, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1"


@query("d39_confusion", "grp:s n:l n_pos:l tp:l fp:l tn:l fn:l accuracy:f balanced_accuracy:f sensitivity:f specificity:f ppv:f npv:f f1:f", f"with {_all_groups(CONF)} select {RATES} from cf where grp <> 'all'")
def d39(spark, sf):
    return metrics.detection_scores(S.scored_days(spark, sf), ["grp"])


@query("d40_auroc", "grp:s auroc:f", f"with {_all_groups(CONF)} select grp, auroc from au where grp <> 'all'")
def d40(spark, sf):
    return metrics.detection_scores(S.scored_days(spark, sf), ["grp"])


@query("d41_auprc", "grp:s auprc:f", f"with {_all_groups(CONF)} select grp, auprc from ap where grp <> 'all'")
def d41(spark, sf):
    return metrics.detection_scores(S.scored_days(spark, sf), ["grp"])


@query("d42_brier", "grp:s brier:f", f"with {_all_groups(CONF)} select grp, brier from cf where grp <> 'all'")
def d42(spark, sf):
    return metrics.detection_scores(S.scored_days(spark, sf), ["grp"])


EVENTS = "ev as (select grp, event, max(case when score >= 0.5 then 1 else 0 end) as hit from sc where label = 1 group by 1, 2), es as (select grp, count(*) as events, sum(hit) as events_caught, sum(hit) / count(*) as event_sensitivity from ev group by 1)"


@query("d43_event_sensitivity", "grp:s events:l events_caught:l event_sensitivity:f false_alarms_per_30:f", f"with {_all_groups(CONF)}, {EVENTS} select cf.grp, events, events_caught, event_sensitivity, 30.0 * fp / nullif(fp + tn, 0) as false_alarms_per_30 from cf join es on es.grp = cf.grp where cf.grp <> 'all'")
def d43(spark, sf):
    d = S.scored_days(spark, sf)
    return metrics.event_scores(d, ["grp"]).join(metrics.detection_scores(d, ["grp"]).select("grp", "false_alarms_per_30"), "grp")


@query("d44_lead_time", "grp:s events_caught:l lead_days_median:f", f"""with {S.SCORED}, f as (select grp, event, min(d) as d from (select grp, d, label, score, cast(pid as varchar) || '_20240201' as event from scored) x where label = 1 and score >= 0.5 group by 1, 2)
select cast(grp as varchar) as grp, count(*) as events_caught, median(date '2024-02-01' - d) as lead_days_median from f group by 1""")
def d44(spark, sf):
    d = S.scored_days(spark, sf).withColumn("event", F.concat(F.col("pid").cast("string"), F.lit("_20240201")))
    return metrics.lead_times(d, ["grp"])


@query("d45_all_and_groups", "grp:s n:l n_pos:l auroc:f auprc:f brier:f sensitivity:f event_sensitivity:f", f"with {_all_groups(CONF)}, {EVENTS} select cf.grp, n, n_pos, auroc, auprc, brier, tp / nullif(tp + fn, 0) as sensitivity, event_sensitivity from cf join au on au.grp = cf.grp join ap on ap.grp = cf.grp join es on es.grp = cf.grp")
def d45(spark, sf):
    d = metrics.with_all(S.scored_days(spark, sf), "grp")
    return metrics.detection_scores(d, ["grp"]).join(metrics.event_scores(d, ["grp"]), "grp")


BAND = "least(floor(score * 10 + 1e-9), 9)"


@query("d46_calibration", "grp:s band:l n:l predicted:f observed:f", f"""with {S.SCORED}, c as (select grp, {BAND} as band, count(*) as n, avg(score) as predicted, avg(label) as observed from scored group by 1, 2), ax as (select distinct grp, unnest(range(0, 10)) as band from scored)
select ax.grp, ax.band, coalesce(n, 0) as n, predicted, observed from ax left join c on c.grp = ax.grp and c.band = ax.band""")
def d46(spark, sf):
    return metrics.calibration(S.scored_days(spark, sf), ["grp"])


THIRDS = S.SCORED + """, hd as (select s.pid, s.d, count(*) as history from scored s join scored h on h.pid = s.pid and h.d between s.d - 6 and s.d group by 1, 2),
 mi as (select user_id as pid, cast(ts as date) as d, cast(extract(hour from ts) * 60 + extract(minute from ts) as int) as m from events),
 mu as (select distinct pid, d, m from mi union all select distinct pid, d, -1 from mi union all select distinct pid, d, 1440 from mi),
 gp as (select pid, d, max(step) - 1 as longest_gap from (select pid, d, m - lag(m) over (partition by pid, d order by m) as step from mu) q group by 1, 2),
 lg as (select s.pid, s.d, s.label, s.score, unnest(['coverage', 'history', 'longest_gap']) as kind, unnest([cast(s.coverage as double), cast(h.history as double), cast(g.longest_gap as double)]) as info
  from scored s join hd h on h.pid = s.pid and h.d = s.d join gp g on g.pid = s.pid and g.d = s.d),
 ct as (select kind, quantile_cont(info, 1.0 / 3) as c1, quantile_cont(info, 2.0 / 3) as c2 from lg group by 1),
 pt as (select lg.*, case when c1 = c2 then (case when info >= c1 then 1 else 0 end) else (case when info >= c1 then 1 else 0 end) + (case when info >= c2 then 1 else 0 end) end as part from lg join ct on ct.kind = lg.kind),
 rk as (select *, rank() over (partition by kind, part order by score) + (count(*) over (partition by kind, part, score) - 1) / 2.0 as r from pt)"""


@query("d47_slices", "kind:s part:l low:f high:f n:l n_pos:l auroc:f sensitivity:f specificity:f", f"""with {THIRDS} select kind, part, min(info) as low, max(info) as high, count(*) as n, sum(label) as n_pos, (sum(r) filter (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) as auroc,
 count(*) filter (label = 1 and score >= 0.5) / greatest(sum(label), 1) as sensitivity, count(*) filter (label = 0 and score < 0.5) / greatest(count(*) - sum(label), 1) as specificity from rk group by 1, 2""")
def d47(spark, sf):
    d = S.scored_days(spark, sf)
    hist = daystore.day_window(d.select("pid", "date"), 7, []).where("present").groupBy("pid", F.col("sample").alias("date")).agg(F.count(F.lit(1)).alias("history"))
    seen = S.table(spark, sf, "events").select(F.col("user_id").alias("pid"), F.to_date("ts").alias("date"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))
    gaps = features.longest_day_gap(seen, ["pid", "date"], "minute")
    return metrics.slices(materialise(d.join(hist, ["pid", "date"]).join(gaps, ["pid", "date"]), "slices"), ["coverage", "history", "longest_gap"])


BOOT = S.SCORED + """, un as (select distinct pid from scored), pl as (select pid, row_number() over (order by md5('9|' || cast(pid as varchar))) as place, count(*) over () as tot from un),
 dr as (select r.replicate, ('0x' || substr(md5('9|' || cast(r.replicate as varchar) || '|' || cast(place as varchar)), 1, 8))::bigint % tot + 1 as place
  from pl, (select unnest(range(1, 1001)) as replicate) r),
 wt as (select replicate, place, count(*) as w from dr group by 1, 2), bw as (select replicate, pid, w from wt join pl on pl.place = wt.place),
 bd as (select replicate, score, sum(label * w) as p, sum(w) as c, sum(w * pow(score - label, 2)) as q from scored s join bw on bw.pid = s.pid group by 1, 2),
 cu as (select *, c - p as n, sum(p) over dn as tp, sum(c) over dn as fl, sum(c - p) over up as below, sum(p) over al as pos, sum(c - p) over al as neg from bd
  window dn as (partition by replicate order by score desc), up as (partition by replicate order by score), al as (partition by replicate)),
 bt as (select replicate, sum(p * (below - n / 2.0)) / nullif(max(pos) * max(neg), 0) as auroc, sum(p / nullif(pos, 0) * tp / fl) as auprc,
  coalesce(sum(p) filter (score >= 0.5), 0) / nullif(max(pos), 0) as sensitivity, coalesce(sum(n) filter (score < 0.5), 0) / nullif(max(neg), 0) as specificity,
  coalesce(sum(p) filter (score >= 0.5), 0) / nullif(sum(c) filter (score >= 0.5), 0) as ppv, sum(q) / sum(c) as brier,
  30.0 * coalesce(sum(n) filter (score >= 0.5), 0) / nullif(max(neg), 0) as false_alarms_per_30 from cu group by 1),
 ev as (select pid, event, max(case when score >= 0.5 then 1 else 0 end) as hit from scored where label = 1 group by 1, 2),
 es as (select replicate, sum(w * hit) / sum(w) as event_sensitivity from ev join bw on bw.pid = ev.pid group by 1)"""

_EIGHT = ", ".join(metrics.INTERVALS)
_BOUNDS = ", ".join(f"quantile_cont({c}, {q}) as {c}_{end}" for c in metrics.INTERVALS for q, end in ((0.025, "lo"), (0.975, "hi")))


@query("d48_bootstrap", "replicate:l " + " ".join(f"{c}:f" for c in metrics.INTERVALS), f"with {BOOT} select bt.replicate, {_EIGHT} from bt left join es on es.replicate = bt.replicate")
def d48(spark, sf):
    return metrics.bootstrap(S.scored_days(spark, sf), 9)


@query("d48_bootstrap_interval", " ".join(f"{c}_{end}:f" for c in metrics.INTERVALS for end in ("lo", "hi")),
       f"with {BOOT} select {_BOUNDS} from bt left join es on es.replicate = bt.replicate")
def d48b(spark, sf):
    return metrics.interval(metrics.bootstrap(S.scored_days(spark, sf), 9), [])


PERM = S.SCORED + """, pr as (select permutation, score, case when row_number() over (partition by permutation order by md5('5|' || cast(permutation as varchar) || '|' || cast(pid as varchar) || '|' || cast(d as varchar))) <= (select sum(label) from scored) then 1 else 0 end as label from scored, (select unnest(range(1, 201)) as permutation) p),
 rk as (select *, rank() over (partition by permutation order by score) + (count(*) over (partition by permutation, score) - 1) / 2.0 as r from pr),
 nu as (select permutation, (sum(r) filter (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) as auroc from rk group by 1),
 ob0 as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from scored), ob as (select (sum(r) filter (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) as o from ob0)"""


@query("d49_permutation_test", "observed:f null_mean:f null_p95:f p_value:f permutations:l", f"with {PERM} select max(o) as observed, avg(auroc) as null_mean, quantile_cont(auroc, 0.95) as null_p95, avg(case when auroc >= o then 1.0 else 0 end) as p_value, count(*) as permutations from nu, ob")
def d49(spark, sf):
    return metrics.permutation_test(S.scored_days(spark, sf), 5, ["pid", "date"])


@query("d49_refit_test", "observed:f null_mean:f null_p95:f p_value:f permutations:l", """with v as (select vec_id as pid, cast(label < 5 as int) as y, cast(embedding[1] > 0 as int) as x from embeddings),
 fo as (select *, (row_number() over (partition by y order by md5('5|0|' || cast(pid as varchar))) - 1) % 5 as fold from v),
 pm as (select 0 as p, pid, x, fold, y from fo union all
  select p, pid, x, fold, cast(row_number() over (partition by p order by md5('5|' || cast(p as varchar) || '|' || cast(pid as varchar))) <= (select sum(y) from v) as int) from fo, (select unnest(range(1, 201)) as p) q),
 ks as (select unnest(range(5)) as k),
 fits as (select p, k, sign(avg(y) filter (x = 1) - avg(y) filter (x = 0)) as s from pm join ks on fold <> k group by 1, 2),
 au as (select pm.p, k, 0.5 + any_value(s) * (avg(x) filter (y = 1) - avg(x) filter (y = 0)) / 2 as auroc from pm join fits f on f.p = pm.p and f.k = pm.fold group by 1, 2),
 me as (select p, avg(auroc) as auroc from au group by 1), ob as (select auroc as o from me where p = 0)
select max(o) as observed, avg(auroc) as null_mean, quantile_cont(auroc, 0.95) as null_p95, avg(case when auroc >= o - 1e-12 then 1.0 else 0 end) as p_value, count(*) as permutations from me, ob where p > 0""")
def d49b(spark, sf):
    """One feature that is 0 or 1: a fold's model scores by the sign of the difference of its training shares, which SQL can say."""
    from pulsegrid.operators import sampling
    from pulsegrid.plans import refit

    e = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pid"), (F.col("label") < 5).cast("int").alias("label"), (F.col("embedding")[0] > 0).cast("int").alias("x"))
    return refit.refit_test(sampling.folds(e, "label", 5, 5).drop("repeat"), ["x"], ["pid"], 200, 5)


FOLDS = """un as (select pid, min(grp) as grp, max(label) as pos from scored group by 1), ux as (select *, pid % 2 as cls from un),
 fo as (select *, (row_number() over (partition by repeat, cls order by md5('3|' || cast(repeat as varchar) || '|' || cast(pid as varchar))) - 1) % 3 as fold from ux, (select unnest(range(0, 4)) as repeat) r)"""


@query("d50_repeated_cv", "auroc:f auroc_lo:f auroc_hi:f repeats:l", f"""with {S.SCORED}, {FOLDS}, x as (select repeat, fold, s.score, s.label from fo join scored s on s.pid = fo.pid),
 rk as (select *, rank() over (partition by repeat, fold order by score) + (count(*) over (partition by repeat, fold, score) - 1) / 2.0 as r from x),
 pf as (select repeat, fold, (sum(r) filter (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) as auroc from rk group by 1, 2), pr as (select repeat, avg(auroc) as a from pf group by 1)
select avg(a) as auroc, quantile_cont(a, 0.025) as auroc_lo, quantile_cont(a, 0.975) as auroc_hi, count(*) as repeats from pr""")
def d50(spark, sf):
    from pulsegrid.operators import cohort, sampling
    d = S.scored_days(spark, sf)
    u = cohort.subject_strata(d).withColumn("cls", F.col("pid") % 2)
    f = sampling.folds(u, "cls", 3, 3, repeats=4).select("repeat", "fold", "pid")
    return metrics.repeated_cv_summary(metrics.detection_scores(d.join(f, "pid"), ["repeat", "fold"]), [], "auroc")


TAGGED = S.RUNS + ", tg as (select *, model || '_d' || cast(run % 3 + 3 as varchar) || case when run % 2 = 0 then '_h1' else '' end as tag from runs)"
LASTSEED = TAGGED + ", ls as (select *, row_number() over (partition by tag, test, seed order by finished desc, run desc) as rn from tg), sd as (select model as base, run % 3 + 3 as days, case when run % 2 = 0 then 1 end as horizon, test, seed, mae from ls where rn = 1)"


def _seeded(spark, sf):
    r = S.runs(spark, sf)
    tag = F.concat("model", F.lit("_d"), (F.col("run") % 3 + 3).cast("string"), F.when(F.col("run") % 2 == 0, "_h1").otherwise(""))
    one = R.last_run(r.withColumn("tag", tag), ["tag", "test", "seed"], "finished", "run")
    base, days, horizon = ledger.parse_tag(F.col("tag"))
    return one.withColumns({"base": base, "days": days, "horizon": horizon})


@query("d51_seed_summary", "base:s days:l horizon:l test:s seeds:l mae_mean:f mae_sd:f", f"with {LASTSEED} select base, days, horizon, test, count(*) as seeds, avg(mae) as mae_mean, stddev_samp(mae) as mae_sd from sd group by 1, 2, 3, 4")
def d51(spark, sf):
    return ledger.seed_summary(_seeded(spark, sf), ["base", "days", "horizon", "test"], ["mae"])


@query("d52_cross_tab", "base:s d3:f d4:f d5:f", f"with {LASTSEED} select base, avg(mae) filter (days = 3) as d3, avg(mae) filter (days = 4) as d4, avg(mae) filter (days = 5) as d5 from sd group by 1")
def d52(spark, sf):
    t = ledger.cross_tab(_seeded(spark, sf), ["base"], "days", [3, 4, 5], "mae")
    return t.withColumnsRenamed({"3": "d3", "4": "d4", "5": "d5"})


@query("d52_interval_cells", "test:s cell:s", f"with {S.RUNS} select test, printf('%d [%d-%d]', cast(floor(avg(mae)) as bigint), cast(floor(min(mae)) as bigint), cast(floor(max(mae)) as bigint)) as cell from runs group by 1".replace("printf('%d [%d-%d]', ", "concat(").replace("cast(floor(avg(mae)) as bigint), cast(floor(min(mae)) as bigint), cast(floor(max(mae)) as bigint))", "cast(floor(avg(mae)) as bigint), '.000 [', cast(floor(min(mae)) as bigint), '.00-', cast(floor(max(mae)) as bigint), '.00]')"))
def d52b(spark, sf):
    t = S.runs(spark, sf).groupBy("test").agg(*[F.floor(f("mae")).cast("double").alias(n) for n, f in (("a", F.avg), ("b", F.min), ("c", F.max))])
    return t.select("test", ledger.interval_cell(F.col("a"), F.col("b"), F.col("c")).alias("cell"))


@query("d53_class_balance", "grp:s subjects:l days:l positive:l positive_subjects:l", f"with {S.SCORED}, p as (select grp, pid, count(*) as c, sum(label) as l from scored group by 1, 2) select cast(grp as varchar) as grp, count(*) as subjects, sum(c) as days, sum(l) as positive, count(*) filter (l > 0) as positive_subjects from p group by 1")
def d53(spark, sf):
    per = S.scored_days(spark, sf).groupBy("grp", "pid").agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("l"))
    return per.groupBy("grp").agg(F.count(F.lit(1)).alias("subjects"), F.sum("c").alias("days"), F.sum("l").alias("positive"), F.count_if(F.col("l") > 0).alias("positive_subjects"))


@query("d54_day_max", "pid:l date:d click:f view:f", "select user_id as pid, cast(ts as date) as date, max(abs(value)) filter (event_type = 'click') as click, max(abs(value)) filter (event_type = 'view') as view from events group by 1, 2")
def d54(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("pid"), F.to_date("ts").alias("date"), *[F.when(F.col("event_type") == v, F.col("value")).alias(v) for v in ("click", "view")])
    return daystore.day_max(e, ["click", "view"])


@query("d55_importance", "model:s family:s total:f share_pct:f", """with c as (select 'm' || cast(l_linenumber as varchar) as model, l_returnflag as family, l_shipdate, abs(l_discount - 0.05) as v from lineitem), f as (select model, family, avg(v) as total from c group by 1, 2)
select model, family, total, 100 * total / sum(total) over (partition by model) as share_pct from f""")
def d55(spark, sf):
    c = S.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"), F.col("l_returnflag").alias("family")).agg(F.avg(F.abs(F.col("l_discount") - 0.05)).alias("v"))
    return ledger.importance_by_family(c, ["model"], "family", "v")


@query("d56_ablation", "model:s dropped:s mae:f change:f", f"with {S.RUNS}, m as (select model, case seed when 0 then 'none' else 'family' || cast(seed as varchar) end as dropped, avg(mae) as mae from runs group by 1, 2) select a.model, a.dropped, a.mae, a.mae - b.mae as change from m a left join m b on b.model = a.model and b.dropped = 'none'")
def d56(spark, sf):
    dropped = F.when(F.col("seed") == 0, "none").otherwise(F.concat(F.lit("family"), F.col("seed").cast("string")))
    return ledger.ablation(S.runs(spark, sf).groupBy("model", dropped.alias("dropped")).agg(F.avg("mae").alias("mae")), ["model"], "dropped")


@query("d57_table_equality", "matched:l left_only:l right_only:l diff_q:l diff_d:l", """with a as (select l_orderkey * 10 + l_linenumber as id, count(*) over (partition by l_orderkey, l_linenumber) as c, l_quantity as q, case when l_suppkey % 2 = 0 then l_discount end as d from lineitem), l as (select id, q, d from a where c = 1 and id % 7 <> 0), r as (select id, q + case when id % 3 = 0 then 0.001 else 0.00001 end as q, case when id % 5 = 0 then null else d end as d from a where c = 1 and id % 11 <> 0)
select count(*) filter (l.id is not null and r.id is not null) as matched, count(*) filter (r.id is null) as left_only, count(*) filter (l.id is null) as right_only, count(*) filter (l.id is not null and r.id is not null and not (l.q is null and r.q is null) and not coalesce(abs(l.q - r.q) <= 1e-4, false)) as diff_q,
 count(*) filter (l.id is not null and r.id is not null and not (l.d is null and r.d is null) and not coalesce(abs(l.d - r.d) <= 1e-4, false)) as diff_d from l full join r on l.id = r.id""")
def d57(spark, sf):
    a = S.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(
        F.count(F.lit(1)).alias("c"), F.max("l_quantity").alias("q"), F.max(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_discount"))).alias("d")).where("c = 1")
    left = a.where("id % 7 <> 0").select("id", "q", "d")
    right = a.where("id % 11 <> 0").select("id", (F.col("q") + F.when(F.col("id") % 3 == 0, 0.001).otherwise(0.00001)).alias("q"), F.when(F.col("id") % 5 != 0, F.col("d")).alias("d"))
    return joins.same_tables(left, right, ["id"], ["q", "d"])


@query("d58_invariants", "rule:s violations:l", "select unnest(['duplicate key', 'mask on blank', 'reading in a run', 'run longer than the cut', 'split outside segment']) as rule, 0 as violations")
def d58(spark, sf):
    from pulsegrid.operators import sampling
    t = hubs.segment_table(spark, sf)
    masked = t.join(sampling.random_mask(t, 1).withColumn("mask", F.lit(1)), ["segment", "slot"], "left")
    inside = F.col("segment").isNotNull()
    rules = {"mask on blank": (F.col("mask") == 1) & F.col("hrv").isNull(), "split outside segment": ~inside & F.col("split").isNotNull(),
             "run longer than the cut": inside & (F.col("missing_run") > hubs.LONGEST_GAP), "reading in a run": F.col("hrv").isNotNull() & (F.col("missing_run") > 0)}
    return quality.violations(masked, rules).unionByName(quality.duplicate_keys(t, ["pid", "slot"]))


@query("d58_label_agreement", "rule:s violations:l", "select unnest(['episode without label', 'label without episode', 'onset label on an invalid day']) as rule, 0 as violations")
def d58b(spark, sf):
    d = S.day_table(spark, sf).withColumn("sample", F.col("hrv_n") > 0)
    d = episodes.onset_valid(episodes.episode_of_day(d, S.episodes(spark, sf)), 3)
    d = episodes.next_onset(d, S.episodes(spark, sf), 3).withColumn("label", (F.col("sample") & F.col("episode").isNotNull()).cast("int"))
    d = d.withColumn("episode", F.when(F.col("sample"), F.col("episode"))).withColumn("onset_label", F.when(F.col("onset_valid"), F.col("onset_label")).otherwise(0))
    return quality.violations(d, {"episode without label": F.col("episode").isNotNull() & (F.col("label") == 0), "label without episode": F.col("episode").isNull() & (F.col("label") == 1),
                                  "onset label on an invalid day": (F.col("onset_label") == 1) & (~F.col("onset_valid") | (F.col("label") == 1))})


@query("d59_pooled_counts", "model:s n:l events:l flagged:l top_score:f", f"with {S.SCORED} select 'split' || cast(pid % 5 as varchar) as model, count(*) as n, sum(label) as events, count(*) filter (score >= 0.5) as flagged, max(score) as top_score from scored group by 1")
def d59(spark, sf):
    d = S.scored_days(spark, sf)
    return d.groupBy(F.concat(F.lit("split"), (F.col("pid") % 5).cast("string")).alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("events"), F.count_if(F.col("score") >= 0.5).alias("flagged"), F.max("score").alias("top_score"))


@query("d60_paired_difference", "test:s splits:l mean_diff:f higher:l", f"with {S.RUNS}, m as (select model, test, seed, avg(mae) as mae from runs group by 1, 2, 3) select a.test, count(*) as splits, avg(b.mae - a.mae) as mean_diff, count(*) filter (b.mae > a.mae) as higher from m a join m b on a.test = b.test and a.seed = b.seed where a.model = 'm1' and b.model = 'm2' group by 1")
def d60(spark, sf):
    m = S.runs(spark, sf).groupBy("model", "test", "seed").agg(F.avg("mae").alias("mae"))
    return ledger.paired_difference(m, ["test"], ["seed"], "model", "m1", "m2", "mae")


@query("d61_pooled_calibration", "band:l n:l predicted:f observed:f splits:l", f"""with {S.SCORED}, b as (select {BAND} as band, score, label, pid % 5 as split from scored), ax as (select unnest(range(0, 10)) as band)
select ax.band, count(b.score) as n, avg(score) as predicted, avg(label) as observed, count(distinct split) as splits from ax left join b on b.band = ax.band group by 1""")
def d61(spark, sf):
    return metrics.pooled_calibration(S.scored_days(spark, sf).withColumn("split", F.col("pid") % 5), [], "split")
