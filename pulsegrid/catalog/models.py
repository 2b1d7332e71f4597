"""Model and evaluation jobs (H) and the plug-in contracts (I)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pulsegrid.catalog import standins as S
from pulsegrid.catalog.cohort import RHYTHM
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.sampling import MASK, UNITS, units
from pulsegrid.catalog.windows import LINE
from pulsegrid.operators import baselines, daystore, fills, joins, metrics, sampling
from pulsegrid.plans import features as PF
from pulsegrid.plans import grid, hubs, models, registry, rhythm
from pulsegrid.plans.neighbours import neighbour_votes
from pulsegrid.sources.stage import materialise, new_path

PERIOD = 4  # six-hour slots per day


def practice_rows(spark, sf):
    """Segments with a fifth of the readings hidden: what the fillers and their scores read of the hub."""
    t = hubs.segment_table(spark, sf)
    return materialise(PF.hidden(t.select("pid", "segment", "slot", "hrv"), sampling.random_mask(t, 1)), "visible")


@query("h01_tree_filler", "n:l n_missing:l mae:f rmse:f line_mae:f")
def h01(spark, sf):
    rows = practice_rows(spark, sf)
    tree = models.fill_error(models.predict_fill(models.fit_filler(rows, 2, PERIOD)))
    line = models.fill_error(registry.get(registry.FILLERS, "straight_line", "fill")(rows, PERIOD))
    return tree.withColumn("line_mae", line.select("mae").scalar())


@query("h02_tree_forecaster", "segment:s h:l pred:f")
def h02(spark, sf):
    train = hubs.segment_table(spark, sf).where("split = 'train'")
    model, feats, names = models.fit_forecaster(train, 3, PERIOD, 4, 20, 11)
    return models.predict_forecast(model, feats, names, PERIOD, 4)


@query("h03_references", "pid:l date:d never:f prior:f", f"with {S.SCORED} select pid, d as date, 0.0 as never, (select avg(label) from scored where pid % 3 <> 0) as prior from scored where pid % 3 = 0")
def h03(spark, sf):
    d = S.scored_days(spark, sf)
    test, train = d.where("pid % 3 = 0"), d.where("pid % 3 <> 0")
    return baselines.prior(baselines.never(test, "never"), train, "label", "prior")


FORE = RHYTHM + """, la as (select pid, arg_max(r, slot) filter (r is not null) as r, max(slot) filter (r is not null) as s from res group by 1), hz as (select pid, r, s, unnest(range(1, 5)) as h from la),
 fc as (select h.pid, h.h, exp(b0 + b_cos * cos(2 * pi() * ((s + h) % 4) / 4) + b_sin * sin(2 * pi() * ((s + h) % 4) / 4) + pow(rho, h) * r + 0.3 * variance / 2) as pred from hz h join fit f on f.pid = h.pid join ar a on a.pid = h.pid)"""


@query("h04_rhythm_forecast", "pid:l h:l pred:f", f"with {FORE} select pid, h, pred from fc")
def h04(spark, sf):
    return rhythm.forecast(hubs.grid_table(spark, sf), ["pid"], PERIOD, 4)


@query("h04_rhythm_filler", "pid:l slot:l filled:f", "with " + RHYTHM + ", " + LINE[len(S.GRID) + 1:].strip().lstrip(",") + """, w as (select e.*, b0, b_cos, b_sin, rho, variance, b0 + b_cos * cos(2 * pi() * (slot % 4) / 4) + b_sin * sin(2 * pi() * (slot % 4) / 4) as mu,
 pow(rho, dprev) * (case when prev > 0 then ln(prev) end - (b0 + b_cos * cos(2 * pi() * ((slot - dprev) % 4) / 4) + b_sin * sin(2 * pi() * ((slot - dprev) % 4) / 4))) as f,
 pow(rho, dnext) * (case when next > 0 then ln(next) end - (b0 + b_cos * cos(2 * pi() * ((slot + dnext) % 4) / 4) + b_sin * sin(2 * pi() * ((slot + dnext) % 4) / 4))) as b from ends e join fit using (pid) join ar using (pid))
select pid, slot, coalesce(hrv, exp(mu + coalesce((1 - dprev / (dprev + dnext)) * f + dprev / (dprev + dnext) * b, f, b, 0) + 0.3 * variance / 2)) as filled from w""")
def h04b(spark, sf):
    g = hubs.grid_table(spark, sf)
    return rhythm.fill(g, fills.nearest(g, ["pid"]), ["pid"], PERIOD)


@query("h05_day_window_classifier", "n:l n_pos:l auroc:f auprc:f brier:f")
def h05(spark, sf):
    e = S.table(spark, sf, "events").withColumn("pid", F.col("user_id"))
    cells = daystore.minute_cells(e.withColumn("hr", F.col("value")), "pid", "ts", ["hr"])
    d = S.scored_days(spark, sf).select("pid", "date", "label")
    x = PF.day_window_vector(cells, d, 3, 360, ["hr"])
    rows = materialise(x.join(d, ["pid", "date"]).select("pid", "date", "label", array_to_vector("x").alias("features")), "windows")
    train = models.class_weights(rows.where("pid % 4 <> 0"), "label")
    fitted = models.fit_contender(train, models.contender("boosted trees", models.light()))
    return metrics.detection_scores(models.score_column(fitted.transform(models.class_weights(rows.where("pid % 4 = 0"), "label"))), [])


@query("h06_class_weights", "pid:l date:d ratio:f balanced:f", f"with {S.SCORED}, c as (select count(*) as n, sum(label) as p from scored) select pid, d as date, case when label = 1 then (n - p) / p else 1.0 end as ratio, case when label = 1 then n / (2 * p) else n / (2 * (n - p)) end as balanced from scored, c")
def h06(spark, sf):
    d = S.scored_days(spark, sf)
    return models.class_weights(models.class_weights(d, "label", "ratio", "ratio"), "label", "balanced", "balanced")


@query("h07_in_fold_scaling", "id:l q:f d:f", """with w as (select l_orderkey * 100000 + l_partkey as id, l_linenumber as ln, case when l_linenumber % 2 = 0 then l_quantity end as q, case when l_linenumber % 3 > 0 then l_discount end as d from lineitem), t as (select * from w where ln <> 1),
 m as (select median(q) as mq, median(d) as md from t), s as (select avg(coalesce(q, mq)) as aq, stddev_pop(coalesce(q, mq)) as sq, avg(coalesce(d, md)) as ad, stddev_pop(coalesce(d, md)) as sd from t, m)
select id, (coalesce(q, mq) - aq) / sq as q, (coalesce(d, md) - ad) / sd as d from w, m, s where ln = 1""")
def h07(spark, sf):
    n = F.col("l_linenumber")
    w = S.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("id"), n.alias("ln"),
                                              F.when(n % 2 == 0, F.col("l_quantity")).alias("q"), F.when(n % 3 > 0, F.col("l_discount")).alias("d"))
    sc = models.fit_scaling(w.where("ln <> 1").select("q", "d"), ["q", "d"])
    return models.apply_scaling(w.where("ln = 1"), sc, ["q", "d"])


def labelled_vectors(spark, sf):
    e = S.table(spark, sf, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    d = e.select(F.col("vec_id").alias("pid"), x.alias("x"), (F.col("label") < 5).cast("int").alias("label"))
    return materialise(models.class_weights(d.withColumn("features", array_to_vector("x")), "label", "balanced"), "vectors")


@query("h08_classifiers", "model:s n:l auroc:f sensitivity:f specificity:f")
def h08(spark, sf):
    rows = labelled_vectors(spark, sf)
    train, test = rows.where("pid % 4 <> 0"), rows.where("pid % 4 = 0")
    out = None
    for c in models.light():
        m = metrics.detection_scores(models.score_column(models.fit_contender(train, c).transform(test)), []).withColumn("model", F.lit(c.name))
        out = m if out is None else out.unionByName(m)
    return out


@query("h09_discriminant", "n:l n_pos:l auroc:f")
def h09(spark, sf):
    rows = labelled_vectors(spark, sf)
    w, b = models.fit_discriminant(rows.where("pid % 4 <> 0"), "x", "label")
    return metrics.detection_scores(models.apply_discriminant(rows.where("pid % 4 = 0"), "x", w, b), [])


@query("h10_nearest_neighbours", "id:l uniform:f by_distance:f", """with a as (select vec_id as id, embedding as x from embeddings where vec_id % 4 = 0), b as (select vec_id as id, embedding as x, case when label < 5 then 1.0 else 0 end as y from embeddings where vec_id % 4 <> 0),
 d as (select a.id, b.y, list_sum([pow(cast(a.x[i] as double) - cast(b.x[i] as double), 2) for i in range(1, 65)]) as d, b.id as rid from a, b), r as (select *, row_number() over (partition by id order by d, rid) as i from d)
select id, avg(y) as uniform, sum(y / sqrt(d)) / sum(1 / sqrt(d)) as by_distance from r where i <= 5 group by 1""")
def h10(spark, sf):
    rows = labelled_vectors(spark, sf).select("pid", "x", "label")
    test, train = rows.where("pid % 4 = 0"), rows.where("pid % 4 <> 0")
    return neighbour_votes(test, train, "pid", "x", "label", 5, pivots=8, rings=4)


@query("h11_nested_cv", "model:s auroc:f auroc_lo:f auroc_hi:f repeats:l")
def h11(spark, sf):
    rows, names = feature_columns(spark, sf)
    folded = sampling.folds(rows.select("pid", "label"), "label", 5, 3, repeats=20)
    return metrics.repeated_cv_summary(models.nested_cv(rows, names, models.contenders(), folded, "pid"), ["model"], "auroc")


def feature_columns(spark, sf):
    """The vectors as columns with blanks: component i of vector v is missing where (v + i) mod 11 is 0."""
    e = S.table(spark, sf, "embeddings")
    names = [f"f_{i}" for i in range(64)]
    cells = [F.when((F.col("vec_id") + i) % 11 != 0, F.col("embedding")[i].cast("double")).alias(n) for i, n in enumerate(names)]
    return materialise(e.select(F.col("vec_id").alias("pid"), (F.col("label") < 5).cast("int").alias("label"), *cells), "feature-columns"), names


CV_FOLDS = """v as (select vec_id as pid, cast(label < 5 as int) as y from embeddings),
 fo as (select *, r.repeat as rep, (row_number() over (partition by r.repeat, y order by md5('3|' || cast(r.repeat as varchar) || '|' || cast(pid as varchar))) - 1) % 5 as fold from v, (select 0 as repeat) r)"""


@query("h11_held_out_folds", "model:s repeat:l fold:l n:l n_pos:l half:l in_range:l", f"""with {CV_FOLDS} select model, rep as repeat, fold, count(*) as n, sum(y) as n_pos, cast(model = 'constant' as int) as half, 1 as in_range
 from fo, (select unnest(['constant', 'logit, squared penalty', 'normal densities']) as model) m group by model, rep, fold""")
def h11b(spark, sf):
    """What SQL can say of every (model, repeat, fold): who is held out, that a constant scores 0.5 and others better than that on the whole."""
    rows, names = feature_columns(spark, sf)
    folded = sampling.folds(rows.select("pid", "label"), "label", 5, 3)
    among = [models.contender(n, models.light()) for n in ("constant", "logit, squared penalty", "normal densities")]
    per = models.nested_cv(rows, names, among, folded, "pid", inner_folds=2)
    return per.withColumns({"half": (F.col("auroc") == 0.5).cast("int"), "in_range": F.col("auroc").between(0, 1).cast("int")})


@query("i02_trained_classifier", "pid:l label:l scored:l constant:f", "select vec_id as pid, cast(label < 5 as int) as label, 1 as scored, (select avg(cast(label < 5 as int)) from embeddings where vec_id % 3 <> 0) as constant from embeddings where vec_id % 3 = 0")
def i02b(spark, sf):
    """Every trained classifier behind the contract gives each test row a score from 0 to 1; the constant one is the training share."""
    rows, _ = feature_columns(spark, sf)
    test, train = rows.where("pid % 3 = 0"), rows.where("pid % 3 <> 0")
    names = [n for n, e in registry.CLASSIFIERS.items() if e.family == "trained"]
    scored = test.withColumnRenamed("label", "truth")
    for n in names:
        scored = registry.get(registry.CLASSIFIERS, n, "detect")(scored, train).withColumnRenamed("score", n)
    others = reduce(and_, [F.col(f"`{n}`").between(0, 1) for n in names if n != "constant"])
    out = test.select("pid", "label").join(scored.select("pid", "constant"), "pid").join(scored.select("pid", others.alias("s")), "pid")
    return out.withColumn("scored", F.col("s").cast("int"))


@query("h12_event_target", "pid:l target:l followup_days:l", """with ev as (select distinct user_id as pid from events where event_type = 'error' and value > 200), un as (select distinct user_id as pid from events where event_type = 'error' and value > 150),
 f as (select user_id as pid, max(cast(ts as date)) - min(cast(ts as date)) + 1 as followup_days from events group by 1)
select c_custkey as pid, case when c_custkey in (select pid from ev) then 1 when c_custkey in (select pid from un) then null when followup_days is not null then 0 end as target, followup_days from customer left join f on f.pid = c_custkey""")
def h12(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("pid"), "event_type", "value", F.to_date("ts").alias("date"))
    roster = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"))
    return models.event_target(roster, e.where("event_type = 'error' and value > 200"), e, e.where("event_type = 'error' and value > 150"))


@query("h13_settings_search", "trial:l settings:s mae:f")
def h13(spark, sf):
    t = hubs.segment_table(spark, sf)
    mask = sampling.block_mask(t, sampling.run_pool(t, distinct=False, longest=18), 123, pct=15)
    rows = materialise(PF.hidden(t, mask), "practice-mask")
    return models.settings_search(rows, 2, PERIOD, {"maxDepth": [2, 3, 5], "maxIter": [3, 6], "stepSize": [0.1, 0.3]}, 2, 0)


@query("h14_drop_one_family", "model:s dropped:s mae:f change:f")
def h14(spark, sf):
    return models.drop_one_family(practice_rows(spark, sf), 2, PERIOD, {"nearest reading": ["prev", "next", "dprev", "dnext"], "time of day": ["sin", "cos"]}, maxIter=4)


@query("h15_importance", "model:s family:s total:f share_pct:f")
def h15(spark, sf):
    return models.importance(models.fit_filler(practice_rows(spark, sf), 2, PERIOD, maxIter=5))


@query("h16_vector_head", "n:l n_pos:l auroc:f")
def h16(spark, sf):
    rows = labelled_vectors(spark, sf).select("pid", F.col("x").alias("vector"), "label")
    cache = rows.where("pid % 3 <> 0").select("pid", "vector")
    _, vectors = joins.fill_cache(rows.select("pid"), cache, ["pid"], lambda miss: rows.join(miss, "pid", "left_semi").select("pid", "vector"))
    d = vectors.join(rows.select("pid", "label"), "pid")
    model = models.vector_head(d.where("pid % 4 <> 0"))
    test = d.where("pid % 4 = 0").withColumn("features", array_to_vector("vector"))
    return metrics.detection_scores(models.score_column(model.transform(test)), [])


@query("h17_experiment_grid", "share:f seed:l n:l n_pos:l auroc:f sensitivity:f", f"""with {UNITS}, gr as (select un.*, share, seed from un, (select unnest([0.2, 0.3, 0.4]) as share) a, (select unnest([0, 1, 2]) as seed) b),
 dr as (select *, row_number() over (partition by share, seed, grp, pos order by md5('grid|' || cast(seed as varchar) || '|' || cast(pid as varchar))) as i, count(*) over (partition by share, seed, grp, pos) as c from gr),
 te as (select share, seed, pid from dr where i <= floor(c * share::double + 0.5)), x as (select t.share, t.seed, s.score, s.label from te t join scored s on s.pid = t.pid),
 rk as (select *, rank() over (partition by share, seed order by score) + (count(*) over (partition by share, seed, score) - 1) / 2.0 as r from x)
select share, seed, count(*) as n, sum(label) as n_pos, (sum(r) filter (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) as auroc, count(*) filter (label = 1 and score >= 0.5) / sum(label) as sensitivity from rk group by 1, 2""")
def h17(spark, sf):
    return models.experiment_grid(S.scored_days(spark, sf), units(spark, sf), ["grp", "pos"], [0.2, 0.3, 0.4], [0, 1, 2])


@query("h17_trained_grid", "task:s window:s horizon:s model:s share:s seed:s n:l n_pos:l auroc:f sensitivity:f")
def h17_trained(spark, sf):
    d = S.scored_days(spark, sf).withColumn("coverage", F.col("coverage").cast("double")).withColumn("strength", F.col("score"))
    age = d.groupBy("pid").agg(F.datediff(F.max("date"), F.min("date")).cast("double").alias("known_days"))
    among = [models.contender(n, models.light()) for n in ("constant", "logit, squared penalty", "one tree")]
    out = grid.trained_grid(d, units(spark, sf), ["grp", "pos"], ["coverage", "strength"], among, new_path(spark, "grid"), shares=[0.3], windows=[1, 7], horizons=[3], static=age)
    return out.select("task", "window", "horizon", "model", "share", "seed", "n", "n_pos", "auroc", "sensitivity")


HIDDEN = MASK + """, vi as (select l.pid, l.segment, l.slot, l.hrv, case when m.slot is null then l.hrv end as visible, m.slot is not null as scored from labelled l left join mask m on m.segment = l.segment and m.slot = l.slot where l.segment is not null),
 nv as (select *, max(case when visible is not null then slot end) over (partition by segment order by slot rows between unbounded preceding and 1 preceding) as p, min(case when visible is not null then slot end) over (partition by segment order by slot rows between 1 following and unbounded following) as x from vi),
 li as (select n.*, coalesce(n.visible, a.visible + (b.visible - a.visible) * (n.slot - n.p) / (n.x - n.p), a.visible, b.visible) as filled from nv n left join vi a on a.segment = n.segment and a.slot = n.p left join vi b on b.segment = n.segment and b.slot = n.x)"""


@query("i01_filler_contract", "model:s n:l mae:f rmse:f", f"with {HIDDEN} select 'straight_line' as model, count(*) as n, avg(abs(filled - hrv)) as mae, sqrt(avg(pow(filled - hrv, 2))) as rmse from li where scored")
def i01(spark, sf):
    rows = practice_rows(spark, sf)
    return models.fill_error(registry.get(registry.FILLERS, "straight_line", "fill")(rows, PERIOD)).withColumn("model", F.lit("straight_line"))


@query("i01_forecaster_contract", "model:s pid:l h:l pred:f", f"""with {S.GRID}, lv as (select pid, arg_max(hrv, slot) filter (hrv is not null) as v, median(hrv) as m from grid group by 1)
select 'last_value' as model, pid, unnest(range(1, 4)) as h, v as pred from lv union all select 'subject_median', pid, unnest(range(1, 4)), m from lv""")
def i01b(spark, sf):
    g = hubs.grid_table(spark, sf)
    run = lambda n: registry.get(registry.FORECASTERS, n, "forecast")(g, PERIOD, 3).select(F.lit(n).alias("model"), "pid", "h", "pred")
    return run("last_value").unionByName(run("subject_median"))


@query("i02_classifier_contract", "model:s n:l auroc:f brier:f", f"with {S.SCORED}, p as (select avg(label) as p from scored where pid % 3 <> 0), t as (select label from scored where pid % 3 = 0) select 'never' as model, count(*) as n, 0.5 as auroc, avg(pow(label, 2)) as brier from t union all select 'prior', count(*), 0.5, avg(pow(p - label, 2)) from t, p")
def i02(spark, sf):
    d = S.scored_days(spark, sf)
    test, train = d.where("pid % 3 = 0"), d.where("pid % 3 <> 0")
    run = lambda n: metrics.detection_scores(registry.get(registry.CLASSIFIERS, n, "detect")(test.drop("score"), train), []).withColumn("model", F.lit(n))
    return run("never").unionByName(run("prior"))


@query("i03_custom_series_function", "pid:l slot:l filled:f", f"with {LINE} select pid, slot, coalesce(hrv, prev + (next - prev) * dprev / (dprev + dnext), prev, next) as filled from ends")
def i03(spark, sf):
    import numpy as np

    def line(pdf):
        pdf = pdf.sort_values("slot")
        ok = pdf["hrv"].notna()
        return pdf.assign(filled=np.interp(pdf["slot"], pdf["slot"][ok], pdf["hrv"][ok]))[["pid", "slot", "filled"]]

    return models.per_series(hubs.grid_table(spark, sf).select("pid", "slot", "hrv"), ["pid"], line, "pid long, slot long, filled double")
