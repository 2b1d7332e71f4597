"""Scores of fills, forecasts and rare-event detectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.core import average_ranks, by_value, draw_key, exact_quantiles, floor_div, sweep
from pulsegrid.sources.stage import materialise


def score_table(rows: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", weight: Column | None = None) -> DataFrame:
    """One row per (keys, distinct score): positives and rows here, and from the highest score down.

    `tp` and `flagged` count the rows scored at least this much. Equal scores
    are merged first, so a constant score is one row, not one task.
    """
    w = F.lit(1) if weight is None else weight
    t = by_value(rows.withColumn("_w", w), keys, score, {"pos": F.col(label) * F.col("_w"), "cnt": F.col("_w")})
    return t.select(
        *keys, F.col(score).alias("score"), "pos", "cnt", "pos_upto", "cnt_upto",
        F.col("pos_upto_total").alias("positives"), F.col("cnt_upto_total").alias("rows"),
        (F.col("pos_upto_total") - F.col("pos_upto") + F.col("pos")).alias("tp"),
        (F.col("cnt_upto_total") - F.col("cnt_upto") + F.col("cnt")).alias("flagged"))


def detection_scores(rows: DataFrame, keys: Sequence[str], threshold: float = 0.5, score: str = "score", label: str = "label",
                     weight: Column | None = None) -> DataFrame:
    """All row-level scores per key from the score table, in one aggregation.

    AUROC gives ties half and is null for one class; AUPRC is the step sum of
    precision over the distinct scores; rates with an empty base are null.
    """
    t = score_table(rows, keys, score, label, weight)
    hit = F.col("score") >= threshold
    pick = lambda c, e: F.coalesce(F.sum(F.when(c, e)), F.lit(0))
    neg = F.col("cnt") - F.col("pos")
    a = t.groupBy(*keys).agg(
        F.sum("cnt").alias("n"), F.sum("pos").alias("n_pos"), pick(hit, F.col("pos")).alias("tp"), pick(hit, neg).alias("fp"),
        pick(~hit, neg).alias("tn"), pick(~hit, F.col("pos")).alias("fn"),
        F.sum(F.col("pos") * (F.col("cnt_upto") - (F.col("cnt") - 1) / 2)).alias("_ranks"),
        F.sum(F.try_divide(F.col("pos"), F.col("positives")) * F.try_divide(F.col("tp"), F.col("flagged"))).alias("auprc"),
        (F.sum(F.col("pos") * F.pow(F.col("score") - 1, 2) + neg * F.pow("score", F.lit(2.0))) / F.sum("cnt")).alias("brier"))
    n1, n0 = F.col("n_pos"), F.col("n") - F.col("n_pos")
    sens, spec = F.try_divide("tp", n1), F.try_divide("tn", n0)
    return a.select(
        *keys, "n", "n_pos", "tp", "fp", "tn", "fn", F.try_divide(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        ((sens + spec) / 2).alias("balanced_accuracy"), sens.alias("sensitivity"), spec.alias("specificity"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"), F.try_divide(F.col("tn"), F.col("tn") + F.col("fn")).alias("npv"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        F.try_divide(F.col("_ranks") - n1 * (n1 + 1) / 2, n1 * n0).alias("auroc"), "auprc", "brier",
        F.try_divide(30 * F.col("fp"), n0).alias("false_alarms_per_30"))


def event_scores(rows: DataFrame, keys: Sequence[str], threshold: float = 0.5, score: str = "score", label: str = "label", event: str = "event") -> DataFrame:
    """Events, events with at least one flagged positive day, and their ratio."""
    ev = rows.where(F.col(label) == 1).groupBy(*keys, event).agg(F.max((F.col(score) >= threshold).cast("int")).alias("_hit"))
    e = ev.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.sum("_hit").alias("events_caught"))
    return e.withColumn("event_sensitivity", F.try_divide("events_caught", "events"))


def lead_times(rows: DataFrame, keys: Sequence[str], threshold: float = 0.5, score: str = "score", label: str = "label", event: str = "event",
               date: str = "date") -> DataFrame:
    """Median days between the first flagged positive day of an event and its onset."""
    from pulsegrid.functions.dates import id_date

    first = rows.where((F.col(label) == 1) & (F.col(score) >= threshold)).groupBy(*keys, event).agg(F.min(date).alias("_d"))
    return exact_quantiles(first.withColumn("_lead", F.datediff(id_date(F.col(event)), "_d")), keys, "_lead", {"lead_days_median": 0.5}).withColumnRenamed("n", "events_caught")


def with_all(rows: DataFrame, group: str, everything: str = "all") -> DataFrame:
    """Every row once under its group and once under `all`."""
    return rows.withColumn(group, F.explode(F.array(F.lit(everything), F.col(group).cast("string"))))


def calibration(rows: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", bands: int = 10) -> DataFrame:
    """Mean score and share of positives in equal score bands, empty bands included."""
    band = F.least(F.floor(F.col(score) * bands + 1e-9), F.lit(bands - 1)).cast("int")
    got = rows.groupBy(*keys, band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("predicted"), F.avg(F.col(label).cast("double")).alias("observed"))
    axis = got.select(*keys).distinct() if keys else got.sparkSession.range(1).drop("id")
    axis = axis.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    return axis.join(got, [*keys, "band"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pooled_calibration(rows: DataFrame, keys: Sequence[str], split: str, score: str = "score", label: str = "label", bands: int = 10) -> DataFrame:
    """Bands merged over all splits: every split's bands, added up by their counts."""
    per = calibration(rows, [*keys, split], score, label, bands)
    n = F.sum("n")
    return per.groupBy(*keys, "band").agg(n.alias("n"), F.try_divide(F.sum(F.col("predicted") * F.col("n")), n).alias("predicted"),
                                          F.try_divide(F.sum(F.col("observed") * F.col("n")), n).alias("observed"),
                                          F.count_if(F.col("n") > 0).alias("splits"))


def thirds(rows: DataFrame, infos: Sequence[str]) -> DataFrame:
    """Rows repeated per information column, with the third (0, 1, 2) its value falls into.

    Equal cut points merge into one; a value on a cut point belongs above it.
    """
    long = rows.withColumn("_i", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("double").alias("info")) for c in infos]))).select(
        *rows.columns, "_i.kind", "_i.info")
    cuts = exact_quantiles(long, ["kind"], "info", {"_c1": 1 / 3, "_c2": 2 / 3}).drop("n")
    part = F.when(F.col("_c1") == F.col("_c2"), (F.col("info") >= F.col("_c1")).cast("int")).otherwise(
        (F.col("info") >= F.col("_c1")).cast("int") + (F.col("info") >= F.col("_c2")).cast("int"))
    return long.join(cuts, "kind").withColumn("part", part).drop("_c1", "_c2")


def slices(rows: DataFrame, infos: Sequence[str], threshold: float = 0.5) -> DataFrame:
    t = thirds(rows, infos)
    span = t.groupBy("kind", "part").agg(F.min("info").alias("low"), F.max("info").alias("high"))
    s = detection_scores(t, ["kind", "part"], threshold).select("kind", "part", "n", "n_pos", "auroc", F.coalesce("sensitivity", F.lit(0.0)).alias("sensitivity"),
                                                               F.coalesce("specificity", F.lit(0.0)).alias("specificity"))
    return span.join(s, ["kind", "part"])


# ------------------------------------------------------- resampling, permutation
def resample_weights(units: DataFrame, replicates: int, seed: str | int, unit: str = "pid") -> DataFrame:
    """How often each unit is drawn in each replicate: n draws with replacement from n units.

    Units are numbered by md5 order, in pieces; each unit's number also serves
    as one draw of every replicate.
    """
    u, drawn = _draws(units, replicates, seed, unit)
    counts = drawn.groupBy("replicate", "_place").agg(F.count(F.lit(1)).alias("w"))
    return counts.join(u.select(unit, "_place"), "_place").select("replicate", unit, "w")


def _draws(units: DataFrame, replicates: int, seed: str | int, unit: str) -> tuple[DataFrame, DataFrame]:
    """The units with their place, and one (replicate, place) row per draw."""
    from pulsegrid.operators.core import draw_order
    from pulsegrid.operators.sampling import hex_number

    u = draw_order(units.select(unit).distinct().withColumn("_md5", draw_key(seed, unit)), [], "_md5", "_place")
    many = int(u.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = u.select("_place", "_place_total").repartition(many, "_place")  # dealt out before it is multiplied
    target = F.pmod(hex_number(draw_key(seed, "replicate", "_place")), F.col("_place_total")) + 1
    return u, dealt.select("_place", "_place_total", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).select("replicate", target.alias("_place"))


BLOCK = 4096
"""Units whose weights one task holds at a time when replicates are added up."""


def _packed_draws(draws: DataFrame, block: int, replicates: int) -> DataFrame:
    """(block, codes): the drawn places of (place, replicate) rows as numbers `offset * replicates + replicate - 1`, packed by block of places."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            place, replicate = (np.concatenate(c) for c in zip(*held, strict=True))
            at = place // block
            order = np.argsort(at, kind="stable")
            blocks, first = np.unique(at[order], return_index=True)
            codes = ((place % block) * replicates + replicate - 1)[order].astype("<i4")
            return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([c.tobytes() for c in np.split(codes, first[1:])], pa.binary())], names=["block", "codes"])

        for b in batches:
            if b.num_rows:
                held.append((b.column("place").to_numpy(), b.column("replicate").to_numpy()))
                n += b.num_rows
            if n >= 1 << 20:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return draws.mapInArrow(pack, "block long, codes binary")


def _weighted_sums(facts: DataFrame, draws: DataFrame, replicates: int, block: int) -> DataFrame:
    """(kind, score, replicate, a, b, known) summed over units, each row counted as often as its unit is drawn.

    `facts` has block, offset (the unit's place), kind, score, a, b. A task holds the weights of one block of units, places x replicates, and adds them up per (kind,
    score); what leaves it has one line per replicate and distinct score of its block, not per unit.
    """
    def add(left, right):
        import pandas as pd

        drawn = np.bincount(np.frombuffer(b"".join(right["codes"]), "<i4"), minlength=block * replicates).astype(np.int32).reshape(block, replicates)
        left = left.sort_values(["kind", "score"])
        group = left.groupby(["kind", "score"], dropna=False, sort=False).ngroup().to_numpy()
        offset, out = left["offset"].to_numpy(), {c: [] for c in ("kind", "score", "replicate", "a", "b", "known")}
        values = {"a": left["a"].fillna(0).to_numpy(dtype=float), "b": left["b"].to_numpy(dtype=float), "known": left["a"].notna().to_numpy(dtype=float)}
        for lo in range(0, len(left), BLOCK):  # so many rows x replicates at a time
            part = slice(lo, lo + BLOCK)
            w = drawn[offset[part]].astype(float)
            first = np.flatnonzero(np.r_[True, np.diff(group[part]) > 0])
            sums = {c: np.add.reduceat(w * v[part, None], first, axis=0) for c, v in values.items()}
            row, replicate = np.nonzero(sums["b"])
            for c in sums:
                out[c].append(sums[c][row, replicate])
            out["replicate"].append(replicate + 1)
            for c in ("kind", "score"):
                out[c].append(left[c].to_numpy()[part][first][row])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    sums = facts.groupBy("block").cogroup(draws.groupBy("block")).applyInPandas(add, "kind int, score double, replicate int, a double, b double, known double")
    return sums.groupBy("kind", "score", "replicate").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("known").alias("known"))


def bootstrap(rows: DataFrame, seed: str | int, replicates: int = 1000, threshold: float = 0.5, unit: str = "pid") -> DataFrame:
    """Scores of every replicate; a unit's days stay together and a unit drawn twice brings its events twice.

    Days are merged to (unit, score) and events to counts per unit. Units are dealt into blocks, and the replicates' weights of a block multiply its rows inside one
    task: no row is copied for a replicate.
    """
    block = min(BLOCK, (2 ** 31 - 1) // replicates)
    places, draws = _draws(rows, replicates, seed, unit)
    places = materialise(places.where(F.col(unit).isNotNull()).select(unit, (F.col("_place") - 1).alias("_at")), "resample-places")
    packed = _packed_draws(draws.select((F.col("_place") - 1).alias("place"), "replicate"), block, replicates)
    merged = rows.where("score is not null").groupBy(unit, "score").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("b"))
    events = event_scores(rows, [unit], threshold).select(unit, F.lit(None).cast("double").alias("score"), F.col("events_caught").alias("a"), F.col("events").alias("b"))
    facts = merged.withColumn("kind", F.lit(0)).unionByName(events.withColumn("kind", F.lit(1))).join(places, unit)
    facts = facts.select(floor_div("_at", block).alias("block"), F.pmod("_at", F.lit(block)).cast("int").alias("offset"), "kind",
                         F.col("score").cast("double").alias("score"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    sums = materialise(_weighted_sums(facts, packed, replicates, block), "resample-sums")
    sums = sums.withColumns({"a": F.when(F.col("known") > 0, F.col("a").cast("long")), "b": F.col("b").cast("long")})
    # a (replicate, score) row for positives and one for the rest, weighted
    x = sums.where("kind = 0").select("replicate", "score", F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("a").alias("wt")),
                                                                              F.struct(F.lit(0).alias("label"), (F.col("b") - F.col("a")).alias("wt")))).alias("z"))
    x = x.select("replicate", "score", "z.label", "z.wt").where("wt > 0")
    s = detection_scores(x, ["replicate"], threshold, weight=F.col("wt"))
    ev = sums.where("kind = 1").select("replicate", F.try_divide("a", "b").alias("event_sensitivity"))
    return s.join(ev, "replicate", "left")


INTERVALS = ("auroc", "auprc", "sensitivity", "specificity", "ppv", "brier", "event_sensitivity", "false_alarms_per_30")
"""The scores that get an interval."""


def interval(replicates: DataFrame, keys: Sequence[str], scores: Sequence[str] = INTERVALS, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval per score; a key's group has one row per replicate."""
    return replicates.groupBy(*keys).agg(
        *[F.percentile(s, F.lit(low)).alias(f"{s}_lo") for s in scores], *[F.percentile(s, F.lit(high)).alias(f"{s}_hi") for s in scores])


def _shuffles(rows: DataFrame, permutations: int, seed: str | int, unit: Sequence[str], keep: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """(permutation, draw, head) and the `keep` columns: every row once per shuffle, dealt out before it is multiplied."""
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.concat_ws("", *[F.concat(F.lit("|"), F.col(c).cast("string")) for c in unit])  # once per row: the draw's text is that of `draw_key`
    wide = rows.select(*unit, *keep).repartition(many, *unit).select(key.alias("_key"), *keep)
    wide = wide.select("*", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("permutation"))
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col("permutation").cast("string"), F.col("_key")))
    return wide.select("permutation", *keep, draw.alias("_draw")).withColumn("_head", F.substring("_draw", 1, digits))


def _at_the_cut(draws: DataFrame, positives: Column, digits: int, weight: Column) -> tuple[DataFrame, DataFrame]:
    """Where each shuffle's positives end: (permutation, head of the cut, positives left there, weight of the heads before), and the draws of that
    head with their place. Only sums per head are shuffled, and the few draws that share the cut's head."""
    heads = draws.groupBy("permutation", "_head").agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
    heads = sweep(materialise(heads, "shuffle-heads"), ["permutation"], "_head", sums={"_upto": F.col("_n"), "_w_upto": F.col("_w")}, piece=F.substring("_head", 1, 1))
    edge = heads.withColumn("_p", positives).where((F.col("_upto") >= F.col("_p")) & (F.col("_upto") - F.col("_n") < F.col("_p")))
    edge = materialise(edge.select("permutation", "_head", (F.col("_p") - F.col("_upto") + F.col("_n")).alias("_rest"), (F.col("_w_upto") - F.col("_w")).alias("_before")), "shuffle-cuts")
    near = materialise(draws.join(edge, ["permutation", "_head"]).drop("_head"), "shuffle-edges")
    return edge, sweep(near, ["permutation"], "_draw", sums={"_place": F.lit(1)}, piece=F.substring("_draw", digits + 1, 2))


def permutation_cuts(rows: DataFrame, permutations: int, seed: str | int, unit: Sequence[str], digits: int = 2) -> DataFrame:
    """(permutation, cut): the draw up to which a shuffle's rows count as positive, so that there are as many as before. `unit` tells rows apart.

    Without a positive row there is no cut.
    """
    positives = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("p")).scalar()
    _, near = _at_the_cut(_shuffles(rows, permutations, seed, unit, (), digits), positives, digits, F.lit(0))
    return near.where(F.col("_place") == F.col("_rest")).select("permutation", F.col("_draw").alias("cut"))


def permuted_auroc(rows: DataFrame, permutations: int, seed: str | int, unit: Sequence[str], digits: int = 2) -> DataFrame:
    """AUROC of each permutation: as many positives as before, placed by an md5 draw. `unit` tells rows apart.

    A row's rank by score is the same in all permutations, so the ranks are found once, and a permutation adds up those of its positives.
    """
    rows = materialise(rows.where("score is not null").select(*unit, "score", "label"), "shuffled-rows")
    ranked = rows.join(average_ranks(rows, [], "score").select("score", "avg_rank"), "score")
    counts = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n"))
    positives, n1, n0 = counts.select("p").scalar(), counts.select(F.col("p").cast("double")).scalar(), counts.select((F.col("n") - F.col("p")).cast("double")).scalar()
    edge, near = _at_the_cut(_shuffles(ranked, permutations, seed, unit, ["avg_rank"], digits), positives, digits, F.col("avg_rank"))
    inside = near.where(F.col("_place") <= F.col("_rest")).groupBy("permutation").agg(F.sum("avg_rank").alias("_inside"))
    sums = edge.join(inside, "permutation").select("permutation", (F.coalesce("_before", F.lit(0.0)) + F.col("_inside")).alias("_r"))
    every = rows.sparkSession.range(1, permutations + 1).select(F.col("id").cast("int").alias("permutation"))
    return every.join(sums, "permutation", "left").select("permutation", F.try_divide(F.col("_r") - n1 * (n1 + 1) / 2, n1 * n0).alias("auroc"))


def permutation_test(rows: DataFrame, seed: str | int, unit: Sequence[str], permutations: int = 200) -> DataFrame:
    rows = materialise(rows.select(*unit, "score", "label"), "permuted")
    observed = detection_scores(rows, []).select("auroc")
    null = permuted_auroc(rows, permutations, seed, unit).withColumn("_obs", observed.scalar())
    return null.agg(F.max("_obs").alias("observed"), F.avg("auroc").alias("null_mean"), F.percentile("auroc", F.lit(0.95)).alias("null_p95"),
                    F.avg((F.col("auroc") >= F.col("_obs")).cast("double")).alias("p_value"), F.count(F.lit(1)).alias("permutations"))


def repeated_cv_summary(per_fold: DataFrame, keys: Sequence[str], score: str, repeat: str = "repeat") -> DataFrame:
    """Mean over folds, then mean and 2.5 / 97.5 % over repeats."""
    per = per_fold.groupBy(*keys, repeat).agg(F.avg(score).alias(score))
    return per.groupBy(*keys).agg(F.avg(score).alias(score), F.percentile(score, F.lit(0.025)).alias(f"{score}_lo"),
                                  F.percentile(score, F.lit(0.975)).alias(f"{score}_hi"), F.count(F.lit(1)).alias("repeats"))


# --------------------------------------------------------- errors of predictions
def error_scores(preds: DataFrame, keys: Sequence[str], cut: float, top: float, pid: str = "pid") -> DataFrame:
    """Errors of predictions against truth: merged per subject first, then per run.

    MAE below and from the cut, median of the subjects' MAEs, impossible values
    and the share above the device maximum.
    """
    t, p = F.col("truth"), F.col("pred")
    ok = p.isNotNull() & ~F.isnan(p)
    e = F.when(ok, F.abs(p - t))
    inf = ok & (F.abs(p) == float("inf"))
    per = preds.groupBy(*keys, pid).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("n_missing"), F.count(e).alias("_k"), F.sum(e).alias("_e"), F.sum(e * e).alias("_e2"),
        F.count(F.when(t < cut, e)).alias("_kb"), F.sum(F.when(t < cut, e)).alias("_eb"), F.count(F.when(t >= cut, e)).alias("_ka"), F.sum(F.when(t >= cut, e)).alias("_ea"),
        F.count_if(inf).alias("n_nonfinite"), F.count_if(ok & (p <= 0)).alias("n_nonpositive"), F.count_if(ok & (p > top)).alias("_above"))
    per = per.withColumn("_mae", F.try_divide("_e", "_k"))
    med = exact_quantiles(per, keys, "_mae", {"mae_per_subject_median": 0.5}).drop("n")
    s = F.sum
    out = per.groupBy(*keys).agg(
        s("n").alias("n"), s("n_missing").alias("n_missing"), F.try_divide(s("_e"), s("_k")).alias("mae"), F.sqrt(F.try_divide(s("_e2"), s("_k"))).alias("rmse"),
        F.try_divide(s("_eb"), s("_kb")).alias("mae_below"), F.try_divide(s("_ea"), s("_ka")).alias("mae_above"),
        s("n_nonfinite").alias("n_nonfinite"), s("n_nonpositive").alias("n_nonpositive"), (100 * s("_above") / s("n")).alias("pct_above_max"))
    return out.join(med, list(keys), "left") if keys else out.withColumn("mae_per_subject_median", med.scalar())
