import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.operators import core


def series(spark, n=60, keys=3, seed=1, blanks=0.5):
    r = random.Random(seed)
    rows = [(k, p, None if r.random() < blanks else float(r.randint(1, 9))) for k in range(keys) for p in range(-7, n - 7)]
    return rows, spark.createDataFrame(rows, "k long, slot long, v double")


@pytest.mark.parametrize("size", [1, 3, 7, 4096])
@pytest.mark.parametrize("own", [True, False])
def test_sweep_equals_plain_scan(spark, size, own):
    rows, df = series(spark)
    seen = F.col("v").isNotNull()
    out = core.sweep(df, ["k"], "slot", size=size, bounds=True, before={"b": core.Seen(seen, ("v",), own)}, after={"a": core.Seen(seen, ("v",), own)},
                     sums={"s": F.when(seen, 1).otherwise(0)})
    got = {(r.k, r.slot): r for r in out.collect()}
    assert len(got) == len(rows)
    for k, p, v in rows:
        mine = [(q, x) for kk, q, x in rows if kk == k and x is not None]
        prev = [t for t in mine if t[0] < p or (own and t[0] == p)]
        nxt = [t for t in mine if t[0] > p or (own and t[0] == p)]
        r = got[k, p]
        assert (tuple(r.b) if r.b else None) == (prev[-1] if prev else None)
        assert (tuple(r.a) if r.a else None) == (nxt[0] if nxt else None)
        assert r.s == sum(1 for q, _ in mine if q <= p) and r.s_total == len(mine)
        assert (r.pos_min, r.pos_max) == (-7, 52)


@pytest.mark.parametrize("size", [1, 4, 50])
@pytest.mark.parametrize("gap", [0, 1, 3])
def test_islands_equal_plain_scan(spark, size, gap):
    rows, df = series(spark, blanks=0.7)
    got = {(r.k, r.slot): r.a for r in core.islands(df.where("v is not null"), ["k"], "slot", F.lit(gap), size=size).collect()}
    last, start, n = {}, {}, 0
    for k, p, v in rows:
        if v is None:
            continue
        if k not in last or p - last[k] - 1 > gap:
            start[k] = p
        last[k] = p
        assert got[k, p] == start[k]
        n += 1
    assert n == len(got)


@pytest.mark.parametrize("size", [2, 5, 4096])
def test_halo_gives_the_rows_of_the_neighbour_pieces(spark, size):
    _, df = series(spark)
    h, own, part = core.with_halo(df, ["k"], "slot", back=3, ahead=2, size=size)
    w = W.partitionBy(*part).orderBy("slot")
    out = core.drop_halo(h.select("*", F.lag("v", 3).over(w).alias("l"), F.lead("v", 2).over(w).alias("r")), own)
    plain = W.partitionBy("k").orderBy("slot")
    want = df.select("*", F.lag("v", 3).over(plain).alias("l"), F.lead("v", 2).over(plain).alias("r"))
    assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0


@pytest.mark.parametrize("bins", [1, 4, 64])
def test_exact_quantiles_equal_numpy(spark, bins):
    r = np.random.default_rng(0)
    data = {1: r.normal(size=101), 2: np.repeat(5.0, 40), 3: np.round(r.normal(size=57), 1), 4: np.array([2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs] + [(1, None)], "k long, x double")
    out = {o.k: o for o in core.exact_quantiles(df, ["k"], "x", {"m": 0.5, "p": 0.9, "t": 1 / 3}, bins=bins).collect()}
    for k, xs in data.items():
        assert out[k].n == len(xs)
        assert np.allclose([out[k].m, out[k].p, out[k].t], np.quantile(xs, [0.5, 0.9, 1 / 3]))


def test_average_ranks_share_ties(spark):
    xs = [3.0, 1.0, 3.0, 3.0, 2.0]
    out = {r.x: r.avg_rank for r in core.average_ranks(spark.createDataFrame([(x,) for x in xs], "x double"), [], "x").collect()}
    assert out == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_draw_order_is_the_md5_order(spark, digits):
    df = spark.range(300).withColumn("k", F.col("id") % 2).withColumn("m", core.draw_key("s", "id"))
    got = core.draw_order(df, ["k"], "m", digits=digits)
    want = df.withColumn("w", F.row_number().over(W.partitionBy("k").orderBy("m")))
    assert got.join(want, ["k", "id"]).where(F.col("draw_rank") != F.col("w")).count() == 0
    assert got.where("draw_rank_total <> 150").count() == 0


@pytest.mark.parametrize("size", [2, 4096])
def test_spine_has_every_position(spark, size):
    df = spark.createDataFrame([(1, -5), (1, 4), (2, 7)], "k long, slot long")
    out = sorted((r.k, r.slot) for r in core.spine(df, ["k"], "slot", size=size).collect())
    assert out == [(1, p) for p in range(-5, 5)] + [(2, 7)]


def test_slots_before_1970_round_down(spark):
    r = spark.sql("select timestamp_ntz'1969-12-31 23:59:30' as t").select(core.slot_of("t", 60).alias("s"), core.slot_start(core.slot_of("t", 60), 60).alias("b")).first()
    assert r.s == -1 and str(r.b) == "1969-12-31 23:59:00"


@pytest.mark.parametrize("step", [2, 3, 9])
def test_bucket_by_counts_the_points_below(spark, step):
    points = [1.0, 2.5, 2.75, 9.0, 9.5]
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 2.5, 2.6, 3, 9, 9.25, 10, "nan")], "x double")
    for r in df.select("x", core.bucket_by("x", F.array(*map(F.lit, points)), step).alias("b")).collect():
        assert r.b == (5 if r.x != r.x else sum(p < r.x for p in points))


def test_long_and_short_keys_side_by_side(spark):
    r = np.random.default_rng(3)
    data = {1: r.normal(size=300), 2: r.normal(size=20), 3: np.round(r.normal(size=51), 1)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k long, x double")
    out = {o.k: (o.n, o.m) for o in core.exact_quantiles(df, ["k"], "x", {"m": 0.5}, bins=8).collect()}
    assert out == {k: (len(xs), pytest.approx(np.median(xs))) for k, xs in data.items()}


def test_no_job_runs_while_a_plan_is_built(spark):
    _, df = series(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("only-built", "")
    try:
        core.sweep(df, ["k"], "slot", sums={"s": F.lit(1)})
        core.islands(df, ["k"], "slot", F.lit(1))
        core.by_value(df, ["k"], "v")
        core.exact_quantiles(df, ["k"], "v", {"m": 0.5})
        core.draw_order(df.withColumn("m", core.draw_key("s", "slot")), ["k"], "m")
        assert len(tracker.getJobIdsForGroup("only-built")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_empty_tables_give_no_rows(spark):
    df = spark.createDataFrame([], "k long, slot long, v double")
    assert core.sweep(df, ["k"], "slot", sums={"s": F.lit(1)}).count() == 0
    assert core.by_value(df, ["k"], "v").count() == 0
    assert core.exact_quantiles(df, ["k"], "v", {"m": 0.5}).count() == 0
    assert core.exact_quantiles(df, [], "v", {"m": 0.5}).count() == 0
