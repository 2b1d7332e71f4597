import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import fills, sampling, segments
from pulsegrid.plans.hubs import segment_hub


def grid(spark, text, pid="p", start=0):
    """One character per slot: a digit is a reading, a dot is a blank."""
    return spark.createDataFrame([(pid, start + i, None if c == "." else float(c)) for i, c in enumerate(text)], "pid string, slot long, hrv double")


def brute(text, gap, min_len):
    """Segments as (first, last) by plain reading of the rules."""
    runs, i = [], 0
    while i < len(text):
        if text[i] == ".":
            j = i
            while j < len(text) and text[j] == ".":
                j += 1
            if j - i > gap:
                runs.append((i, j))
            i = j
        else:
            i += 1
    edges, a = [], 0
    for s, e in [*runs, (len(text), len(text))]:
        edges.append((a, s))
        a = e
    out = []
    for a, b in edges:
        seen = [i for i in range(a, b) if text[i] != "."]
        if seen and seen[-1] - seen[0] + 1 >= min_len:
            out.append((seen[0], seen[-1]))
    return out


TEXTS = ["....", "1", "1..1", "1...1", "11..11...1111.1", "..11.1...1..1..1....1111..", "1.1.1.1.1.1.1", "12345", "1...1...1", "11....111.1..1.....22222.."]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("size", [2, 4096])
def test_segments_follow_the_rules(spark, text, size):
    g = grid(spark, text, start=-3)
    got = sorted((r.a + 3, r.b + 3, r.k) for r in segments.segment_table(g, ["pid"], 2, 4, size=size).collect())
    want = brute(text, 2, 4)
    assert got == [(a, b, k) for k, (a, b) in enumerate(want)]
    lab = segments.label_segments(g, segments.segment_table(g, ["pid"], 2, 4, size=size), ["pid"], size=size).collect()
    assert len(lab) == len(text)
    for r in lab:
        inside = [k for k, (a, b) in enumerate(want) if a <= r.slot + 3 <= b]
        assert r.segment == (f"p_s{inside[0]:02d}" if inside else None)
        if inside:
            a, b = want[inside[0]]
            n = b - a + 1
            assert r.split == ("train" if r.slot + 3 - a < n * 80 // 100 else "test")


def test_run_of_exactly_the_limit_does_not_cut(spark):
    assert segments.segment_table(grid(spark, "11..11"), ["pid"], 2, 4).count() == 1
    assert segments.segment_table(grid(spark, "11...11"), ["pid"], 2, 4).count() == 0


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("size", [2, 4096])
def test_missing_runs(spark, text, size):
    got = {r.slot: r.missing_run for r in segments.missing_runs(grid(spark, text), ["pid"], size=size).collect()}
    i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] == ".":
            j += 1
        for p in range(i, j):
            assert got[p] == j - i
        if j < len(text):
            assert got[j] == 0
        i = j + 1


def test_threshold_scan_totals(spark):
    g = grid(spark, "11..11...1111.1")
    out = {(r.x, r.pid): (r.kept_pct, r.missing_inside_pct) for r in segments.threshold_scan(g, ["pid"], [0, 2, 3], 4).collect()}
    for x in (0, 2, 3):
        kept = brute("11..11...1111.1", x, 4)
        slots = sum(b - a + 1 for a, b in kept)
        seen = sum("11..11...1111.1"[i] != "." for a, b in kept for i in range(a, b + 1))
        assert out[x, "p"] == pytest.approx((100 * seen / 9, 100 * (1 - seen / slots)))
        assert out[x, None] == pytest.approx(out[x, "p"])


@pytest.mark.parametrize("text", ["..1..3..", "....", "5", "1..4", "12.4"])
def test_straight_line(spark, text):
    import numpy as np

    out = [r.filled for r in fills.straight_line(fills.nearest(grid(spark, text), ["pid"], size=2)).orderBy("slot").collect()]
    idx = [i for i, c in enumerate(text) if c != "."]
    want = [None] * len(text) if not idx else list(np.interp(range(len(text)), idx, [float(text[i]) for i in idx]))
    assert out == want


@pytest.mark.parametrize("rate", [0.05, 1.0, 20.0, 40.0])
def test_decayed_average_over_many_pieces(spark, rate):
    import math

    text = "1..2...3" + "." * 60 + "45" + "." * 50 + "6"
    got = {r.slot: (r.decayed_mean, r.decayed_count) for r in fills.decayed_average(grid(spark, text), ["pid"], rate).collect()}
    for t in range(len(text)):
        w = {i: math.exp(-rate * (t - i)) for i in range(t + 1) if text[i] != "."}
        num, den = sum(float(text[i]) * x for i, x in w.items()), sum(w.values())
        assert got[t][0] == pytest.approx(num / (den + 1e-6), rel=1e-9, abs=1e-12)
        assert got[t][1] == pytest.approx(math.log1p(den), rel=1e-9, abs=1e-12)


def test_elapsed_features_of_a_day(spark):
    rows = [("d", 0, 70.0, None), ("d", 5, 71.0, 30.0), ("d", 6, 72.0, None), ("d", 100, 73.0, None)]
    t = spark.createDataFrame(rows, "day string, minute long, hr double, hrv double")
    out = fills.since_last(t, ["day"], "minute", ["hr", "hrv"]).orderBy("minute").collect()
    assert [r.hrv_since for r in out] == [1, 0, 1, 95] and [r.elapsed for r in out] == [1, 5, 1, 94] and [r.hr_since for r in out] == [0, 0, 0, 0]


def test_hourly_state_shrinks_between_readings(spark):
    import math

    t = spark.createDataFrame([("d", 130, 10.0)], "day string, minute long, hr double")
    s = {r.hour: r.state for r in fills.hourly_state(t, ["day"], "minute", "hr", 0.01).collect()}
    assert s[1] is None and s[2] == pytest.approx(10 * math.exp(-0.01 * (179 - 130)))
    for h in range(3, 24):
        assert s[h] / s[h - 1] == pytest.approx(math.exp(-0.6))


def test_blocks_are_unbroken_minutes(spark):
    m = spark.createDataFrame([("p", i, 1 if c == "x" else 0) for i, c in enumerate("xx..xxx.x")], "pid string, slot long, on int")
    b = segments.flag_blocks(m, ["pid"], "on", size=2).groupBy("pid", "a").agg(F.count(F.lit(1)).alias("n"))
    out = segments.number_blocks(b, ["pid"], size=2).orderBy("block").collect()
    assert [(r.block, r.a, r.n) for r in out] == [(1, 0, 2), (2, 4, 3), (3, 8, 1)]


@pytest.fixture(scope="module")
def labelled(spark):
    text = "".join("12..3"[(i * 7) % 5] if i % 11 else "." for i in range(400))
    g = grid(spark, text).unionByName(grid(spark, "1234567..12" * 9, "q"))
    out = segment_hub(g).cache()
    out.count()
    return out


def test_random_mask_counts(spark, labelled):
    m = sampling.random_mask(labelled, 3)
    n = {r.segment: r.n for r in labelled.where("segment is not null and hrv is not null").groupBy("segment").agg(F.count("hrv").alias("n")).collect()}
    got = {r.segment: r["count"] for r in m.groupBy("segment").count().collect()}
    for s, k in n.items():
        assert got.get(s, 0) == round(k * 20 / 100)  # Python rounds half to even
    assert m.join(labelled.where("hrv is null"), ["segment", "slot"]).count() == 0
    assert m.exceptAll(sampling.random_mask(labelled.repartition(3), 3)).count() == 0  # same draw on any partitioning


def test_block_mask_invariants(spark, labelled):
    pool = sampling.run_pool(labelled)
    assert {r.length for r in pool.collect()} <= {1, 2}
    m = sampling.block_mask(labelled, pool, 5, pct=20)
    assert m.count() == m.distinct().count()
    assert m.join(labelled.where("hrv is null"), ["segment", "slot"]).count() == 0
    hit = {r.segment: r["count"] for r in m.groupBy("segment").count().collect()}
    for r in labelled.where("segment is not null and hrv is not null").groupBy("segment").agg(F.count("hrv").alias("n")).collect():
        target = round(r.n * 20 / 100)
        assert target <= hit.get(r.segment, 0) < target + 2  # the last run may overshoot by less than its length


def test_block_mask_meets_the_target_of_a_long_segment_and_ends_where_no_run_reaches(spark):
    rows = spark.range(6000).select(F.lit("s").alias("segment"), F.col("id").alias("slot"), F.lit(1.0).alias("hrv"))
    small = spark.createDataFrame([("t", i, 1.0) for i in range(5)], "segment string, slot long, hrv double")
    pool = spark.createDataFrame([(1, 3), (2, 1)], "length long, n long")
    m = sampling.block_mask(rows.unionByName(small), pool, 1, pct=20)
    n = {r.segment: r["count"] for r in m.groupBy("segment").count().collect()}
    assert 1200 <= n["s"] <= 1201 and 1 <= n["t"] <= 2
    every = sampling.block_mask(small, pool, 1, pct=100)
    assert sorted(r.slot for r in every.collect()) == [0, 1, 2, 3]  # a run starts before the last slot but one, so it never covers the last


def test_stratified_draw_and_parts(spark):
    u = spark.range(101).select(F.col("id").alias("pid"), (F.col("id") % 3).alias("grp"), (F.col("id") % 2).alias("pos"))
    d = sampling.stratified_draw(u, ["grp", "pos"], 0.3, 1)
    n = {(r.grp, r.pos): r["count"] for r in u.groupBy("grp", "pos").count().collect()}
    for r in d.groupBy("grp", "pos").count().collect():
        assert r["count"] == int(n[r.grp, r.pos] * 0.3 + 0.5)
    parts = sampling.nested_draw(u, ["grp", "pos"], 0.3, 0.2, 1)
    assert parts.count() == 101 and parts.where("part = 'test'").count() == d.count()


def test_folds_are_balanced(spark):
    u = spark.range(50).select(F.col("id").alias("pid"), (F.col("id") % 2).alias("label"))
    for r in sampling.folds(u, "label", 5, 1, repeats=2).groupBy("repeat", "label", "fold").count().collect():
        assert r["count"] == 5


def test_small_subset_keeps_positives_up_to_half(spark):
    d = spark.range(200).select("id", (F.col("id") < 8).cast("int").alias("label"))
    s = sampling.small_subset(d, "label", 40, 1, ["id"])
    assert s.count() == 40 and s.where("label = 1").count() == 8
    many = spark.range(200).select("id", (F.col("id") < 90).cast("int").alias("label"))
    s = sampling.small_subset(many, "label", 40, 1, ["id"])
    assert s.count() == 40 and s.where("label = 1").count() == 20
    assert sampling.small_subset(d, "label", 500, 1, ["id"]).count() == 200
