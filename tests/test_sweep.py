"""Looks and sums along a series: rows are shuffled once, null keys and ties of pieces included."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import core, sampling, segments
from pulsegrid.operators.core import Seen


@pytest.fixture
def merged(spark):
    """No broadcast, as on tables that outgrow it."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


ROWS = [(k, n, None if n % 5 in (1, 2) or n in (20, 27) else float(n * n % 37)) for k in ("a", "b", None) for n in range(40) if (k, n) != ("b", 7)]


def stored(spark, tmp_path):
    spark.createDataFrame(ROWS, "k string, slot long, v double").repartition(3).write.parquet(str(tmp_path / "rows"))
    return spark.read.parquet(str(tmp_path / "rows"))


@pytest.mark.parametrize("size", [4, 7, 4096])
def test_sweep_against_plain_python(merged, tmp_path, size):
    seen = F.col("v").isNotNull()
    got = core.sweep(stored(merged, tmp_path), ["k"], "slot", size=size, bounds=True, sums={"s": F.col("v")}, before={"p": Seen(seen, ("v",)), "po": Seen(seen, own=True), "any": Seen(F.lit(True), ("v",))},
                     after={"x": Seen(seen, ("v",)), "xo": Seen(seen, own=True), "next": Seen(F.lit(True), ("v",))}).collect()
    assert len(got) == len(ROWS)
    item = lambda r: None if r is None else tuple(r)
    for r in got:
        own = [x for x in ROWS if x[0] == r.k]
        full = [x for x in own if x[2] is not None]
        last = lambda rows: rows[-1][1:] if rows else None
        first = lambda rows: rows[0][1:] if rows else None
        assert item(r.p) == last([x for x in full if x[1] < r.slot]) and item(r.x) == first([x for x in full if x[1] > r.slot])
        assert (r.po and r.po.pos) == max([x[1] for x in full if x[1] <= r.slot], default=None)
        assert (r.xo and r.xo.pos) == min([x[1] for x in full if x[1] >= r.slot], default=None)
        assert item(r.any) == last([x for x in own if x[1] < r.slot]) and item(r.next) == first([x for x in own if x[1] > r.slot])
        assert r.s == sum(x[2] for x in full if x[1] <= r.slot) and r.s_total == sum(x[2] for x in full)
        assert (r.pos_min, r.pos_max) == (0, 39)


def test_sweep_shuffles_its_rows_once(merged, tmp_path):
    seen = F.col("v").isNotNull()
    out = core.sweep(stored(merged, tmp_path), ["k"], "slot", before={"p": Seen(seen)}, after={"x": Seen(seen)}, sums={"s": F.lit(1)})
    text = out._jdf.queryExecution().executedPlan().toString()
    # one shuffle of the rows, and two of the table of pieces
    assert "Join" not in text and text.count("Exchange") == 3


def test_islands_are_dealt_once_and_keep_null_keys(merged, tmp_path):
    out = core.islands(stored(merged, tmp_path).where("v is not null").drop("v"), ["k"], "slot", F.lit(2), size=4)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") <= 4  # rows for either side of the join, pieces by key and back
    got = {(r.k, r.slot): r.a for r in out.collect()}
    for k in ("a", "b", None):
        start = prior = None
        for _, n, v in (x for x in ROWS if x[0] == k and x[2] is not None):
            start = n if prior is None or n - prior - 1 > 2 else start
            prior = n
            assert got.pop((k, n)) == start
    assert not got


def test_short_segments_are_drawn_whole(merged, tmp_path):
    n = F.col("id")
    df = merged.range(6000).select(F.when(n < 5000, "long").otherwise(F.format_string("s%d", n % 7)).alias("segment"), n.alias("slot"), F.lit(1.0).alias("hrv"))
    ends = df.groupBy("segment").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    df.join(ends, "segment").write.parquet(str(tmp_path / "labelled"))
    t = merged.read.parquet(str(tmp_path / "labelled"))
    rows = lambda m: sorted(map(tuple, m.collect()))
    got = rows(sampling.random_mask(t, 3))
    assert got == rows(sampling.random_mask(t.drop("a", "b"), 3))  # in sixteen parts
    assert len([x for x in got if x[0] == "long"]) == 1000
    seen, sweep = [], core.sweep
    with pytest.MonkeyPatch.context() as m:
        m.setattr(core, "sweep", lambda df, keys, pos, piece=None, **kw: (seen.append(df.select("segment", piece.alias("p"))), sweep(df, keys, pos, piece=piece, **kw))[1])
        sampling.random_mask(t, 3)
    parts = {r.segment: r.n for r in seen[0].groupBy("segment").agg(F.count_distinct("p").alias("n")).collect()}
    assert parts.pop("long") == 16 and set(parts.values()) == {1}


def test_a_segment_is_named_once(merged, tmp_path):
    grid = stored(merged, tmp_path).withColumnsRenamed({"k": "pid", "v": "hrv"})
    t = segments.label_segments(grid, segments.segment_table(grid, ["pid"], 2, 4), ["pid"])
    text = t._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" in text[text.index("Join"):] and "format_string" not in text[:text.index("Join")]
    assert {r.segment for r in t.where("pid = 'a'").select("segment").distinct().collect()} - {None} == {"a_s00", "a_s01"}
