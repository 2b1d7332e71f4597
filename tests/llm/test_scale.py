"""Plans that must hold for long lists, many items and files of very many anchored lines."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsegrid.llm import decontamination, license_scan, substring_dedup, url_filters


def spans_by_hand(lines, anchors):
    """Every window of joined lines that holds an anchor, straight from the rule."""
    here = {i for i, x in enumerate(lines) if set(x) & set(anchors)}
    n, out = len(lines), set()
    for size in license_scan.WINDOWS:
        last = max(n - size, 0)
        starts = {*range(0, last + 1, max(1, size // 4) if size > 7 else 1), last}
        out |= {(s, min(n, size)) for s in starts if here & set(range(s, s + size))}
    return out | {(0, n)} if here else set()


def test_windows_of_lines(spark):
    rng = random.Random(5)
    files = [(f"p{k}", [[rng.choice(["a", "b", "mark" if rng.random() < share else "c"])] for _ in range(n)])
             for k, (n, share) in enumerate([(1, 1.0), (1, 0.0), (5, 0.5), (23, 0.2), (24, 0.9), (25, 0.1), (90, 0.1), (90, 1.0), (200, 0.02)])]
    got = license_scan.sections(spark.createDataFrame(files, "_path string, lines array<array<string>>"), ["mark"])
    got = {(r["_path"], tuple(r["words"])): r["n"] for r in got.groupBy("_path", "words").agg(F.count("section").alias("n")).collect()}
    want = Counter((p, tuple(w for x in lines[a:a + size] for w in x)) for p, lines in files for a, size in spans_by_hand(lines, ["mark"]))
    assert got == want


def test_file_of_many_anchored_lines(spark):
    """The work grows with the lines: 16,000 anchored ones took more than two minutes when starts were compared with all of them."""
    lines = spark.range(1).select(F.lit("p").alias("_path"), F.transform(F.sequence(F.lit(1), F.lit(16000)), lambda i: F.array(F.lit("mark"), i.cast("string"))).alias("lines"))
    begun = time.monotonic()
    assert license_scan.sections(lines, ["mark"]).select(F.sum(F.size("words"))).first()[0] > 16000
    assert time.monotonic() - begun < 30


def test_filter_and_list_too_large_to_send(spark):
    """Shuffled filter and list give what the broadcast ones give; null and rejected urls stay."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("http://h"), (F.col("id") % 50).cast("string"), F.lit(".org/p/"), (F.col("id") % 900).cast("string"))).alias("url"))
    listed = pages.where("page_id % 3 = 0").unionByName(pages.where("page_id = 9"))
    want = sorted(map(repr, url_filters.url_filter(pages, listed).collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = url_filters.url_filter(pages, listed, blocks_to_send=0)
        got = sorted(map(repr, plan.collect()))
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == want and len(got) == 3000
    assert {r.listed for r in url_filters.url_filter(pages, listed.limit(0)).collect()} == {False}


def leaks_by_hand(docs, items, k=5, least=0.8):
    """Pairs of which some window reaches the similarity, from all windows that the item's length allows."""
    gram = lambda t: [tuple(t.lower().split()[i:i + k]) for i in range(len(t.lower().split()) - k + 1)]
    out = set()
    for d, t in docs:
        g = gram(t)
        for i, x in items:
            bag = Counter(gram(x))
            n = sum(bag.values())
            for a in range(len(g)):
                for b in range(a + 1, min(len(g), a + n) + 1):
                    both = sum((Counter(g[a:b]) & bag).values())
                    if n and both / (n + b - a - both) >= least:
                        out.add((d, i))
    return out


def test_leaks_against_all_windows(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + str(rng.randrange(40)) for _ in range(n))
    items = [(i, text(rng.choice([12, 20, 26]))) for i in range(12)]
    docs = []
    for d in range(30):
        inside = items[d % 12][1].split()
        if d % 3 == 1:
            inside[-1] = "changed"
        if d % 3 == 2:
            inside[len(inside) // 2] = "changed"  # five shingles go: under the similarity
        docs.append((d, f"{text(15)} {' '.join(inside)} {text(15)}"))
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    assert set(got) == leaks_by_hand(docs, items) and len(got) >= 15


def test_listing_of_many_items(spark):
    """The listing of 20,000 items (56 million rows) would not fit a broadcast; its join is planned from its written size."""
    text = lambda c: F.concat_ws(" ", *[F.concat(F.lit(f"w{j}"), F.pmod(F.xxhash64(c, F.lit(j)), F.lit(5000)).cast("string")) for j in range(14)])
    items = spark.range(2000).select(F.col("id").alias("item_id"), text(F.col("id")).alias("text"))
    docs = items.where("item_id % 20 = 0").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before it all "), F.col("text"), F.lit(" and after")).alias("text"))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(i, i) for i in range(0, 2000, 20)}


def test_phrase_of_every_document_spreads_over_the_parts():
    phrase, rng = b" ".join(b"common%d" % i for i in range(5)), np.random.default_rng(5)
    texts = [b" ".join([*(b"w%d" % x for x in rng.integers(0, 10**9, 12)), phrase, *(b"w%d" % x for x in rng.integers(0, 10**9, 12))]) for _ in range(3000)]
    parts, load = 64, np.zeros(64, dtype=np.int64)
    for n in range(3):
        own = texts[1000 * n:1000 * n + 1000]
        batch = pa.RecordBatch.from_arrays([pa.array(range(1000 * n, 1000 * n + 1000), pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "_text"])
        row = substring_dedup._slice(batch, n, 13, 5).to_pylist()[0]
        own = substring_dedup._seeds(n, row["seeds"], 8).to_pylist()
        everything = substring_dedup._asks(n, row | {"shared": own}, parts, 8, 13, 5).to_pylist()
        for r in everything:
            load[r["part"]] += len(r["windows"]) // 8
    assert load.sum() == 3000 * 17 and load.max() < 1.3 * np.median(load)


def test_repeats_across_many_slices(spark):
    """Documents of many partitions: a hot phrase with differing neighbours, a passage that many share, copies, ties of ids."""
    rng = np.random.default_rng(11)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 10**8, n)]
    phrase, passage, copy = some(5), some(40), some(60)
    rows = [(i, " ".join(some(int(rng.integers(0, 30))) + phrase + some(20) + (passage[:int(rng.integers(5, 41))] if i % 3 == 0 else []))) for i in range(400)]
    rows += [(i % 50, " ".join(copy)) for i in range(400, 520)] + [(600, None), (601, ""), (None, " ".join(copy)), (None, " ".join(copy[5:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for j in range(len(w) - 12):
            key = tuple(w[j:j + 13])
            first[key] = min(first.get(key, float("inf")), order(i))
    want = []
    for i, t in rows:
        w = (t or "").split()
        gone = {x for j in range(len(w) - 12) if first[tuple(w[j:j + 13])] < order(i) for x in range(j, j + 13)}
        want.append((i, len(w), len(gone), None if t is None else " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [(r.doc_id, r._n_words, r._n_removed, r._kept_text) for r in substring_dedup.drop_repeats(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[2] for r in got) > 1000
