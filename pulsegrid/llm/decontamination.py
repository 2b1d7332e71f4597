"""Benchmark passages in documents: SimHash of item-sized windows, Hamming search over blocks, exact verification.

A window of a document is as long as some item and begins and ends in a five-word shingle that some item has (a fixed-size
bitmap of all items' shingles says so; what it lets through wrongly is refused later). Windows get a SimHash of their bag of
shingles. Within radius 15, two fingerprints differ in at most three bits in one of four 16-bit blocks, so every item is
listed under all block values within three bits, and a window looks up its four: nothing within the radius is missed. A bitmap of
all listed values keeps those that no item of the window's size is listed under from being shuffled.
Found pairs are verified by the exact weighted Jaccard similarity of the bags, each shingle weighing as often as it occurs.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import map_arrow, neutral, table, utf8, window_hashes, word_hashes
from pulsegrid.sources.stage import materialise

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 4
WIDTH = 64 // BLOCKS
FLIPS = [0, *(sum(1 << i for i in c) for r in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(WIDTH), r))]
"""What a block may differ by."""

FILTER_BITS = 26
"""log2 of the bitmap's bits: 8 MB, whatever the tables hold."""


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    return window_hashes(word_hashes(text.lower().split()), k)


def simhashes(bits: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the rows starts .. ends of a bit table (n x 64)."""
    sums = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    over = 2 * (sums[ends] - sums[starts]) > (ends - starts)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<i8").ravel()


def bits_of(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def item_table(items: DataFrame, item_id: str, text: str, k: int) -> DataFrame:
    """(item_id, n, fp, bag): items of at least one shingle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, fps, bags = [], [], [], []
        for i, t in zip(batch.column("item_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            h = shingles(t, k)
            if len(h):
                ids.append(i)
                sizes.append(len(h))
                fps.append(int(simhashes(bits_of(h), np.array([0]), np.array([len(h)]))[0]))
                bags.append(h.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(bags, pa.binary())], names=["item_id", "n", "fp", "bag"])

    return map_arrow(items.select(F.col(item_id).cast("long").alias("item_id"), utf8(text).alias("_text")), run, "item_id long, n long, fp long, bag binary")


def shingle_filter(items: DataFrame, bits: int) -> bytes:
    """A bitmap of the items' shingles: 2**bits bits come to the driver, packed in rows of up to 8 KB."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(batch.column("bag").to_pylist()), dtype="<u8")
        at = np.unique(h & np.uint64((1 << bits) - 1)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    rows = map_arrow(items.select("bag"), run, "at long", text="bag")
    table_ = np.zeros(1 << bits - 3, dtype=np.uint8)
    words = rows.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    size = 1 << min(bits - 6, 10)

    def piece(own: pa.Table) -> pa.Table:
        at, to = own["word"].to_numpy(), np.zeros(size, dtype="<i8")
        to[at % size] = own["bits"].to_numpy()
        return pa.table({"first": pa.array([at[0] // size * size], pa.int64()), "packed": pa.array([to.tobytes()], pa.binary())})

    for r in words.groupBy(F.floor(F.col("word") / size)).applyInArrow(piece, "first long, packed binary").collect():
        table_.view("<i8")[r["first"]:r["first"] + size] = np.frombuffer(r["packed"], dtype="<i8")
    return table_.tobytes()


def listed_values(items: DataFrame) -> dict[int, bytes]:
    """For each size of item a bitmap of (block, value): 32 KB a size come to the driver, however many items there are."""

    def draw(own: pa.Table) -> pa.Table:
        to = np.zeros((BLOCKS, 1 << WIDTH), dtype=bool)
        fps = np.unique(own["fp"].to_numpy())
        for b, values in enumerate(block_values(fps)):
            for flip in FLIPS:
                to[b, values ^ flip] = True
        return pa.table({"n": own["n"][:1], "packed": pa.array([np.packbits(to, axis=1, bitorder="little").tobytes()], pa.binary())})

    return {r["n"]: r["packed"] for r in items.select("n", "fp").distinct().groupBy("n").applyInArrow(draw, "n long, packed binary").collect()}


def block_values(fps: np.ndarray) -> list[np.ndarray]:
    return [(fps.astype("<i8").view("<u8") >> np.uint64(WIDTH * b)).astype(np.int64) & ((1 << WIDTH) - 1) for b in range(BLOCKS)]


def hit_regions(h: np.ndarray, known: np.ndarray, bits: int, gap: int, least: int) -> list[tuple[int, int]]:
    """(first, end) of stretches of shingles that begin and end with a known one and hold at least `least`, cut at gaps of `gap`."""
    low = h & np.uint64((1 << bits) - 1)
    hits = np.flatnonzero(known[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
    if len(hits) < least:
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(hits) > gap) + 1, [len(hits)]])
    return [(int(hits[a]), int(hits[b - 1]) + 1) for a, b in zip(cut, cut[1:], strict=False) if b - a >= least]


def windows_of(h: np.ndarray, known: np.ndarray, bits: int, sizes: list[int], similarity: float) -> tuple[np.ndarray, ...]:
    """(start, end, size) of the windows of a stretch: from a known shingle over at most `size` shingles back to a known one,
    with enough known ones for `similarity` to an item of that size."""
    low = h & np.uint64((1 << bits) - 1)
    hit = (known[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(hit)])
    last = np.maximum.accumulate(np.where(hit > 0, np.arange(len(h)) + 1, 0))
    starts = np.flatnonzero(hit)
    out = []
    for size in sizes:
        ends = last[np.minimum(starts + size, len(h)) - 1]
        ok = sums[ends] - sums[starts] >= similarity * size - 1e-9
        if ok.any():
            out.append((starts[ok], ends[ok], np.full(int(ok.sum()), size)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both)


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
          similarity: float = SIMILARITY, k: int = SHINGLE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window for each pair of at least `similarity`; A-Z do not differ from a-z.

    Ties go to the earlier, then the shorter window. Null and empty texts, and items of fewer than `k` words, match nothing. Rows
    that share an id count as one. A null doc_id is reported like any other. Empty tables give no rows. Equal passages of any number of documents
    are windowed, searched and verified once. No table is broadcast: all grow with the items or the documents, and Spark would judge them by their packed size on disk.
    """
    bench = materialise(item_table(items, item_id, item_text, k), "benchmark-items")
    sizes = sorted(r["n"] for r in bench.select("n").distinct().collect())
    known_bytes = shingle_filter(bench, filter_bits)
    spark = docs.sparkSession
    sent, asked_for = spark.sparkContext.broadcast(known_bytes), spark.sparkContext.broadcast(listed_values(bench))
    least = int(np.ceil(similarity * sizes[0] - 1e-9)) if sizes else 1
    gap = sizes[-1] if sizes else 1

    def regions(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = np.frombuffer(sent.value, dtype=np.uint8)
        out: list[tuple] = []
        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            h = shingles(t, k)
            for a, b in hit_regions(h, known, filter_bits, gap, least):
                own = h[a:b].tobytes()
                out.append((d, a, xxhash.xxh3_128_digest(own), own))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "at", "key", "bag"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("_text"))
    found = materialise(map_arrow(rows, regions, "doc_id long, at long, key binary, bag binary"), "benchmark-regions")
    distinct = materialise(found.groupBy("key").agg(F.first("bag").alias("bag")), "benchmark-distinct")

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = np.frombuffer(sent.value, dtype=np.uint8)
        listed = np.stack([np.frombuffer(asked_for.value[n], dtype=np.uint8) for n in sizes]).reshape(len(sizes), BLOCKS, -1)
        out = []
        for key, own in zip(batch.column("key").to_pylist(), batch.column("bag").to_pylist(), strict=True):
            h = np.frombuffer(own, dtype="<u8")
            a, b, n = windows_of(h, known, filter_bits, sizes, similarity)
            fp, of = simhashes(bits_of(h), a, b), np.searchsorted(sizes, n)
            for i, value in enumerate(block_values(fp)):
                at = np.flatnonzero(listed[of, i, value >> 3] >> (value & 7).astype(np.uint8) & 1)
                out += zip([key] * len(at), *(x[at].tolist() for x in (a, b, n, fp)), [i] * len(at), value[at].tolist(), strict=True)
        cols = list(zip(*out, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), *[pa.int64()] * 6), strict=True)], names=["key", "start", "end", "n", "fp", "block", "value"])

    probes = map_arrow(distinct, windows, "key binary, start long, end long, n long, fp long, block long, value long", text="bag")
    pairs = hamming_pairs(probes, bench.select("item_id", "n", F.col("fp").alias("item_fp")))
    # a pair carries the shingles of its window, not those of the whole region
    own = F.substring("bag", (8 * F.col("start") + 1).cast("int"), (8 * (F.col("end") - F.col("start"))).cast("int")).alias("bag")
    pairs = pairs.join(distinct.hint("merge"), "key").select("key", "item_id", "start", "end", own).join(
        bench.select("item_id", F.col("bag").alias("item_bag")).hint("merge"), "item_id")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = zip(*(batch.column(c).to_pylist() for c in ("bag", "item_bag")), strict=True)
        sims = [jaccard(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")) for x, y in bags]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "item_id", "start", "end")), pa.array(sims, pa.float64())], names=["key", "item_id", "start", "end", "similarity"])

    sure = map_arrow(pairs, verify, "key binary, item_id long, start long, end long, similarity double", text="item_bag").where(F.col("similarity") >= similarity)
    best = lambda at: F.max(F.struct("similarity", (-at).alias("at"), (F.col("start") - F.col("end")).alias("n"))).alias("b")
    sure = sure.groupBy("key", "item_id").agg(best(F.col("start"))).select("key", "item_id", "b.similarity", (-F.col("b.at")).alias("start"), (-F.col("b.at") - F.col("b.n")).alias("end"))
    hits = found.select("doc_id", "at", "key").join(sure.hint("merge"), "key").groupBy("doc_id", "item_id").agg(best(F.col("at") + F.col("start")))
    return hits.select("doc_id", "item_id", "b.similarity", (-F.col("b.at")).alias("first_word"), (F.lit(k - 1) - F.col("b.n")).alias("n_words"))


def hamming_pairs(probes: DataFrame, items: DataFrame) -> DataFrame:
    """Probes, one row per block, with the items of their size whose fingerprints differ in at most RADIUS bits.

    The listing holds 2,788 rows an item. It is made by all tasks, never written, and shuffled by size of item, block and value: a broadcast
    would hold all of it, or all of the probes, on the driver.
    """
    block = lambda i: F.shiftrightunsigned("item_fp", WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1))
    spread = items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    listed = spread.select("item_id", "n", "item_fp", F.posexplode(F.array(*[block(i) for i in range(BLOCKS)])).alias("block", "own"))
    listed = listed.select("item_id", "n", "item_fp", F.col("block").cast("long").alias("block"), "own", F.explode(F.lit(FLIPS).cast("array<long>")).alias("flip")).select(
        "item_id", "n", "item_fp", "block", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
    near = probes.join(listed.hint("merge"), ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    return near.select("key", "start", "end", "item_id").distinct()


def drop_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without the documents that hold a benchmark passage. Rows without a doc_id are judged together."""
    bad = leaks(docs, items, doc_id=doc_id, text=text).select(F.col("doc_id").alias("_bad"), F.lit(True).alias("_leaks")).distinct()
    names = docs.columns
    return neutral(docs).join(bad, F.col(f"c{names.index(doc_id)}").cast("long").eqNullSafe(F.col("_bad")), "left_anti").toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
