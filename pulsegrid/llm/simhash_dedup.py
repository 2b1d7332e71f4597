"""Near copies by SimHash: fingerprints within two bits, found through a grid over per-segment bit counts.

The 64 bits are cut into 32 segments of two, and a fingerprint is mapped to the vector of its segments' bit counts.
The Manhattan distance of two vectors is a lower bound of the Hamming distance, so a pair within two bits is within
two in that space, and differs in at most two coordinates. The coordinates are dealt to six groups; the cells of the
range join are the 15 ways to look at four of the six, and one of them holds both ends of every such pair. Pairs that
share a cell are filtered by the lower bound and then verified on the bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import map_arrow, neutral, table, utf8
from pulsegrid.llm.graph import components
from pulsegrid.sources.stage import materialise

RADIUS = 2
GROUPS = 6
LOW = 0x5555555555555555
"""The lower bit of every two-bit segment."""

SHINGLES_AT_ONCE = 65_536


def fingerprint(text: bytes, k: int = 3) -> int:
    """SimHash of the k-word shingles, A-Z lower-cased, repeats included; zero without a word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(words) - k + 1)
    last = min(k, len(words)) - 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        to = min(n, at + SHINGLES_AT_ONCE)
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at:to], ends[at + last:to + last], strict=True)),
                        dtype="<u8", count=to - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; a null text has fingerprint zero."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, k) for t in batch.column("_text").to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("_text")), run, "doc_id long, fp long")


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def embedding(fp: Column) -> Column:
    """The 32 bit counts, two bits each, in one number."""
    low, high = fp.bitwiseAND(_long(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(_long(LOW))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Sum of the differences of two embeddings. A segment's counts 0, 1, 2 differ by 1 if the lower bits differ, else by 2 or 0."""
    x = a.bitwiseXOR(b)
    low = x.bitwiseAND(_long(LOW))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(_long(LOW))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def grid_cells(e: Column) -> Column:
    """An array of (view, key): the counts outside two of the groups."""
    masks = [sum(3 << 2 * i for i in range(g, 32, GROUPS)) for g in range(GROUPS)]
    return F.array(*[F.struct(F.lit(i).alias("view"), e.bitwiseAND(_long(~(masks[a] | masks[b]) & (1 << 64) - 1)).alias("key"))
                     for i, (a, b) in enumerate(combinations(range(GROUPS), RADIUS))])


def links(distinct: DataFrame, dense_cell: int = 64) -> DataFrame:
    """Links (u, v) between the distinct fingerprints `fp`: the components they make are those of all pairs within two bits.

    A cell of at most `dense_cell` fingerprints is joined with itself. In fuller cells all pairs would grow with the square, so
    their fingerprints are linked another way, also exact: two numbers are within two bits if and only if some number is
    within one bit of both. Each fingerprint names its 65 numbers, and all that name the same one link to the least.
    """
    cells = distinct.select("fp", F.inline(grid_cells(embedding(F.col("fp")))))
    full = cells.groupBy("view", "key").agg(F.count("fp").alias("n")).where("n > 1")
    shared = materialise(cells.join(full, ["view", "key"]), "grid")
    sparse = shared.where(F.col("n") <= dense_cell)
    a, b = sparse.select("view", "key", F.col("fp").alias("u")), sparse.select("view", "key", F.col("fp").alias("v"))
    u, v = F.col("u"), F.col("v")
    near = a.join(b, ["view", "key"]).where((u < v) & (manhattan(embedding(u), embedding(v)) <= RADIUS) & (F.bit_count(u.bitwiseXOR(v)) <= RADIUS))
    crowd = shared.where(F.col("n") > dense_cell).select("fp").distinct()
    balls = crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(_long(1 << i)) for i in range(64)])).alias("hub"))
    hubs = balls.groupBy("hub").agg(F.min("fp").alias("u"), F.count("fp").alias("n")).where("n > 1").select("hub", "u")
    stars = balls.join(hubs, "hub").where(F.col("fp") != F.col("u")).select("u", F.col("fp").alias("v"))
    return near.select("u", "v").unionByName(stars).distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, dense_cell: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the least doc_id that links of at most two bits reach, itself included.

    Null and empty texts have fingerprint zero and link like any other. A null doc_id is grouped, but names a group only if
    nothing else is in it (null). Repeated rows come back as often. An empty table gives no rows. Other columns are not read.
    Equal fingerprints are merged before anything is joined, so thousands of copies are one vertex.
    """
    fps = materialise(fingerprints(docs, doc_id, text, k), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints-distinct")
    roots = components(links(distinct, dense_cell))
    rooted = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = materialise(rooted.join(least, "root").select("fp", "component_id"), "groups")
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of which one document of each group stays: that with the least doc_id.

    Rows without a doc_id cannot be told apart and stay. Of repeated rows with one doc_id one stays.
    """
    names, docs = docs.columns, neutral(docs)
    doc_id, text = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    groups = simhash_groups(docs, doc_id, text)
    stays = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    kept = docs.join(stays, F.col(doc_id).cast("long") == F.col("_stay"), "left_semi")
    again = materialise(docs.groupBy(doc_id).count().where("count > 1").select(F.col(doc_id).alias("_again")), "repeated-ids")
    once = kept.join(again, F.col(doc_id) == F.col("_again"), "left_anti")
    more = kept.join(again, F.col(doc_id) == F.col("_again"), "left_semi").dropDuplicates([doc_id])
    return once.unionByName(more).unionByName(docs.where(F.col(doc_id).isNull())).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    rows = simhash_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
