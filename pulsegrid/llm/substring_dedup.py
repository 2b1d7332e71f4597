"""Exact substring dedup by seed and extend.

Seeds: every five-word run is hashed and winnowed, so that the least hash of any nine neighbouring runs is an anchor. A
window of 13 words is nine such runs, so each window has one anchor, fixed by its own words: documents that share a window
share its anchor. Slices of documents are joined on their distinct anchors, and an anchor that no other slice holds is done
with. Extension: around each shared anchor the windows that hold it reach both ways, and each is compared in full (64 bits
of the window, 32 of its anchor) with those that met at the same anchor. The windows of one anchor are dealt by their own
hash, so a phrase that stands in every document spreads over all parts as its surroundings differ; where they do not, a
slice asks once. Only the first document of a window matters, so a window never makes pairs. Matched windows that touch
form the maximal repeats, and as each is a whole window, none is shorter than the threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import BATCH_BYTES, map_arrow, mix, neutral, parts_for, slices, table, utf8, window_hashes, word_hashes
from pulsegrid.sources.stage import materialise

WINDOW = 13
SEED_WORDS = 5

CHARS_PER_PART = 16_000_000
"""Text whose windows meet in one part: bounds what a task holds."""

SEED_CHARS_PER_PART = 4 * CHARS_PER_PART
"""The same for anchors, of which there is about one in five words."""

SEED_BITS = np.uint64((1 << 48) - 1)
"""What is kept of an anchor until windows are compared."""

NO_ID = np.iinfo(np.int64).max
"""Stands for a null id: later than every document."""

SLICES = "slice long, chars long, ids binary, crcs binary, sizes binary, lengths binary, seeds binary, zip binary"
SEEDS = "part int, slice long, seeds binary"
SHARED = "slice long, part long, seeds binary"
ASKS = "part int, slice long, known boolean, places binary, ids binary, tags binary, windows binary"
FOUND = "slice long, places binary"
SPANS = "doc_id long, crc long, spans binary"


def seeds_and_windows(words: list[bytes], window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window: its anchor, and the hash of all its words."""
    h = word_hashes(words)
    full = window_hashes(h, window)
    grams = mix(window_hashes(h, k) ^ np.uint64(0x5851F42D4C957F2D))
    n, w = len(full), window - k + 1
    if not n:
        return full, full
    anchor = grams[:n].copy()
    for j in range(1, w):
        np.minimum(anchor, grams[j:j + n], out=anchor)
    return anchor, full


def first_document(anchor: np.ndarray, window: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry the least `doc` of those with the same anchor and window."""
    order = np.lexsort((anchor, window))
    a, w = anchor[order], window[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (a[1:] != a[:-1])
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
    out = np.empty_like(doc)
    out[order] = least[np.cumsum(new) - 1]
    return out


def run_firsts(*columns: np.ndarray) -> np.ndarray:
    """Places where a new run begins: some column changes."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def packed(x: np.ndarray) -> bytes:
    """Numbers as steps from one to the next, all first bytes before all second ones, compressed: small steps take few bytes."""
    steps = np.diff(x.astype("<i8"), prepend=np.int64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def seed_places(anchor: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part where an anchor meets its like, and its 32-bit name there. Two anchors of one name cost a needless comparison, no match."""
    low = anchor & SEED_BITS
    return (low % np.uint64(parts)).astype(np.int64), (low // np.uint64(parts)).astype("<u4")


def record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its places in ascending order) of every part that occurs."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(part[at[0]]), at


def _slice(batch: pa.RecordBatch, number: int, window: int, k: int) -> pa.RecordBatch | None:
    """One row for a slice of documents: their ids and texts, how many windows each has, and the slice's distinct anchors."""
    ids = np.array([NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()], dtype="<i8")
    texts = batch.column("_text").to_pylist()
    pieces = [seeds_and_windows(t.split(), window, k)[0] for t in texts]
    sizes, lengths = (np.fromiter(map(len, x), dtype="<i8", count=len(texts)) for x in (pieces, texts))
    if not sizes.sum():
        return None
    crcs = np.fromiter(map(zlib.crc32, texts), dtype="<i8", count=len(texts))
    seeds = np.unique(np.concatenate(pieces) & SEED_BITS)
    return record([(number, int(lengths.sum()), *(x.tobytes() for x in (ids, crcs, sizes, lengths)), packed(seeds), zstandard.compress(b"".join(texts), 1))], SLICES)


def _seeds(number: int, seeds: bytes, parts: int) -> pa.RecordBatch:
    part, name = seed_places(unpacked(seeds).astype(np.uint64), parts)
    return record([(p, number, np.unique(name[at]).tobytes()) for p, at in by_part(part)], SEEDS)


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """One part of the anchors: those that two slices hold, for each slice that holds them."""
    each = [np.frombuffer(b, dtype="<u4") for b in group["seeds"]]
    seeds = np.concatenate(each)
    _, place, n = np.unique(seeds, return_inverse=True, return_counts=True)
    cuts = np.cumsum([len(x) for x in each])[:-1]
    kept = [x[m].tobytes() for x, m in zip(each, np.split(n[place] > 1, cuts), strict=True)]
    return pd.DataFrame([(i, p, b) for i, p, b in zip(group["slice"], group["part"], kept, strict=True) if b], columns=["slice", "part", "seeds"])


def _asks(number: int, row: dict, parts: int, seed_parts: int, window: int, k: int) -> pa.RecordBatch | None:
    """What one slice asks: its first documents' windows around shared anchors, one row for each part; and its matches inside the slice."""
    ids, lengths = (np.frombuffer(row[c], dtype="<i8") for c in ("ids", "lengths"))
    text = zstandard.decompress(row["zip"])
    ends = np.cumsum(lengths).tolist()
    pieces = [seeds_and_windows(text[a:b].split(), window, k) for a, b in pairwise([0, *ends])]
    anchor, full = (np.concatenate([p[i] for p in pieces]) for i in (0, 1))
    doc = np.repeat(ids, [len(w) for _, w in pieces])
    early = first_document(anchor, full, doc) < doc
    out = []
    if early.any():
        out.append((number % parts, number, True, packed(np.flatnonzero(early)), b"", b"", b""))
    key = lambda part, name: part << 32 | name.astype(np.int64)
    shared = [key(r["part"], np.frombuffer(r["seeds"], dtype="<u4")) for r in row["shared"] or []]
    asked = np.flatnonzero(~early & np.isin(key(*seed_places(anchor, seed_parts)), np.concatenate([np.empty(0, dtype=np.int64), *shared])))
    for part, i in by_part((full[asked] % np.uint64(parts)).astype(np.int64)):
        at = asked[i]
        out.append((part, number, False, packed(at), packed(doc[at]), anchor[at].astype("<u4").tobytes(), full[at].astype("<u8").tobytes()))
    return record(out, ASKS) if out else None


def _answers(group: pd.DataFrame) -> pd.DataFrame:
    """One part: which of the windows that each slice asks for an earlier document has. Matches known before ride along."""
    out = group.loc[group["known"], ["slice", "places"]]
    rows = group[~group["known"]]
    if not len(rows):
        return out
    places = [unpacked(b) for b in rows["places"]]
    doc = np.concatenate([unpacked(b) for b in rows["ids"]])
    tag, full = np.frombuffer(b"".join(rows["tags"]), dtype="<u4"), np.frombuffer(b"".join(rows["windows"]), dtype="<u8")
    found = np.split(first_document(tag, full, doc) < doc, np.cumsum([len(p) for p in places])[:-1])
    new = [(i, packed(p[m])) for i, p, m in zip(rows["slice"], places, found, strict=True) if m.any()]
    return pd.concat([out, pd.DataFrame(new, columns=["slice", "places"])])


def _by_document(row: dict) -> pa.RecordBatch:
    """One slice: the runs that all parts found, one row for each of its documents that has any."""
    ids, crcs, sizes = (np.frombuffer(row[c], dtype="<i8") for c in ("ids", "crcs", "sizes"))
    at = np.sort(np.concatenate([unpacked(b) for b in row["found"]]))
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, at, side="right")
    first = run_firsts(doc, at - np.arange(len(at)))
    count = np.diff(first, append=len(at))
    own = doc[first]
    pairs = np.stack([at[first] - (ends - sizes)[own], count]).T.astype("<i8")
    begins = run_firsts(own)
    spans = [x.tobytes() for x in np.split(pairs, begins[1:])]
    return record(list(zip(ids[own[begins]].tolist(), crcs[own[begins]].tolist(), spans, strict=True)), SPANS)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = SEED_WORDS) -> DataFrame:
    """(doc_id, crc, spans): runs (start, count; 64-bit pairs) of windows that a document with a smaller id holds too.

    `crc` is that of the whole text and tells rows with one id apart; the null id is written as the largest number.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "_text", BATCH_BYTES):
                number += 1
                out = _slice(part, number, window, k)
                if out is not None:
                    yield out

    pieces = materialise(rows.mapInArrow(cut, SLICES), "dedup-slices")
    parts = parts_for(pieces, F.col("chars"), CHARS_PER_PART)
    seed_parts = parts_for(pieces, F.col("chars"), SEED_CHARS_PER_PART)

    seeds = per_row(pieces.select("slice", "seeds"), lambda r: _seeds(r["slice"], r["seeds"], seed_parts), SEEDS)
    shared = seeds.groupBy("part").applyInPandas(_shared, SHARED).groupBy("slice").agg(F.collect_list(F.struct("part", "seeds")).alias("shared"))
    meeting = pieces.select("slice", "ids", "lengths", "zip").join(shared, "slice", "left")
    asks = per_row(meeting, lambda r: _asks(r["slice"], r, parts, seed_parts, window, k), ASKS)
    found = asks.groupBy("part").applyInPandas(_answers, FOUND).groupBy("slice").agg(F.collect_list("places").alias("found"))
    return per_row(pieces.select("slice", "ids", "crcs", "sizes").join(found, "slice"), _by_document, SPANS)


def per_row(df: DataFrame, fn: Callable[[dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`fn` over each row, which is one slice: several rows, or None, come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = fn(batch.slice(i, 1).to_pylist()[0])
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def remaining(text: bytes, spans: list[bytes], window: int) -> tuple[list[bytes], int]:
    """The kept words and the number of all words."""
    words = text.split()
    if not spans:
        return words, len(words)
    runs = np.frombuffer(b"".join(spans), dtype="<i8").reshape(-1, 2)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1] + window - 1, -1)
    gone = np.cumsum(steps[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], len(words)


ADDED = ("_kept_text", "_n_words", "_n_removed")


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = SEED_WORDS) -> DataFrame:
    """All columns of `docs`, of any name but those of the three that are added: `_kept_text` (kept words joined by one blank; null for a null text), `_n_words` and `_n_removed`.

    A word goes if it lies in a window of `window` words that also starts in a document with a smaller id. Null and empty texts
    have no words. A null id is later than every other and removes nothing; rows that share an id remove nothing from one
    another. Texts shorter than the window are kept. Long texts and documents with thousands of copies are handled whole.
    """
    own = [c for c in docs.columns if c not in ADDED]
    docs = neutral(docs.select(*own))
    doc_id, text = f"c{own.index(doc_id)}", f"c{own.index(text)}"
    crc = F.crc32(utf8(text)).alias("_crc")
    spans = repeats(docs, doc_id, text, window, k).groupBy(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc")).agg(F.collect_list("spans").alias("_spans"))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NO_ID)).cast("long")).alias("_id")
    joined = squeezed(docs.select("*", key, crc), text).join(spans, ["_id", "_crc"], "left")

    names = [c for c in docs.columns if c != text]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else zstandard.decompress(t) for t in batch.column("_zip").to_pylist()]
        kept, all_, gone = [], [], []
        for t, s in zip(texts, batch.column("_spans").to_pylist(), strict=True):
            words, n = remaining(t or b"", s or [], window)
            kept.append(None if t is None else b" ".join(words).decode("utf-8", "replace"))
            all_.append(n)
            gone.append(n - len(words))
        whole = pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts], pa.string())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), whole, pa.array(kept, pa.string()), pa.array(all_, pa.int64()), pa.array(gone, pa.int64())],
                                          names=[*names, text, "_kept_text", "_n_words", "_n_removed"])

    schema = docs.select(*names, F.col(text).cast("string").alias(text), F.lit(None).cast("string").alias("_kept_text"), F.lit(0).cast("long").alias("_n_words"), F.lit(0).cast("long").alias("_n_removed")).schema
    rows = joined.select(*names, "_zip", "_spans")
    return map_arrow(rows, cut, schema, text="_zip", limit=BATCH_BYTES // 4).select(*docs.columns, *ADDED).toDF(*own, *ADDED)


def squeezed(docs: DataFrame, text: str) -> DataFrame:
    """The text column as compressed bytes `_zip`, for a shuffle that carries whole texts."""
    names = [c for c in docs.columns if c != text]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        zips = [None if t is None else zstandard.compress(t, 1) for t in batch.column("_bytes").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(zips, pa.binary())], names=[*names, "_zip"])

    schema = docs.select(*names, F.lit(None).cast("binary").alias("_zip")).schema
    return map_arrow(docs.select(*names, F.col(text).cast("string").cast("binary").alias("_bytes")), run, schema, text="_bytes")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeats(docs)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                      F.sha2(F.coalesce("_kept_text", F.lit("")), 256).alias("kept_sha256"))
