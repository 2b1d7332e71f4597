"""What the operators share: words, hashes of word windows, batches, parts of size, held-out rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MULT = np.uint64(0x9E3779B97F4A7C15)
"""Odd multiplier of the polynomial window hash."""

BATCH_BYTES = 4_000_000
"""Text handled at once inside a task: bounds the arrays, not the documents (one longer text is one batch)."""


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def neutral(docs: DataFrame) -> DataFrame:
    """The same rows with columns named c0, c1, …, which no helper column is named like."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def held_out(doc_id: str = "doc_id") -> Column:
    """Is crc32 of the id's decimal text a multiple of five? A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
              text: str = "_text", limit: int = BATCH_BYTES) -> DataFrame:
    """`fn` over slices of at most `limit` bytes of text (or one row, if that is longer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)], dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k neighbouring values; empty if there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= MULT
        acc += h[j:j + n]
    return mix(acc)


def covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of n places lie in a run of k places that begins at one of `starts`."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + k, -1)
    return np.cumsum(steps[:-1]) > 0


def parts_for(df: DataFrame, amount: Column, each: int) -> int:
    """How many parts of about `each` units the rows make; at least the shuffle's partitions."""
    total = df.agg(F.sum(amount).alias("n")).first()["n"] or 0
    return int(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // each)))
