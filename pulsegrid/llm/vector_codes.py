"""Product codes of integer vectors: one book of entries per part, the nearest entry found by equal-average search.

The squared distance of two vectors of d components is at least the square of the difference of their sums, divided by d. So a book is kept in
order of its entries' component sums; a part looks at the entries outward from its own sum, and stops on a side as soon as that bound strictly
exceeds the best distance. Entries at the very same distance are still reached, and the lowest index among them wins.

Books are small and of fixed size (parts x entries x components), so they travel with the tasks; what comes back of a round is one
sum per book component, whatever the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import table
from pulsegrid.sources.stage import materialise

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of `x` the nearest row of `book` (ties: lowest index), the squared distance, and how many distances were worked out in all."""
    d = x.shape[1]
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, entries = sums[order], book[order]
    own = x.sum(axis=1)
    above = np.searchsorted(sums, own)
    best = np.full(len(x), (1 << 62) // d, dtype=np.int64)
    code = np.full(len(x), len(book), dtype=np.int64)
    sides = [(np.arange(len(x)), above, 1), (np.arange(len(x)), above - 1, -1)]
    looked = 0
    while sides:
        rest = []
        for rows, at, step in sides:
            inside = (at >= 0) & (at < len(book))
            rows, at = rows[inside], at[inside]
            gap = sums[at] - own[rows]
            within = gap * gap <= best[rows] * d
            rows, at = rows[within], at[within]
            if not len(rows):
                continue
            looked += len(rows)
            off = x[rows] - entries[at]
            dist = np.einsum("ij,ij->i", off, off)
            index = order[at]
            better = (dist < best[rows]) | ((dist == best[rows]) & (index < code[rows]))
            best[rows[better]], code[rows[better]] = dist[better], index[better]
            rest.append((rows, at + step, step))
        sides = rest
    return code, best, looked


def components(v: str) -> Column:
    """The vector as integers: floor of 256 times each component."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(v: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    fine = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  NaN is above infinity
    return F.col(v).isNotNull() & F.coalesce(F.forall(v, fine), F.lit(False))


def matrix(batch: pa.RecordBatch, width: int, parts: int) -> np.ndarray:
    """(rows, parts, components per part) of the column `v`; the last part is filled with zeros if the width is no multiple of the parts."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
    each = -(-width // parts)
    return np.pad(flat, ((0, 0), (0, each * parts - width))).reshape(-1, parts, each)


def improved(rows: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The books with every entry replaced by the floored mean of the parts nearest to it; unused entries stay."""
    parts, entries, each = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            x = matrix(batch, width, parts)
            for p in range(parts):
                code = nearest(x[:, p], books[p])[0]
                np.add.at(sums[p], code, x[:, p])
                counts[p] += np.bincount(code, minlength=entries)
        cell = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cell, each)), pa.array(np.tile(np.arange(each), len(cell))), pa.array(sums.reshape(-1, each)[cell].ravel()),
                                          pa.array(np.repeat(counts.ravel()[cell], each))], names=["cell", "place", "total", "n"])

    means = rows.select("v").mapInArrow(run, "cell long, place long, total long, n long").groupBy("cell", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.reshape(-1, each).copy()
    for r in means.collect():  # at most one row per component of the books
        out[r["cell"], r["place"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for every row whose vector is there and finite.

    Books start from the vectors with the smallest ids (repeated ids: by their components; null ids last) and are improved over all rows. `code` has two hex
    digits per part, `error` is the squared distance summed over parts, `label_error` its sum over equal labels, null being a label of its own.

    Vectors are as long as the longest; parts are equal, the last filled with zeros if the length is no multiple of their number. A shorter or empty vector, or
    one with a component beyond 2^22 in magnitude at most (less for parts of over 256 components), keeps its row with null code and error and takes no part in the books. With fewer rows than
    entries the books are shorter. Repeated rows come back as often. Other columns are not read. An empty table gives no rows.
    """
    kept = vectors.where(usable(vector)).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), components(vector).alias("v"))
    width = kept.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    each = max(1, -(-width // parts))
    limit = min(1 << 30, (1 << 30) // each)
    fits = (F.size("v") == width) & F.lit(width > 0) & F.forall("v", lambda x: F.abs(x) < limit)
    sound = kept.where(fits)
    seeds = sound.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in seeds], dtype=np.int64).reshape(len(seeds), width)
    books = np.pad(books, ((0, 0), (0, each * parts - width))).reshape(len(seeds), parts, each).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(seeds) else 0):
        books = improved(sound, books, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, width, parts)
            codes, error = np.empty((len(x), parts), dtype=np.uint8 if entries <= 256 else np.uint16), np.zeros(len(x), dtype=np.int64)
            for p in range(parts):
                codes[:, p], best, _ = nearest(x[:, p], books[p])
                error += best
            text = codes.astype(">u2").tobytes().hex() if entries > 256 else codes.tobytes().hex()
            size = len(text) // max(1, len(x))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([text[i:i + size] for i in range(0, len(text), size)], pa.string()),
                                              pa.array(error)], names=["vec_id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    coded = sound.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")
    odd = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = materialise(coded.unionByName(odd), "vector-codes")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


_NEAR = """
near{k} AS MATERIALIZED (
  SELECT a.r, a.p, min(CAST(list_sum(list_transform(list_zip(a.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + b.e) AS best
  FROM parts a JOIN book{k} b ON a.p = b.p GROUP BY a.r, a.p)"""

_BOOK = """
book{n} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c
  FROM book{k} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT a.p, n.best % 64 AS e, i, CAST(sum(a.x[i]) AS BIGINT) AS s, count(*) AS n
          FROM parts a JOIN near{k} n ON a.r = n.r AND a.p = n.p, (SELECT unnest(range(1, (SELECT w FROM width) + 1)) AS i) GROUP BY ALL)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""

SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(v)) // 16 AS w FROM kept),
parts AS MATERIALIZED (SELECT r, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, width, (SELECT unnest(range(16)) AS p)),
book0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM parts WHERE r < 64),""" + ",".join([
    _NEAR.format(k=0), _BOOK.format(k=0, n=1), _NEAR.format(k=1), _BOOK.format(k=1, n=2), _NEAR.format(k=2)]) + """,
coded AS MATERIALIZED (
  SELECT k.vec_id, k.label, string_agg(format('{:02x}', n.best % 64), '' ORDER BY n.p) AS code, CAST(sum(n.best // 64) AS BIGINT) AS error
  FROM kept k JOIN near2 n ON k.r = n.r GROUP BY k.r, k.vec_id, k.label),
digest AS (
  SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM book2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest"""
