"""Mixture-controlled packing: deficit round-robin over one queue of tokens per source.

Every window of `capacity` tokens serves each source its share. A share is seldom a whole number of tokens: what a source
is owed beyond what it was served is its deficit, carried into the next window. Token j of a source with T tokens
is due at time (j + 1/2) / T, and the windows cut the order of due times: each is full, and where a window ends a source is off
its share by at most one token and half a token for each other source. So the state of the round-robin at any window follows from the sources' totals, and
every task continues it where its rows lie in their queues; nothing is simulated in sequence.
"""

from __future__ import annotations

import functools
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import slices, table, utf8
from pulsegrid.sources.stage import materialise

CAPACITY = 4096
END = 2
KEPT_WORDS = 300_000
"""Lower-case words whose ids a Python worker remembers; beyond, it starts afresh. A question of speed and memory only."""


def struct_of(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


PROBE = "Hello, world... unbelievably  stra\u00dfe \u00c9\u00e0\u00fc** ci\u00f3n\u00f1. \u039f\u0394\u039f\u03a3 it's don't 3rd 12,5 a\u00b2 x_y \u8a9e\u8a00 e\u0301t\u00e9 <b>T\u00eate</b>\n\t'quoted' end.'"
"""A text on which encoding word by word must give the whole encoding, else whole texts are encoded."""

MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
"""ASCII marks without the apostrophe: after letters, the splitter makes one part of any number of them."""


def texts_of(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def gathered(blob: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `codes` name, one after another, out of runs of these sizes in `blob`; and where each begins, with the end."""
    begin = np.cumsum(size) - size
    n = size[codes]
    upto = np.concatenate([[0], np.cumsum(n)])
    return blob[np.repeat(begin[codes] - upto[:-1], n) + np.arange(upto[-1])], upto


class WordTokenizer:
    """Ids of a text by a tokenizer whose words end at white space: each distinct word is encoded once and remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.plain: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.byte_chars = [chr(b) if b in printable else chr(next(spare)) for b in range(256)]
        self.one_pass = '"type":"BPE"' in self.whole.to_str().replace(" ", "") and self._agrees()
        self.by_words = True
        self.by_words = self.ids([PROBE.encode()]) == self._encode([PROBE])

    def _agrees(self) -> bool:
        """Does the short way give the tokenizer's own ids?"""
        return all(self._letters(w) == self._encode([w])[0] for w in ("hello", "straße", "éàü", "ciónñ", "unbelievably"))

    def _encode(self, words: list[str]) -> list[bytes]:
        return [struct_of(e.ids) for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, word: str) -> bytes:
        """Ids of a lower-case word of letters only: neither normalizer nor splitter has anything to do."""
        mapped = word if word.isascii() else "".join(map(self.byte_chars.__getitem__, word.encode()))
        return struct_of([t.id for t in self.model.tokenize(mapped)])

    def _bases(self, bases: list[str]) -> list[bytes | None]:
        """Ids of lower-case words of letters; None where a normal form may differ."""
        got = list(map(self.plain.get, bases))
        new = [i for i, x in enumerate(got) if x is None]
        normal = unicodedata.is_normalized("NFC", "\n".join([bases[i] for i in new]))
        for i in new:
            w = bases[i]
            if normal or unicodedata.is_normalized("NFC", w):
                got[i] = self.plain[w] = self._letters(w)
        return got

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after another, and their numbers. Letters with marks after them are two units, found once each; other
        words go through the whole tokenizer."""
        lower = pc.utf8_lower(words)
        base = pc.utf8_rtrim(lower, MARKS)
        plain = pc.and_not(pc.utf8_is_alpha(base), pc.match_substring(words, "İ")).to_numpy(zero_copy_only=False)
        if not self.one_pass:
            plain[:] = False
        coded = base.dictionary_encode()
        base_code, names = coded.indices.to_numpy().astype(np.int64), texts_of(coded.dictionary)
        used = np.zeros(len(names), dtype=bool)
        used[base_code[plain]] = True
        units: list[bytes] = [b""] * len(names)
        at = np.flatnonzero(used).tolist()
        for i, x in zip(at, self._bases([names[i] for i in at]), strict=True):
            if x is None:
                used[i] = False
            else:
                units[i] = x
        plain &= used[base_code]
        extra = (pc.binary_length(lower).to_numpy() - pc.binary_length(base).to_numpy()).astype(np.int64)
        tailed, odd = np.flatnonzero(plain & (extra > 0)), np.flatnonzero(~plain)
        code = np.full((len(words), 2), len(names), dtype=np.int64)  # a unit without ids
        code[plain, 0] = base_code[plain]
        units.append(b"")
        tails = [w[-n:] for w, n in zip(texts_of(lower.take(pa.array(tailed))), extra[tailed].tolist(), strict=True)]
        number = {t: len(units) + i for i, t in enumerate(dict.fromkeys(tails))}
        new = [t for t in number if t not in self.tails]
        self.tails.update(zip(new, self._encode(new), strict=True))
        units += [self.tails[t] for t in number]
        code[tailed, 1] = [number[t] for t in tails]
        code[odd, 0] = np.arange(len(units), len(units) + len(odd))
        units += self._encode(texts_of(words.take(pa.array(odd))))
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units)) // 4
        ids, upto = gathered(np.frombuffer(b"".join(units), dtype="<u4"), size, code.ravel())
        return ids, np.diff(upto[::2])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8, none null) one after another, and where each text's begin; the last entry is their number."""
        if not self.by_words:
            each = [np.frombuffer(x, dtype="<u4") for x in self._encode(texts_of(texts.cast(pa.string())))]
            return np.concatenate([np.empty(0, dtype="<u4"), *each]), np.cumsum([0, *map(len, each)])
        if len(self.plain) > KEPT_WORDS:
            self.plain.clear()
        if len(self.tails) > KEPT_WORDS:
            self.tails.clear()
        split = pc.ascii_split_whitespace(texts.cast(pa.string()))
        coded = split.flatten().dictionary_encode()
        ids, upto = gathered(*self._distinct(coded.dictionary), coded.indices.to_numpy())
        place = split.offsets.to_numpy()
        return ids, upto[place - place[0]]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, at = self.encode(pa.array(texts, pa.binary()))
        return [ids[a:b].tobytes() for a, b in pairwise(at.tolist())]


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def served(totals: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """How many tokens of each source are among the first `tokens[i]`: one row per i, which sums to tokens[i].

    The due time up to which the counts reach the sum is found by bisection; sources due at the very same time come in
    order. Counts never fall as tokens grow, so neighbouring windows share no token.
    """
    rates = totals.astype(np.float64)
    tokens = np.asarray(tokens, dtype=np.int64)
    count = lambda t: np.minimum(np.floor(rates * t[:, None] + 0.5).astype(np.int64), totals)
    low, high = np.zeros(len(tokens)), np.full(len(tokens), 2.0)
    for _ in range(80):
        mid = (low + high) / 2
        enough = count(mid).sum(axis=1) >= tokens
        low, high = np.where(enough, low, mid), np.where(enough, mid, high)
    before, after = count(low), count(high)
    rest = (tokens - before.sum(axis=1))[:, None]
    step = after - before
    ahead = np.cumsum(step, axis=1) - step
    return before + np.clip(rest - ahead, 0, step)


def pieces_of(source: np.ndarray, start: np.ndarray, length: np.ndarray, totals: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Into which pieces the windows cut rows (source, place in its queue, length): row, first token, length, sequence, offset.

    The windows of all rows are worked out once: rows of one part of the table lie close in all queues.
    """
    whole = int(totals.sum())
    last_window = -(-whole // capacity)
    due = whole / np.maximum(1, totals[source])
    slack = len(totals) // capacity + 2
    first = np.clip(((start + 0.5) * due).astype(np.int64) // capacity - slack, 0, last_window)
    stop = np.clip(((start + length) * due).astype(np.int64) // capacity + slack + 1, 0, last_window)
    n = stop - first
    row = np.repeat(np.arange(len(source)), n)
    window = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
    known, place = np.unique(np.concatenate([window, window + 1]), return_inverse=True)
    counts = served(totals, np.minimum(known * capacity, whole))
    left, right = place[:len(window)], place[len(window):]
    s = source[row]
    a, b = counts[left, s], counts[right, s]
    lo, hi = np.maximum(a, start[row]), np.minimum(b, (start + length)[row])
    before = np.cumsum(counts, axis=1) - counts
    ahead = before[right, s] - before[left, s]
    ok = lo < hi
    return row[ok], (lo - start[row])[ok], (hi - lo)[ok], window[ok], (ahead + lo - a)[ok]


TOKENS = "doc_id long, source string, ids binary, part long, before long"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary")


def tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str | None = "source") -> DataFrame:
    """The ids of every row with the end id, and where they stand in their source's queue inside their part of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: dict[str, int] = {}
        t = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "_text", 4_000_000):
                ids, at = t.encode(part.column("_text"))
                ids = np.insert(ids, at[1:], END).astype("<u4")
                ends = at + np.arange(len(at))
                before = []
                for s, n in zip(part.column("source").to_pylist(), np.diff(ends).tolist(), strict=True):
                    before.append(queue.get(s, 0))
                    queue[s] = before[-1] + n
                ids = pa.Array.from_buffers(pa.large_binary(), len(before), [None, pa.py_buffer((4 * ends).astype("<i8")), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), ids, part.column("part"), pa.array(before, pa.int64())],
                                                 names=["doc_id", "source", "ids", "part", "before"])

    name = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), name.alias("source"), utf8(text).alias("_text"),
                       F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, TOKENS)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str | None = "source", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    Each window takes from every source in proportion to the source's tokens, which is the mixture that uses every token exactly
    once. All sequences are full but the last. Null and empty texts have the end id alone; a null source is a source of its
    own with the empty name; a null doc_id is carried. Repeated rows are packed each. An empty table gives no rows. Documents
    of any length are cut where windows end.

    Texts are tokenized once; the ids are written, with the row's place in its part. The parts' totals by source, summed up,
    say where each part's queues begin. The totals by source go to the tasks: their number is that of the sources, which
    the mixture presupposes to be named.
    """
    rows = materialise(tokens(docs, path, doc_id, text, source), "tokens")
    per_part = rows.groupBy("part", "source").agg(F.sum(F.length("ids") / 4).cast("long").alias("n"))
    per_part = materialise(per_part, "token-counts")
    totals = {r["source"]: r["n"] for r in per_part.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").collect()}
    names = {s: i for i, s in enumerate(totals)}
    counts = np.array(list(totals.values()), dtype=np.int64)
    begins = materialise(queue_starts(per_part), "queue-starts")
    placed = rows.join(begins, ["part", "source"]).select("doc_id", "source", "ids", (F.col("begin") + F.col("before")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids", 4_000_000):
                ids = part.column("ids").to_pylist()
                size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                source_ = np.array([names[s] for s in part.column("source").to_pylist()], dtype=np.int64)
                row, at, n, sequence, offset = pieces_of(source_, part.column("at").to_numpy(), size, counts, capacity)
                own = [ids[r][4 * a:4 * b] for r, a, b in zip(row.tolist(), at.tolist(), (at + n).tolist(), strict=True)]
                row_ = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(row_), pa.array(at), pa.array(n), pa.array(list(map(zlib.crc32, own)), pa.int64()), pa.array(size[row]), pa.array(sequence),
                    pa.array(offset), part.column("source").take(row_), pa.array(own, pa.binary())], names=[c.split()[0] for c in PIECES.split(", ")])

    return placed.mapInArrow(run, PIECES)


def queue_starts(per_part: DataFrame, block: int = 1024) -> DataFrame:
    """(part, source, begin): the tokens of the source in the parts before. Summed in blocks of parts, so that no source's rows meet in one task."""
    from pyspark.sql import Window as W

    blocks = per_part.withColumn("block", F.floor(F.col("part") / block))
    sums = blocks.groupBy("source", "block").agg(F.sum("n").alias("n"))
    over = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    heads = sums.select("source", "block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("head"))
    inside = W.partitionBy("source", "block").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(heads, ["source", "block"]).select(
        "part", "source", (F.col("head") + F.col("own")).alias("begin"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
