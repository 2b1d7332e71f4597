"""Periodic runs of words: longest common extensions from suffix trees, Lyndon roots extended both ways.

A run repeats its first q words at least twice and cannot be made longer on either side. Every run has a root that is the longest
Lyndon word beginning somewhere in the text, in the order of the words or in its reverse. So one candidate per place and order
is enough: its root is the stretch up to the next smaller suffix, and the common extensions of root begin and root end, to the right
and to the left, say how far its period reaches.

Extensions are lowest common ancestors: Ukkonen's tree of the words answers those to the right, the tree of the reversal
those to the left, each through an Euler tour with constant-time range minima in linear memory.

Trees are only built where a run can be. The words of a run are covered by six-word grams that come again inside it, so text
outside such stretches holds none. The grams are compared by hash: a false hit only makes a tree larger.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import map_arrow, table, utf8, window_hashes

LEAST = 12
GRAM = 6
"""A run of period q and length n repeats n - q >= max(LEAST / 2, q) words at distance q, hence all its grams of this length."""

BLOCK = 16
"""Places per block of the range minima."""


def suffix_tree(s: list[int]) -> tuple[list[int], list[dict[int, int] | None]]:
    """Ukkonen's tree of `s`, whose last symbol is unique: length of the edge into each node, and the children (None: a leaf)."""
    n = len(s)
    most = 2 * n
    begin, end, link = [0] * most, [n] * most, [0] * most
    kids: list[dict[int, int] | None] = [None] * most
    kids[0] = {}
    end[0] = 0
    new, node, edge, length, pending = 1, 0, 0, 0, 0
    for i, c in enumerate(s):
        pending += 1
        last = 0
        while pending:
            if not length:
                edge = i
            head = s[edge]
            own = kids[node]
            nxt = own.get(head)
            if nxt is None:
                own[head] = new
                begin[new] = i
                new += 1
                if last:
                    link[last] = node
                    last = 0
            else:
                at = begin[nxt]
                size = (i + 1 if kids[nxt] is None else end[nxt]) - at
                if length >= size:
                    edge += size
                    length -= size
                    node = nxt
                    continue
                old = s[at + length]
                if old == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                own[head] = new
                begin[new] = at
                begin[nxt] = end[new] = at + length
                kids[new] = {old: nxt, c: new + 1}
                begin[new + 1] = i
                if last:
                    link[last] = new
                last = new
                new += 2
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return (np.array(end[:new]) - np.array(begin[:new])).tolist(), kids


class Extensions:
    """Lengths of common beginnings of two suffixes of one word list, in constant time each."""

    def __init__(self, words: list[int], ranks: bool = False) -> None:
        """`words` are numbers from 0. With `ranks`, also the order of the suffixes by rising and by falling words."""
        first, tour, leaves, last = self._tour(*suffix_tree([*words, -1]), len(words), ranks)
        self.first, self.tour = np.array(first, dtype=np.int64), np.array(tour, dtype=np.int32)
        if ranks:
            self.rising, self.falling = self._ranks(np.array(leaves), np.array(last))
        del first, tour, leaves, last
        self._minima()

    @staticmethod
    def _tour(size: list[int], kids: list[dict[int, int] | None], n: int, ranks: bool) -> tuple[list[int], ...]:
        """String depths along an Euler tour (a node's each time it is come back to) and where each suffix's leaf stands in it. With `ranks`, also
        the suffixes in order, and for each suffix that begins others the place of the last of them (-1: it begins none)."""
        first, tour, leaves, last = [0] * (n + 1), [0], [], [-1] * (n + 1)
        own, depth, stack = kids[0], 0, []
        rest = iter([own[c] for c in sorted(own)] if ranks else own.values())
        while True:
            for k in rest:
                below = depth + size[k]
                inner = kids[k]
                if inner is None:
                    leaf = n + 1 - below
                    first[leaf] = len(tour)
                    leaves.append(leaf)
                    tour += below, depth
                else:
                    stack.append((own, depth, rest))
                    own, depth = inner, below
                    rest = iter([own[c] for c in sorted(own)] if ranks else own.values())
                    break
            else:
                if -1 in own:
                    last[n - depth] = len(leaves) - 1
                if not stack:
                    return first, tour, leaves, last
                own, depth, rest = stack.pop()
                tour.append(depth)

    @staticmethod
    def _ranks(leaves: np.ndarray, last: np.ndarray) -> tuple[list[int], list[int]]:
        """Rank of every suffix by rising and by falling words; a suffix that begins another comes before it in both."""
        n = len(leaves)
        rising, falling = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        rising[leaves] = np.arange(n)
        begins = last >= 0
        falling[np.lexsort((np.where(begins, n - np.arange(n), 0), ~begins, n - 1 - np.where(begins, last, rising)))] = np.arange(n)
        return rising.tolist(), falling.tolist()

    def _minima(self) -> None:
        """Minima from each place to both ends of its block, and a sparse table over whole blocks."""
        size = -(-len(self.tour) // BLOCK) * BLOCK
        self.tour = np.concatenate([self.tour, np.full(size - len(self.tour), np.iinfo(np.int32).max, dtype=np.int32)])
        grid = self.tour.reshape(-1, BLOCK)
        self.to_left = np.minimum.accumulate(grid, axis=1).ravel()
        self.to_right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        step = 1
        while 2 * step <= len(self.levels[0]):
            top = self.levels[-1]
            self.levels.append(np.minimum(top[:-step], top[step:]))
            step *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of the suffixes at i and at j (i != j); place n is the empty suffix."""
        a, b = self.first[i], self.first[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        left, right = a // BLOCK, b // BLOCK
        out = np.minimum(self.to_right[a], self.to_left[b])
        far = np.flatnonzero(right - left > 1)
        if len(far):
            lo, hi = left[far] + 1, right[far]
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            best = np.empty(len(far), dtype=np.int32)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                best[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << int(k))])
            out[far] = np.minimum(out[far], best)
        near = np.flatnonzero(left == right)
        if len(near):
            lo, hi = a[near], b[near]
            best = self.tour[lo]
            for step in range(1, BLOCK):
                best = np.minimum(best, self.tour[np.minimum(lo + step, hi)])
            out[near] = best
        return out.astype(np.int64)


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each suffix but the empty one, the next place to the right with a smaller suffix."""
    n = len(rank) - 1
    out = [n] * n
    stack = [n]
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while rank[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out, dtype=np.int64)


def runs_of(words: list[int], least: int = LEAST) -> np.ndarray:
    """All runs of a list of numbers from 0: rows (start, length, period), by start, then period."""
    n = len(words)
    if n < 2:
        return np.empty((0, 3), dtype=np.int64)
    ahead = Extensions(words, ranks=True)
    behind = Extensions(words[::-1])
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([next_smaller(ahead.rising), next_smaller(ahead.falling)])
    period = j - i
    fits = np.flatnonzero(2 * period <= n)
    i, j, period = i[fits], j[fits], period[fits]
    start = i - behind.common(n - i, n - j)
    length = j + ahead.common(i, j) - start
    long = (length >= 2 * period) & (length >= least)
    found = np.unique(np.stack([start[long], period[long], length[long]], axis=1), axis=0)
    return found[:, [0, 2, 1]]


def stretches(grams: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words, each covered by grams that come again inside the same range, at most half its length away; every run lies in one."""
    if len(grams) == 0:
        return []
    todo, out = [(0, len(grams) + GRAM - 1)], []
    while todo:
        a, b = todo.pop()
        own = grams[a:b - GRAM + 1]
        order = np.argsort(own, kind="stable")
        same = (own[order[1:]] == own[order[:-1]]) & (2 * np.diff(order) <= b - a)
        if not same.any():
            continue
        again = np.concatenate([order[1:][same], order[:-1][same]])
        hit = np.bincount(again, minlength=len(own)) > 0
        depth = np.cumsum(np.pad(hit.astype(np.int32), (0, GRAM)) - np.pad(hit.astype(np.int32), (GRAM, 0)))
        edges = np.diff(np.concatenate([[0], depth[:-1] > 0, [0]]).astype(np.int8))
        for x, y in zip((np.flatnonzero(edges == 1) + a).tolist(), (np.flatnonzero(edges == -1) + a).tolist(), strict=True):
            if (x, y) == (a, b):
                out.append((a, b))
            elif y - x >= LEAST:
                todo.append((x, y))
    return out


def runs_of_words(words: list[bytes]) -> np.ndarray:
    """All runs of at least `LEAST` words: rows (start, length, period), by start, then period."""
    none = np.empty((0, 3), dtype=np.int64)
    if len(words) < LEAST:
        return none
    found = []
    for a, b in stretches(window_hashes(np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64), GRAM)):
        part = words[a:b]
        number: dict[bytes, int] = {}
        rows = runs_of([number.setdefault(w, len(number)) for w in part])
        found.append(rows + np.array([a, 0, 0]))
    found = np.concatenate(found) if found else none
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])


ROWS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: the runs (start, length, period) by start, then period, and the text without repeats.

    Words are stretches without white space (space, tab to carriage return). `rewrite` may change a document's words first. Null and empty texts have no words, no
    runs and an empty collapsed text. Runs that begin together are told apart by period. Repeated rows come back as often, a null doc_id
    is carried, other columns are not read, an empty table gives no rows. A text of any length is read whole, in one task; beside its words the memory grows
    with its longest repetitive stretch, by about a kilobyte a word.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        sizes, offsets, flat, texts = [], [0], [], []
        for i, t in zip(ids, batch.column("_text").to_pylist(), strict=True):
            words = t.split()
            if rewrite is not None:
                words = rewrite(i, words)
            found = runs_of_words(words)
            sizes.append(len(words))
            offsets.append(offsets[-1] + len(found))
            flat.append(found)
            texts.append(collapsed(words, found))
        rows = np.concatenate(flat)
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(RUN)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())],
                                          names=["doc_id", "n_words", "runs", "collapsed"])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("_text")), run, ROWS)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: one document in ten repeats a stretch of its words up to its end. A null id is left alone."""
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a:a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[:n - a]


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: counts, the longest run, digests of all runs and of the collapsed text."""
    rows = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.withColumn("best", longest)
    length = -F.col("best.less")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor((1000 * length - F.pmod(1000 * length, F.col("best.period"))) / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
