"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

For every n-gram length a polynomial hash rolls over the words (numpy, one array operation per length); the characters
of all words covered by an n-gram seen before, and of lines seen before, are measured against the characters of all words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import covered, map_arrow, table, utf8, window_hashes, word_hashes

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
INNER = bytes(range(0x80, 0xC0))
"""UTF-8 bytes that do not begin a character."""


@dataclass(frozen=True)
class Limits:
    """Shares above which a text is refused: the limits published for web text, by n-gram length. They are made for long pages: in
    a text of under `short_words` words one repetition of at most `one_repeat` words is not held against it."""

    duplicate_ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    duplicate_lines: float = 0.30
    duplicate_line_chars: float = 0.20
    short_words: int = 300
    one_repeat: int = 20
    min_words: int = 50
    max_repeat_percent: int = 50


def characters(b: bytes) -> int:
    return len(b.translate(None, INNER))


def but_one(again: np.ndarray, first: np.ndarray, k: int, most: int) -> np.ndarray:
    """The windows of k words seen `again`, without those of the longest passage of at most `most` words that repeats an earlier one."""
    at = np.flatnonzero(again)
    ends = np.flatnonzero((np.diff(at) != 1) | (np.diff(first[at]) != 1))
    begins, ends = np.concatenate([[0], ends + 1]), np.concatenate([ends + 1, [len(at)]])
    sizes = np.where(ends - begins + k - 1 <= most, ends - begins, 0)
    x = int(sizes.argmax())
    return np.delete(at, np.s_[begins[x]:ends[x]]) if sizes[x] else at


def measure(text: bytes, limits: Limits) -> tuple:
    words = text.split()
    n = len(words)
    word_chars = characters(text.translate(None, SPACE))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    seen: set[bytes] = set()
    n_dup, dup_chars, spared = 0, 0, 0
    short = n < limits.short_words
    for x in lines:
        if x in seen:
            n_dup += 1
            size = characters(x.translate(None, SPACE))
            dup_chars += size
            if short and size > spared and len(x.split()) <= limits.one_repeat:
                spared = size
        seen.add(x)
    h = word_hashes(words)
    g = window_hashes(h, 3)
    n_repeat = 0
    if len(g):
        _, back, times = np.unique(g, return_inverse=True, return_counts=True)
        n_repeat = int(covered(n, np.flatnonzero(times[back] > 1), 3).sum())
    failed = n < limits.min_words or 100 * n_repeat > limits.max_repeat_percent * n
    sizes = np.fromiter((characters(w) for w in words), dtype=np.int64, count=n) if n_repeat else np.zeros(n, dtype=np.int64)
    shares, held = {}, {}
    for k in limits.duplicate_ngrams:
        # an n-gram of three or more words that repeats holds three-word windows that repeat
        g = window_hashes(h, k) if n_repeat else np.empty(0, dtype=np.uint64)
        again = np.ones(len(g), dtype=bool)
        _, first, back = np.unique(g, return_index=True, return_inverse=True) if short else (*np.unique(g, return_index=True), None)
        again[first] = False
        shares[k] = held[k] = int(sizes[covered(n, np.flatnonzero(again), k)].sum()) / word_chars if again.any() else 0.0
        if short and shares[k]:
            held[k] = int(sizes[covered(n, but_one(again, first[back], k, limits.one_repeat), k)].sum()) / word_chars
    line_chars = dup_chars / max(1, word_chars)
    repetitive = (n_dup - bool(spared)) / max(1, len(lines)) > limits.duplicate_lines or (dup_chars - spared) / max(1, word_chars) > limits.duplicate_line_chars or any(
        held[k] > most for k, most in limits.duplicate_ngrams.items())
    return n, word_chars, n_symbols, n_dup, n_repeat, failed, not failed and not repetitive, line_chars, max(shares.values(), default=0.0)


COLUMNS = ("n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long", "base_failed boolean",
           "kept boolean", "dup_line_chars double", "top_ngram_chars double")


def repetition_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits | None = None) -> DataFrame:
    """One row per row of `docs`: the counts, the base rule and the verdict. `kept` is false if the base rule failed or a repetition limit is passed;
    the shares are those of all repetitions, also of the one that a short text is forgiven.

    Null and empty texts have no words: all counts are 0, shares 0, the base rule fails. Texts of any length are measured whole.
    Repeated rows come back as often; an empty table gives none; a null doc_id stays null. Other columns are not read.
    """
    limits = limits or Limits()
    names = ["doc_id", *(c.split()[0] for c in COLUMNS)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(measure(t, limits) for t in batch.column("_text").to_pylist()), strict=True))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r) for r in rows)], names=names)

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("_text")), run, ", ".join(["doc_id long", *COLUMNS]))


def query(spark, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))
