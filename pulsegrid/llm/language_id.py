"""Language by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A vector turned by its place in the n-gram and
multiplied with its neighbours' (binding) stands for the n-gram; the sum over a text's n-grams (bundling) stands for the
text, and the sum over a language's texts for the language. A text takes the language of the nearest prototype by cosine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import held_out, map_arrow, table, utf8

DIMENSIONS = 512
GRAM = 3
SEED = 20_24
KEPT_GRAMS = 32_768
"""n-gram vectors a Python worker keeps; beyond, it starts afresh. A question of speed and memory only."""

SAMPLE_PER_LANGUAGE = 4_000
"""About so many training texts of each language, chosen by a hash of the id."""

UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Code point -> is it a letter?"""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=bool)


@dataclass
class Encoder:
    """Texts to bundles. Built in the worker, so that nothing but the parameters is sent."""

    dimensions: int = DIMENSIONS
    gram: int = GRAM
    letters: np.ndarray = field(default_factory=_letters)
    place: dict = field(default_factory=dict)
    letter: dict = field(default_factory=dict)
    bank: np.ndarray | None = None

    def letter_vector(self, code: int) -> np.ndarray:
        if code not in self.letter:
            self.letter[code] = np.random.default_rng([SEED, code]).integers(0, 2, self.dimensions).astype(np.float32) * 2 - 1
        return self.letter[code]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of lower-cased letters, other characters being one blank, and how often each occurs."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(self.letters[codes], codes, 32).astype(np.uint64)
        codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        n = len(codes) - self.gram + 1
        if n <= 0 or len(codes) <= 2:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        key = np.zeros(n, dtype=np.uint64)
        for j in range(self.gram):
            key = key << np.uint64(21) | codes[j:j + n]
        return np.unique(key, return_counts=True)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """The bank's rows of these n-grams, made where they are missing."""
        place = self.place
        rows = [place.get(k, -1) for k in keys.tolist()]
        if -1 in rows:
            new = [k for k, r in zip(keys.tolist(), rows, strict=True) if r < 0]
            if len(place) + len(new) > KEPT_GRAMS:
                place.clear()
                new = keys.tolist()
            size = max(KEPT_GRAMS, len(new))
            if self.bank is None or len(self.bank) < size:
                self.bank = np.empty((size, self.dimensions), dtype=np.float32)
            for k in new:
                v = np.ones(self.dimensions, dtype=np.float32)
                for j in range(self.gram):
                    v = v * np.roll(self.letter_vector(k >> 21 * j & 0x1FFFFF), j)
                self.bank[len(place)] = v
                place[k] = len(place)
            rows = [place[k] for k in keys.tolist()]
        return self.bank[rows]

    def bundle(self, text: str) -> np.ndarray | None:
        """None without a letter."""
        keys, times = self.grams(text)
        total = None
        for at in range(0, len(keys), KEPT_GRAMS):
            part = times[at:at + KEPT_GRAMS].astype(np.float32) @ self.vectors(keys[at:at + KEPT_GRAMS])
            total = part if total is None else total + part
        return total


def train(docs: DataFrame, doc_id: str, text: str, lang: str, dimensions: int, gram: int, per_language: int) -> dict[str, np.ndarray]:
    """A unit prototype for each language of the rows that are not held out. What comes back is one vector per language."""
    rows = docs.select(F.col(doc_id).alias("_id"), utf8(text).alias("_text"), F.col(lang).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & ~held_out("_id") & (F.length("_text") > 0))
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("lang").alias("n")).collect()}
    if not total:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in total.items() for x in (k, per_language / n)])
    rows = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < 1_000_000 * F.element_at(share, F.col("lang")))
    encoders: list[Encoder] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not encoders:
            encoders.append(Encoder(dimensions, gram))
        sums: dict[str, np.ndarray] = {}
        for t, k in zip(batch.column("_text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            v = encoders[0].bundle(t.decode("utf-8", "replace"))
            if v is not None:
                sums[k] = sums.get(k, 0) + v / np.linalg.norm(v)
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype(float).tolist() for v in sums.values()], pa.list_(pa.float64()))],
                                          names=["lang", "sums"])

    sums = map_arrow(rows, run, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("at", "x"))
    found: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang", "at").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["lang"], np.zeros(dimensions, dtype=np.float32))[r["at"]] = r["x"]
    return {k: v / max(1e-9, np.linalg.norm(v)) for k, v in sorted(found.items())}


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *, dimensions: int = DIMENSIONS, gram: int = GRAM,
             per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; score is the cosine with the chosen prototype, at least 0.

    Null texts and texts without a letter are `und` with score 0, and so is everything if no row has a language. Equal cosines go
    to the language that sorts first. A null doc_id counts as held out. Repeated rows come back as often. Other columns are
    not read, and the languages of held-out rows never are.
    """
    prototypes = train(docs, doc_id, text, lang, dimensions, gram, per_language)
    names = list(prototypes)
    table_ = np.stack(list(prototypes.values())).astype(np.float32) if names else None
    encoders: list[Encoder] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not encoders:
            encoders.append(Encoder(dimensions, gram))
        said, scores = [], []
        for t in batch.column("_text").to_pylist():
            v = encoders[0].bundle(t.decode("utf-8", "replace")) if names else None
            size = 0.0 if v is None else float(np.linalg.norm(v))
            if not size:
                said.append(UNKNOWN)
                scores.append(0.0)
                continue
            cos = table_ @ v / size
            best = int(np.argmax(cos))
            said.append(names[best])
            scores.append(min(1.0, max(0.0, float(cos[best]))))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(said, pa.string()), pa.array(scores, pa.float64())],
                                          names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), utf8(text).alias("_text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
