"""Toxicity by a weighted finite-state grammar over clauses.

A clause is read as a string of word classes. Small machines follow it side by side: an insult machine and a threat machine,
which report a match, and a target, a negation and a reported-speech machine, which say in which context it stands. Their
product is one machine, composed once; the label on its match is the pattern, such as "insult, aimed, not negated, not
reported". A text's score is the logistic sum of its patterns' weights over matched clauses; a word outside a clause that the
grammar accepts counts for nothing. Which words are insults, and the weights, are learned from labelled rows; what they do not show
keeps the grammar's own values.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from pulsegrid.llm.common import held_out, map_arrow, neutral, table, utf8
from pulsegrid.sources.stage import materialise

# The word classes the grammar starts from, in English, German, French and Spanish.
WORDS = {
    "insult": "idiot idiots moron morons stupid pathetic worthless scum trash loser losers clown disgusting imbecile dumb "
              "idioten dummkopf abschaum versager imbécile crétin idiote minable imbécil estúpido idiota basura",
    "threat": "kill hurt destroy attack beat murder töten umbringen vernichten tuer frapper détruire matar golpear destruir",
    "target": "you your yours yourself du dich dir euch ihr tu toi vous votre tú te ti usted vosotros ustedes",
    "negation": "not never nor neither cannot nicht kein keine nie niemals ne pas jamais aucun no nunca jamás ningún",
    "report": "said says wrote reported quoted claimed sagte schrieb meldete behauptete dit écrit déclaré rapporté dijo escribió declaró",
}

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLASSES = {"insult": INSULT, "threat": THREAT, "target": TARGET, "negation": NEGATION, "report": REPORT}

REACH = {"target": 4, "negation": 3}
"""Words over which a target or a negation holds."""

PRIOR = {"bias": -4.0, "insult": 6.0, "threat": 2.0, "aimed": 1.0, "negated": -1.0, "reported": -1.0}
"""Log-odds before any label is seen."""

PRIOR_STRENGTH = 0.02
"""Weight of the squared distance from PRIOR, against the mean loss of a labelled text."""

SAMPLE = 20_000
"""About so many labelled texts are learned from, chosen by a hash of the id."""

PREFIXES = (4, 5, 6, 7, 8)
MIN_TEXTS = 3
MAX_CLEAN_SHARE = 0.04
MAX_WORDS = 300
"""Most learned words and word beginnings; the best come first."""

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,|\n]")
STOPS = frozenset(".!?;:,|\n")


# ------------------------------------------------------------------ the grammar
@dataclass(frozen=True)
class Machine:
    """state, class -> (state, label or None); missing arcs lead by `rest` from state to state."""

    start: int
    arcs: dict[tuple[int, int], tuple[int, str | None]]
    rest: dict[int, int]

    def step(self, state: int, cls: int) -> tuple[int, str | None]:
        return self.arcs.get((state, cls), (self.rest.get(state, state), None))

    def states(self) -> set[int]:
        return {self.start, *(s for s, _ in self.arcs), *(t for t, _ in self.arcs.values()), *self.rest, *self.rest.values()}


def matcher(cls: int, label: str) -> Machine:
    return Machine(0, {(0, cls): (0, label)}, {})


def context(cls: int, reach: int | None) -> Machine:
    """State > 0 while the context holds: `reach` words long, or to the clause's end."""
    on = reach or 1
    return Machine(0, {(s, cls): (on, None) for s in range(on + 1)}, {s: s - 1 for s in range(1, on + 1)} if reach else {})


def compose() -> tuple[dict[tuple[int, int], tuple[int, str | None]], int]:
    """The product machine: one table (state, class) -> (state, pattern), and its start.

    A pattern is read after the step of the contexts, so a target right before or a few words before the insult aims it. A
    target that follows is found by reading the clause backwards as well.
    """
    insult, threat = matcher(INSULT, "insult"), matcher(THREAT, "threat")
    target, negation, report = context(TARGET, REACH["target"]), context(NEGATION, REACH["negation"]), context(REPORT, None)
    states = {s: i for i, s in enumerate(sorted(product(target.states(), negation.states(), report.states())))}
    arcs = {}
    for (t, n, r), i in states.items():
        for cls in range(6):
            label = insult.step(0, cls)[1] or threat.step(0, cls)[1]
            to = (target.step(t, cls)[0], negation.step(n, cls)[0], report.step(r, cls)[0])
            pattern = label and "|".join([label, *(["aimed"] if t else []), *(["negated"] if n else []), *(["reported"] if r else [])])
            arcs[i, cls] = (states[to], pattern)
    return arcs, states[0, 0, 0]


ARCS, START = compose()


def patterns_of(classes: list[int]) -> list[str]:
    """Patterns matched in one clause. A threat counts only when it is aimed."""
    found, state = [], START
    for at, c in enumerate(classes):
        state, pattern = ARCS[state, c]
        if pattern:
            if "aimed" not in pattern and TARGET in classes[at + 1:at + 1 + REACH["target"]]:
                head, *rest = pattern.split("|")
                pattern = "|".join([head, "aimed", *rest])
            if not pattern.startswith("threat") or "aimed" in pattern:
                found.append(pattern)
    return found


@dataclass
class Grammar:
    words: dict[str, int]
    beginnings: frozenset[str] = frozenset()
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    kept: dict[str, int] = field(default_factory=dict)

    def class_of(self, word: str) -> int:
        c = self.kept.get(word)
        if c is None:
            c = self.words.get(word, OTHER)
            if c == OTHER and any(word[:n] in self.beginnings for n in PREFIXES):
                c = INSULT
            if len(self.kept) > 500_000:
                self.kept.clear()
            self.kept[word] = c
        return c

    def matches(self, text: str) -> Counter:
        """How many clauses match each pattern."""
        found: Counter = Counter()
        clause: list[int] = []
        hot = False
        for token in [*TOKEN.findall(text.lower()), "."]:
            if token in STOPS:
                if hot:
                    found.update(set(patterns_of(clause)))
                clause, hot = [], False
            else:
                c = self.class_of(token)
                clause.append(c)
                hot = hot or c in (INSULT, THREAT)
        return found

    def score(self, text: str) -> float:
        return self.score_of(self.matches(text))

    def score_of(self, matches: Counter) -> float:
        z = self.weights["bias"] + sum(self.weights[f] * x for f, x in features(matches).items())
        return float(1 / (1 + np.exp(-z)))


def features(matches: Counter) -> dict[str, float]:
    """Log of one plus the clauses with each trait."""
    n: dict[str, int] = defaultdict(int)
    for pattern, times in matches.items():
        for trait in pattern.split("|"):
            n[trait] += times
    return {k: float(np.log2(1 + v)) for k, v in n.items()}


def plain_grammar() -> Grammar:
    return Grammar({w: CLASSES[k] for k, ws in WORDS.items() for w in ws.split()})


# ------------------------------------------------------------------ learning
def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, sample: int) -> DataFrame:
    """(text, toxic) of a bounded sample of the labelled rows that are not held out; one row per text.

    A doc_id labelled twice is toxic if one label says so. The sampled ids, 16 bytes each, are few enough to send to every task.
    """
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = materialise(ids.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")), "toxic-labels")
    n = ids.count()
    chosen = ids.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n))))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), utf8(text).alias("_text")).join(F.broadcast(chosen), "_id")
    return materialise(rows.groupBy("_text").agg(F.max("toxic").alias("toxic")), "toxic-sample")


def candidate_words(sample: DataFrame) -> dict[str, tuple[int, int]]:
    """Words and beginnings ("word*") found in at least MIN_TEXTS toxic texts and hardly in others: (toxic, all) texts each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for t, y in zip(batch.column("_text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for f in word_features(t.decode("utf-8", "replace")):
                counts[f][0] += y
                counts[f][1] += 1
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))], names=["f", "pos", "n"])

    rows = map_arrow(sample, run, "f string, pos long, n long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    best = rows.where((F.col("pos") >= MIN_TEXTS) & (F.col("n") - F.col("pos") <= MAX_CLEAN_SHARE * F.col("n"))).orderBy(F.desc("pos"), "f").limit(20 * MAX_WORDS)
    return {r["f"]: (r["pos"], r["n"]) for r in best.collect()}


def word_features(text: str) -> set[str]:
    words = {w for w in TOKEN.findall(text.lower()) if w not in STOPS}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def chosen_words(sample: DataFrame, candidates: dict[str, tuple[int, int]]) -> list[str]:
    """Cover the toxic texts by as few candidates as possible: the one that explains most texts not yet explained comes next.
    Words that only came along in copies of a text explain nothing new and are left out."""
    if not candidates:
        return []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(word_features(t.decode("utf-8", "replace")) & candidates.keys()) for t in batch.column("_text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["found"])

    texts = [set(r["found"]) for r in map_arrow(sample.where("toxic = 1"), run, "found array<string>").collect()]
    holds: dict[str, set[int]] = defaultdict(set)
    for i, t in enumerate(texts):
        for f in t:
            holds[f].add(i)
    left, chosen = set(range(len(texts))), []
    least = max(MIN_TEXTS, len(texts) // 500)
    while len(chosen) < MAX_WORDS and holds:
        gains = {f: len(s & left) for f, s in holds.items()}
        f = max(gains, key=lambda f: (gains[f], not f.endswith("*"), len(f), f))
        if gains[f] < least:
            break
        chosen.append(f)
        left -= holds.pop(f)
        holds = {f: s for f, s in holds.items() if len(s & left) >= least}
    # synonyms: words as pure and as frequent as the cover's, that stand in most texts without each other
    common = np.median([candidates[f][0] for f in chosen]) if chosen else 0
    rest = [f for f, (pos, n) in candidates.items() if f not in chosen and not f.endswith("*") and pos >= max(least, 0.5 * common)]
    return chosen + rest[:MAX_WORDS - len(chosen)]


def fit_weights(grammar: Grammar, sample: DataFrame) -> dict[str, float]:
    """Logistic weights of the traits, drawn to PRIOR. Texts with the same matches come to the driver as one row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = ["\t".join(f"{k}={v:.6f}" for k, v in sorted(features(grammar.matches(t.decode("utf-8", "replace"))).items())) for t in batch.column("_text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(found), batch.column("toxic")], names=["x", "toxic"])

    rows = map_arrow(sample, run, "x string, toxic int").groupBy("x", "toxic").count().collect()
    names = [k for k in PRIOR if k != "bias"]
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for i, r in enumerate(rows):
        for part in r["x"].split("\t") if r["x"] else []:
            k, _, v = part.partition("=")
            x[i, 1 + names.index(k)] = float(v)
    y, n = np.array([r["toxic"] for r in rows], dtype=float), np.array([r["count"] for r in rows], dtype=float)
    prior = np.array([PRIOR["bias"], *(PRIOR[k] for k in names)])
    w = prior.copy()
    for _ in range(50 if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) / n.sum() + PRIOR_STRENGTH * (w - prior)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x / n.sum() + PRIOR_STRENGTH * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(["bias", *names], w.tolist(), strict=True))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Grammar:
    """The grammar with learned insults and weights; the plain grammar if nothing is labelled."""
    rows = labelled_sample(docs, labels, doc_id, text, sample)
    grammar = plain_grammar()
    for f in chosen_words(rows, candidate_words(rows)):
        if f.endswith("*"):
            grammar.beginnings = grammar.beginnings | {f[:-1]}
        else:
            grammar.words[f] = INSULT
    grammar.weights = fit_weights(grammar, rows)
    grammar.kept = {}
    return grammar


# ------------------------------------------------------------------ scoring
def with_scores(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """All columns of `docs`, `_score` from 0 to 1 and `_clauses`, the matched clauses. Null and empty texts match nothing and have the
    grammar's lowest score without a match. Texts of any length are read whole; repeated rows are scored each."""
    names = list(docs.columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [grammar.matches((t or b"").decode("utf-8", "replace")) for t in batch.column("_bytes").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array([grammar.score_of(m) for m in found], pa.float64()),
                                           pa.array([sum(m.values()) for m in found], pa.int32())], names=[*names, "_score", "_clauses"])

    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType()), StructField("_clauses", IntegerType())])
    plain = neutral(docs).withColumn("_bytes", F.col(f"c{names.index(text)}").cast("string").cast("binary"))
    return map_arrow(plain, run, schema, text="_bytes")


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, that score below `threshold`. Columns of any name are carried."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    scored = with_scores(plain, learn(docs.select(doc_id, text), labels, doc_id, text), f"c{names.index(text)}")
    return scored.where(F.col("_score") < threshold).drop("_score", "_clauses").toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_scores(docs, learn(docs, table(spark, sf_dir, "labels")))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("_score").alias("score"),
                       (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_clauses").alias("matched_clauses"))
