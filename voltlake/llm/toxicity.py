"""Toxicity scores from a weighted finite-state pattern grammar.

A lexical transducer turns words into classes: insult, threat, target, negation, reported
speech. Five small transducers read a clause's classes and mark what they match; their
composition is one machine whose final marks name the clause's pattern (an insult, an insult at
a target, a negated or reported one, a threat at a target ...). An arc that sets a mark carries the
prior log-odds of the mark, a final state the learned correction of its pattern, so the weight of a clause's path is its score:
clauses are scored by pattern, never words alone, and a text by the noisy-or of its clauses.

Learned from a bounded sample of labelled rows: the insult entries (whole words or stems that a
greedy cover of the toxic texts needs and clean texts lack) and each pattern's weight, shrunk
towards the prior of its parts. Labels, language, source and id are inputs of learning only.

Edge cases: null and empty texts, and texts without a matched clause, get the base score; with no
labelled rows the built-in entries and prior weights stand; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm import scratch

WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:,\n]")

#: Seed words of the grammar's closed classes.
THREAT = ["kill", "hurt", "destroy", "burn", "shoot", "stab", "töten", "tuer", "matar"]
TARGET = ["you", "your", "yours", "they", "them", "he", "she", "people", "du", "dich", "sie", "ihr", "vous", "toi", "tu", "usted", "ustedes"]
NEGATION = ["not", "no", "never", "none", "without", "nicht", "kein", "nie", "pas", "jamais", "nunca", "sin"]
REPORTED = ["said", "says", "claimed", "wrote", "quoted", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"]

CLASSES = ("insult", "threat", "target", "negation", "reported")


#: Prior log-odds of a clause by its marks; learned weights are shrunk towards them.
PRIOR = {"insult": 3.0, "threat": 0.5, "target": 0.5, "negation": -1.0, "reported": -1.5}
BASE = -4.0


@dataclass
class Transducer:
    """Deterministic weighted transducer over word classes; a missing arc loops in place."""

    start: int
    arcs: dict[tuple[int, str], tuple[int, float]]
    marks: dict[int, tuple[str, ...]]
    finals: dict[int, float] = field(default_factory=dict)

    def run(self, symbols) -> tuple[tuple[str, ...], float]:
        state, weight = self.start, 0.0
        for s in symbols:
            state, w = self.arcs.get((state, s), (state, 0.0))
            weight += w
        return self.marks.get(state, ()), weight + self.finals.get(state, 0.0)


def detector(symbol: str) -> Transducer:
    """Marks a clause that holds a class."""
    return Transducer(0, {(0, symbol): (1, PRIOR[symbol])}, {1: (symbol,)})


def before(first: str, then: tuple[str, ...]) -> Transducer:
    """Marks a clause where a class comes before one of others."""
    return Transducer(0, {(0, first): (1, 0.0)} | {(1, s): (2, PRIOR[first]) for s in then}, {2: (first,)})


def compose(a: Transducer, b: Transducer, alphabet=CLASSES) -> Transducer:
    """The machine that runs both at once: states are pairs, marks unite, weights add."""
    ids, arcs, marks, finals = {(a.start, b.start): 0}, {}, {}, {}
    todo = [(a.start, b.start)]
    while todo:
        p, q = pair = todo.pop()
        here = ids[pair]
        marks[here] = tuple(dict.fromkeys(a.marks.get(p, ()) + b.marks.get(q, ())))
        finals[here] = a.finals.get(p, 0.0) + b.finals.get(q, 0.0)
        for s in alphabet:
            (p2, v), (q2, w) = a.arcs.get((p, s), (p, 0.0)), b.arcs.get((q, s), (q, 0.0))
            if (p2, q2) not in ids:
                ids[p2, q2] = len(ids)
                todo.append((p2, q2))
            arcs[here, s] = (ids[p2, q2], v + w)
    return Transducer(0, arcs, marks, finals)


def grammar() -> Transducer:
    machine = detector("insult")
    for part in (detector("threat"), detector("target"), before("negation", ("insult", "threat")), before("reported", ("insult", "threat"))):
        machine = compose(machine, part)
    return machine


def prior(marks: tuple[str, ...]) -> float:
    hard = [m for m in marks if m in ("insult", "threat")]
    if not hard or hard == ["threat"] and "target" not in marks:
        return BASE
    return sum(PRIOR[m] for m in marks)


@dataclass
class Model:
    words: dict[str, str]
    stems: tuple[str, ...]
    weights: dict[tuple[str, ...], float]

    def __post_init__(self):
        self.machine = grammar()
        for state, marks in self.machine.marks.items():
            self.machine.finals[state] = self.weights.get(marks, prior(marks)) - sum(PRIOR[m] for m in marks)
        insults = [w for w, c in self.words.items() if c == "insult"] + list(self.stems)
        hard = insults + [w for w, c in self.words.items() if c == "threat"]
        self.hard = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, sorted(hard, key=len, reverse=True)))})") if hard else None
        self.starts = tuple(self.stems)

    def symbol(self, word: str) -> str | None:
        return self.words.get(word) or ("insult" if self.starts and word.startswith(self.starts) else None)

    def clauses(self, text: str):
        """(start, end, marks, weight) of each clause that holds an insult or a threat."""
        low, at = text.lower(), 0
        while self.hard and (m := self.hard.search(low, at)):
            left = max((low.rfind(c, at, m.start()) for c in ".!?;:,\n"), default=-1)
            left = max(left + 1, at)
            e = CLAUSE_END.search(low, m.end())
            right = e.start() if e else len(low)
            symbols = [s for w in WORD.findall(low, left, right) if (s := self.symbol(w))]
            marks, weight = self.machine.run(symbols)
            if "insult" in marks or "threat" in marks:
                yield left, right, marks, weight
            at = max(right, m.end())

    def score(self, text: str | None) -> float:
        clean = 1 - 1 / (1 + math.exp(-BASE))
        for *_, weight in self.clauses(text or ""):
            clean *= 1 / (1 + math.exp(weight))
        return 1 - clean


def closed_words() -> dict[str, str]:
    out = {}
    for words, kind in ((THREAT, "threat"), (TARGET, "target"), (NEGATION, "negation"), (REPORTED, "reported")):
        out |= dict.fromkeys(words, kind)
    return out


def features(text: str, least: int = 4, most: int = 7) -> set[str]:
    """Words of a text and their stems (marked by a final hyphen)."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in range(least, min(most, len(w)) + 1)}


def cover(toxic: list[set[str]], clean: Counter, n_clean: int, support: int = 4, rate: float = 0.001, times: int = 5) -> list[str]:
    """Greedy cover of the toxic texts by features that clean texts (almost) lack: a first pass until
    every text that can be is covered once, a second one with features of wide support until
    each is covered ``times`` over, so that rarer companions of the first are found too. A word or
    stem that a chosen stem begins adds nothing."""
    counts = Counter(f for t in toxic for f in t)
    least = max(support, len(toxic) // 250)
    good = {f for f, n in counts.items() if n >= least and clean[f] <= rate * n_clean}
    rows = [t & good for t in toxic]
    chosen: list[str] = []
    for need, floor in ((1, least), (times, max(least + 2, len(toxic) // 40))):
        missing = [need - sum(f in t for f in chosen) for t in toxic]
        while counts := Counter(f for t, n in zip(rows, missing, strict=True) if n > 0 for f in t):
            f = max(counts, key=lambda x: (counts[x] / (1 + clean[x]), -len(x), x))
            if counts[f] < floor:
                break
            chosen.append(f)
            stem = f[:-1] if f.endswith("-") else None
            for k, t in enumerate(rows):
                missing[k] -= f in t
                rows[k] = {g for g in t if g != f and not (stem and g.startswith(stem))}
    return chosen


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, toxic) rows; repeated texts count once."""
    rows = sorted({t or "": y for t, y in rows}.items())
    toxic = [features(t) for t, y in rows if y]
    clean = Counter(f for t, y in rows if not y for f in features(t))
    n_clean = sum(not y for _, y in rows)
    chosen = cover(toxic, clean, max(1, n_clean)) if toxic else []
    words = closed_words() | {f: "insult" for f in chosen if not f.endswith("-")}
    stems = tuple(f[:-1] for f in chosen if f.endswith("-"))
    model, weights = Model(words, stems, {}), {}
    seen: dict[tuple[str, ...], list[int]] = {}
    for t, y in rows:
        for marks in {m for *_, m, _ in model.clauses(t)}:
            seen.setdefault(marks, [0, 0])[y] += 1
    share = max(1, len(toxic)) / max(1, n_clean)
    for marks, (no, yes) in seen.items():
        p = 1 / (1 + math.exp(-prior(marks)))
        weights[marks] = math.log((yes + 4 * p) / share / (no + 4 * (1 - p)))
    return Model(words, stems, weights)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[str, int]]:
    """At most ``per_class`` toxic and twice as many clean labelled texts, chosen by hash on narrow columns."""
    rows = []
    for y, most in ((0, 2 * per_class), (1, per_class)):
        ids = labels.where(F.col(label) == y).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        rows += [(r["text"], y) for r in docs.join(F.broadcast(ids), "doc_id", "left_semi").where("text is not null").select("doc_id", "text").orderBy("doc_id").limit(2 * most).collect()]
    return rows


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Model:
    """Fit on the labelled rows that are not held out (crc32 of the id leaves 0 by 5)."""
    own = labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("toxic").isNotNull())
    return fit(sample(docs.select("doc_id", "text"), own, "toxic", per_class))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.stems, model.weights))

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.stems, model.weights))
    at = docs.columns.index("text")

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) < 0.5 for t in b.column(at)], pa.bool_()))
        scratch.tidy()

    return docs.mapInArrow(run, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    """Score every document; rows whose id's crc32 leaves 0 by 5 are held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs, train(docs, labels))
    return got.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
