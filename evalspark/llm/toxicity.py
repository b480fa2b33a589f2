"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes (insult, threat, target, negation, report,
quote, clause end).  Five small transducers read the class sequence of a
clause and are composed into one table: insults carry learned weights, a
target before or after aims them (one named later is written back to them), a negation just before turns them down, a
verb of saying or a quotation marks them as reported, and a threat counts
only together with its target.  What is scored is the matched clauses: the
sums of weights of plain, aimed, negated, reported and threatening matches
and their density, through a logistic link.

The insult weights are lower confidence bounds of log odds per word, learned
from a bounded sample of labelled documents; the link is fitted on another
fold of the sample, drawn towards stated priors where the sample says nothing.

Defined results: a null or empty text, or one without a match, has the score
of the intercept; repeated rows score alike; only ``doc_id`` (passed through)
and ``text`` are read; without labels the priors alone decide.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import common, labelled

MIN_DOCS = 3                 # labelled documents that must hold a word before it counts
MIN_WEIGHT = 1.0
STEMS = (4, 6)               # lengths of word beginnings that are learned besides whole words
Z = 1.64                     # one-sided 95 % bound of the log odds

# Fixed word classes of the grammar.
THREATS = frozenset("kill hurt destroy beat shoot stab burn töten verletzen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours he she him her they them du dich euch ihr sie tu toi vous ils elle él ella ellos usted tú".split())
NEGATIONS = frozenset("not never no neither nor isn aren wasn nicht nie kein keine ne pas jamais nunca jamás tampoco".split())
REPORTS = frozenset("said says say called calls wrote quoted claimed sagte sagt schrieb dit écrit disait dijo dice escribió".split())

# Symbols that the transducers read and write.
OTHER, INSULT, THREAT, TARGET, NEG, REPORT, QUOTE, END = range(8)
PLAIN, AIMED, NEGATED, REPORTED, MENACE = "plain", "aimed", "negated", "reported", "menace"
BACK = "back"                # written at a target: the plain insults of the clause so far are aimed
KINDS = (PLAIN, AIMED, NEGATED, REPORTED, MENACE)
NEG_REACH = 3                # words after a negation that it still turns down

#: Prior mean of the link: intercept, one factor per kind, density.
PRIOR = np.array([-4.0, 0.5, 0.6, 0.1, 0.15, 0.5, 0.5])

_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\w+|[.!?;\n]|[\"“”„«»]")


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][symbol] = (next state, mark)``; a missing arc stays and marks nothing."""

    states: int
    arcs: dict[int, dict[int, tuple[int, str | None]]]

    def step(self, state: int, symbol: int) -> tuple[int, str | None]:
        return self.arcs.get(state, {}).get(symbol, (state, None))


def _target() -> Transducer:
    """State 1: a target was named in this clause; state 2: an insult was, but no target yet."""
    return Transducer(3, {
        0: {TARGET: (1, None), INSULT: (2, None)},
        1: {END: (0, None), INSULT: (1, AIMED)},
        2: {END: (0, None), TARGET: (1, BACK)},
    })


def _negation() -> Transducer:
    """States 1..NEG_REACH: words left in a negation's reach."""
    arcs: dict[int, dict[int, tuple[int, str | None]]] = {0: {NEG: (NEG_REACH, None)}}
    for left in range(1, NEG_REACH + 1):
        arcs[left] = {s: (left - 1, NEGATED if s in (INSULT, THREAT) else None) for s in (OTHER, INSULT, THREAT, TARGET, REPORT)}
        arcs[left] |= {NEG: (NEG_REACH, None), END: (0, None)}
    return Transducer(NEG_REACH + 1, arcs)


def _report() -> Transducer:
    """State 1: after a verb of saying, to the clause's end; state 2: inside a quotation."""
    marked = {INSULT: REPORTED, THREAT: REPORTED}
    return Transducer(3, {
        0: {REPORT: (1, None), QUOTE: (2, None)},
        1: {END: (0, None), QUOTE: (2, None)} | {s: (1, m) for s, m in marked.items()},
        2: {QUOTE: (0, None), END: (0, None)} | {s: (2, m) for s, m in marked.items()},
    })


def _threat() -> Transducer:
    """A threat and a target in one clause, in either order."""
    return Transducer(4, {
        0: {THREAT: (1, None), TARGET: (2, None)},
        1: {TARGET: (3, MENACE), END: (0, None)},
        2: {THREAT: (3, MENACE), END: (0, None)},
        3: {END: (0, None)},
    })


def _insult() -> Transducer:
    return Transducer(1, {0: {INSULT: (0, PLAIN)}})


@dataclass(frozen=True)
class Grammar:
    """The composition of transducers: one state per reachable tuple of their states."""

    #: By state and symbol: the next state, the mark, and whether the symbol aims the clause so far.
    table: dict[tuple[int, int], tuple[int, str | None, bool]]

    @staticmethod
    def compose(*parts: Transducer) -> Grammar:
        number = {t: i for i, t in enumerate(product(*[range(p.states) for p in parts]))}
        rank = {REPORTED: 4, NEGATED: 3, MENACE: 2, AIMED: 1, PLAIN: 0, None: -1}
        table = {}
        for states, i in number.items():
            for symbol in range(8):
                # Each transducer reads what those before it wrote: a negated or reported threat is no threat any more.
                read, moves = symbol, []
                for p, s in zip(parts, states, strict=True):
                    moves.append(p.step(s, read))
                    if symbol == THREAT and moves[-1][1]:
                        read = OTHER
                marks = {m for _, m in moves}
                back = BACK in marks
                marks = marks - {BACK} or {None}
                if symbol == THREAT and MENACE not in marks:
                    marks = {None}
                table[i, symbol] = number[tuple(n for n, _ in moves)], max(marks, key=rank.__getitem__), back
        return Grammar(table)


GRAMMAR = Grammar.compose(_target(), _negation(), _report(), _threat(), _insult())


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    link: tuple[float, ...] = tuple(PRIOR)
    words: frozenset[str] = field(default=frozenset(), compare=False)
    stems: tuple[tuple[int, frozenset[str]], ...] = field(default=(), compare=False)

    def __post_init__(self):
        object.__setattr__(self, "words", frozenset(w for w in self.weights if w[-1] != "*") | THREATS)
        stems = [(n, frozenset(w[:-1] for w in self.weights if w[-1] == "*" and len(w) == n + 1)) for n in STEMS]
        object.__setattr__(self, "stems", tuple((n, s) for n, s in stems if s))

    def touches(self, words: list[str]) -> bool:
        """Whether any word could match at all."""
        return not self.words.isdisjoint(words) or any(not s.isdisjoint([w[:n] for w in words]) for n, s in self.stems)

    def weight(self, word: str) -> float | None:
        """The weight of the word or of the heaviest stem of it."""
        found = [self.weights[t] for t in (word, *(word[:n] + "*" for n in STEMS if len(word) > n)) if t in self.weights]
        return max(found) if found else None


def matches(text: str, model: Model) -> list[tuple[str, float]]:
    """Kind and weight of every match, clause by clause."""
    found: list[tuple[str, float]] = []
    state, clause = 0, 0                                   # the grammar's state; the first match of the clause
    for token in _TOKEN.findall(text.lower()):
        weight = model.weight(token)
        if weight is not None:
            symbol = INSULT
        elif token in ".!?;\n":
            symbol = END
        elif token in "\"“”„«»":
            symbol = QUOTE
        elif token in THREATS:
            symbol = THREAT
        elif token in TARGETS:
            symbol = TARGET
        elif token in NEGATIONS:
            symbol = NEG
        elif token in REPORTS:
            symbol = REPORT
        else:
            symbol = OTHER
        state, mark, back = GRAMMAR.table[state, symbol]
        if back:
            found[clause:] = [(AIMED if kind == PLAIN else kind, w) for kind, w in found[clause:]]
        if mark:
            found.append((mark, 5.0 if weight is None else weight))
        if symbol == END:
            clause = len(found)
    return found


def features(text: str | None, model: Model) -> np.ndarray:
    """1, log of the weight sums per kind, and the weight per square root of words."""
    out = np.zeros(len(KINDS) + 2)
    out[0] = 1.0
    words = _WORD.findall(text.lower()) if text else []
    if model.touches(words):
        for kind, weight in matches(text, model):
            out[1 + KINDS.index(kind)] += weight
        total = out[1] + out[2] + out[5] + 0.2 * (out[3] + out[4])
        out[1:6] = np.log1p(out[1:6])
        out[6] = total / math.sqrt(len(words))
    return out


def fit_link(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, pull: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic link by Newton steps, with a normal prior of precision ``pull``."""
    beta = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + pull * (beta - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _log_odds(a, b, toxic: float, clean: float, log, sqrt):
    """Lower confidence bound of the log odds, on columns or on numbers."""
    return (log((a + 0.5) / (toxic + 1.0)) - log((b + 0.5) / (clean + 1.0))
            - Z * sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))


def learn_weights(rows: DataFrame) -> dict[str, float]:
    """Words and stems (``stem*``) whose log odds of a toxic document are surely above ``MIN_WEIGHT``.

    Copies of one toxic document would make any of its words look toxic; so a
    term counts only as often as it follows different words in toxic documents.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    stems = [F.transform(F.filter("words", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*")))
             for n in STEMS]
    terms = rows.select("label", F.array_distinct(words).alias("words")).select(
        "label", F.explode(F.array_distinct(F.concat("words", *stems))).alias("term"))
    counts = terms.groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).filter(F.col("a") >= MIN_DOCS)
    totals = rows.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    if not totals["toxic"]:
        return {}
    toxic, clean = float(totals["toxic"]), float(totals["clean"])
    odds = _log_odds(F.col("a"), F.col("b"), toxic, clean, F.log, F.sqrt)
    likely = counts.withColumn("weight", odds).filter(F.col("weight") >= MIN_WEIGHT)
    likely = {r["term"]: (r["a"], r["b"]) for r in likely.collect()}      # words of the bounded sample
    if not likely:
        return {}

    def follows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for text in batch.column(0).to_pylist():
                tokens = _WORD.findall(text.lower())
                for before, word in zip(["", *tokens], tokens, strict=False):
                    pairs.update((t, before) for t in (word, *(word[:n] + "*" for n in STEMS)) if t in likely)
            term, before = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(before, pa.string())], ["term", "before"])

    seen = rows.filter("label = 1").select("text").mapInArrow(follows, "term string, before string").distinct()
    settings = {r["term"]: r["n"] for r in seen.groupBy("term").agg(F.count("*").alias("n")).collect()}
    weights = {t: _log_odds(min(a, settings[t]), b, toxic, clean, math.log, math.sqrt)
               for t, (a, b) in likely.items() if settings.get(t, 0) >= MIN_DOCS}
    return {t: w for t, w in weights.items() if w >= MIN_WEIGHT}


def fit(docs: DataFrame, labels: DataFrame, rows: int = labelled.SAMPLE_ROWS) -> Model:
    """Words from two thirds of the sample, link from the rest, so that the link sees the words' real worth."""
    chosen = common.staged(labelled.sample(docs, labels, "toxic", rows), "toxic-sample")
    model = Model(learn_weights(chosen.filter("fold > 0")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, model).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    seen = chosen.filter("fold = 0").select("text", "label").mapInArrow(run, "label int, x array<double>").collect()
    if not seen:
        return model
    beta = fit_link(np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen], float))
    return Model(model.weights, tuple(beta.tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` per row; only ``text`` decides."""
    slim = docs.select("doc_id", "text")
    id_type = slim.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)      # words of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        beta = np.array(m.link)
        for batch in batches:
            for part in common.slices(batch):
                x = np.array([features(t, m) for t in part.column(1).to_pylist()]).reshape(-1, len(beta))
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return slim.mapInArrow(common.releasing(run), f"doc_id {id_type}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    names = docs.columns
    text = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        beta = np.array(m.link)
        limit = math.log(threshold / (1 - threshold))
        for batch in batches:
            stay = [float(features(t, m) @ beta) < limit for part in common.slices(batch) for t in part.column(text).to_pylist()]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(common.releasing(run), docs.schema)
