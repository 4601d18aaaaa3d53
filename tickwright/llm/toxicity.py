"""Toxicity: a lexicon learned from labels, matched with misspellings, and read in context.

Words are run through a Levenshtein automaton intersected with the lexicon's trie, made
deterministic as it is used: a state is the set of (trie node, edits) that a prefix can be in,
so most words die within a few letters.  Every match is scored by the window around it: other
matches nearby speak for abuse, quotation marks around it for quotation.  A logistic model
over these sums gives the score.

Learning takes a sample of at most ``MOST_LABELLED`` labelled rows, chosen by hash; scoring
covers every text.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.llm.bpe import Memory
from tickwright.llm.common import in_batches, remainder, stage, texts

MOST_LABELLED = 20_000
MOST_TERMS = 500
THRESHOLD = 0.3
#: Words on either side of a match that are its context.
WINDOW = 12
_WORD = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r'["“”„«»\n]')
#: Marks that close what a mark opens (fixed values).
_CLOSES = {'"': '"', "“": "”", "„": "“”", "«": "»"}
FEATURES = ("exact", "fuzzy", "quoted", "crowded", "terms")


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of the quotations, however long; none goes over a line's end.  One pass: a
    mark opens one unless it closes the one that is open."""
    spans, opened, closes = [], None, ""
    for mark in _MARK.finditer(text):
        if mark[0] == "\n":
            opened, closes = None, ""
        elif opened is not None and mark[0] in closes:
            if mark.start() > opened + 1:
                spans.append((opened, mark.end()))
            opened, closes = None, ""
        elif opened is None and mark[0] in _CLOSES:
            opened, closes = mark.start(), _CLOSES[mark[0]]
    return spans


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """All words within a term's allowed edits (insert, delete, replace a letter)."""

    def __init__(self, terms: list[str], edits=allowed_edits, most_steps: int = 300_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.reach = [0]  # most edits that a term below a node allows
        for term in terms:
            node, allowed = 0, edits(term)
            self.reach[0] = max(self.reach[0], allowed)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], allowed)
            self.term[node] = term
        self.edits, self.most_steps = edits, most_steps
        self.start = self._closed({(0, 0)} if terms else set())
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.accepts: dict[frozenset, tuple[str, int] | None] = {}

    def _closed(self, state: set[tuple[int, int]]) -> frozenset:
        """With letters of a term left out."""
        todo, best = list(state), {}
        while todo:
            node, used = todo.pop()
            if used > self.reach[node] or best.get(node, 99) <= used:
                continue
            best[node] = used
            todo += [(child, used + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _step(self, state: frozenset, letter: str) -> frozenset:
        after: set[tuple[int, int]] = set()
        for node, used in state:
            after.add((node, used + 1))
            for own, child in self.children[node].items():
                after.add((child, used + (own != letter)))
        return self._closed(after)

    def _accept(self, state: frozenset) -> tuple[str, int] | None:
        ends = [(used, self.term[node]) for node, used in state if self.term[node] and used <= self.edits(self.term[node])]
        return min(ends)[::-1] if ends else None

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance, the first by name of several; None beyond."""
        state, steps = self.start, self.steps
        for letter in word:
            after = steps.get((state, letter))
            if after is None:
                if len(steps) >= self.most_steps:
                    steps.clear()
                    self.accepts.clear()
                after = steps[(state, letter)] = self._step(state, letter)
            if not after:
                return None
            state = after
        if state not in self.accepts:
            self.accepts[state] = self._accept(state)
        return self.accepts[state]


@dataclass
class ToxicityModel:
    """Lexicon, terms that also match misspelled, and the weights of the features."""

    terms: list[str]
    fuzzy: set[str] = field(default_factory=set)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    bias: float = -20.0

    def __post_init__(self):
        self._memory: Memory | None = None

    def __getstate__(self):
        return self.__dict__ | {"_memory": None}

    def matches(self, text: str) -> list[tuple[int, str, int]]:
        """(word number, term, edits) of every matching word."""
        if self._memory is None:
            self._memory = Memory(LexiconAutomaton(self.terms).match)
        lowered = text.lower()
        words = _WORD.findall(lowered)
        found = {word: hit for word in set(words) if (hit := self._memory[word]) and (not hit[1] or hit[0] in self.fuzzy)}
        return [(at, *found[word]) for at, word in enumerate(words) if word in found] if found else []

    def features(self, text: str) -> np.ndarray:
        found = self.matches(text)
        if not found:
            return np.zeros(len(FEATURES))
        lowered = text.lower()
        starts = [m.start() for m in _WORD.finditer(lowered)]
        spans = quoted_spans(lowered)
        places = np.array([at for at, _, _ in found])
        sums = dict.fromkeys(FEATURES, 0.0)
        for at, _, edits in found:
            near = int(np.searchsorted(places, at + WINDOW, "right") - np.searchsorted(places, at - WINDOW, "left")) - 1
            last = bisect.bisect_right(spans, (starts[at], len(lowered) + 1)) - 1
            if last >= 0 and starts[at] < spans[last][1]:
                sums["quoted"] += 1
            else:
                sums["fuzzy" if edits else "exact"] += 1
                sums["crowded"] += near > 0
        sums["terms"] = len({term for _, term, _ in found})
        return np.log1p([sums[name] for name in FEATURES])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.features(text) @ self.weights, -30, 30))))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample; ids with several labels take the largest."""
    ids = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return texts(docs).join(F.broadcast(ids), "doc_id")  # at most ``most`` rows


def _sure(hits: Column, misses: Column) -> Column:
    """Lower end of the 95 % interval of a share (Wilson)."""
    n, z = hits + misses, 1.96
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def learn_terms(sample: DataFrame, most_terms: int = MOST_TERMS) -> list[str]:
    """Words that mark toxic documents: a line counts once however often it is copied, a term
    is in at least one in a hundred toxic documents (three at least) and mostly in those."""
    lines = (sample.select("doc_id", "toxic", F.explode(F.split(F.lower("text"), "\n")).alias("line"))
             .groupBy("line").agg(F.min(F.struct("doc_id", "toxic")).alias("first")))
    words = (lines.select("first.doc_id", "first.toxic", F.explode(F.regexp_extract_all("line", F.lit(r"(\p{L}{4,})"), F.lit(1))).alias("word"))
             .distinct().groupBy("word").agg(F.sum("toxic").alias("hits"), F.sum(1 - F.col("toxic")).alias("misses")))
    toxic = sample.agg(F.sum("toxic")).first()[0] or 0
    kept = words.filter((F.col("hits") >= max(3, toxic // 100)) & (_sure(F.col("hits"), F.col("misses")) >= 0.5))
    return sorted(row.word for row in kept.orderBy(F.desc("hits"), "word").limit(most_terms).collect())


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_terms: int = MOST_TERMS, ridge: float = 1.0) -> ToxicityModel:
    """Learn from the labelled rows given; the caller leaves out those that are held out.

    Without labelled rows nothing is learned and every score is near 0.
    """
    sample = stage(_labelled(docs, labels, most_labelled), "labelled")
    terms = learn_terms(sample, most_terms)
    if not terms:
        return ToxicityModel([])
    trial = ToxicityModel(terms, set(terms))

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hits = [sorted({term for _, term, edits in trial.matches(text) if edits}) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(hits, pa.list_(pa.string()))], names=["toxic", "hits"])

    misspelled = (in_batches(sample, read, "toxic int, hits array<string>").select("toxic", F.explode("hits").alias("term"))
                  .groupBy("term").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n")))
    doubtful = {row.term for row in misspelled.filter("2 * hits < n").collect()}  # at most one row per term
    model = ToxicityModel(terms, set(terms) - doubtful)

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [model.features(text).tolist() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    measured = in_batches(sample, measure, "toxic int, x array<double>").groupBy("toxic", "x").count().toArrow().to_pydict()
    x = np.array(measured["x"]).reshape(-1, len(FEATURES))
    y, n = np.array(measured["toxic"], dtype=float), np.array(measured["count"], dtype=float)
    model.weights, model.bias = _logistic(x, y, n, ridge)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method; the bias is not held back."""
    x = np.hstack([x, np.ones((len(x), 1))])
    hold = np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + hold * w
        curvature = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score_documents(df: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, terms) of every row; ``terms`` are the matched terms, once each.

    A null text counts as empty and scores the bias alone; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MOST_TERMS words and a few weights

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = shared.value
        rows = batch.column("text").to_pylist()
        scores = [own.score(text) for text in rows]
        terms = [",".join(sorted({term for _, term, _ in own.matches(text)})) for text in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(terms)],
            names=["doc_id", "score", "predicted", "terms"])

    return in_batches(texts(df), score, "doc_id long, score double, predicted int, terms string")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text is 2 modulo 4."""
    return remainder(doc_id, 4) == 2
