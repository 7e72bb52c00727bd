"""Toxicity by a lexicon trie intersected with Levenshtein automata, and context windows around its hits.

The lexicon is learned: words far commoner in toxic than in clean documents that stand among many different
neighbours (so the other words of copied documents don't enter). The trie of its terms is intersected with the
Levenshtein automaton of each term's edits; the product is made deterministic state by state as words ask for it, so a
word is matched against all terms and their misspellings in one walk that mostly dies within a few letters. A hit's
worth is its term's log odds, less for edits; the window around it lowers it within a quotation or a report of
speech and raises it in address. The sum over the whole text is calibrated by a logistic curve.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.llm.common import column_of, small_batches, text_batches, texts_of
from gablework.llm.labelled import fold, labelled_sample

_TOKEN = re.compile(r"\w+(?:[@$*!]\w+)*")
_QUOTE = re.compile("[\"“”„«»]")
#: What ends a quotation that a mark opens.
_ENDS = {'"': '"', "“": "”", "„": "“”", "«": "»"}
#: Words of reported speech, and of address.
_REPORTS = frozenset("said says called calls wrote quote quoted word words term sagte nannte schrieb wort dijo llamó escribió palabra dit appelé écrit mot".split())
_ADDRESS = frozenset("you your youre du dein ihr tú eres usted tu vous es".split())


@dataclass(frozen=True)
class Settings:
    """sample: labelled documents that are learned from, at most. terms: of the lexicon at most, the most telling. least_docs, least_share, least_contexts, least_odds: what a word needs to enter (toxic documents, their share, different words before it, log odds). least_near: log odds from which a misspelled form that clean documents have counts. least_clean: clean documents from which a form is held to that. near: a misspelled hit's share of its term's worth. threshold: score from which a document is rejected. window: words to either side of a hit. quoted, reported, addressed: factors of a hit's worth. held_out: the fold (modulus, remainder) never learned from."""

    sample: int = 20_000
    terms: int = 2_000
    least_docs: int = 3
    least_contexts: int = 3
    least_odds: float = 2.5
    least_share: float = 0.01
    least_near: float = 1.0
    least_clean: int = 2
    near: float = 0.25
    threshold: float = 0.7
    window: int = 6
    quoted: float = 0.35
    reported: float = 0.6
    addressed: float = 1.25
    held_out: tuple[int, int] = (3, 1)


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of the text's quotations, marks included, of any length within a line; in order, none within another. A mark opens one if a mark that ends it follows in the line, but not at once."""
    out, at = [], 0
    for line in text.split("\n"):
        marks = [(m.start(), m[0]) for m in _QUOTE.finditer(line)] if any(map(line.__contains__, _ENDS)) else []
        after, ends = {}, [None] * len(marks)  # of each mark the next one that ends it
        for i in range(len(marks) - 1, -1, -1):
            ends[i] = min((after[e] for e in _ENDS.get(marks[i][1], "") if e in after), default=None)
            after[marks[i][1]] = i
        i = 0
        while i < len(marks):
            if (j := ends[i]) is not None and marks[j][0] > marks[i][0] + 1:
                out.append((at + marks[i][0], at + marks[j][0] + 1))
                i = j
            i += 1
        at += len(line) + 1
    return out


def edits_of(term: str) -> int:
    """Edits that still count as the term: none up to four letters, one up to eight, two beyond."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """match(word): the (edits, term) with the fewest edits, ties to the first term by code point; or None."""

    #: States that are kept; beyond, they are made anew.
    STATES = 100_000

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]
        for t in sorted(set(terms)):
            node = 0
            self.most[0] = max(self.most[0], edits_of(t))
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits_of(t))
            self.term[node] = t
        self._reset()

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """The number of the state with these edits at these trie nodes, letters that the word leaves out included."""
        todo = list(least)
        while todo:
            node = todo.pop()
            e = least[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < least.get(child, 99):
                    least[child] = e
                    todo.append(child)
        key = frozenset(least.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] is not None and e <= edits_of(self.term[n])]
            self.accepts.append(min(ends, default=None))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e + 1 <= self.most[node] and e + 1 < least.get(node, 99):
                least[node] = e + 1  # a letter too many
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < least.get(child, 99):
                    least[child] = cost
        to = self.steps[state][c] = self._state(least)
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        if len(self.sets) > self.STATES:
            self._reset()
        state, steps = self.start, self.steps
        for c in word:
            state = steps[state].get(c, -1) if c in steps[state] else self._step(state, c)
            if state == self.dead:
                return None
        return self.accepts[state]


@dataclass
class Model:
    """terms: the worth of each term's exact hits and of its misspelled ones. innocent: words near a term that clean documents use; they don't count. bias, slope: of the calibration over log(1 + evidence)."""

    terms: dict[str, tuple[float, float]]
    bias: float
    slope: float
    settings: Settings
    innocent: frozenset[str] = frozenset()
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": {}}

    def hits(self, text: str) -> list[tuple[str, int, float, int, int]]:
        """(term, edits, context factor, start, end) of each hit, in order."""
        if "automaton" not in self._made:
            self._made |= {"automaton": LexiconAutomaton(list(self.terms)), "known": {}, "hit": {}}
        automaton, known, hit = self._made["automaton"], self._made["known"], self._made["hit"]
        if not self.terms:
            return []
        words = _TOKEN.findall(text.lower())
        seen = set(words)
        if len(known) > 300_000:
            known.clear()
        for w in seen.difference(known):
            known[w] = True
            if (found := automaton.match(w)) and not (found[0] and w in self.innocent):
                hit[w] = found
        if hit.keys().isdisjoint(seen):
            return []
        lowered = text.lower()
        places = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(lowered)]
        quotes = quotations(lowered)
        starts = [x for x, _ in quotes]
        out, reach, s = [], self.settings.window, self.settings
        for i, (w, a, b) in enumerate(places):
            if w in hit:
                factor = 1.0
                q = bisect(starts, a) - 1
                if q >= 0 and b < quotes[q][1]:
                    factor *= s.quoted
                if any(p[0] in _REPORTS for p in places[max(0, i - reach) : i]):
                    factor *= s.reported
                if any(p[0] in _ADDRESS for p in places[max(0, i - reach) : i + reach + 1]):
                    factor *= s.addressed
                out.append((hit[w][1], hit[w][0], factor, a, b))
        return out

    def evidence(self, hits: list[tuple[str, int, float, int, int]]) -> float:
        """The worth of the terms hit: of each its best hit, and a quarter more for each of up to two more hits."""
        best: dict[str, list[float]] = {}
        for t, e, f, _, _ in hits:
            best.setdefault(t, []).append(self.terms[t][1 if e else 0] * (0.8 ** max(0, e - 1)) * f)
        return sum(max(v) * (1 + 0.25 * min(2, len(v) - 1)) for v in best.values())

    def score(self, text: str) -> float:
        z = self.bias + self.slope * math.log1p(self.evidence(self.hits(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _toxic_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents, some contexts) of the toxic documents of a partition."""
    docs, contexts = Counter(), defaultdict(set)
    for batch in text_batches(rows):
        for text in texts_of(batch):
            words = _TOKEN.findall(text.lower())
            docs.update(set(words))
            for left, w in zip(["", *words], words, strict=False):
                if len(contexts[w]) < 16:
                    contexts[w].add(left)
    if docs:
        words = sorted(docs)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([docs[w] for w in words], type=pa.int64()), pa.array([sorted(contexts[w]) for w in words], type=pa.list_(pa.string()))], names=["word", "n", "contexts"])


def _counted(words: frozenset[str]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = Counter()
        for batch in text_batches(rows):
            for text in texts_of(batch):
                docs.update(words.intersection(_TOKEN.findall(text.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), type=pa.string()), pa.array(list(docs.values()), type=pa.int64())], names=["word", "n"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """bias, slope of y over x; held near a curve that rises through the middle by a light prior."""
    w = np.zeros(2)
    design = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2), design.T @ (y - p) - 0.5 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(0.0, w[1]))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from the labelled documents outside the held-out fold, by no other input than their texts. With no toxic or no clean ones every score is 0.5 or less. Of rows that repeat an id the first text by order is learned from; null texts count as empty."""
    modulus, out = settings.held_out
    sample = labelled_sample(docs, labels, "toxic", fold(modulus) != out, settings.sample)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model({}, -3.0, 1.0, settings)
    toxic = sample.where("y = 1").select("text").mapInArrow(_toxic_words, "word string, n long, contexts array<string>")
    met = toxic.groupBy("word").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("contexts"))
    met = met.where((F.col("n") >= max(settings.least_docs, settings.least_share * n1)) & (F.col("contexts") >= settings.least_contexts) & (F.length("word") >= 3))
    # each word holds least_share of the sample's toxic documents at least, so they are few whatever the sample
    in_toxic = {r["word"]: (r["n"], r["contexts"]) for r in met.collect()}
    clean = sample.where("y = 0").select("text").mapInArrow(_counted(frozenset(in_toxic)), "word string, n long")
    in_clean = {r["word"]: r["n"] for r in clean.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    odds = {}
    for w, (n, contexts) in in_toxic.items():
        v = math.log((n + 0.5) / (n1 + 1)) - math.log((in_clean.get(w, 0) + 0.5) / (n0 + 1))
        if v >= settings.least_odds and contexts >= min(12, max(settings.least_contexts, 0.4 * n)):
            odds[w] = min(8.0, v)
    best = sorted(odds, key=lambda w: (-odds[w] * math.log1p(in_toxic[w][0]), w))[: settings.terms]
    model = Model({w: (odds[w], settings.near * odds[w]) for w in best}, 0.0, 1.0, settings)

    def misspelled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = {0: Counter(), 1: Counter()}
        for batch in text_batches(rows):
            for y, text in zip(column_of(batch, "y").to_pylist(), texts_of(batch), strict=True):
                lowered = text.lower()
                docs[y].update({lowered[a:b] for _, e, _, a, b in model.hits(text) if e})
        words = sorted(docs[0].keys() | docs[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), *(pa.array([docs[y][w] for w in words], type=pa.int64()) for y in (0, 1))], names=["word", "n0", "n1"])

    # a form that clean documents use is a word of its own unless toxic ones use it far more; all others are worth a fixed share
    forms = sample.select("y", "text").mapInArrow(misspelled, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    common = forms.where(F.col("n0") >= settings.least_clean)
    told = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    model.innocent = frozenset(r["word"] for r in common.where(told < settings.least_near).select("word").collect())
    model._made.clear()

    def found(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(rows):
            hits = [model.hits(t) for t in texts_of(batch)]
            kind = pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("factor", pa.float64())]))
            yield pa.RecordBatch.from_arrays([column_of(batch, "y"), pa.array([[{"term": t, "edits": e, "factor": f} for t, e, f, _, _ in h] for h in hits], type=kind)], names=["y", "hits"])

    seen = sample.select("y", "text").mapInArrow(found, "y int, hits array<struct<term string, edits int, factor double>>")
    rows = [(r["y"], [(h["term"], h["edits"], h["factor"], 0, 0) for h in r["hits"]]) for r in seen.where(F.size("hits") > 0).collect()]
    x = np.array([math.log1p(model.evidence(h)) for _, h in rows] + [0.0] * (n1 + n0 - len(rows)))
    plain = n1 - sum(y for y, _ in rows)
    y = np.array([y for y, _ in rows] + [1] * plain + [0] * (n1 + n0 - len(rows) - plain), dtype=float)
    model.bias, model.slope = _logistic(x, y)
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs.

    score: 0 to 1, of the whole text; null and empty texts get the score of no evidence. held_out: whether the id is in
    the fold that is never learned from (a null id isn't). Null and repeated ids come out as they came in; an empty
    table gives no rows; other columns aren't read.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(rows):
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array([model.score(t) for t in texts_of(batch)], type=pa.float64())], names=["doc_id", "score"])

    modulus, out = model.settings.held_out
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(modulus) == out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= model.settings.threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns as they were. Null and empty texts are clean; null and repeated ids stay as they are; an empty table gives no rows."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(rows):
            yield batch.filter(pa.array([model.score(t) < model.settings.threshold for t in texts_of(batch)]))

    return small_batches(docs).mapInArrow(run, docs.schema)
