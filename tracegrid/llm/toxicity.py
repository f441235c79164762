"""Toxicity by Levenshtein automata over a lexicon trie, with context windows that tell quotation from abuse.

The lexicon holds whole words and stems (a stem matches every word that begins with it). It starts from a fixed list
of insults and adds what labelled rows teach: words and stems that occur in toxic documents far more often than their
share would explain; words that resemble an entry but occur in clean rows are set down as ordinary. One lazily determinised automaton accepts every word within an entry's edit distance: its states
are sets of (trie node, edits) pairs, made when first met, so most words fail after a few characters. Each hit counts
by its distance and by its context: inside quotation marks, or near a word of reporting, it counts a quarter. The
document's score is a logistic function of its evidence, fitted to labelled rows.

Learning takes at most about `max_train` labelled rows by a hash of their ids, which bounds the terms that it can learn;
all that pass are kept. Without labels of both kinds fixed weights are used. Null and empty texts have no evidence and
get the score of a clean text. Repeated labels of a document: the largest counts. Labels without document or value are
ignored, as are other columns, whatever their names. Repeated rows get equal results, rows with a null doc_id are scored
like others; an empty table gives no rows. A word within reach of several entries counts by the fewest edits; terms are
taken in order of length and then of letters where one could stand for another. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import materialise, sample_at_most, ship

#: Insults to start from, in four languages.
LEXICON = (
    "abschaum arschloch asshole bastard bitch cabrón connard crétin degenerate disgusting dreckig dumbass dumm ekelhaft estúpido "
    "freak gilipollas idiot idiota idiote imbecile imbécil imbécile loser moron pathetic pendejo retard salaud scum "
    "scumbag stupid trottel vermin worthless wichser"
).split()
#: Words that report what someone else said.
REPORTING = (
    "said says called calls calling quote quoted quotes wrote reported alleged word term phrase sagte nannte schrieb wort zitat "
    "dit appelé écrit mot citation dijo llamó escribió palabra cita"
).split()
#: What opens a quotation, and what may close it.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‹": "›"}
WINDOW = 60  # characters to either side
QUOTED = 0.25  # what a quoted or reported hit counts
MAX_TRAIN, FEWEST = 20_000, 10
_TOKEN = re.compile(r"\w+(?:[*@$!]\w+)*")


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


@dataclass
class Automaton:
    """Words and stems ("stem*") of a lexicon, with the edits that each allows."""

    entries: tuple[str, ...]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, tuple[int, bool]] = field(default_factory=dict)  # trie node: (edits allowed, is a stem)

    def __post_init__(self) -> None:
        self.room = [0]  # the most edits that an entry below a node allows
        for entry in self.entries:
            stem, word, node = entry.endswith("*"), entry.rstrip("*"), 0
            allowed = 0 if stem else edits_allowed(len(word))
            self.room[0] = max(self.room[0], allowed)
            for ch in word:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.room.append(0)
                node = self.children[node][ch]
                self.room[node] = max(self.room[node], allowed)
            old = self.ends.get(node, (0, False))
            self.ends[node] = (max(old[0], allowed), old[1] or stem)
        self.forget()

    def forget(self) -> None:
        """Start again with no state but the first; what is met later is made anew."""
        start = self._closed({0: 0})
        self.states = [start]
        self.numbers = {tuple(sorted(start.items())): 0}
        self.steps: list[dict[str, int]] = [{}]
        self.accepts = [self._accept(start)]

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With characters of the lexicon left out; per node the fewest edits."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = nodes[node] + 1
                if e <= self.room[child] and e < nodes.get(child, 9):
                    nodes[child] = e
                    todo.append(child)
        return nodes

    def _accept(self, nodes: dict[int, int]) -> tuple[int, bool] | None:
        """(fewest edits, a stem is complete) of the entries that end here."""
        hits = [(e, self.ends[n][1]) for n, e in nodes.items() if n in self.ends and e <= self.ends[n][0]]
        return (min(e for e, _ in hits), any(s for _, s in hits)) if hits else None

    def _step(self, state: int, ch: str) -> int:
        """The state after one more character; -1 if nothing can match any more."""
        if ch in self.steps[state]:
            return self.steps[state][ch]
        out: dict[int, int] = {}
        for node, e in self.states[state].items():
            moves = [(node, e + 1)] + [(child, e + (c != ch)) for c, child in self.children[node].items()]
            for n, cost in moves:
                if cost <= self.room[n] and cost < out.get(n, 9):
                    out[n] = cost
        if not out:
            to = -1
        else:
            nodes = self._closed(out)
            key = tuple(sorted(nodes.items()))
            if key not in self.numbers:
                self.numbers[key] = len(self.states)
                self.states.append(nodes)
                self.steps.append({})
                self.accepts.append(self._accept(nodes))
            to = self.numbers[key]
        self.steps[state][ch] = to
        return to

    def distance(self, word: str) -> int | None:
        """The fewest edits to an entry, or None."""
        state = 0
        for ch in word:
            state = self._step(state, ch)
            if state < 0:
                return None
            if self.accepts[state] is not None and self.accepts[state][1]:
                return self.accepts[state][0]  # a stem is complete: whatever follows
        return None if self.accepts[state] is None else self.accepts[state][0]


#: Words, with their distance, and states of the automaton remembered by one worker.
REMEMBERED, STATES = 500_000, 100_000


@dataclass(frozen=True)
class ToxicityModel:
    entries: tuple[str, ...]
    ordinary: tuple[str, ...]
    weights: tuple[float, ...]  # bias, then one for each feature

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.clip(features @ np.array(self.weights[1:]) + self.weights[0], -30, 30)
        return 1 / (1 + np.exp(-z))


class Evidence:
    """Features of a text: evidence of exact hits, of misspelled hits, and of all hits by length."""

    def __init__(self, entries: tuple[str, ...], ordinary: tuple[str, ...] = ()):
        self.automaton, self.ordinary, self.known = Automaton(entries), frozenset(ordinary), {}

    def _lookup(self, words: set[str]) -> dict[str, int]:
        known, out = self.known, {}
        if len(known) > REMEMBERED:
            known.clear()
        if len(self.automaton.states) > STATES:
            self.automaton.forget()
        for w in words:
            d = known.get(w, -1)
            if d == -1:
                d = self.automaton.distance(w)
                d = known[w] = None if d and w in self.ordinary else d
            if d is not None:
                out[w] = d
        return out

    @staticmethod
    def quoted(text: str, start: int, end: int) -> bool:
        left, right = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
        for opening, closing in QUOTES.items():
            if opening == '"':
                if left.count('"') % 2 and '"' in right:
                    return True
            elif left.rfind(opening) > max(left.rfind(c) for c in closing) and any(c in right for c in closing):
                return True
        return not _REPORTED.isdisjoint(_TOKEN.findall(left))

    def features(self, text: str | None) -> tuple[float, float, float]:
        lower = (text or "").lower()
        words = _TOKEN.findall(lower)
        hits = self._lookup(set(words))
        if not hits:
            return 0.0, 0.0, 0.0
        exact = fuzzy = 0.0
        for m in _TOKEN.finditer(lower):
            d = hits.get(m[0])
            if d is not None:
                counts = QUOTED if self.quoted(lower, m.start(), m.end()) else 1.0
                if d:
                    fuzzy += counts / d
                else:
                    exact += counts
        return math.log1p(exact), math.log1p(fuzzy), math.log1p(100 * (exact + fuzzy) / len(words))


_REPORTED = frozenset(REPORTING)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    """(text, y) of a bounded sample, written once. At most about max_train ids are broadcast, so that no text is shuffled."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.max(F.col(label_col)) > 0).cast("int").alias("y"))
    chosen = sample_at_most(materialise(rows, "labels"), "__id", max_train)
    own = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    return materialise(own.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("text", "y"), "learning-rows")


STEMS = range(4, 7)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A word counts once a document; a stem once for each of the document's words that have it."""
    seen, toxic_docs = (Counter(), Counter()), Counter()
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = set(_TOKEN.findall((text or "").lower()))
            terms = Counter(words) + Counter(w[:k] + "*" for w in words for k in STEMS if len(w) > k)
            seen[y].update(terms)
            if y:
                toxic_docs.update(terms.keys())
    terms = list(seen[0].keys() | seen[1].keys())
    for at in range(0, len(terms), 50_000):
        part = terms[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[t] for t in part]) for c in (seen[1], seen[0], toxic_docs))], names=["term", "toxic", "clean", "docs"])


def _contexts(terms: frozenset[str]) -> Callable:
    """The words on either side of each occurrence of a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                words = ["", *_TOKEN.findall((text or "").lower()), ""]
                for left, w, right in zip(words, words[1:], words[2:]):
                    out += [(t, f"{left} {right}") for t in (w, *(w[:k] + "*" for k in STEMS if len(w) > k)) if t in terms]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([c for _, c in out], pa.string())], names=["term", "context"])

    return run


def learn_lexicon(rows: DataFrame, least: int = 3) -> list[str]:
    """Words and stems that mark the toxic ones among labelled rows (text, y); their number is bounded by these rows' words.

    A term is in `least` toxic rows or more, and so pure that a tenth of a term like it would be expected by chance."""
    n = rows.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    if not n["toxic"] or n["toxic"] == n["n"]:
        return []
    counted = rows.mapInArrow(_term_counts, "term string, toxic long, clean long, docs long").groupBy("term")
    totals = materialise(counted.agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "docs")]).where(F.col("docs") >= least), "terms")
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    surprise = F.col("toxic") * F.log(share / F.lit(n["toxic"] / n["n"]))
    needed = math.log(10 * max(1, totals.count()))
    pure = totals.where((share >= 0.95) & (surprise >= needed)).select("term", (surprise / F.col("toxic")).alias("each")).collect()
    each = {r["term"]: r["each"] for r in pure}
    around = rows.where("y = 1").mapInArrow(_contexts(frozenset(each)), "term string, context string").groupBy("term").agg(F.countDistinct("context").alias("n"))
    # copies of one toxic document bring a term again and again between the same words; only other places count
    places = {r["term"]: r["n"] for r in around.collect()}
    found = [t for t, k in places.items() if k >= least and k * each[t] >= needed]
    stems = sorted((t for t in found if t.endswith("*")), key=lambda t: (len(t), t))
    words = [t for t in found if not t.endswith("*")]
    kept: list[str] = []
    for s in stems:  # the shortest pure stem stands for the longer ones; one made up of a single word says no more than it
        if not any(s.startswith(k[:-1]) for k in kept):
            kept.append(s)
    spread = {s: [w for w in words if w.startswith(s[:-1])] for s in kept}
    kept = [s for s in kept if len(spread[s]) != 1]
    # as long a stem as loses next to none of its places
    kept = [max((t for t in stems if t.startswith(s[:-1]) and places[t] >= 0.95 * places[s]), key=len) for s in kept]
    return sorted({*kept, *words})  # words that a stem covers too: their misspellings may begin otherwise


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps. Fixed weights where a class has fewer than FEWEST rows."""
    if min((y > 0).sum(), (y <= 0).sum()) < FEWEST:
        return -2.0, 4.0, 3.0, 0.5
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)  # more evidence never makes a text less toxic
    w[2] = max(w[2], 0.5 * w[1])  # a sample without misspellings says nothing about them
    return tuple(w.tolist())


def _near_words(entries: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(entries)
        for b in batches:
            near = [(w, y) for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w, d in evidence._lookup(set(_TOKEN.findall((text or "").lower()))).items() if d]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in near], pa.string()), pa.array([y for _, y in near], pa.int32())], names=["word", "y"])

    return run


def ordinary_words(rows: DataFrame, entries: tuple[str, ...]) -> list[str]:
    """Words that resemble an entry but occur in clean documents as often as in toxic ones: no misspellings of it."""
    near = rows.mapInArrow(_near_words(entries), "word string, y int").groupBy("word").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    return sorted(r["word"] for r in near.where("2 * toxic <= n").select("word").collect())


def _features(entries: tuple[str, ...], ordinary: tuple[str, ...], keep: int) -> Callable:
    """keep: the column, besides the text, that is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(entries, ordinary)
        for b in batches:
            f = np.array([evidence.features(t) for t in b.column(1 - keep).to_pylist()], np.float64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(keep), *(pa.array(f[:, k]) for k in range(3))], names=[b.schema.names[keep], "f0", "f1", "f2"])

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> ToxicityModel:
    ship(docs.sparkSession)
    rows = _labelled(docs, labels, id_col, text_col, label_col, max_train)
    entries = tuple(sorted({*LEXICON, *learn_lexicon(rows)}))
    ordinary = tuple(ordinary_words(rows, entries))
    known = rows.mapInArrow(_features(entries, ordinary, 1), "y int, f0 double, f1 double, f2 double").toPandas()  # at most about max_train rows of 4 numbers
    return ToxicityModel(entries, ordinary, _fit(known[["f0", "f1", "f2"]].to_numpy(), known["y"].to_numpy(np.float64)))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_features(model.entries, model.ordinary, 0), f"doc_id {kind}, f0 double, f1 double, f2 double")
    z = F.lit(model.weights[0])
    for k, w in enumerate(model.weights[1:]):
        z = z + F.col(f"f{k}") * F.lit(w)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return rows.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
