"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and everything else counts as a blank; a text has blanks before and after it. Each run of 1 to 3
characters that holds a letter is hashed into a bucket; a table of smoothed log-probabilities (buckets x languages, 4 bytes each: 2 MB for 4
languages, 100 MB for 200) is broadcast, and batches of texts are scored by summing their buckets' entries in numpy.

Learning takes at most about `max_train` labelled rows, by a hash of their ids; repeated rows count each. A text that is
null or has no letter is `und` with score 0. If nothing can be learned (an empty table, no language), every text is
`und`; an empty table to judge gives no rows. Of languages with equal scores the first by name is taken. Repeated rows
get equal results, whatever the id, null too; other columns, whatever their names, are ignored or passed on. Long texts
are read whole, in slabs that look two characters ahead, so that no n-gram is lost or counted twice at a seam.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import sample_at_most, ship

BUCKET_BITS, ORDERS = 17, (1, 2, 3)
MAX_TRAIN, SLAB = 20_000, 1 << 20
AHEAD = max(ORDERS) - 1
#: Odd multipliers that spread the characters of an n-gram (any odd numbers do).
_MIX = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; built once a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _points(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all pieces in a row; letter marks; where each piece starts; the places that only look ahead."""
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    ends = np.cumsum([len(p) for p in pieces])
    return np.where(letter, points, np.uint32(32)), letter, np.r_[0, ends[:-1]], (ends[:, None] - 1 - np.arange(AHEAD)).ravel()


def _buckets(points: np.ndarray, letter: np.ndarray, order: int, ahead: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that starts at each position; 0, which counts nothing, where no letter is in it."""
    h, any_letter = points * _MIX[0], letter.copy()
    for k in range(1, order):
        h[:-k] = (h[:-k] ^ (h[:-k] >> np.uint32(15))) * _MIX[1] + points[k:] * _MIX[2]
        any_letter[:-k] |= letter[k:]
    h ^= h >> np.uint32(13)
    h *= _MIX[order - 1]
    out = (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    out[~any_letter] = 0
    out[ahead] = 0
    return out


def _slabs(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(owners, pieces) of bounded total length. Each piece ends in AHEAD characters that belong to the next, or blanks."""
    owners, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        t = f" {(t or '').lower()}"
        for at in range(0, len(t), SLAB):
            owners.append(i)
            pieces.append(t[at : at + SLAB + AHEAD].ljust(min(SLAB, len(t) - at) + AHEAD))
            size += len(pieces[-1])
            if size >= SLAB:
                yield owners, pieces
                owners, pieces, size = [], [], 0
    if pieces:
        yield owners, pieces


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prior: np.ndarray
    table: np.ndarray  # languages x buckets, float32

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sums, seen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for owners, pieces in _slabs(texts):
            points, letter, starts, ahead = _points(pieces)
            np.add.at(seen, owners, np.add.reduceat(letter, starts, dtype=np.int64))
            for order in ORDERS:
                b = _buckets(points, letter, order, ahead)
                for k, row in enumerate(self.table):
                    np.add.at(sums[:, k], owners, np.add.reduceat(row[b], starts, dtype=np.float64))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        logs = sums + self.prior
        best = logs.argmax(axis=1)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[k] if n else "und" for k, n in zip(best, seen)], np.where(seen > 0, score, 0.0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in batches:
        texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang in set(langs):
            own = [t for t, x in zip(texts, langs) if x == lang]
            docs[lang] = docs.get(lang, 0) + len(own)
            into = total.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            for _, pieces in _slabs(own):
                points, letter, _, ahead = _points(pieces)
                for order in ORDERS:
                    into += np.bincount(_buckets(points, letter, order, ahead), minlength=len(into))
    for lang, c in total.items():
        c[0] = 0
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[docs[lang], c[at]])], names=["lang", "bucket", "n"])


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> LanguageModel:
    """Learn from the rows of docs with text and lang. The driver gets at most one number for each bucket and language."""
    ship(docs.sparkSession)
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = sample_at_most(labelled, id_col, max_train).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counted["lang"].unique()))
    table = np.zeros((len(languages), 1 << BUCKET_BITS))
    prior = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        head = own["bucket"] < 0
        prior[k] = np.log(own["n"][head].sum() + 1)
        table[k, own["bucket"][~head]] = own["n"][~head]
    table = np.log(table + 0.5) - np.log((table + 0.5).sum(axis=1, keepdims=True))
    table[:, 0] = 0
    return LanguageModel(languages, prior, table.astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = sent.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows, with all their columns, whose text has a language the model knows, at a score of `least` or more."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = sent.value.score(b.column(at).to_pylist())
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
