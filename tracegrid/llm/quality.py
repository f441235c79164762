"""Quality by ridge regression on random Fourier features of document statistics, with isotonic calibration.

One pass over the texts makes a row of statistics for each document. Random Fourier features of the standardised
statistics approximate a Gaussian kernel; each partition sums its normal equations, the driver adds these sums (at
most `PARTS` matrices, whatever the input) and solves for the ridge weights. Half of the learning rows (by a hash of
their ids) fit the weights, the other half the isotonic map from raw scores to probabilities.

Learning takes at most about `max_train` labelled rows. Null and empty texts have statistics of zero and are scored
like any other. Without labels of both kinds every score is the share of label 1, or 0.5 without any. Repeated labels
of a document: the largest counts. A doc_id that comes with several texts teaches by the one with the least statistics,
in their order. Raw scores that tie are one knot of the isotonic map. Repeated rows get equal results, rows with a null
doc_id are scored like others; an empty table gives no rows; other columns, whatever their names, are ignored; texts are
read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import materialise, sample_at_most, ship

MAX_TRAIN, WAVES, PARTS, RIDGE, SEED = 100_000, 256, 8, 1.0, 7
STATS = (
    "log_bytes log_words word_length long_words upper digit punctuation mark pipe symbol space newline high "
    "distinct_words top_word repeated_lines repeated_pairs short_lines line_length ends"
).split()

#: Classes of ASCII bytes, by number in the order below; all bytes from 0x80 on are "high".
_CLASSES = ["lower", "upper", "digit", "punctuation", "mark", "pipe", "symbol", "space", "newline", "control", "high"]


def _class_table() -> np.ndarray:
    t = np.full(256, _CLASSES.index("symbol"), np.uint8)
    t[:32], t[128:] = _CLASSES.index("control"), _CLASSES.index("high")
    for chars, name in (("abcdefghijklmnopqrstuvwxyz", "lower"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), ("0123456789", "digit"), (".,;:'\"()-", "punctuation"), ("!?", "mark"), ("|", "pipe"), (" \t", "space"), ("\n\r", "newline")):
        t[list(chars.encode())] = _CLASSES.index(name)
    return t


_TABLE = _class_table()


def statistics(text: str | None) -> list[float]:
    """The numbers named in STATS."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATS)
    c = np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=len(_CLASSES)) / len(raw)
    share = dict(zip(_CLASSES, c.tolist()))
    words = raw.lower().split()
    n = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = len(raw) - raw.count(b" ") - raw.count(b"\n")
    k = max(1, len(lines))
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        letters / n,
        sum(len(w) > 15 for w in counts) / max(1, len(counts)),
        *(share[x] for x in ("upper", "digit", "punctuation", "mark", "pipe", "symbol", "space", "newline", "high")),
        len(counts) / n**0.8,
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / k,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        sum(len(x) < 20 for x in lines) / k,
        np.log1p(len(raw) / k),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / k,
    ]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = np.array([statistics(t) for t in b.column(1).to_pylist()], np.float64).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[:, k]) for k in range(len(STATS)))], names=["doc_id", *STATS])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_stats, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray  # statistics x features
    phase: np.ndarray
    weights: np.ndarray  # bias last
    steps_x: np.ndarray  # isotonic map: knots and values
    steps_y: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.waves + self.phase), np.ones(len(z))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return np.clip(np.interp(raw, self.steps_x, self.steps_y), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y, by pooling adjacent violators; ties in x are pooled first."""
    order = np.argsort(x, kind="stable")
    xs, start, n = np.unique(x[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(y[order].astype(np.float64), start)
    blocks: list[list[float]] = []  # [sum, count, first x, last x]
    for v, s, k in zip(xs.tolist(), sums.tolist(), n.tolist()):
        blocks.append([s, k, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, k2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + k2, blocks[-1][2], last]
    knots = np.array([[e, (b[0] + 0.5) / (b[1] + 1)] for b in blocks for e in (b[2], b[3])])
    return knots[:, 0], np.maximum.accumulate(knots[:, 1])


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_train: int = MAX_TRAIN) -> QualityModel:
    """Learn from the statistics of labelled documents. The driver gets PARTS matrices, and for calibration one pair of numbers for each row."""
    d = len(STATS)
    rng = np.random.default_rng(SEED)
    waves, phase = rng.normal(0, 1 / np.sqrt(d), (d, WAVES)), rng.uniform(0, 2 * np.pi, WAVES)
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col)).cast("double").alias("y"))
    # repeated documents have one vote
    own = stats.select("doc_id", *STATS).join(sample_at_most(y, "doc_id", max_train), "doc_id")
    rows = own.groupBy("doc_id", "y").agg(F.min(F.struct(*STATS)).alias("s")).select("doc_id", "y", "s.*")
    rows = materialise(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2 * PARTS)).cast("int")), "learning-rows")
    moments = rows.agg(F.count("*").alias("n"), F.avg("y").alias("p"), *[F.avg(s).alias(f"m_{s}") for s in STATS], *[F.stddev_pop(s).alias(f"s_{s}") for s in STATS]).first()
    flat = QualityModel(np.zeros(d), np.ones(d), waves, phase, np.zeros(WAVES + 1), np.zeros(1), np.full(1, 0.5 if moments["p"] is None else moments["p"]))
    if not moments["n"] or moments["p"] in (0.0, 1.0):
        return flat
    mean = np.array([moments[f"m_{s}"] for s in STATS])
    scale = np.array([moments[f"s_{s}"] or 1.0 for s in STATS])
    base = QualityModel(mean, scale, waves, phase, np.zeros(WAVES + 1), np.zeros(1), np.zeros(1))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros((WAVES + 1, WAVES + 1)), np.zeros(WAVES + 1)
        for at in range(0, len(pdf), 4096):
            block = pdf.iloc[at : at + 4096]
            z = base.features(block[list(STATS)].to_numpy())
            a += z.T @ z
            b += z.T @ block["y"].to_numpy()
        return pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    solved = rows.where(F.col("part") < PARTS).groupBy("part").applyInPandas(sums, "a binary, b binary").collect()
    size = WAVES + 1
    a = sum((np.frombuffer(r["a"]).reshape(size, size) for r in solved), np.zeros((size, size)))
    b = sum((np.frombuffer(r["b"]) for r in solved), np.zeros(size))
    weights = np.linalg.solve(a + RIDGE * np.eye(size), b)
    fitted = QualityModel(mean, scale, waves, phase, weights, np.zeros(1), np.zeros(1))
    held = rows.where(F.col("part") >= PARTS).select("y", *STATS).toPandas()
    if not len(held):
        return flat
    raw = fitted.features(held[list(STATS)].to_numpy()) @ weights
    return QualityModel(mean, scale, waves, phase, weights, *isotonic(raw, held["y"].to_numpy()))


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for each row of statistics."""
    ship(stats.sparkSession)
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.column_stack([np.asarray(b.column(k + 1)) for k in range(len(STATS))]).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(s))], names=["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", *STATS).mapInArrow(run, f"doc_id {kind}, score double")
