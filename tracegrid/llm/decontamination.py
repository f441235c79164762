"""Benchmark decontamination: n-gram seeds join training passages to test items, Smith-Waterman alignment scores them.

Words are runs of letters and digits, lower-cased. Every n-gram of words of a test item is a seed (3 words; an item with
fewer is one seed of its own length), kept as a 64-bit hash. One pass over the texts, however large the benchmark, finds
the places whose n-gram passes a table of bits set by the seeds' hashes, and cuts passages around them; the passages'
hashes are then joined with the table of seeds, which lets false hits go and names the items. A seed counts however
often it occurs: no frequency tells an edited copy that leaked everywhere from a common phrase, and an alignment may
hold a single seed, so none is passed over for being common. Each item is aligned with the words about its seeds
(match +2, mismatch -1, gap -1); the score is the best local alignment's over that of the whole item. Places whose words
cannot reach the threshold, whatever their order, are not aligned: that bound, which loses nothing, keeps common phrases
cheap. Documents from THRESHOLD on are contaminated.

The table of bits is all that is broadcast: 4,096 bits a seed, and 128 MB at most (beyond that more false hits reach the
join, which is exact). Null and empty texts, on either side, match nothing, nor do items without an id. Rows that repeat
a doc_id and a text are reported once; a doc_id that comes with several texts is judged by each. Repeated items count
once; an item id with several texts matches by any of them. Of passages with equal scores the first is reported. An
empty table on either side gives no rows. Other columns, whatever their names, are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import materialise, ship, text_key

SIZE, THRESHOLD = 3, 0.5
BITS_A_SEED, MOST_BITS = 12, 30  # as powers of two
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"\w+")
#: Odd multipliers that tell the places of an n-gram apart (any odd numbers do).
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last + 1 of the aligned words of b) of the best local alignment of two word arrays.

    Row by row; gaps along a row are a running maximum, as a gap costs the same for each word."""
    n = len(b)
    ramp = np.arange(n + 1) * -GAP
    above, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in a:
        diagonal = above[:-1] + np.where(b == word, MATCH, MISMATCH)
        up = above[1:] + GAP
        here = np.r_[0, np.maximum(np.maximum(diagonal, up), 0)]
        start = np.r_[0, np.where(here[1:] == 0, np.arange(1, n + 1), np.where(diagonal >= up, origin[:-1], origin[1:]))]
        lifted = here + ramp
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, np.arange(n + 1), 0))
        above, origin = run - ramp, start[source]
        k = int(above.argmax())
        if above[k] > best[0]:
            best = (int(above[k]), int(origin[k]), k)
    return best


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the n-gram at each position."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ hashes[k : n + k]) * _PLACES[k]
        h ^= h >> np.uint64(29)
    return h


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, seed, size, n): the distinct seeds of each item, with the item's number of words."""
    for b in batches:
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = words_of(text)
            if words:
                size = min(SIZE, len(words))
                seed = np.unique(gram_hashes(word_hashes(words), size)).view(np.int64)
                k = len(seed)
                yield pa.RecordBatch.from_arrays([pa.array([item] * k, pa.int64()), pa.array(seed), pa.array([size] * k, pa.int32()), pa.array([len(words)] * k, pa.int32())], names=["item", "seed", "size", "n"])


class SeedBits:
    """Which hashes, by their upper bits, may be a seed's."""

    def __init__(self, log2: int, words: np.ndarray, values: np.ndarray, sizes: list[int], reach: int):
        self.shift, self.sizes, self.reach = np.uint64(64 - log2), sizes, reach
        self.table = np.zeros(1 << (log2 - 6), np.uint64)
        self.table[words] = values

    def places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of the n-grams that may be seeds, by position."""
        hashes, at, seed = word_hashes(words), [], []
        for size in self.sizes:
            h = gram_hashes(hashes, size)
            bit = h >> self.shift
            hit = np.flatnonzero(self.table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
            at.append(hit)
            seed.append(h[hit])
        at, seed = np.concatenate(at), np.concatenate(seed)
        order = np.argsort(at, kind="stable")
        return at[order], seed[order]


def _seed_bits(seeds: DataFrame) -> SeedBits | None:
    """The driver gets one number for each 64 bits that hold a seed: at most 2**24, and no more than there are seeds."""
    size = seeds.agg(F.count("*").alias("k"), F.max("n").alias("reach"), F.array_sort(F.collect_set("size")).alias("sizes")).first()
    if not size["k"]:
        return None
    log2 = min(MOST_BITS, max(6, int(size["k"]).bit_length() + BITS_A_SEED))
    bit = seeds.select(F.shiftrightunsigned("seed", 64 - log2).alias("bit"))
    found = bit.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS INT))")).alias("b")).toPandas()
    return SeedBits(log2, found["w"].to_numpy(np.int64), found["b"].to_numpy(np.int64).view(np.uint64), size["sizes"], size["reach"])


def windows(at: np.ndarray, reach: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first word, end, places) of runs of places within reach of each other, with as much around them."""
    for p in np.split(at, np.flatnonzero(np.diff(at) > reach) + 1):
        yield max(0, int(p[0]) - reach), int(p[-1]) + reach + SIZE, p


PASSAGES = "doc_id long, digest long, first long, words string, seed array<long>, at array<int>"


def _passages(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: SeedBits = sent.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for b in batches:
            rows = []
            for doc, digest, text in zip(*(c.to_pylist() for c in b.columns)):
                words = words_of(text)
                at, seed = bits.places(words)
                if not len(at):
                    continue
                k = 0
                for first, end, places in windows(at, bits.reach):
                    own = seed[k : k + len(places)].view(np.int64)
                    k += len(places)
                    rows.append((doc, digest, first, " ".join(words[first:end]), own, (places - first).astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PASSAGES.split(", ")])

    return run


MATCHES = "doc_id long, digest long, item_id long, score double, first_word long, last_word long, passage string"
#: Items remembered by one worker, as numbers.
REMEMBERED = 10_000


def _score(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[dict[str, int], np.ndarray]] = {}
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows = []
            for doc, digest, first, text, at, item_id, item_text in zip(*(c.to_pylist() for c in b.columns)):
                if item_text not in known:
                    if len(known) > REMEMBERED:
                        known.clear()
                    ws = words_of(item_text)
                    number = {w: k for k, w in enumerate(dict.fromkeys(ws))}
                    known[item_text] = number, np.array([number[w] for w in ws], np.int64)
                number, item = known[item_text]
                words, full = text.split(" "), MATCH * len(item)
                ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                for start, end, _ in windows(np.unique(at), len(item)):
                    part = ids[start:end]
                    if MATCH * np.isin(item, part).sum() < threshold * full:
                        continue  # not even in the best order
                    value, low, high = align(item, part)
                    if value >= threshold * full:
                        rows.append((doc, digest, item_id, value / full, first + start + low, first + start + high, " ".join(words[start + low : start + high])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in MATCHES.split(", ")])

    return run


def _matches(docs: DataFrame, benchmark: DataFrame, threshold: float, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The best passage for each row of docs (by doc_id and digest of its text) and item."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text")).distinct()
    items = materialise(items.withColumn("item", F.xxhash64("item_id", "item_text")), "items")
    seeds = materialise(items.select("item", "item_text").mapInArrow(_seeds, "item long, seed long, size int, n int"), "seeds")
    bits = _seed_bits(seeds)
    if bits is None:
        return spark.createDataFrame([], MATCHES)
    sent = spark.sparkContext.broadcast(bits)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    passages = materialise(rows.mapInArrow(_passages(sent), PASSAGES).withColumn("pid", F.monotonically_increasing_id()), "passages")
    hits = passages.select("pid", F.explode(F.arrays_zip("seed", "at")).alias("h")).select("pid", F.col("h.seed").alias("seed"), F.col("h.at").alias("at"))
    named = hits.join(seeds.select("seed", "item"), "seed").groupBy("pid", "item").agg(F.collect_list("at").alias("places"))
    named = materialise(named, "hits")  # so that the joins below know its size and can split what is long
    pairs = named.hint("merge").join(passages.select("pid", "doc_id", "digest", "first", "words"), "pid").join(items, "item")
    scored = pairs.select("doc_id", "digest", "first", "words", "places", "item_id", "item_text").mapInArrow(_score(threshold), MATCHES)
    best = F.max_by(F.struct("score", "first_word", "last_word", "passage"), F.struct("score", -F.col("first_word"))).alias("b")
    return scored.groupBy("doc_id", "digest", "item_id").agg(best).select("doc_id", "digest", "item_id", "b.*")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, passage): the best passage for each contaminated pair."""
    return _matches(docs, benchmark, threshold, id_col, text_col, item_col, item_text_col).drop("digest")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no test item was found."""
    found = _matches(docs, benchmark, threshold, id_col, text_col, item_col, item_text_col)
    gone = materialise(found.select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__digest")).distinct(), "gone").hint("merge")  # both grow with the corpus
    return docs.join(gone, (text_key(docs[text_col]) == gone["__digest"]) & docs[id_col].cast("long").eqNullSafe(gone["__gone"]), "left_anti")
