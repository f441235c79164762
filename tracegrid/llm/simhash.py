"""SimHash near-duplicates by an inverted index on byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 bytes, so they share at least 5 of their 8
positional bytes: the guaranteed minimum. Of 5 shared bytes at least 3 lie in one half of the positions, so the index
posts a fingerprint under the 8 triples of positions within a half, and every pair that reaches the minimum meets in a
posting. (A posting of a single byte would hold 1/256 of the corpus, and its pairs grow with the square of that.) In a
posting the shared positional bytes of the pairs are tallied, pairs below 5 are let go, the rest are verified by bits.

What a task holds is bounded. Postings of at most HOT fingerprints are compared in memory, by a search that visits each
fingerprint once and drops whatever it reaches, so that it gives a spanning forest and not all pairs. Longer postings
are passed on, as they stream by, to a second index keyed by the 5-byte sets that contain the triple; its postings
leave 24 bits open, and the long ones among them are connected in one table of 2**24 entries (64 MB), whatever they hold.

Null and empty texts, and those of white space only, have fingerprint 0 and are linked like any other. Copies share
one fingerprint and one place in the index. Documents are linked by their fingerprints alone: rows that repeat a doc_id
are judged each by its own text. A component's id is the smallest doc_id in it; null ids count only where no other is.
An empty table gives no rows. Other columns, whatever their names, are ignored. Texts are read whole, in slabs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import materialise, ship
from tracegrid.llm.components import connected_components

BITS, BYTES = 3, 8
NEEDED = BYTES - BITS
#: The positions of each posting key: first index (a key's bits from 24 on are its place in this list), second index (from 40 on).
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
FIVES = list(combinations(range(BYTES), NEEDED))
SLAB = 1 << 20
#: Postings up to SHORT are compared side by side, up to HOT in memory.
SHORT, HOT = 16, 1 << 16


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set; bytes are summed 255 rows at a time, within uint8."""
    rows = -(-len(h) // 255) * 255
    padded = np.zeros(rows, np.uint64)
    padded[: len(h)] = h
    bits = np.unpackbits(padded.view(np.uint8).reshape(rows, 8), axis=1, bitorder="little")
    return bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def _slabs(raw: bytes) -> Iterator[bytes]:
    """A very long text in pieces that end at white space."""
    at = 0
    while len(raw) - at > SLAB:
        end = at + SLAB
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of a text's word shingles, repeats included, slab by slab; of the whole sequence if it has fewer words."""
    last, none = [], True
    digest = xxhash.xxh64_intdigest
    for piece in _slabs((text or "").encode("utf-8", "surrogatepass").lower()):  # bytes.lower changes A-Z only
        words = last + piece.split()  # bytes.split cuts at 0x20 and 0x09-0x0D only
        if len(words) >= size:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
            yield np.fromiter(map(digest, shingles, repeat(42)), np.uint64, len(words) - size + 1)
            none = False
        last = words[max(0, len(words) - size + 1) :]
    if none and last:
        yield np.array([digest(b" ".join(last), 42)], np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included, as an unsigned integer."""
    counts, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, size):
        counts += bit_counts(h)
        total += len(h)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0]) if total else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long) for each row; fp holds the unsigned fingerprint's bits."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def runs(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Rows sorted by their first column, as arrays: (False, whole runs of equal keys), or (True, a part of a run longer than hot)."""
    held: list[list[np.ndarray]] = []
    burning = None

    def taken() -> list[np.ndarray]:
        out = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        return out

    for b in batches:
        cols = [np.asarray(c) for c in b.columns]
        if burning is not None:
            cut = int(np.searchsorted(cols[0], burning, "right"))
            if cut:
                yield True, [c[:cut] for c in cols]
            cols = [c[cut:] for c in cols]
        if not len(cols[0]):
            continue
        burning = None
        if held and held[-1][0][-1] != cols[0][0]:
            yield False, taken()
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last run may go on
        if cut:
            held.append([c[:cut] for c in cols])
            yield False, taken()
        held.append([c[cut:] for c in cols])
        if sum(len(h[0]) for h in held) > hot:
            burning = held[0][0][0]
            yield True, taken()
    if held:
        yield False, taken()


_CANON = np.full(256, -1, np.int8)  # by the mask of equal bytes: the first triple that two fingerprints share
for _m in range(256):
    _CANON[_m] = next((i for i, t in enumerate(TRIPLES) if all(_m >> p & 1 for p in t)), -1)


def _same_bytes(x: np.ndarray) -> np.ndarray:
    """The mask of positions at which two fingerprints with exclusive-or x agree."""
    return np.packbits(x.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little").ravel()


def linked(x: np.ndarray) -> np.ndarray:
    """Tally of shared positional bytes first, then the count of differing bits."""
    ok = np.bitwise_count(_same_bytes(x)) >= NEEDED
    ok[ok] = np.bitwise_count(x[ok]) <= BITS
    return ok


Pairs = tuple[np.ndarray, np.ndarray]


def side_by_side(key: np.ndarray, fp: np.ndarray, near: Callable[[np.ndarray], np.ndarray]) -> Iterator[Pairs]:
    """(i, j) of the links within runs of equal keys of at most SHORT rows."""
    for d in range(1, SHORT):
        at = np.flatnonzero(key[d:] == key[:-d]) if len(key) > d else ()
        if not len(at):
            return
        at = at[near(fp[at] ^ fp[at + d])]
        yield at, at + d


def forest(fp: np.ndarray, near: Callable[[np.ndarray], np.ndarray]) -> Pairs:
    """(i, j): a spanning forest of the links of one run. Every row is reached once."""
    left, right = [], []
    rest = np.arange(len(fp))
    rest_fp = fp
    while len(rest):
        queue, rest_fp, rest = [rest[0]], rest_fp[1:], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(rest_fp ^ fp[i])
            if hit.any():
                found = rest[hit]
                left.append(np.full(len(found), i))
                right.append(found)
                queue += found.tolist()
                rest_fp, rest = rest_fp[~hit], rest[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _by_triple(hot: int) -> Callable:
    """Links of the first index's postings; rows with `over` set are fingerprints (u) of postings longer than hot, with the key (v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u: np.ndarray, v: np.ndarray, over: bool = False) -> Iterator[pa.RecordBatch]:
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.astype(np.int64) if over else v.view(np.int64)), pa.array(np.full(len(u), over))], names=["u", "v", "over"])

        for is_hot, (key, fp) in runs(batches, hot):
            fp = fp.view(np.uint64)
            if is_hot:
                yield from out(fp, key, True)
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[starts, len(key)])
            short = np.repeat(size <= SHORT, size)
            for i, j in side_by_side(key[short], fp[short], linked):
                a, b, k = fp[short][i], fp[short][j], key[short][i]
                first = _CANON[_same_bytes(a ^ b)] == k >> 24  # each pair under its first shared key only
                yield from out(a[first], b[first])
            for s, n in zip(starts[size > SHORT], size[size > SHORT]):
                own = fp[s : s + n]
                if n > hot:
                    yield from out(own, key[s : s + n], True)
                else:
                    i, j = forest(own, linked)
                    yield from out(own[i], own[j])

    return run


class OpenBits:
    """The fingerprints of one posting of the second index, by the 24 bits that its key leaves open. Its size is fixed."""

    def __init__(self, five: int):
        free = [p for p in range(BYTES) if p not in FIVES[five]]
        self.shifts = [np.uint64(8 * p) for p in free]
        bits = [1 << b for b in range(24)]
        self.flips = [sum(c) for k in range(1, BITS + 1) for c in combinations(bits, k)]
        self.label = np.full(1 << 24, -1, np.int32)
        self.base = np.uint64(0)

    def _open(self, fp: np.ndarray) -> np.ndarray:
        return sum((fp >> s & np.uint64(255)) << np.uint64(8 * k) for k, s in enumerate(self.shifts)).astype(np.int32)

    def _closed(self, value: np.ndarray) -> np.ndarray:
        v = value.astype(np.uint64)
        return sum((v >> np.uint64(8 * k) & np.uint64(255)) << s for k, s in enumerate(self.shifts)) | self.base

    def add(self, fp: np.ndarray) -> None:
        mask = ~np.uint64(sum(255 << int(s) for s in self.shifts))
        self.base = fp[0] & mask
        at = self._open(fp)
        self.label[at] = at

    def links(self, block: int = 1 << 20) -> Iterator[Pairs]:
        """Each fingerprint with the smallest of its component, found by handing on the least label until none changes."""
        at = np.flatnonzero(self.label >= 0).astype(np.int32)
        changed = True
        while changed:
            changed = False
            for k in range(0, len(at), block):
                part = at[k : k + block]
                least = self.label[part].copy()
                for f in self.flips:
                    other = self.label[part ^ f]
                    np.minimum(least, np.where(other < 0, least, other), out=least)
                while True:  # a label's own label may be smaller yet
                    shorter = np.minimum(least, self.label[least])
                    if (shorter == least).all():
                        break
                    least = shorter
                changed |= bool((least < self.label[part]).any())
                self.label[part] = least
        for k in range(0, len(at), block):
            part = at[k : k + block]
            part = part[self.label[part] != part]
            yield self._closed(part), self._closed(self.label[part])


def _by_five(hot: int) -> Callable:
    """Links of the second index's postings, however long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: Iterator[Pairs]) -> Iterator[pa.RecordBatch]:
            for u, v in pairs:
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        table, key_of = None, None
        for is_hot, (key, fp) in runs(batches, hot):
            fp = fp.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(key)]):
                own = fp[s:e]
                if table is not None and key[s] != key_of:
                    yield from out(table.links())
                    table = None
                if is_hot or len(own) > hot:
                    if table is None:
                        table, key_of = OpenBits(int(key[s] >> 40)), key[s]
                    table.add(own)
                else:
                    i, j = forest(own, linked)
                    yield from out([(own[i], own[j])])
        if table is not None:
            yield from out(table.links())

    return run


def _key(fp: Column, positions: tuple[int, ...], number: int) -> Column:
    """The bytes at these positions, lowest first, below the number of the key."""
    parts = [F.shiftleft(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long")), 8 * k) for k, p in enumerate(positions)]
    key = F.lit(number << (8 * len(positions))).cast("long")
    for p in parts:
        key = key.bitwiseOR(p)
    return key


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v) between distinct fingerprints (column fp) that differ in at most 3 bits, as far as needed to connect them."""
    ship(distinct.sparkSession)
    fp = F.col("fp")
    posted = distinct.select(F.explode(F.array(*[_key(fp, t, i).cast("int") for i, t in enumerate(TRIPLES)])).alias("key"), "fp")
    found = posted.repartition("key").sortWithinPartitions("key").mapInArrow(_by_triple(hot), "u long, v long, over boolean")
    found = materialise(found, "by-triple")
    # a triple's 5-byte sets, for the fingerprints of its long postings
    over = found.where("over").select(F.col("u").alias("fp"), F.shiftright("v", 24).alias("triple"))
    keys = F.array(*[F.when(F.col("triple").isin([k for k, t in enumerate(TRIPLES) if set(t) <= set(c)]), _key(fp, c, i)) for i, c in enumerate(FIVES)])
    again = over.select("fp", F.explode(F.array_compact(keys)).alias("key")).distinct().select("key", "fp")
    more = again.repartition("key").sortWithinPartitions("key").mapInArrow(_by_five(hot), "u long, v long")
    return found.where("not over").select("u", "v").unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents in one component are connected by links; its id is the smallest doc_id."""
    fps = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = materialise(connected_components(links(distinct.select("fp"))).withColumnRenamed("node", "fp"), "components")
    least = found.join(distinct, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    in_one = found.join(least, "component").select("fp", "component_id")
    alone = distinct.join(found, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    named = materialise(in_one.unionByName(alone), "named")  # so that the join deals out both sides and can split a hot fingerprint
    return fps.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")
