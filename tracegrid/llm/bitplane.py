"""Token-id files: fixed-size blocks of ids, transposed into byte or bit planes, each plane compressed with zstandard.

A file set is a folder of shards, written by Spark's committer (so lost executors and repeated tasks leave nothing
behind) in row containers that any store which Spark can write to holds. A row is a chunk: `shard`, `chunk` (its
number in the shard), `first` (ids before it in the shard), `n_ids`, `width` (bytes an id), `planes` (list of
compressed planes, the low-order one first; 8 times as many for bit planes), and the chunk's part of the document index: `doc_id`, `doc_start`
(ids before the document in the shard), `doc_from` and `doc_ids` (the document's ids before this chunk, and in it).
The chunk rows are the chunk index: a reader finds ids by (shard, first) and prunes by column statistics. Shards follow one
another in ascending doc_id order.

Null and empty texts hold the end id alone. Repeated rows are written each, next to each other; rows of one doc_id with
unequal texts in any order. Null doc_ids come first. An empty table makes a file set without chunks. Other columns,
whatever their names, are ignored. A very long text spans chunks.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm.common import ship
from tracegrid.llm.tokens import encoder, vocabulary

CHUNKS = "shard int, chunk int, first long, n_ids int, width int, planes array<binary>, doc_id array<long>, doc_start array<long>, doc_from array<long>, doc_ids array<int>"
BLOCK, LEVEL = 1 << 16, 3


def to_planes(ids: np.ndarray, bits: bool, level: int = LEVEL) -> list[bytes]:
    """ids (little-endian, 2 or 4 bytes) as compressed planes."""
    z = zstandard.ZstdCompressor(level=level)
    planes = list(ids.view(np.uint8).reshape(len(ids), ids.itemsize).T)
    if bits:
        planes = [np.packbits(p >> np.uint8(b) & np.uint8(1), bitorder="little") for p in planes for b in range(8)]
    return [z.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(z.decompress(p), np.uint8) for p in planes]
    if len(raw) == 8 * width:
        bits = [np.unpackbits(p, count=n, bitorder="little") for p in raw]
        raw = [np.bitwise_or.reduce([bits[8 * i + b] << np.uint8(b) for b in range(8)]) for i in range(width)]
    return np.ascontiguousarray(np.stack(raw, axis=1)).view(f"<u{width}").ravel()


def _chunks(vocab: str, cut: str, end_id: int, block: int, bits: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId() if task else 0
        encode = encoder(vocabulary(vocab), cut)
        end = np.array([end_id], encode.dtype)
        held, n_held, docs, at, first, chunk = deque(), 0, [], 0, 0, 0

        def taken_ids(n: int) -> np.ndarray:
            """The first n held ids; what is left of the array that they end in is a view of it, not a copy."""
            parts, missing = [], n
            while missing:
                part = held.popleft()
                if len(part) > missing:
                    held.appendleft(part[missing:])
                    part = part[:missing]
                parts.append(part)
                missing -= len(part)
            return np.concatenate(parts)

        def taken(n: int) -> pa.RecordBatch:
            nonlocal n_held, docs, first, chunk
            ids = taken_ids(n)
            inside, later = [], []
            for doc, start, begin, length in docs:  # begin: of the document's ids, the first that is held
                got = min(length, first + n - (start + begin))
                inside.append((doc, start, begin, got))
                if got < length:
                    later.append((doc, start, begin + got, length - got))
            row = {"shard": shard, "chunk": chunk, "first": first, "n_ids": n, "width": encode.dtype.itemsize, "planes": to_planes(ids, bits)}
            row |= {k: [x[i] for x in inside] for i, k in enumerate(("doc_id", "doc_start", "doc_from", "doc_ids"))}
            n_held, docs, first, chunk = n_held - n, later, first + n, chunk + 1
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _SCHEMA], schema=_SCHEMA)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode.encode([text])[0], end)
                held.append(ids)
                docs.append((doc, at, 0, len(ids)))
                n_held, at = n_held + len(ids), at + len(ids)
                while n_held - block >= 0 and docs:
                    # a document that ends at the block's end belongs to it whole
                    yield taken(block)
        if n_held:
            yield taken(n_held)

    return run


_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()), ("planes", pa.list_(pa.binary()))]
    + [(k, pa.list_(pa.int64())) for k in ("doc_id", "doc_start", "doc_from")]
    + [("doc_ids", pa.list_(pa.int32()))]
)


def write_ids(
    docs: DataFrame,
    path: str,
    vocab: str = "word_bpe_49k.json",
    cut: str = "words",
    end_id: int = 2,
    block: int = BLOCK,
    bits: bool = False,
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of docs, ordered by doc_id, as a file set at `path`. Planes are bytes, or bits with bits=True."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    chunks = ordered.mapInArrow(_chunks(vocab, cut, end_id, block, bits), CHUNKS)
    chunks.write.option("compression", "none").parquet(path)  # the planes are compressed


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(shard, ids before it): one pair for each task that wrote, gathered from the chunk index alone."""
    sizes = read_chunks(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    out, total = [], 0
    for r in sizes:
        out.append((r["shard"], total))
        total += r["n"]
    return out


def _segments(keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = from_planes(row["planes"], row["n_ids"], row["width"]).astype("<u4")
                ends = np.cumsum(row["doc_ids"])
                raw = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), row["doc_ids"])]
                n = len(raw)
                cols = [pa.array(row["doc_id"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_start"], pa.int64()), pa.array(row["doc_from"], pa.int64()), pa.array(row["doc_ids"], pa.int64())]
                cols += [pa.array([zlib.crc32(x) for x in raw], pa.int64())] + ([pa.array(raw, pa.binary())] if keep_ids else [])
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "shard", "doc_start", "doc_from", "n", "crc"] + ["ids"] * keep_ids)

    return run


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """The crc32 of byte strings in a row, from the (crc32, length) of each: shifting by zero bytes is linear over bits."""
    total, poly = 0, 0xEDB88320  # the CRC-32 polynomial, reflected
    for crc, length in parts:
        step = [poly] + [1 << i for i in range(31)]  # the operator for one zero bit, as columns
        apply = lambda m, v: int(np.bitwise_xor.reduce([m[i] for i in range(32) if v >> i & 1] or [0]))
        n = length * 8
        while n:
            if n & 1:
                total = apply(step, total)
            step = [apply(step, c) for c in step]
            n >>= 1
        total ^= crc
    return total


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = [p[0]["crc"] if len(p) == 1 else crc32_joined([(x["crc"], 4 * x["n"]) for x in p]) for p in b.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document, from the files: chunks are decoded apart from one another,
    and the checksums of a document's parts (as many as chunks it spans) are joined."""
    ship(spark)
    starts = spark.createDataFrame(shard_starts(spark, path), "shard int, base long")
    parts = read_chunks(spark, path).mapInArrow(_segments(False), "doc_id long, shard int, doc_start long, doc_from long, n long, crc long")
    whole = parts.groupBy("shard", "doc_start").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("doc_from", "n", "crc"))).alias("parts"))
    placed = whole.join(F.broadcast(starts), "shard").select("doc_id", (F.col("base") + F.col("doc_start")).alias("start"), "n_tokens", "parts")
    return placed.mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, doc_start, doc_from, n, crc, ids): the ids themselves, one row for each document and chunk."""
    ship(spark)
    return read_chunks(spark, path).mapInArrow(_segments(True), "doc_id long, shard int, doc_start long, doc_from long, n long, crc long, ids binary")
