"""Feature-major blocks: the traces of one feature for a run of samples, as flags, offsets and joined columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.operators.traces import field

PRESENT, EMPTY = 1, 2  # flag bits


def block_of(sample_id: Column, per_block: int) -> Column:
    return F.floor(sample_id / per_block).cast("int")


def flag_of(trace_len: Column) -> Column:
    """0 missing, 1 present, 3 present and empty."""
    return F.when(trace_len.isNull(), 0).when(trace_len == 0, PRESENT | EMPTY).otherwise(PRESENT).cast("int")


def block_offsets(index: DataFrame, per_block: int) -> DataFrame:
    """(feature_id, block_id, sample_id, start, stop) for present traces: running sums within a block."""
    w = Window.partitionBy("feature_id", "block_id").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = index.withColumn("block_id", block_of(F.col("sample_id"), per_block)).withColumn("stop", F.sum("trace_len").over(w))
    return rows.select("feature_id", "block_id", "sample_id", (F.col("stop") - F.col("trace_len")).alias("start"), "stop")


def assemble(index: DataFrame, regrouped: DataFrame, columns: Sequence[str], n_samples: int, per_block: int) -> DataFrame:
    """One row for each feature and block that holds a trace: flags for every sample of the block, n+1 offsets, joined columns.

    A block has at most per_block traces, which bounds what a row gathers.
    """
    rows = regrouped.withColumn("block_id", block_of(F.col("sample_id"), per_block))
    got = rows.groupBy("feature_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", "trace_len", *columns))).alias("t"))
    first = F.col("block_id").cast("long") * per_block
    span = F.sequence(first, F.least(first + per_block, F.lit(n_samples).cast("long")) - 1)
    lengths = F.map_from_arrays(F.transform("t", lambda x: x["sample_id"]), F.transform("t", lambda x: x["trace_len"]))
    got = got.withColumn("lens", F.transform(span, lambda s: F.try_element_at(lengths, s)))
    offsets = F.aggregate("lens", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + F.coalesce(n, F.lit(0)))))
    return got.select("feature_id", "block_id", F.transform("lens", flag_of).alias("flags"), offsets.alias("offsets"), *[F.flatten(F.transform("t", field(c))).alias(c) for c in columns])


def trace_in_block(block: DataFrame, sample_id: int, columns: Sequence[str], per_block: int) -> DataFrame:
    """(feature_id, flags, trace_len, columns) of one sample, cut out of its blocks by their offsets."""
    i = sample_id % per_block
    rows = block.where(F.col("block_id") == sample_id // per_block).where(F.size("flags") > i)
    start, stop = F.col("offsets")[i], F.col("offsets")[i + 1]
    return rows.select("feature_id", F.col("flags")[i].alias("flags"), (stop - start).alias("trace_len"), *[F.slice(c, start + 1, stop - start).alias(c) for c in columns])


def feature_estimates(index: DataFrame, per_block: int) -> DataFrame:
    """(feature_id, n_points, n_blocks) that size the feature-major layout."""
    return index.groupBy("feature_id").agg(F.sum(F.col("trace_len").cast("long")).alias("n_points"), F.countDistinct(block_of(F.col("sample_id"), per_block)).alias("n_blocks"))


def _packed(budget: int, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used = -1, 0
        for b in batches:
            parts = np.empty(b.num_rows, np.int32)
            for k, size in enumerate(b.column(1).to_pylist()):
                if part < 0 or used + size > budget:
                    part, used = part + 1, 0
                used += size
                parts[k] = part
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts)], names=[id_col, "part_id"])

    return run


def bin_pack(sizes: DataFrame, id_col: str, size_col: str, budget: int) -> DataFrame:
    """(id, part_id): runs of ids in order, each closed before its total would pass the budget; an oversized id is alone.

    Where a run ends depends on all before it, so one task reads one small row for each id of an axis, in order and in
    constant memory; data are not read.
    """
    listed = sizes.select(F.col(id_col).cast("long").alias(id_col), F.col(size_col).cast("long").alias("size"))
    return listed.repartition(1).sortWithinPartitions(id_col).mapInArrow(_packed(budget, id_col), f"{id_col} long, part_id int")
