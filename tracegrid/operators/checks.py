"""Integrity checks as DataFrames of violations: no rows, no faults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.errors import DataError
from tracegrid.sources import storage


#: Rows of a range of positions, the most that order_report means to give one task.
RANGE_ROWS = 262_144


def _falls(keys: Sequence[str], before: Column) -> Column:
    """Whether keys do not exceed those before, as SQL compares rows: unknown where a null decides or no row is before."""
    out = F.lit(True)
    for key in reversed(keys):
        out = (F.col(key) < before[key]) | ((F.col(key) == before[key]) & out)
    return out


def order_violations(rows: DataFrame, position: Column, keys: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Rows whose keys do not exceed those of the row before by `position` (nulls last, ties by keys); per `partition` (a file,
    say) where given, else over the whole table by order_report."""
    if not partition:
        return order_report(rows, position, keys)
    w = Window.partitionBy(*partition).orderBy(position.asc_nulls_last(), *keys)
    return rows.withColumn("__before", F.lag(F.struct(*keys)).over(w)).where(_falls(keys, F.col("__before"))).drop("__before")


def order_report(rows: DataFrame, position: Column, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """order_violations for a whole table without one task that reads it all: rows are dealt by ranges of `position` (as many as
    `tasks`, or one for each RANGE_ROWS rows), compared within their range, and each range's first row with the last row before
    it (one row for each range).

    The dealt rows are written once: two evaluations would draw the ranges' bounds from different samples."""
    k, at = F.struct(*keys), F.col("__at")
    tasks = tasks or rows.count() // RANGE_ROWS + 1
    dealt = rows.withColumn("__at", position).repartitionByRange(tasks, at.asc_nulls_last(), *keys).withColumn("__range", F.spark_partition_id())
    # max_by over structs sorts its input, so it too is given a range a task, not a split of the files
    dealt = storage.stored(dealt, storage.scratch_path(rows.sparkSession, "order")).repartition(tasks, "__range")
    w = Window.partitionBy("__range").orderBy(at.asc_nulls_last(), *keys)
    inside = dealt.withColumn("__before", F.lag(k).over(w))
    last = dealt.groupBy("__range").agg(F.max_by(k, F.struct(at.isNull(), at, k)).alias("__last"))
    # ranges without rows have no last row; the nearest one below counts
    edges = last.select(F.lead("__range").over(Window.orderBy("__range")).alias("__next"), F.col("__last"))
    met = inside.join(F.broadcast(edges), F.col("__range") == F.col("__next"), "left").withColumn("__before", F.coalesce("__before", "__last"))
    return met.where(_falls(keys, F.col("__before"))).select(*rows.columns)


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage_gaps(ids: DataFrame, id_col: str, n: int) -> DataFrame:
    """(id, n): ids of 0..n-1 that do not occur exactly once, and ids outside."""
    have = ids.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    both = ids.sparkSession.range(n).join(have, "id", "full_outer")
    return both.select("id", F.coalesce("n", F.lit(0)).alias("n")).where((F.col("n") != 1) | (F.col("id") < 0) | (F.col("id") >= n))


def unequal_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one that the other lacks, by side, as often as they are lacking; the columns of both must agree. Each side is evaluated once."""
    signed = a.withColumn("__n", F.lit(1)).union(b.withColumn("__n", F.lit(-1)))
    n, block = F.col("__n"), 65_536
    odd = signed.groupBy(*a.columns).agg(F.sum("__n").alias("__n")).where(n != 0).withColumn("side", F.when(n > 0, "left").otherwise("right"))
    # in two steps, so that no row holds an array as long as its count
    blocks = odd.withColumn("__n", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.abs(n) - 1, F.lit(block).cast("long")), lambda at: F.least(F.abs(n) - at, F.lit(block)))))
    return blocks.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), n))).drop("__n")


def length_mismatches(index: DataFrame, points: DataFrame) -> DataFrame:
    """Cells whose number of points is not their trace_len, and points without an index row."""
    n = points.groupBy("sample_id", "feature_id").agg(F.count("*").alias("n"))
    both = index.join(n, ["sample_id", "feature_id"], "full_outer")
    return both.select("sample_id", "feature_id", "trace_len", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("trace_len").isNull() | (F.col("trace_len") != F.col("n")))


def enrich(meta: DataFrame, extra: DataFrame, on: str, require_all: bool = False) -> DataFrame:
    """Metadata with new columns from `extra`; existing columns may not be replaced, repeated keys not be joined."""
    clash = (set(meta.columns) & set(extra.columns)) - {on}
    if clash:
        raise DataError(f"columns exist already: {sorted(clash)}")
    if duplicates(extra, [on]).head(1):
        raise DataError(f"{on} is repeated in the new columns")
    out = meta.join(extra, on, "left")
    if require_all:
        new = [c for c in extra.columns if c != on]
        if out.where(F.greatest(*[F.col(c).isNull() for c in new], F.lit(False))).head(1):
            raise DataError("some rows got no value")
    return out
