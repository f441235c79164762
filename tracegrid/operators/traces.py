"""Traces: variable-length runs of points in a cell. Missing, empty and non-empty cells are told apart by the index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.errors import RequestError, TooLargeError

CELL = ["sample_id", "feature_id"]


def field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def number_points(points: DataFrame, *order: Column) -> DataFrame:
    """point_idx = 0..len-1 within each trace, in the given order."""
    return points.withColumn("point_idx", (F.row_number().over(Window.partitionBy(*CELL).orderBy(*order)) - 1).cast("int"))


def trace_index(present: DataFrame, points: DataFrame) -> DataFrame:
    """(sample_id, feature_id, trace_len) for every cell in `present`, empty ones included."""
    n = points.groupBy(*CELL).agg(F.count("*").cast("int").alias("n"))
    return present.select(*CELL).distinct().join(n, CELL, "left").select(*CELL, F.coalesce("n", F.lit(0)).cast("int").alias("trace_len"))


def regroup(index: DataFrame, points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each present cell with an array for each point column, in point order; empty traces have empty arrays."""
    gathered = points.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("point_idx", *columns))).alias("p"))
    rows = index.join(gathered, CELL, "left")
    empty = F.coalesce(F.col("p"), F.array().cast(gathered.schema["p"].dataType))
    return rows.select(*CELL, "trace_len", (F.size(empty) == F.col("trace_len")).alias("complete"), *[F.transform(empty, field(c)).alias(c) for c in columns])


def count_traces(index: DataFrame, sample_ids: Sequence[int], feature_ids: Sequence[int] | None = None, include_missing: bool = False) -> int:
    """How many traces a request returns, from the index alone."""
    if include_missing and feature_ids is not None:
        return len(set(sample_ids)) * len(set(feature_ids))
    return filtered(index, sample_ids, feature_ids).count()


def filtered(rows: DataFrame, sample_ids: Sequence[int] | None, feature_ids: Sequence[int] | None) -> DataFrame:
    if sample_ids is not None:
        rows = rows.where(F.col("sample_id").isin(sorted(set(sample_ids))))
    if feature_ids is not None:
        rows = rows.where(F.col("feature_id").isin(sorted(set(feature_ids))))
    return rows


def get_traces(index: DataFrame, points: DataFrame, columns: Sequence[str], sample_ids: Sequence[int], feature_ids: Sequence[int] | None = None, include_missing: bool = False, max_traces: int | None = None) -> DataFrame:
    """Traces of a request by (sample_id, feature_id); with include_missing, missing cells come with present = false."""
    if not len(sample_ids):
        raise RequestError("the request names no sample")
    if max_traces is not None and count_traces(index, sample_ids, feature_ids, include_missing) > max_traces:
        raise TooLargeError(f"the request has more than {max_traces} traces")
    found = regroup(filtered(index, sample_ids, feature_ids), filtered(points, sample_ids, feature_ids), columns).withColumn("present", F.lit(True))
    if include_missing and feature_ids is not None:
        spark = index.sparkSession
        s = spark.createDataFrame([(i,) for i in sorted(set(sample_ids))], "sample_id long")
        f = spark.createDataFrame([(i,) for i in sorted(set(feature_ids))], "feature_id int")
        found = s.crossJoin(F.broadcast(f)).join(found, CELL, "left").withColumn("present", F.coalesce("present", F.lit(False)))
    return found.orderBy(*CELL)


def layout_flat(traces: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON object for each trace."""
    return traces.select(*CELL, F.to_json(F.struct(*CELL, "trace_len", F.struct(*columns).alias("columns")), {"ignoreNullFields": "false"}).alias("json"))


def layout_nested(traces: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON object for each sample, with its traces by feature."""
    t = traces.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "trace_len", F.struct(*columns).alias("columns")))).alias("traces"))
    return t.select("sample_id", F.to_json(F.struct("sample_id", "traces"), {"ignoreNullFields": "false"}).alias("json"))
