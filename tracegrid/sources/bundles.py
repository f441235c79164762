"""Bundles: traces as one row a cell with an array for each column, in files sorted by (sample, feature)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.operators.traces import regroup


def write_bundles(index: DataFrame, points: DataFrame, columns: Sequence[str], path: str, files: int = 8) -> None:
    """Ranges of samples, one a file: within a file and from file to file rows ascend by (sample_id, feature_id)."""
    rows = regroup(index, points, columns).drop("complete")
    rows.repartitionByRange(files, "sample_id", "feature_id").sortWithinPartitions("sample_id", "feature_id").write.option("compression", "zstd").parquet(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def by_feature(bundles: DataFrame, files: int = 8) -> DataFrame:
    """The same rows in the order in which a feature-major build wants them."""
    return bundles.repartitionByRange(files, "feature_id", "sample_id").sortWithinPartitions("feature_id", "sample_id")


def file_order(bundles: DataFrame) -> DataFrame:
    """(file, n, sorted): whether each file's rows ascend by (sample_id, feature_id), by the rows' places in it."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("at")
    rows = bundles.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), F.struct("sample_id", "feature_id").alias("k"))
    before = rows.withColumn("before", F.lag("k").over(w))
    return before.groupBy("file").agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("k") > F.col("before")), F.lit(True)).alias("sorted"))
