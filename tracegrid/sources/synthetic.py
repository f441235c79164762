"""Synthetic grids and traces, by column expressions over hashes of ids: any row can be made alone, on any task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.functions.values import hashed_normal, hashed_uniform


def scalar_cells(spark: SparkSession, n_samples: int, n_features: int, seed: int = 0, density: float = 0.8, group: int = 8, noise: float = 0.5, start: int = 0) -> DataFrame:
    """(sample_id, feature_id, value) of samples start..n_samples-1: features of a group share a latent value of each sample and so are redundant.

    Every other feature of a group follows it with the opposite sign. A range of samples has the same cells as in the whole grid.
    """
    i = F.col("id")
    grid = spark.range(start * n_features, n_samples * n_features).select(F.floor(i / n_features).alias("sample_id"), F.pmod(i, F.lit(max(1, n_features))).cast("int").alias("feature_id"))
    s, f = F.col("sample_id"), F.col("feature_id")
    latent = hashed_normal(seed, s, F.floor(f / group), F.lit("latent"))
    own = hashed_normal(seed, s, f, F.lit("own"))
    value = latent * F.when(f % 2 == 0, 1.0).otherwise(-1.0) + own * noise
    return grid.where(hashed_uniform(seed, s, f, F.lit("kept")) < density).select("sample_id", "feature_id", value.alias("value"))


def scalar_samples(spark: SparkSession, n_samples: int, seed: int = 0, missing_y: float = 0.1) -> DataFrame:
    """(sample_id, sample_key, y): y follows the latent value of group 0; a share is null."""
    s = F.col("id")
    y = hashed_normal(seed, s, F.lit(0).cast("long"), F.lit("latent")) + 0.3 * hashed_normal(seed, s, F.lit("y"))
    return spark.range(n_samples).select(s.alias("sample_id"), F.format_string("sample_%08d", s).alias("sample_key"), F.when(hashed_uniform(seed, s, F.lit("seen")) >= missing_y, y).alias("y"))


def scalar_features(spark: SparkSession, n_features: int, group: int = 8) -> DataFrame:
    f = F.col("id").cast("int")
    return spark.range(n_features).select(f.alias("feature_id"), F.format_string("feature_%06d", f).alias("feature_key"), F.floor(f / group).cast("int").alias("group_id"))


def trace_lengths(spark: SparkSession, n_samples: int, n_features: int, longest: int, seed: int = 0, missing: float = 0.2) -> DataFrame:
    """The index (sample_id, feature_id, trace_len) with lengths 0..longest; a share of cells is missing."""
    i = F.col("id")
    grid = spark.range(n_samples * n_features).select(F.floor(i / n_features).alias("sample_id"), F.pmod(i, F.lit(max(1, n_features))).cast("int").alias("feature_id"))
    s, f = F.col("sample_id"), F.col("feature_id")
    n = F.floor(hashed_uniform(seed, s, f, F.lit("length")) * (longest + 1)).cast("int")
    return grid.where(hashed_uniform(seed, s, f, F.lit("there")) >= missing).select("sample_id", "feature_id", n.alias("trace_len"))


def trace_points(index: DataFrame, seed: int = 0) -> DataFrame:
    """(sample_id, feature_id, point_idx, time, value): a noisy wave for each trace."""
    p = index.where("trace_len > 0").select("sample_id", "feature_id", F.explode(F.sequence(F.lit(0), F.col("trace_len") - 1)).alias("point_idx"))
    s, f, k = F.col("sample_id"), F.col("feature_id"), F.col("point_idx")
    phase = hashed_uniform(seed, s, f, F.lit("phase")) * 2 * F.pi()
    value = F.sin(k * 0.1 * (1 + f % 5) + phase) + 0.1 * hashed_normal(seed, s, f, k)
    return p.select("sample_id", "feature_id", "point_idx", (k * 0.01).alias("time"), value.alias("value"))
