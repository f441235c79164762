"""Persistent traces, sample-major: points in parts by sample range, an index that tells empty from missing, a JSON root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrid import axes
from tracegrid.errors import DataError, RequestError
from tracegrid.functions.temporal import format_ns_array
from tracegrid.functions.values import finite_or_null_array, in_unsigned_range
from tracegrid.operators import checks, traces
from tracegrid.schema import TRACE_INDEX, UNSIGNED, PointColumn, PointSchema
from tracegrid.sources import storage

KIND, VERSION = "tracegrid-traces", 1
PART = T.StructField("part_id", T.IntegerType())


def _require_sound(index: DataFrame, points: DataFrame, schema: PointSchema, n_samples: int, n_features: int) -> None:
    bad = F.lit(False)
    for c in schema.columns:
        bad = bad | F.col(c.name).isNull()
        if c.storage in UNSIGNED and c.logical != "categorical":
            bad = bad | ~in_unsigned_range(F.col(c.name), c.storage)
    if points.where(F.coalesce(bad, F.lit(True))).head(1):
        raise DataError("a point is null or outside the range of its storage type")
    cell = index.groupBy(*traces.CELL).agg(F.count("*").alias("n")).where(~F.col("sample_id").between(0, n_samples - 1) | ~F.col("feature_id").between(0, n_features - 1) | (F.col("n") > 1))
    if cell.head(1):
        raise DataError("a trace is repeated or outside the axes")
    if checks.length_mismatches(index, points).head(1):
        raise DataError("a trace's points are not as many as its length")
    w = points.groupBy(*traces.CELL).agg(F.count("*").alias("n"), F.countDistinct("point_idx").alias("d"), F.min("point_idx").alias("a"), F.max("point_idx").alias("b"))
    if w.where("n != d OR a != 0 OR b != n - 1").head(1):
        raise DataError("point_idx is not 0..n-1 in some trace")


def build(index: DataFrame, points: DataFrame, schema: PointSchema, samples: DataFrame, features: DataFrame, path: str, rows_per_part: int = 10_000_000, rows_per_file: int = 4_000_000, overwrite: bool = False) -> TraceDataset:
    """Write a dataset and open it. Parts are runs of as many samples as hold about rows_per_part points on average.

    Files are cut by range over (sample, feature, point), so a sample with very many points is spread over tasks.
    """
    spark = points.sparkSession
    want = ["sample_id", "feature_id", "point_idx", *schema.names]
    if set(points.columns) != set(want):
        raise DataError(f"points have columns {points.columns}, not {want}")
    n_samples, n_features = (axes.require_dense_ids(m, c, k if k in m.columns else None) for m, c, k in ((samples, "sample_id", "sample_key"), (features, "feature_id", "feature_key")))
    points = points.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.points()])
    index = index.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRACE_INDEX])
    _require_sound(index, points, schema, n_samples, n_features)
    n_points = points.count()
    per_part = max(1, int(n_samples * min(1, rows_per_part / max(1, n_points))))
    storage.begin(spark, path, overwrite)
    part = F.floor(F.col("sample_id") / per_part).cast("int").alias("part_id")
    for name, df, keys in (("points", points, ["sample_id", "feature_id", "point_idx"]), ("index", index, ["sample_id", "feature_id"])):
        n = max(1, -(-(n_points if name == "points" else index.count()) // rows_per_file))
        df.repartitionByRange(n, *keys).select("*", part).sortWithinPartitions("part_id", *keys).write.partitionBy("part_id").mode("overwrite").parquet(f"{path}/{name}")
    samples.write.mode("overwrite").parquet(f"{path}/samples")
    features.write.mode("overwrite").parquet(f"{path}/features")
    columns = [{"name": c.name, "storage": c.storage, "logical": c.logical} for c in schema.columns]
    root = {"format": KIND, "version": VERSION, "n_samples": n_samples, "n_features": n_features, "samples_per_part": per_part, "n_points": n_points, "point_schema": columns}
    storage.write_json(spark, f"{path}/manifest.json", root)
    return TraceDataset(spark, path)


class TraceDataset:
    """Requests for written traces, by ids or keys; results are in (sample_id, feature_id) order."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.root = spark, path, storage.read_root(spark, path, KIND, VERSION)
        self.point_schema = PointSchema(tuple(PointColumn(c["name"], c["storage"], c["logical"]) for c in self.root["point_schema"]))

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        whole = T.StructType([*schema.fields, PART])
        if len([n for n in storage.names(self.spark, f"{self.path}/{name}") if n.startswith("part_id=")]) == 0:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.path}/{name}")

    @property
    def index(self) -> DataFrame:
        return self._table("index", TRACE_INDEX)

    @property
    def points(self) -> DataFrame:
        return self._table("points", self.point_schema.points())

    @property
    def samples(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/samples")

    @property
    def features(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/features")

    def schema(self) -> dict:
        return dict(self.root)

    def _request(self, sample_ids, sample_keys, feature_ids, feature_keys) -> tuple[list[int], list[int] | None]:
        axes.exactly_one(sample_ids, sample_keys, "sample")
        s = list(sample_ids) if sample_keys is None else axes.resolve_keys(self.samples, "sample_key", "sample_id", sample_keys)
        if feature_ids is not None and feature_keys is not None:
            raise RequestError("give feature ids or feature keys, not both")
        f = list(feature_ids) if feature_ids is not None else axes.resolve_keys(self.features, "feature_key", "feature_id", feature_keys) if feature_keys is not None else None
        axes.check_range(s, self.root["n_samples"], "sample")
        axes.check_range(f or [], self.root["n_features"], "feature")
        return s, f

    def _pruned(self, rows: DataFrame, sample_ids: list[int]) -> DataFrame:
        return rows.where(F.col("part_id").isin(sorted({i // self.root["samples_per_part"] for i in sample_ids}))).drop("part_id")

    def get_traces(self, sample_ids=None, sample_keys=None, feature_ids: Sequence[int] | None = None, feature_keys=None, include_missing: bool = False, max_traces: int | None = None, temporal_format: str = "raw_ns", finite: bool = False) -> DataFrame:
        """(sample_id, feature_id, trace_len, complete, columns, present). ``finite`` puts null for NaN and infinities."""
        s, f = self._request(sample_ids, sample_keys, feature_ids, feature_keys)
        out = traces.get_traces(self._pruned(self.index, s), self._pruned(self.points, s), self.point_schema.names, s, f, include_missing, max_traces)
        for c in self.point_schema.columns:
            if c.logical in ("timestamp_ns", "timedelta_ns"):
                out = out.withColumn(c.name, format_ns_array(F.col(c.name), c.logical, temporal_format))
            elif finite and c.storage == "float64":
                out = out.withColumn(c.name, finite_or_null_array(F.col(c.name)))
        return out

    def count_traces(self, sample_ids=None, sample_keys=None, feature_ids=None, feature_keys=None, include_missing: bool = False) -> int:
        s, f = self._request(sample_ids, sample_keys, feature_ids, feature_keys)
        return traces.count_traces(self._pruned(self.index, s), s, f, include_missing)

    def get_traces_json(self, layout: str = "nested", **request) -> DataFrame:
        if layout not in ("nested", "flat"):
            raise RequestError(f"unknown layout {layout!r}")
        found = self.get_traces(**({"finite": True, "temporal_format": "iso"} | request))
        return (traces.layout_nested if layout == "nested" else traces.layout_flat)(found, self.point_schema.names)

    def violations(self) -> DataFrame:
        """(sample_id, feature_id, fault): repeated index rows, lengths that points do not bear out, rows in the wrong part."""
        i, p = self.index, self.points
        repeated = checks.duplicates(i, traces.CELL).select(*traces.CELL, F.lit("repeated trace").alias("fault"))
        lengths = checks.length_mismatches(i.drop("part_id"), p).select(*traces.CELL, F.lit("length").alias("fault"))
        wrong = [d.where(F.col("part_id") != F.floor(F.col("sample_id") / self.root["samples_per_part"])).select(*traces.CELL, F.lit("part").alias("fault")) for d in (i, p)]
        return repeated.unionByName(lengths).unionByName(wrong[0]).unionByName(wrong[1])
