"""Persistent scalar grids: a feature-major dense table in parts, a locator, r2 sidecars, both axes and a JSON root."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid import axes
from tracegrid.errors import DataError, NotFoundError, TooLargeError
from tracegrid.operators import checks, scalar, selection, stats
from tracegrid.schema import DENSE, LOCATOR
from tracegrid.sources import storage

KIND, VERSION = "tracegrid-scalar", 1
#: Samples of one feature that a row gathers while the grid is filled: bounds the longest row.
SPAN = 4096
STATS = "feature_id int, part_id int, offset_in_part int, r2y double, n_y_overlap int, y_col string"


def dense_rows(raw: DataFrame, n_samples: int, n_features: int, per_part: int, tasks: int) -> DataFrame:
    """The full grid in (feature_id, sample_id) order within each task.

    Only sparse cells and one empty slot for each feature and SPAN samples are shuffled, by range, so a feature's
    cells lie together and a long feature is still split; the grid itself is filled in after the shuffle.
    """
    spark = raw.sparkSession
    spans = -(-n_samples // SPAN)
    cells = raw.select("feature_id", F.floor(F.col("sample_id") / SPAN).cast("long").alias("span"), F.struct("sample_id", "value").alias("c"))
    slot = F.lit(None).cast(cells.schema["c"].dataType)  # marks a span that may hold no cell
    slots = spark.range(n_features * spans).select(F.floor(F.col("id") / max(1, spans)).cast("int").alias("feature_id"), F.pmod("id", F.lit(max(1, spans))).alias("span"), slot.alias("c"))
    rows = cells.unionByName(slots).repartitionByRange(tasks, "feature_id", "span")
    got = rows.groupBy("feature_id", "span").agg(F.collect_list("c").alias("c"))
    first = F.col("span") * SPAN
    at = F.transform("c", lambda c: F.struct((c["sample_id"] - first).cast("int").alias("at"), c["value"].alias("value")))
    wide = got.select("feature_id", first.alias("first"), F.posexplode(scalar.slots(at, F.least(first + SPAN, F.lit(n_samples).cast("long")) - first)).alias("i", "cell"))
    cell = F.col("cell")
    out = wide.select("feature_id", (F.col("first") + F.col("i")).alias("sample_id"), cell.isNotNull().cast("short").alias("mask"), F.coalesce(cell, F.lit(float("nan"))).alias("value"))
    return out.withColumn("part_id", F.floor(F.col("feature_id") / per_part).cast("int")).sortWithinPartitions("part_id", "feature_id", "sample_id")


def build(raw: DataFrame, samples: DataFrame, features: DataFrame, path: str, y_cols: Sequence[str] = (), target_bytes: int = 32 << 20, per_part: int | None = None, overwrite: bool = False) -> ScalarDataset:
    """Write a dataset and open it. NULL and NaN cells are missing; ids outside the axes and repeated cells are DataErrors."""
    spark = raw.sparkSession
    n_samples, n_features = (axes.require_dense_ids(m, c, k if k in m.columns else None) for m, c, k in ((samples, "sample_id", "sample_key"), (features, "feature_id", "feature_key")))
    raw = scalar.clean_raw(raw)
    scalar.require_valid_cells(raw, n_samples, n_features)
    per_part = per_part or scalar.features_per_part(n_samples, target_bytes)
    storage.begin(spark, path, overwrite)
    tasks = max(1, -(-scalar.ROW_BYTES * n_samples * n_features // target_bytes))
    parts = dense_rows(raw, n_samples, n_features, per_part, tasks).write.partitionBy("part_id").mode("overwrite")
    # a row group of about the least features of a part, so that a feature is a small share of what a reader touches
    group = min(128 << 20, max(1 << 20, scalar.ROW_BYTES * n_samples * scalar.LEAST_FEATURES))
    parts.option("compression", "zstd").option("parquet.block.size", group).parquet(f"{path}/parts")
    for name, df in (("locator", scalar.locator(spark, n_features, n_samples, per_part)), ("samples", samples), ("features", features)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    stats.selection_stats(raw, features, samples, list(y_cols), per_part).write.partitionBy("y_col").mode("overwrite").parquet(f"{path}/stats")
    root = {"format": KIND, "version": VERSION, "n_samples": n_samples, "n_features": n_features, "features_per_part": per_part, "n_parts": -(-n_features // per_part), "y_cols": list(y_cols)}
    written = spark.read.schema(_part_schema()).parquet(f"{path}/parts").count() if n_samples and n_features else 0
    if written != n_samples * n_features:
        raise DataError(f"{written} cells were written, not {n_samples} x {n_features}")
    storage.write_json(spark, f"{path}/manifest.json", root)
    return ScalarDataset(spark, path)


def _part_schema():
    from pyspark.sql import types as T

    return T.StructType([*DENSE.fields, T.StructField("part_id", T.IntegerType())])


class ScalarDataset:
    """Lookups in a written grid; ids or keys name cells, request order and repeats are kept."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.root = spark, path, storage.read_root(spark, path, KIND, VERSION)
        self.n_samples, self.n_features, self.per_part = self.root["n_samples"], self.root["n_features"], self.root["features_per_part"]

    def schema(self) -> dict:
        return dict(self.root)

    @property
    def dense(self) -> DataFrame:
        """The grid. A dataset without cells has no files, hence the empty frame."""
        if not self.n_samples or not self.n_features:
            return self.spark.createDataFrame([], _part_schema())
        return self.spark.read.schema(_part_schema()).parquet(f"{self.path}/parts")

    @property
    def samples(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/samples")

    @property
    def features(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/features")

    @property
    def raw(self) -> DataFrame:
        return self.dense.where("mask = 1").select("sample_id", "feature_id", "value")

    def _ids(self, ids: Sequence[int] | None, keys: Sequence | None, axis: str) -> list[int]:
        axes.exactly_one(ids, keys, axis)
        if keys is None:
            return list(ids)
        meta = self.samples if axis == "sample" else self.features
        return axes.resolve_keys(meta, f"{axis}_key", f"{axis}_id", keys)

    def feature(self, feature_id: int) -> DataFrame:
        axes.check_range([feature_id], self.n_features, "feature")
        return scalar.feature_slice(self.dense, feature_id, self.per_part).select("feature_id", "sample_id", "present", "value")

    def sample(self, sample_id: int) -> DataFrame:
        axes.check_range([sample_id], self.n_samples, "sample")
        return scalar.sample_slice(self.dense, sample_id).select("feature_id", "sample_id", "present", "value")

    def cells(self, feature_ids=None, sample_ids=None, feature_keys=None, sample_keys=None, strict: bool = False, max_cells: int | None = None) -> DataFrame:
        """Features x samples. Strict requests, and those by key, fail on ids the grid lacks; others give present = false."""
        f, s = self._ids(feature_ids, feature_keys, "feature"), self._ids(sample_ids, sample_keys, "sample")
        if max_cells is not None and len(f) * len(s) > max_cells:
            raise TooLargeError(f"the request has more than {max_cells} cells")
        if strict:
            axes.check_range(f, self.n_features, "feature")
            axes.check_range(s, self.n_samples, "sample")
        return scalar.cells(self.dense, f, s, self.per_part)

    def rows(self, part_id: int, offsets: Sequence[int]) -> DataFrame:
        """The features at the given places of a part."""
        axes.check_range([part_id], self.root["n_parts"], "part")
        return scalar.part_rows(self.dense, part_id, offsets, self.per_part)

    def iter_cells(self, feature_ids: Sequence[int], sample_ids: Sequence[int], batch_size: int = 128, **kw) -> Iterator[DataFrame]:
        """cells() for batches of features, one frame each."""
        for k in range(0, len(feature_ids), batch_size):
            yield self.cells(feature_ids[k : k + batch_size], sample_ids, **kw)

    def decorate(self, rows: DataFrame) -> DataFrame:
        """Rows with the keys of their ids; ids without a key get null."""
        for axis, meta in (("feature", self.features), ("sample", self.samples)):
            if f"{axis}_id" in rows.columns and f"{axis}_key" in meta.columns:
                rows = rows.join(meta.select(F.col(f"{axis}_id").cast(rows.schema[f"{axis}_id"].dataType).alias(f"{axis}_id"), f"{axis}_key"), f"{axis}_id", "left")
        return rows

    def value(self, feature_id: int, sample_id: int, strict: bool = False) -> tuple[bool, float | None]:
        r = self.cells([feature_id], [sample_id], strict=strict).first()
        return r["present"], r["value"]

    def value_by_key(self, feature_key, sample_key) -> tuple[bool, float | None]:
        """Keys that the axes lack are NotFoundErrors."""
        r = self.cells(feature_keys=[feature_key], sample_keys=[sample_key]).first()
        return r["present"], r["value"]

    def stats(self, y_col: str) -> DataFrame:
        if y_col not in self.root["y_cols"]:
            raise NotFoundError(f"there are no statistics of {y_col!r}")
        return self.spark.read.schema(STATS).parquet(f"{self.path}/stats").where(F.col("y_col") == y_col)  # reads the target's folder alone

    def top_features(self, y_col: str, k: int = 256) -> DataFrame:
        return stats.top_features(self.stats(y_col), k)

    def locate(self, feature_id: int) -> dict | None:
        """Where a feature's rows are, or None."""
        r = self.spark.read.schema(LOCATOR).parquet(f"{self.path}/locator").where(F.col("feature_id") == feature_id).first()
        return r.asDict() if r else None

    def select_features(self, options: selection.SelectionOptions) -> DataFrame:
        """(rank, feature_id, r2y, n_y_overlap): candidates come from the sidecar, only their parts are read for pairs."""
        ranked = selection.candidates(self.stats(options.y_col), options)
        return selection.staged(self.raw, ranked, options)

    def violations(self) -> DataFrame:
        """(fault, detail) for repeated or absent cells, masks at odds with values and ids in the wrong part; no rows, no faults."""
        d = self.dense
        repeated = checks.duplicates(d, ["feature_id", "sample_id"]).select(F.lit("repeated cell").alias("fault"), F.to_json(F.struct("feature_id", "sample_id")).alias("detail"))
        counts = d.groupBy("feature_id").agg(F.count("*").alias("n"))
        short = self.features.select(F.col("feature_id").cast("int").alias("feature_id")).join(counts, "feature_id", "full_outer").where(F.coalesce("n", F.lit(0)) != self.n_samples)
        short = short.select(F.lit("cells of a feature").alias("fault"), F.to_json(F.struct("feature_id", "n")).alias("detail"))
        odd = d.where(((F.col("mask") == 1) == F.isnan("value")) | ~F.col("mask").isin(0, 1) | (F.col("part_id") != F.floor(F.col("feature_id") / self.per_part)))
        odd = odd.select(F.lit("mask or part").alias("fault"), F.to_json(F.struct("feature_id", "sample_id", "mask", "part_id")).alias("detail"))
        return repeated.unionByName(short).unionByName(odd)
