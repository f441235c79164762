"""Feature-major blocks by ids or keys, with their axes and categorical dictionaries beside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid import axes
from tracegrid.errors import DataError, NotFoundError, RequestError
from tracegrid.operators import checks
from tracegrid.schema import PointSchema
from tracegrid.sources import binary_blocks, storage


def save_axes(uri: str, samples: DataFrame, features: DataFrame, dictionaries: DataFrame | None = None) -> None:
    """Write the axes (sample_id, sample_key), (feature_id, feature_key) and dictionaries (column_name, code, label) of a binary dataset."""
    axes.require_dense_ids(samples, "sample_id", "sample_key")
    axes.require_dense_ids(features, "feature_id", "feature_key")
    none = samples.sparkSession.createDataFrame([], "column_name string, code int, label string")
    for name, df in (("samples", samples), ("features", features), ("dictionaries", none if dictionaries is None else dictionaries)):
        df.write.mode("overwrite").parquet(f"{uri}/axes/{name}")


def build(index: DataFrame, points: DataFrame, schema: PointSchema, samples: DataFrame, features: DataFrame, uri: str, dictionaries: DataFrame | None = None, overwrite: bool = False, **options) -> BlockDataset:
    """Write blocks with their axes, and open them. The root, written last, goes first if a dataset is replaced."""
    spark = index.sparkSession
    if storage.exists(spark, f"{uri}/{binary_blocks.ROOT}"):
        if not overwrite:
            raise DataError(f"{uri} holds a dataset already")
        storage.remove(spark, f"{uri}/{binary_blocks.ROOT}")
        storage.remove(spark, f"{uri}/{binary_blocks.FOLDER}")
    save_axes(uri, samples, features, dictionaries)
    binary_blocks.write(index, points, schema, samples.count(), features.count(), uri, **options)
    return BlockDataset(spark, uri)


class BlockDataset:
    """Lookups in a written binary dataset; strict requests, and those by key, fail on what the axes lack."""

    def __init__(self, spark: SparkSession, uri: str) -> None:
        self.spark, self.uri = spark, uri

    def has_axes(self) -> bool:
        return storage.exists(self.spark, f"{self.uri}/axes/samples/_SUCCESS") and storage.exists(self.spark, f"{self.uri}/axes/features/_SUCCESS")

    def _axis(self, axis: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.uri}/axes/{axis}s")

    def schema(self) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in binary_blocks.read(self.spark, self.uri).schema.fields[4:]]

    def dictionaries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.uri}/axes/dictionaries")

    def locate(self, feature_id: int) -> dict | None:
        """The shard of a feature and the run of index records that are its blocks, or None."""
        root = storage.read_json(self.spark, f"{self.uri}/{binary_blocks.ROOT}")
        for s in root["shards"]:
            if s["feature_id_start"] <= feature_id <= s["feature_id_end"]:
                first = (feature_id - s["feature_id_start"]) * root["blocks_per_feature"]
                return {"feature_id": feature_id, "shard_id": s["shard_id"], "first_record": first, "n_records": root["blocks_per_feature"], "blocks_index_name": s["blocks_index_name"]}
        return None

    def has(self, axis: str, key) -> bool:
        """Whether the axis ("feature" or "sample") has a key."""
        return bool(self._axis(axis).where(F.col(f"{axis}_key") == str(key)).head(1))

    def _ids(self, axis: str, ids: Sequence[int] | None, keys: Sequence | None, strict: bool) -> list[int]:
        axes.exactly_one(ids, keys, axis)
        if keys is not None:
            if not self.has_axes():
                raise RequestError(f"{self.uri} has no keys")
            return axes.resolve_keys(self._axis(axis), f"{axis}_key", f"{axis}_id", keys)
        if strict:
            axes.check_range(ids, self._axis(axis).count(), axis)
        return list(ids)

    def traces(self, feature_ids=None, sample_ids=None, feature_keys=None, sample_keys=None, strict: bool = False) -> DataFrame:
        """Features x samples as (feature_ordinal, sample_ordinal, feature_id, sample_id, present, trace_len, columns...): missing ones have no points."""
        f, s = self._ids("feature", feature_ids, feature_keys, strict), self._ids("sample", sample_ids, sample_keys, strict)
        found = binary_blocks.read(self.spark, self.uri, sorted(set(f)), sorted(set(s))).drop("flags")
        wanted = axes.request(self.spark, f, "feature_id", "int").withColumnRenamed("ordinal", "feature_ordinal")
        wanted = wanted.crossJoin(F.broadcast(axes.request(self.spark, s, "sample_id", "long").withColumnRenamed("ordinal", "sample_ordinal")))  # as many rows as were asked for
        out = wanted.join(found, ["feature_id", "sample_id"], "left")
        columns = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in found.columns[3:]]
        return out.select("feature_ordinal", "sample_ordinal", "feature_id", "sample_id", F.col("trace_len").isNotNull().alias("present"), F.coalesce("trace_len", F.lit(0)).alias("trace_len"), *columns)

    def trace(self, feature_key, sample_key) -> dict:
        """One trace by keys."""
        return self.traces(feature_keys=[feature_key], sample_keys=[sample_key]).first().asDict()

    def labels(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows with a categorical column's codes turned into labels (null for 0 and codes without one)."""
        own = {r["code"]: r["label"] for r in self.dictionaries().where(F.col("column_name") == column).collect()}
        if not own:
            raise NotFoundError(f"there is no dictionary of {column!r}")
        table = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
        return rows.withColumn(column, F.transform(column, lambda c: F.try_element_at(table, c.cast("int"))))

    def violations(self) -> DataFrame:
        """(fault, detail): traces outside the axes, repeated ones, and lengths at odds with their columns; no rows, no faults."""
        t = binary_blocks.read(self.spark, self.uri)
        s, f = (self._axis(a).agg(F.count("*")).first()[0] for a in ("sample", "feature"))
        outside = t.where((F.col("sample_id") < 0) | (F.col("sample_id") >= s) | (F.col("feature_id") < 0) | (F.col("feature_id") >= f))
        odd = t.where(F.greatest(*[F.size(c) != F.col("trace_len") for c in t.columns[4:]], F.lit(False)) | ((F.col("trace_len") == 0) != (F.col("flags") == 3)))
        twice = checks.duplicates(t, ["sample_id", "feature_id"])
        say = lambda df, fault: df.select(F.lit(fault).alias("fault"), F.to_json(F.struct("sample_id", "feature_id")).alias("detail"))
        return say(outside, "outside the axes").unionByName(say(odd, "length or flag")).unionByName(say(twice, "repeated trace"))
