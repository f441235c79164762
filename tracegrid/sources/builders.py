"""Builders: a resumable session with its axes, from the first staged sample to a dataset that can be opened.

A builder's folder holds the axes and a session's batches. Opening the same folder again goes on where it was left;
what a writer that died has left behind counts for nothing and can be removed with ``recover``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid import axes
from tracegrid.errors import DataError, RequestError
from tracegrid.operators import checks
from tracegrid.schema import RAW, TRACE_INDEX, PointSchema
from tracegrid.sources import binary_blocks, block_dataset, scalar_store, storage, trace_store
from tracegrid.sources.session import Session


class _Builder:
    def __init__(self, spark: SparkSession, path: str, tables: dict, samples: DataFrame | None = None, features: DataFrame | None = None) -> None:
        """The axes are needed when a folder is opened for the first time, and are not replaced later."""
        self.spark, self.path = spark, path.rstrip("/")
        if not storage.exists(spark, f"{self.path}/axes.json"):
            if samples is None or features is None:
                raise RequestError(f"{path} is new and needs its axes")
            for df, axis in ((samples, "sample"), (features, "feature")):
                key = f"{axis}_key"
                axes.require_dense_ids(df, f"{axis}_id", key if key in df.columns else None)
                df.write.mode("overwrite").parquet(f"{self.path}/{axis}s-0")
            storage.write_json(spark, f"{self.path}/axes.json", {"samples": "samples-0", "features": "features-0"})
        self.session = Session(spark, f"{self.path}/stage", tables)

    def _axis(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{storage.read_json(self.spark, f'{self.path}/axes.json')[name]}")

    @property
    def samples(self) -> DataFrame:
        return self._axis("samples")

    @property
    def features(self) -> DataFrame:
        return self._axis("features")

    def update_features(self, extra: DataFrame, require_all: bool = False) -> None:
        """Add columns to the feature axis; those that it has may not be replaced. The old axis counts until the new one is whole."""
        named = storage.read_json(self.spark, f"{self.path}/axes.json")
        fresh = f"features-{int(named['features'].rpartition('-')[2]) + 1}"
        checks.enrich(self.features, extra, "feature_id", require_all).write.mode("overwrite").parquet(f"{self.path}/{fresh}")
        storage.write_json(self.spark, f"{self.path}/axes.json", named | {"features": fresh})

    def status(self) -> dict:
        return self.session.status(self.samples)

    def pending(self) -> DataFrame:
        return self.session.pending(self.samples.select(F.col("sample_id").cast("long").alias("sample_id")))

    def recover(self) -> list[str]:
        """Remove batches that were written but never committed, and name them. No writer may be at work."""
        known = {*self.session.committed(), *self.session.live()}
        left = sorted({b for t in ("done", *self.session.tables) for b in storage.names(self.spark, f"{self.session.path}/{t}")} - known)
        for b in left:
            for t in ("done", *self.session.tables):
                storage.remove(self.spark, f"{self.session.path}/{t}/{b}")
        return left

    def finish(self, batch: str = "all") -> None:
        """All samples must be staged; many batches become one."""
        if self.pending().head(1):
            raise DataError("some samples are still pending")
        self.session.compact(batch, self.samples)


class ScalarBuilder(_Builder):
    """Stages scalar cells and builds a scalar dataset."""

    def __init__(self, spark: SparkSession, path: str, samples: DataFrame | None = None, features: DataFrame | None = None) -> None:
        super().__init__(spark, path, {"cells": RAW}, samples, features)

    def write(self, batch: str, cells: DataFrame, samples: DataFrame | None = None) -> bool:
        return self.session.write(batch, samples, cells=cells)

    def build(self, out: str, y_cols: Sequence[str] = (), **options) -> scalar_store.ScalarDataset:
        self.finish()
        return scalar_store.build(self.session.table("cells"), self.samples, self.features, out, y_cols, **options)


class TraceBuilder(_Builder):
    """Stages traces, by tables or one at a time, and builds a sample-major dataset or feature-major blocks."""

    def __init__(self, spark: SparkSession, path: str, schema: PointSchema, samples: DataFrame | None = None, features: DataFrame | None = None) -> None:
        super().__init__(spark, path, {"index": TRACE_INDEX, "points": schema.points()}, samples, features)
        self.schema, self._held = schema, {}

    def write(self, batch: str, index: DataFrame, points: DataFrame, samples: DataFrame | None = None) -> bool:
        return self.session.write(batch, samples, index=index, points=points)

    def add_trace(self, sample_id: int, feature_id: int, columns: Mapping[str, Sequence]) -> None:
        """Hold one trace, empty or not, until its sample is committed."""
        if set(columns) != set(self.schema.names) or len({len(v) for v in columns.values()}) > 1:
            raise RequestError(f"a trace has the columns {self.schema.names}, all of one length")
        held = self._held.setdefault(int(sample_id), {})
        if int(feature_id) in held:
            raise RequestError(f"sample {sample_id} has feature {feature_id} already")
        held[int(feature_id)] = {n: list(columns[n]) for n in self.schema.names}

    def commit(self, sample_id: int) -> bool:
        """Stage what was added for a sample (a sample without traces counts as well) as a batch of its own; False if that is there already."""
        held = self._held.pop(int(sample_id), {})
        rows = [(int(sample_id), f, k, *v) for f, t in held.items() for k, v in enumerate(zip(*(t[n] for n in self.schema.names)))]
        index = [(int(sample_id), f, len(t[self.schema.names[0]])) for f, t in held.items()]
        made = [self.spark.createDataFrame(r, s) for r, s in ((index, TRACE_INDEX), (rows, self.schema.points()))]
        return self.write(f"sample-{int(sample_id)}", *made, samples=self.spark.createDataFrame([(int(sample_id),)], "sample_id long"))

    def build(self, out: str, **options) -> trace_store.TraceDataset:
        self.finish()
        return trace_store.build(self.session.table("index"), self.session.table("points"), self.schema, self.samples, self.features, out, **options)

    def build_blocks(self, out: str, dictionaries: DataFrame | None = None, **options) -> block_dataset.BlockDataset:
        self.finish()
        return block_dataset.build(self.session.table("index"), self.session.table("points"), self.schema, self.samples, self.features, out, dictionaries, **options)
