"""Resumable staging: batches of whole samples, each committed once, in any order and from any number of writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracegrid.errors import DataError, RequestError
from tracegrid.sources import storage

DONE = T.StructType([T.StructField("sample_id", T.LongType())])


class Session:
    """Tables staged under ``path``. A batch counts once its JSON commit exists; whatever else lies there is ignored.

    A batch name that is committed already is skipped, so a repeated or restarted writer adds nothing. Two batches
    may hold one sample if their writers run at the same time; building from the stage then finds repeated cells.
    Many small batches can be compacted into one: a single JSON file puts it in the place of those that it holds.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, T.StructType]) -> None:
        if not {"done", "commits", "compactions"}.isdisjoint(tables):
            raise RequestError("done, commits and compactions are names of the session")
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables

    def _names(self, folder: str) -> list[str]:
        return [n[: -len(".json")] for n in storage.names(self.spark, f"{self.path}/{folder}") if n.endswith(".json")]

    def committed(self) -> list[str]:
        """Every batch that was committed, also those that have been compacted since."""
        return self._names("commits")

    def live(self) -> list[str]:
        """The batches to read: committed ones, with compacted ones in the place of those that they hold."""
        merged = self._names("compactions")
        held = {b for m in merged for b in storage.read_json(self.spark, f"{self.path}/compactions/{m}.json")["holds"]}
        return sorted({*self.committed(), *merged} - held)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        paths = [f"{self.path}/{name}/{b}" for b in self.live()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        return self._read(name, self.tables[name])

    def completed(self) -> DataFrame:
        return self._read("done", DONE).distinct()

    def pending(self, samples: DataFrame) -> DataFrame:
        return samples.join(self.completed(), "sample_id", "left_anti")

    def write(self, batch: str, samples: DataFrame | None = None, *, skip_completed: bool = True, **rows: DataFrame) -> bool:
        """Stage one batch: the samples that it completes, and their rows of each table. False if it was there already.

        With skip_completed, samples of earlier batches are left out. Without ``samples`` those in the rows count.
        """
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise RequestError(f"bad name of a batch: {batch!r}")
        if set(rows) != set(self.tables):
            raise RequestError(f"a batch needs the tables {sorted(self.tables)}")
        if batch in {*self.committed(), *self._names("compactions")}:
            return False
        for name, df in rows.items():
            want = self.tables[name].names
            if set(df.columns) != set(want):
                raise DataError(f"table {name} has columns {df.columns}, not {want}")
        if samples is None:
            for df in rows.values():
                ids = df.select("sample_id")
                samples = ids if samples is None else samples.unionByName(ids)
        ids = samples.select(samples["sample_id"].cast("long").alias("sample_id")).distinct()
        if skip_completed:
            ids = ids.join(self.completed(), "sample_id", "left_anti")
        ids.write.mode("overwrite").parquet(f"{self.path}/done/{batch}")
        fresh = self.spark.read.schema(DONE).parquet(f"{self.path}/done/{batch}")
        for name, df in rows.items():
            cast = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in self.tables[name]])
            cast.join(fresh, "sample_id", "left_semi").write.mode("overwrite").parquet(f"{self.path}/{name}/{batch}")
        storage.write_json(self.spark, f"{self.path}/commits/{batch}.json", {"batch": batch})
        return True

    def compact(self, batch: str, samples: DataFrame | None = None, rows_per_file: int = 4_000_000, cleanup: bool = False) -> bool:
        """Rewrite all live batches as one, in files of about rows_per_file rows cut by range over the id columns.

        With ``samples`` none of them may be pending. False if there is nothing to merge or the name is taken. What a
        compaction that died has written is not read and is overwritten by the next one of its name. ``cleanup``
        removes the merged batches' files, so no reader may be at work on them; their names stay known.
        """
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise RequestError(f"bad name of a batch: {batch!r}")
        if samples is not None and self.pending(samples).head(1):
            raise DataError("some samples are still pending")
        old = self.live()
        if len(old) < 2 or batch in {*self.committed(), *self._names("compactions")}:
            return False
        for name, schema in {**self.tables, "done": DONE}.items():
            paths = [f"{self.path}/{name}/{b}" for b in old]
            rows = self.spark.read.schema(schema).parquet(*paths)
            rows = rows.distinct() if name == "done" else rows
            keys = [c for c in ("sample_id", "feature_id", "point_idx") if c in schema.names]
            files = max(1, -(-rows.count() // rows_per_file))
            rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{self.path}/{name}/{batch}")
        storage.write_json(self.spark, f"{self.path}/compactions/{batch}.json", {"batch": batch, "holds": old})
        if cleanup:
            for name in ("done", *self.tables):
                for b in old:
                    storage.remove(self.spark, f"{self.path}/{name}/{b}")
        return True

    def status(self, samples: DataFrame) -> dict:
        n, left = samples.count(), self.pending(samples).count()
        return {"n_samples": n, "completed": n - left, "pending": left, "batches": len(self.committed())}
