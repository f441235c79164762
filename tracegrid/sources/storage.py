"""Where datasets live: the folder shared by the cluster, JSON roots, and writes that leave a root last."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tracegrid.errors import DataError, NotFoundError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a session of one process may lack it and gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    own = getattr(spark.sparkContext, "_tracegrid_store", None)
    if own is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise DataError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.sparkContext._tracegrid_store = "file://" + tempfile.mkdtemp(prefix="tracegrid-store-")
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracegrid-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if there is no such folder."""
    fs, p = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """Written beside its place and then renamed, so that readers see all of it or nothing."""
    fs, p = _file(spark, path)
    _, new = _file(spark, f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(new, True)
    out.write(json.dumps(value, indent=1).encode())
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(new, p):
        raise DataError(f"{path} could not be put in place")


def read_json(spark: SparkSession, path: str) -> dict:
    if not exists(spark, path):
        raise NotFoundError(f"there is no {path}")
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_root(spark: SparkSession, path: str, kind: str, version: int) -> dict:
    root = read_json(spark, f"{path}/manifest.json")
    if (root.get("format"), root.get("version")) != (kind, version):
        raise DataError(f"{path} holds {root.get('format')} {root.get('version')}, not {kind} {version}")
    return root


def begin(spark: SparkSession, path: str, overwrite: bool) -> None:
    """Make room for a dataset. Its root goes first, so that one half removed or half written cannot be opened."""
    if exists(spark, f"{path}/manifest.json"):
        if not overwrite:
            raise DataError(f"{path} holds a dataset already")
        remove(spark, f"{path}/manifest.json")
    if exists(spark, path):
        for name in ("parts", "index", "points", "locator", "stats", "samples", "features"):
            remove(spark, f"{path}/{name}")


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df and read it back under the same schema."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
