"""Shared plumbing of the corpus operators: shared storage, scratch tables, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII letters that lower-casing changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session that runs in one process may lack it; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    own = getattr(spark.sparkContext, "_tracegrid_shared", None)
    if own is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.sparkContext._tracegrid_shared = "file://" + tempfile.mkdtemp(prefix="tracegrid-")
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_dir(spark)}/tracegrid-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back; this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class SharedFile:
    """A file in the shared folder, written by the driver through Spark's own file systems, so on whatever storage that is."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, self.path = spark.sparkContext._jvm, path
        where = jvm.org.apache.hadoop.fs.Path(path)
        self._out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)

    def write(self, raw: bytes, block: int = 4 << 20) -> None:
        for at in range(0, len(raw), block):
            self._out.write(bytearray(raw[at : at + block]))

    def close(self) -> None:
        self._out.close()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, unless their path already has it."""
    root = Path(__file__).resolve().parents[2]
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if str(root) in on_path or getattr(sc, "_tracegrid_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="tracegrid-code-")) / "tracegrid_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "tracegrid").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._tracegrid_shipped = True


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; null stays null."""
    return F.translate(c, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """XXH64 of a text (null: empty): with the id, what tells a row from others under the same id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(c: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo modulus: the rule that splits rows for learning and testing."""
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus))


def sample_at_most(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """About `most` rows at the utmost, chosen by a hash of the id: the stated bound of what a model learns from.

    All rows stay if there are no more than `most`.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * most / n))
