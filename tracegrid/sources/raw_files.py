"""Raw cells in files of one sample each, with or without a sample_id column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.errors import DataError
from tracegrid.operators.scalar import clean_raw

#: The sample's number in a file's name.
FILE_NAME = r"sample_(\d+)"


def read_raw(spark: SparkSession, path: str, pattern: str = FILE_NAME) -> DataFrame:
    """(sample_id, feature_id, value). Files without a sample_id column take it from their own name or folder's name, so
    the column is a constant of each file; a file whose name has no number is a DataError once it is read."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    if "sample_id" not in rows.columns:
        number = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
        fault = F.raise_error(F.concat(F.lit("no sample number in "), F.col("_metadata.file_path")))
        rows = rows.withColumn("sample_id", F.when(number != "", number.cast("long")).otherwise(fault.cast("long")))
    missing = {"feature_id", "value"} - set(rows.columns)
    if missing:
        raise DataError(f"raw files lack {sorted(missing)}")
    return clean_raw(rows)
