"""The two axes: dense ids, external keys, and requests that name either."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.errors import DataError, NotFoundError, RequestError


def assign_dense_ids(keys: DataFrame, key_col: str, id_col: str, kind: str = "long") -> DataFrame:
    """Ids 0..N-1 in key order. Axis tables only: they are ordered in one task, like any numbering without gaps."""
    order = F.row_number().over(Window.orderBy(F.col(key_col))) - 1
    return keys.withColumn(id_col, order.cast(kind))


def dense_id_report(meta: DataFrame, id_col: str, key_col: str | None = None) -> DataFrame:
    """One row (n_rows, n_ids, min_id, max_id, n_keys, null_keys, ok): ids must be 0..N-1, keys non-null and unique."""
    key = F.col(key_col).cast("string") if key_col else F.col(id_col).cast("string")
    a = meta.agg(
        F.count("*").alias("n_rows"), F.countDistinct(id_col).alias("n_ids"), F.min(id_col).cast("long").alias("min_id"), F.max(id_col).cast("long").alias("max_id"),
        F.countDistinct(key).alias("n_keys"), F.count(F.when(key.isNull(), 1)).alias("null_keys"),
    )
    n = F.col("n_rows")
    dense = (n == 0) | ((F.col("n_ids") == n) & (F.col("min_id") == 0) & (F.col("max_id") == n - 1))
    return a.withColumn("ok", dense & (F.col("n_keys") == n) & (F.col("null_keys") == 0))


def require_dense_ids(meta: DataFrame, id_col: str, key_col: str | None = None) -> int:
    """The number of rows; DataError if ids or keys break the rules."""
    r = dense_id_report(meta, id_col, key_col).first()
    if not r["ok"]:
        raise DataError(f"{id_col} must be 0..N-1 and keys unique and non-null: {r.asDict()}")
    return r["n_rows"]


def resolve_keys(meta: DataFrame, key_col: str, id_col: str, keys: Sequence) -> list[int]:
    """Ids in the order of the keys; NotFoundError names the first unknown one. Keys are compared as strings."""
    wanted = [str(k) for k in keys]
    rows = meta.where(F.col(key_col).cast("string").isin(list(dict.fromkeys(wanted)))).select(F.col(key_col).cast("string").alias("k"), F.col(id_col).alias("i")).collect()
    found = {r["k"]: r["i"] for r in rows}
    for k in wanted:
        if k not in found:
            raise NotFoundError(f"unknown key {k!r}")
    return [found[k] for k in wanted]


def exactly_one(ids: Sequence | None, keys: Sequence | None, what: str) -> None:
    if (ids is None) == (keys is None):
        raise RequestError(f"give exactly one of {what} ids and {what} keys")
    if not len(ids if ids is not None else keys):
        raise RequestError(f"the request names no {what}")


def check_range(ids: Sequence[int], n: int, what: str) -> None:
    for i in ids:
        if not 0 <= i < n:
            raise NotFoundError(f"{what} id {i} is outside 0..{n - 1}")


def request(spark, ids: Sequence[int], id_col: str, kind: str) -> DataFrame:
    """A request as rows (ordinal, id): results keep its order and its repeats."""
    return spark.createDataFrame(list(enumerate(ids)), f"ordinal int, {id_col} {kind}")
