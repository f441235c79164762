"""Exact deduplication against a persistent digest index, bucketed and sorted by hash. DataFrame functions only.

Empty table: empty results, and the index stays as it is. Null text counts as empty text. Rows that repeat a
doc_id with an equal text are one document: the report judges them alike, the filter passes one of them on. A doc_id
that comes with several texts is judged by each text. A null doc_id loses to any other id; where a text has only null
ids, the report keeps those rows and the filter passes one on. Other columns are ignored by the report and passed on.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm.common import ascii_lower, materialise, scratch_path


def text_digest(text: Column) -> Column:
    """SHA-256 of the text after lower-casing A-Z, as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """One row for each text seen so far: (digest, keep_id, group_size), in buckets sorted by digest.

    The table lives at `path` and is registered in the session's catalog under a name derived from it, so a later
    session opens it by constructing the class with the same path and number of buckets. `group_size` is the
    number of rows that held the text in the batch that brought it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + _table_suffix(path)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        """The index by its buckets: joins on digest need no shuffle of it."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def plain(self) -> DataFrame:
        """The index without its buckets: a join deals it out anew, so that a hot digest's rows can be split."""
        return self.spark.read.schema("digest BINARY, keep_id BIGINT, group_size BIGINT").parquet(self.path)

    def add(self, digests: DataFrame) -> None:
        """Append the texts of (doc_id, digest) that the index lacks; of equal texts the largest doc_id counts."""
        groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        fresh = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        # one file a bucket and append
        fresh.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest").write.insertInto(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _table_suffix(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:20]


def dedup_report(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add docs to the index; for each row (doc_id, digest, keep_id, group_size, kept)."""
    digests = materialise(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    index.add(digests)
    both = digests.join(index.plain().hint("merge"), "digest")
    return both.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat a doc_id (or lack one) and a text, any one."""
    own_index = index or DigestIndex(docs.sparkSession, scratch_path(docs.sparkSession, "digest-index"))
    found = dedup_report(docs, own_index, id_col, text_col).groupBy("doc_id", "digest").agg(F.max("kept").alias("__kept"), F.count("*").alias("n"))
    marked = materialise(found.where("not __kept or n > 1").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "__kept"), "marked")
    if index is None:
        own_index.drop()  # the files stay with the other intermediate tables; the session's catalog is left as it was
    marked = marked.hint("merge")  # it grows with the corpus, as docs do
    own = "__own_digest"
    while own in docs.columns:
        own += "_"
    rows = docs.withColumn(own, text_digest(F.col(text_col)))

    def same(other: DataFrame) -> Column:
        return rows[id_col].eqNullSafe(other["__id"]) & (rows[own] == other["__digest"])

    out = rows.join(marked, same(marked), "left_anti")
    repeats = marked.where(marked["__kept"])
    if not repeats.isEmpty():
        out = out.unionByName(rows.join(repeats, same(repeats), "left_semi").dropDuplicates([id_col, own]))
    return out.drop(own)
