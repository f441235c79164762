"""A training corpus in five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm import decontamination, exact_dedup, langid, packing, similar
from tracegrid.llm.common import id_bucket, materialise, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go; any other stays, junk and languages not learned too. The model learns from documents with a crc32 modulo 4 other than 2."""
    model = langid.train(docs.where(id_bucket(F.col("doc_id"), 4) != 2))
    return langid.keep_known(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; a null id loses to any other, and of repeated rows one stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more on five-word shingles the one with the smallest doc_id stays; a null id loses to any other."""
    return similar.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row judged by its own text, with or without an id."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in training sequences. Null and empty texts are documents of the end id alone."""
    return packing.pack(docs)


#: Each stage passes an empty table on as an empty one, keeps columns that it does not know whatever their names, and
#: reads texts of any length whole; its module's docstring says what else it does with ties and repeats.
STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminated", decontaminated), ("packed", packed)]

#: SQL can't express language models, fingerprints, alignment or tokenizers; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
