"""The registered queries of the corpus operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm import bitplane, decontamination, exact_dedup, langid, licenses, packing, quality, simhash, toxicity, url_filter
from tracegrid.llm.common import id_bucket, materialise, read_table, scratch_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # a table without paths has no licence files; its stand-in paths tell rows apart, and nothing is inherited
    stand_in = F.concat_ws("/", F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan_licenses(docs, path=F.col("path") if "path" in docs.columns else stand_in)


def op4_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    bitplane.write_ids(read_table(spark, sf_dir, "documents"), path)
    return bitplane.read_documents(spark, path)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "digest-index"))
    found = exact_dedup.dedup_report(read_table(spark, sf_dir, "documents"), index)
    index.drop()  # the result reads the index's files, which stay
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _judged(docs: DataFrame, scored: DataFrame, modulus: int, held: int) -> DataFrame:
    held_out = id_bucket(F.col("doc_id"), modulus) == held
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(id_bucket(F.col("doc_id"), 5) != 0))
    return _judged(docs, toxicity.score(docs, model), 5, 0)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs.where(id_bucket(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    stats = materialise(quality.document_statistics(docs), "statistics")
    model = quality.train(stats, labels.where(id_bucket(F.col("doc_id"), 3) != 1))
    return _judged(docs, quality.score(stats, model), 3, 1)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_packing, op3_licenses, op4_bitplane, op5_exact_dedup, op6_toxicity, op7_url_filter, op8_language, op9_decontamination, op10_quality, pipeline)
    return {f.__name__: f for f in own}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    return {
        "op5_exact_dedup": f"""
            WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
            FROM t WINDOW w AS (PARTITION BY text_sha256)""",
        "op7_url_filter": f"""
            WITH rules(rule_host, rule_path, verdict) AS (VALUES {rules}),
            cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            parts AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
            hits AS (SELECT DISTINCT host, path, rule_host || rule_path AS rule, verdict FROM parts JOIN rules
                     ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
            best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM hits GROUP BY ALL)
            SELECT parts.page_id, parts.host, parts.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
            FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path""",
    }
