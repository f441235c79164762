"""The grid's axes and cells drawn from the star-schema tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.functions.temporal import ntz_to_ns

DIMS, PRIORITIES = 64, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
METRICS = ("count", "sum", "max")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding dimensions as features, with NULL and NaN cells by rule."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("feature_id", "v"))
    s, f = F.col("sample_id"), F.col("feature_id")
    value = F.when((s * 7 + f * 13) % 11 == 0, None).when((s + f) % 29 == 0, float("nan")).otherwise(F.col("v").cast("double"))
    return cells.select("sample_id", "feature_id", value.alias("value"))


EMB_RAW = """emb_raw AS (SELECT vec_id AS sample_id, CAST(i - 1 AS INT) AS feature_id,
  CASE WHEN (vec_id * 7 + (i - 1) * 13) % 11 = 0 THEN NULL WHEN (vec_id + i - 1) % 29 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(embedding[i] AS DOUBLE) END AS value
  FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)),
emb AS (SELECT * FROM emb_raw WHERE value IS NOT NULL AND NOT isnan(value))"""


def emb_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: y has nulls and NaNs, y_alt is complete, y_const is constant."""
    v = F.col("vec_id")
    y = F.when(v % 17 == 0, None).when(v % 19 == 0, float("nan")).otherwise(F.col("label").cast("double"))
    return table(spark, sf_dir, "embeddings").select(v.alias("sample_id"), y.alias("y"), (F.col("label") * F.col("label")).cast("double").alias("y_alt"), F.lit(7.0).alias("y_const"))


EMB_Y = """ys AS (
  SELECT vec_id AS sample_id, 'y' AS y_col, CAST(label AS DOUBLE) AS y FROM embeddings WHERE vec_id % 17 <> 0 AND vec_id % 19 <> 0
  UNION ALL SELECT vec_id, 'y_alt', CAST(label * label AS DOUBLE) FROM embeddings
  UNION ALL SELECT vec_id, 'y_const', 7.0 FROM embeddings)"""


def emb_features(spark: SparkSession) -> DataFrame:
    return spark.range(DIMS).select(F.col("id").cast("int").alias("feature_id"), F.format_string("dim_%02d", "id").alias("feature_key"))


def cust_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order metrics of customers by priority: sparse and partly redundant."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").cast("double").alias("count"), F.sum("o_totalprice").alias("sum"), F.max("o_totalprice").alias("max"))
    prio = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("o_orderpriority")) - 1
    cells = F.array(*[F.struct((prio * 3 + k).cast("int").alias("feature_id"), F.col(m).alias("value")) for k, m in enumerate(METRICS)])
    return o.select(F.col("o_custkey").alias("sample_id"), F.explode(cells).alias("c")).select("sample_id", "c.feature_id", "c.value")


CUST_RAW = """cust_agg AS (SELECT o_custkey AS sample_id, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS p, CAST(count(*) AS DOUBLE) AS a, sum(o_totalprice) AS b, max(o_totalprice) AS c
  FROM orders GROUP BY ALL),
cust AS (SELECT sample_id, p * 3 AS feature_id, a AS value FROM cust_agg UNION ALL SELECT sample_id, p * 3 + 1, b FROM cust_agg UNION ALL SELECT sample_id, p * 3 + 2, c FROM cust_agg)"""


def cust_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_name").alias("sample_key"), F.col("c_acctbal").alias("y"))


def cust_features(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i * 3 + k, f"{p}/{m}") for i, p in enumerate(PRIORITIES) for k, m in enumerate(METRICS)], "feature_id int, feature_key string")


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (sample_id = user, feature_id = type, ts in ns, value); traces are the points with value >= 200, so many are empty."""
    e = table(spark, sf_dir, "events")
    f = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    return e.select(F.col("user_id").alias("sample_id"), f.cast("int").alias("feature_id"), ntz_to_ns(F.col("ts")).alias("ts"), "value", "event_id")


EVENTS = """ev AS (SELECT user_id AS sample_id, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INT) AS feature_id,
  epoch_us(ts) * 1000 AS ts, value, event_id FROM events),
pts AS (SELECT sample_id, feature_id, CAST(row_number() OVER (PARTITION BY sample_id, feature_id ORDER BY ts, event_id) - 1 AS INT) AS point_idx, ts, value
  FROM ev WHERE value >= 200),
idx AS (SELECT c.sample_id, c.feature_id, CAST(count(p.sample_id) AS INT) AS trace_len FROM (SELECT DISTINCT sample_id, feature_id FROM ev) c
  LEFT JOIN pts p ON c.sample_id = p.sample_id AND c.feature_id = p.feature_id GROUP BY ALL)"""
