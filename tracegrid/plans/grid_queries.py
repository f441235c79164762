"""Registered queries of the grid operators with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracegrid import axes
from tracegrid.functions import temporal, values
from tracegrid.operators import blocks, checks, scalar, selection, stats, traces
from tracegrid.plans import fixtures as fx
from tracegrid.schema import RAW, PointColumn, PointSchema
from tracegrid.sources import binary_blocks, scalar_store, session, storage, trace_store
from tracegrid.streaming import ingest

PER_PART, PER_BLOCK, DIGITS = 16, 16, 7
FEATURES, SAMPLES = [5, 3, 5, 63, 99], [9, 0, 4, 9, 10_000_000]
TRACE_SAMPLES, TRACE_FEATURES = [3, 0, 7, 3, 149], [4, 0, 9]
OPTIONS = selection.SelectionOptions(y_r2_threshold=0.0, min_non_null_y=50, ff_r2_threshold=0.5, min_non_null_pair=50, top_m=8)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str) -> Callable:
    def wrap(f: Callable) -> Callable:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, *cols: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


#: r2 from moments n, sx, sy, sxx, syy, sxy.
R2 = """CASE WHEN n >= {least} AND n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0
  THEN pow(n * sxy - sx * sy, 2) / ((n * sxx - sx * sx) * (n * syy - sy * sy)) ELSE 0.0 END"""
GRID = """grid AS (SELECT f AS feature_id, s.vec_id AS sample_id, CASE WHEN c.value IS NULL THEN 0 ELSE 1 END AS mask, c.value AS value
  FROM (SELECT CAST(unnest(generate_series(0, 63)) AS INT) AS f) CROSS JOIN embeddings s LEFT JOIN emb c ON c.feature_id = f AND c.sample_id = s.vec_id)"""
STATS = f"""mo AS (SELECT y_col, feature_id, count(*) AS n, sum(value) AS sx, sum(y) AS sy, sum(value * value) AS sxx, sum(y * y) AS syy, sum(value * y) AS sxy
  FROM emb JOIN ys USING (sample_id) GROUP BY ALL),
st AS (SELECT t.y_col, f AS feature_id, CAST(f // {PER_PART} AS INT) AS part_id, CAST(f % {PER_PART} AS INT) AS offset_in_part, coalesce({R2.format(least=2)}, 0.0) AS r2, CAST(coalesce(n, 0) AS INT) AS n_y_overlap
  FROM (SELECT CAST(unnest(generate_series(0, 63)) AS INT) AS f) CROSS JOIN (SELECT DISTINCT y_col FROM ys) t LEFT JOIN mo ON mo.feature_id = f AND mo.y_col = t.y_col)"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = scalar.clean_raw(fx.emb_raw(spark, sf_dir))
    return scalar.densify(raw, fx.emb_samples(spark, sf_dir).select("sample_id"), fx.DIMS, PER_PART)


@register(f"WITH {fx.EMB_RAW} SELECT sample_id, feature_id, value FROM emb")
def scalar_raw_clean(spark, sf_dir):
    return scalar.clean_raw(fx.emb_raw(spark, sf_dir))


@register(f"WITH {fx.EMB_RAW}, {GRID} SELECT feature_id, sample_id, mask, value FROM grid")
def scalar_densify(spark, sf_dir):
    d = _dense(spark, sf_dir)
    return d.select("feature_id", "sample_id", F.col("mask").cast("int").alias("mask"), values.finite_or_null(F.col("value")).alias("value"))


@register(f"""SELECT CAST(f AS INT) AS feature_id, CAST(f AS INT) AS global_rank, CAST(f // {PER_PART} AS INT) AS part_id, CAST(f % {PER_PART} AS INT) AS offset_in_part,
  f % {PER_PART} * (SELECT count(*) FROM embeddings) AS first_row_in_part FROM (SELECT unnest(generate_series(0, 63)) AS f)""")
def feature_locator(spark, sf_dir):
    return scalar.locator(spark, fx.DIMS, fx.table(spark, sf_dir, "embeddings").count(), PER_PART)


@register(f"""WITH {fx.EMB_RAW}, {GRID} SELECT CAST(feature_id // {PER_PART} AS INT) AS part_id, min(feature_id) AS first_feature_id, max(feature_id) AS last_feature_id, count(*) AS row_count,
  CAST(sum(mask) AS BIGINT) AS n_present FROM grid GROUP BY 1""")
def part_stats(spark, sf_dir):
    return scalar.part_stats(_dense(spark, sf_dir))


@register(f"WITH {fx.EMB_RAW}, {GRID} SELECT sample_id, mask = 1 AS present, value FROM grid WHERE feature_id = 5")
def feature_slice(spark, sf_dir):
    return scalar.feature_slice(_dense(spark, sf_dir), 5, PER_PART).select("sample_id", "present", "value")


@register(f"WITH {fx.EMB_RAW}, {GRID} SELECT feature_id, mask = 1 AS present, value FROM grid WHERE sample_id = 7")
def sample_slice(spark, sf_dir):
    return scalar.sample_slice(_dense(spark, sf_dir), 7).select("feature_id", "present", "value")


def _list(xs) -> str:
    return ", ".join(f"({i}, {x})" for i, x in enumerate(xs))


@register(f"""WITH {fx.EMB_RAW}, {GRID}, f(fo, fid) AS (VALUES {_list(FEATURES)}), s(so, sid) AS (VALUES {_list(SAMPLES)})
  SELECT fo AS feature_ordinal, so AS sample_ordinal, fid AS feature_id, CAST(sid AS BIGINT) AS sample_id, coalesce(mask = 1, false) AS present, value
  FROM f CROSS JOIN s LEFT JOIN grid ON feature_id = fid AND sample_id = sid""")
def cell_many_request_order(spark, sf_dir):
    return scalar.cells(_dense(spark, sf_dir), FEATURES, SAMPLES, PER_PART)


@register("""SELECT o.ordinal, c.c_custkey AS sample_id, o.k AS sample_key FROM (VALUES (0, 'Customer#000000003'), (1, 'Customer#000000001'), (2, 'Customer#000000003')) o(ordinal, k)
  JOIN customer c ON c.c_name = o.k""")
def key_lookup(spark, sf_dir):
    keys = ["Customer#000000003", "Customer#000000001", "Customer#000000003"]
    samples = fx.cust_samples(spark, sf_dir)
    wanted = spark.createDataFrame(list(enumerate(keys)), "ordinal int, sample_key string")
    return wanted.join(samples.where(F.col("sample_key").isin(keys)), "sample_key").select("ordinal", "sample_id", "sample_key")


def _stats(spark, sf_dir, *y_cols):
    raw = scalar.clean_raw(fx.emb_raw(spark, sf_dir))
    return stats.selection_stats(raw, fx.emb_features(spark), fx.emb_samples(spark, sf_dir), list(y_cols), PER_PART)


_STATS_OUT = f"SELECT y_col, feature_id, part_id, offset_in_part, round(r2, {DIGITS}) AS r2y, n_y_overlap FROM st"


@register(f"WITH {fx.EMB_RAW}, {fx.EMB_Y}, {STATS} {_STATS_OUT} WHERE y_col = 'y'")
def selection_stats_y(spark, sf_dir):
    return rounded(_stats(spark, sf_dir, "y"), "r2y")


@register(f"WITH {fx.EMB_RAW}, {fx.EMB_Y}, {STATS} {_STATS_OUT}")
def selection_stats_multi_y(spark, sf_dir):
    return rounded(_stats(spark, sf_dir, "y", "y_alt", "y_const"), "r2y")


@register("SELECT CAST(unnest(generate_series(0, 63)) AS INT) AS feature_id, 0.0::DOUBLE AS r2y")
def stats_constant_y(spark, sf_dir):
    return _stats(spark, sf_dir, "y_const").select("feature_id", "r2y")


@register(f"WITH {fx.EMB_RAW}, {fx.EMB_Y}, {STATS} {_STATS_OUT} WHERE y_col = 'y' ORDER BY r2 DESC NULLS LAST, feature_id LIMIT 10")
def top_features(spark, sf_dir):
    return rounded(stats.top_features(_stats(spark, sf_dir, "y"), 10), "r2y")


PAIRS = """pm AS (SELECT a.feature_id AS lo, b.feature_id AS hi, count(*) AS n, sum(a.value) AS sx, sum(b.value) AS sy, sum(a.value * a.value) AS sxx, sum(b.value * b.value) AS syy,
  sum(a.value * b.value) AS sxy FROM {cells} a JOIN {cells} b ON a.sample_id = b.sample_id AND a.feature_id < b.feature_id GROUP BY ALL)"""


@register(f"WITH {fx.CUST_RAW}, {PAIRS.format(cells='cust')} SELECT lo, hi, n, round({R2.format(least=2)}, 6) AS r2 FROM pm")
def pair_r2(spark, sf_dir):
    return rounded(stats.pair_r2(scalar.clean_raw(fx.cust_raw(spark, sf_dir))), "r2", digits=6)


SELECTED = f"""{fx.CUST_RAW}, cm AS (SELECT feature_id, count(*) AS n, sum(value) AS sx, sum(y) AS sy, sum(value * value) AS sxx, sum(y * y) AS syy, sum(value * y) AS sxy
  FROM cust JOIN (SELECT c_custkey AS sample_id, c_acctbal AS y FROM customer) USING (sample_id) GROUP BY ALL),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY r2y DESC, feature_id) AS INT) AS rank, feature_id, r2y, CAST(n AS INT) AS n_y_overlap
  FROM (SELECT feature_id, n, {R2.format(least=2)} AS r2y FROM cm) WHERE n >= 50 AND r2y >= 0),
cells AS (SELECT sample_id, rank AS feature_id, value FROM cust JOIN ranked USING (feature_id)), {PAIRS.format(cells='cells')},
edges AS (SELECT lo, hi, n, {R2.format(least=50)} AS r2 FROM pm WHERE n >= 50 AND {R2.format(least=50)} >= 0.5)"""


def _cust_cells(spark, sf_dir):
    """The customers' cells, written once: selection reads them many times, and each time would be an aggregation of the orders."""
    return storage.stored(scalar.clean_raw(fx.cust_raw(spark, sf_dir)), storage.scratch_path(spark, "cells"))


def _ranked(spark, sf_dir):
    raw = _cust_cells(spark, sf_dir)
    return raw, selection.stored_candidates(raw, fx.cust_features(spark), fx.cust_samples(spark, sf_dir), OPTIONS)


@register(f"WITH {SELECTED} SELECT lo, hi, n, round(r2, 6) AS r2 FROM edges")
def redundancy_edges(spark, sf_dir):
    return rounded(selection.redundancy_edges(*_ranked(spark, sf_dir), OPTIONS), "r2", digits=6)


@register(f"""WITH RECURSIVE {SELECTED}, near AS (SELECT r.rank, coalesce(list(e.lo) FILTER (e.lo IS NOT NULL), []) AS lower FROM ranked r LEFT JOIN edges e ON e.hi = r.rank GROUP BY r.rank),
  g(k, sel) AS (SELECT 0, CAST([] AS INT[]) UNION ALL SELECT g.k + 1, CASE WHEN len(sel) < 8 AND NOT list_has_any(sel, lower) THEN list_append(sel, near.rank) ELSE sel END
    FROM g JOIN near ON near.rank = g.k + 1)
  SELECT rank, feature_id, round(r2y, {DIGITS}) AS r2y, n_y_overlap FROM ranked WHERE list_contains((SELECT sel FROM g ORDER BY k DESC LIMIT 1), rank)""")
def select_features(spark, sf_dir):
    raw = _cust_cells(spark, sf_dir)
    return rounded(selection.select_features(raw, fx.cust_features(spark), fx.cust_samples(spark, sf_dir), OPTIONS), "r2y")


def _traces(spark, sf_dir):
    cells = fx.event_cells(spark, sf_dir)
    points = traces.number_points(cells.where("value >= 200"), F.col("ts"), F.col("event_id")).select("sample_id", "feature_id", "point_idx", "ts", "value")
    return traces.trace_index(cells, points), points


@register(f"WITH {fx.EVENTS} SELECT sample_id, feature_id, trace_len FROM idx")
def trace_index(spark, sf_dir):
    return _traces(spark, sf_dir)[0]


@register(f"WITH {fx.EVENTS} SELECT sample_id, feature_id, point_idx, ts, value FROM pts")
def trace_points(spark, sf_dir):
    return _traces(spark, sf_dir)[1]


def _joined(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


REGROUPED = """re AS (SELECT i.sample_id, i.feature_id, trace_len, coalesce(string_agg(CAST(ts AS VARCHAR), ',' ORDER BY point_idx), '') AS ts_list,
  coalesce(round(sum(value), 4), 0.0) AS value_sum FROM idx i LEFT JOIN pts p ON i.sample_id = p.sample_id AND i.feature_id = p.feature_id GROUP BY i.sample_id, i.feature_id, trace_len)"""


def _value_sum() -> F.Column:
    return F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 4)


@register(f"WITH {fx.EVENTS}, {REGROUPED} SELECT *, true AS complete FROM re")
def trace_regroup(spark, sf_dir):
    t = traces.regroup(*_traces(spark, sf_dir), ["ts", "value"])
    return t.select("sample_id", "feature_id", "trace_len", _joined("ts").alias("ts_list"), _value_sum().alias("value_sum"), "complete")


@register(f"WITH {fx.EVENTS} SELECT feature_id, count(*) AS n_traces, CAST(sum(trace_len) AS BIGINT) AS n_points FROM idx WHERE sample_id IN (0, 3, 7, 149) GROUP BY 1")
def trace_count(spark, sf_dir):
    return traces.filtered(_traces(spark, sf_dir)[0], TRACE_SAMPLES, None).groupBy("feature_id").agg(F.count("*").alias("n_traces"), F.sum("trace_len").alias("n_points"))


@register(f"""WITH {fx.EVENTS}, {REGROUPED}, want AS (SELECT s AS sample_id, f AS feature_id FROM (SELECT unnest([0, 3, 7, 149]) AS s) CROSS JOIN (SELECT unnest([0, 4, 9]) AS f))
  SELECT CAST(w.sample_id AS BIGINT) AS sample_id, w.feature_id, re.sample_id IS NOT NULL AS present, trace_len, ts_list
  FROM want w LEFT JOIN re ON re.sample_id = w.sample_id AND re.feature_id = w.feature_id""")
def include_missing(spark, sf_dir):
    t = traces.get_traces(*_traces(spark, sf_dir), ["ts", "value"], TRACE_SAMPLES, TRACE_FEATURES, include_missing=True)
    return t.select("sample_id", "feature_id", "present", "trace_len", _joined("ts").alias("ts_list"))


@register(f"""WITH {fx.EVENTS}, t AS (SELECT i.sample_id, i.feature_id, trace_len, coalesce(string_agg(CAST(ts AS VARCHAR), ',' ORDER BY point_idx), '') AS ts FROM idx i
    LEFT JOIN pts p ON i.sample_id = p.sample_id AND i.feature_id = p.feature_id GROUP BY ALL)
  SELECT sample_id, '{{"sample_id":' || sample_id || ',"traces":[' || string_agg('{{"feature_id":' || feature_id || ',"trace_len":' || trace_len || ',"columns":{{"ts":[' || ts || ']}}}}', ',' ORDER BY feature_id) || ']}}' AS json
  FROM t GROUP BY sample_id""")
def layout_nested(spark, sf_dir):
    return traces.layout_nested(traces.regroup(*_traces(spark, sf_dir), ["ts"]), ["ts"])


@register(f"""WITH {fx.EVENTS}, t AS (SELECT i.sample_id, i.feature_id, trace_len, coalesce(string_agg(CAST(ts AS VARCHAR), ',' ORDER BY point_idx), '') AS ts FROM idx i
    LEFT JOIN pts p ON i.sample_id = p.sample_id AND i.feature_id = p.feature_id GROUP BY ALL)
  SELECT sample_id, feature_id, '{{"sample_id":' || sample_id || ',"feature_id":' || feature_id || ',"trace_len":' || trace_len || ',"columns":{{"ts":[' || ts || ']}}}}' AS json FROM t""")
def layout_flat(spark, sf_dir):
    return traces.layout_flat(traces.regroup(*_traces(spark, sf_dir), ["ts"]), ["ts"])


@register(f"""WITH {fx.EVENTS} SELECT feature_id, CAST(sample_id // {PER_BLOCK} AS INT) AS block_id, sample_id,
  CAST(sum(trace_len) OVER w - trace_len AS BIGINT) AS start, CAST(sum(trace_len) OVER w AS BIGINT) AS stop FROM idx WINDOW w AS (PARTITION BY feature_id, sample_id // {PER_BLOCK} ORDER BY sample_id)""")
def block_offsets(spark, sf_dir):
    return blocks.block_offsets(_traces(spark, sf_dir)[0], PER_BLOCK)


BLOCKS = f"""users AS (SELECT max(sample_id) + 1 AS n FROM ev),
slots AS (SELECT DISTINCT i.feature_id, i.sample_id // {PER_BLOCK} AS b FROM idx i),
spread AS (SELECT feature_id, b, b * {PER_BLOCK} + k AS sample_id, k FROM slots CROSS JOIN (SELECT unnest(generate_series(0, {PER_BLOCK - 1})) AS k) CROSS JOIN users WHERE b * {PER_BLOCK} + k < n),
lens AS (SELECT s.*, trace_len FROM spread s LEFT JOIN idx i ON i.feature_id = s.feature_id AND i.sample_id = s.sample_id)"""


def _blocks(spark, sf_dir):
    index, points = _traces(spark, sf_dir)
    n = fx.table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] + 1
    return blocks.assemble(index, traces.regroup(index, points, ["ts", "value"]), ["ts", "value"], n, PER_BLOCK)


@register(f"""WITH {fx.EVENTS}, {BLOCKS}, run AS (SELECT *, CAST(sum(coalesce(trace_len, 0)) OVER (PARTITION BY feature_id, b ORDER BY k) AS BIGINT) AS stop FROM lens)
  SELECT feature_id, CAST(b AS INT) AS block_id, string_agg(CASE WHEN trace_len IS NULL THEN '0' WHEN trace_len = 0 THEN '3' ELSE '1' END, ',' ORDER BY k) AS flags,
  '0,' || string_agg(CAST(stop AS VARCHAR), ',' ORDER BY k) AS offsets FROM run GROUP BY 1, 2""")
def block_flags(spark, sf_dir):
    return _blocks(spark, sf_dir).select("feature_id", "block_id", _joined("flags").alias("flags"), _joined("offsets").alias("offsets"))


@register(f"""WITH {fx.EVENTS} SELECT i.feature_id, CASE WHEN i.trace_len = 0 THEN 3 ELSE 1 END AS flags, i.trace_len, coalesce(string_agg(CAST(ts AS VARCHAR), ',' ORDER BY point_idx), '') AS ts_list
  FROM idx i LEFT JOIN pts p ON i.sample_id = p.sample_id AND i.feature_id = p.feature_id WHERE i.sample_id = 7 GROUP BY ALL""")
def block_trace_lookup(spark, sf_dir):
    return blocks.trace_in_block(_blocks(spark, sf_dir), 7, ["ts"], PER_BLOCK).where("flags > 0").select("feature_id", "flags", "trace_len", _joined("ts").alias("ts_list"))


@register(f"WITH {fx.EVENTS} SELECT feature_id, CAST(sum(trace_len) AS BIGINT) AS n_points, count(DISTINCT sample_id // {PER_BLOCK}) AS n_blocks FROM idx GROUP BY 1")
def feature_estimates(spark, sf_dir):
    return blocks.feature_estimates(_traces(spark, sf_dir)[0], PER_BLOCK)


DICTIONARY = """dict AS (SELECT label, CAST(row_number() OVER (ORDER BY first, label) AS INT) AS code
  FROM (SELECT event_type AS label, min(event_id) AS first FROM events WHERE event_id % 13 <> 0 GROUP BY 1))"""


def _categories(spark, sf_dir):
    label = F.when(F.col("event_id") % 13 == 0, None).otherwise(F.col("event_type"))
    rows = fx.table(spark, sf_dir, "events").select("event_id", label.alias("label"))
    return rows, values.category_dictionary(rows, "label", "event_id")


@register(f"WITH {DICTIONARY} SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 0 ELSE code END AS code FROM events JOIN dict ON event_type = label")
def categorical_encode(spark, sf_dir):
    return values.encode_category(*[_categories(spark, sf_dir)[0], "label", _categories(spark, sf_dir)[1]]).select("event_id", "code")


@register(f"WITH {DICTIONARY} SELECT event_id, CAST(event_id % 8 AS INT) AS code, label FROM events LEFT JOIN dict ON code = event_id % 8")
def categorical_decode(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 8).cast("int").alias("code"))
    return values.decode_category(rows, "code", _categories(spark, sf_dir)[1])


@register("""WITH seen AS (SELECT event_type AS label, min(event_id) AS first, min(CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END) AS late FROM events GROUP BY 1)
  SELECT label, CAST(row_number() OVER (ORDER BY late, first, label) AS INT) AS code FROM seen""")
def categorical_extend(spark, sf_dir):
    """A dictionary of two labels is kept and extended by those that come later."""
    rows = fx.table(spark, sf_dir, "events")
    first = values.category_dictionary(rows.where(F.col("event_type").isin("click", "view")), "event_type", "event_id")
    return values.extend_dictionary(first, rows, "event_type", "event_id")


@register("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) % 1000000 * 1000 + event_id % 1000 AS VARCHAR), 9, '0') AS iso FROM events")
def timestamp_iso(spark, sf_dir):
    ns = temporal.ntz_to_ns(F.col("ts")) + F.col("event_id") % 1000
    return fx.table(spark, sf_dir, "events").select("event_id", temporal.timestamp_iso(ns).alias("iso"))


DELTA = "(event_id - 5) * CASE event_id % 4 WHEN 0 THEN 1000000000 WHEN 1 THEN 3600000000000 WHEN 2 THEN 86400000000000 ELSE 1234567890 END"


@register(f"""WITH d AS (SELECT event_id, {DELTA} AS ns FROM events), p AS (SELECT *, abs(ns) AS a, abs(ns) // 1000000000 AS s FROM d),
  q AS (SELECT *, s // 86400 AS dd, s % 86400 // 3600 AS hh, s % 3600 // 60 AS mm, s % 60 AS ss, rtrim(lpad(CAST(a % 1000000000 AS VARCHAR), 9, '0'), '0') AS f FROM p),
  r AS (SELECT *, CASE WHEN hh > 0 THEN hh || 'H' ELSE '' END || CASE WHEN mm > 0 THEN mm || 'M' ELSE '' END || CASE WHEN ss > 0 OR f <> '' THEN ss || CASE WHEN f <> '' THEN '.' || f ELSE '' END || 'S' ELSE '' END AS clock FROM q)
  SELECT event_id, CASE WHEN ns = 0 THEN 'PT0S' ELSE CASE WHEN ns < 0 THEN '-' ELSE '' END || 'P' || CASE WHEN dd > 0 THEN dd || 'D' ELSE '' END || CASE WHEN clock <> '' THEN 'T' || clock ELSE '' END END AS iso FROM r""")
def timedelta_iso(spark, sf_dir):
    e = F.col("event_id")
    unit = F.when(e % 4 == 0, 10**9).when(e % 4 == 1, 3600 * 10**9).when(e % 4 == 2, 86400 * 10**9).otherwise(1234567890)
    ns = (e.cast("decimal(19,0)") - 5) * unit  # from event 106,758 on, days pass the LONGs
    return fx.table(spark, sf_dir, "events").select("event_id", temporal.timedelta_iso(ns).alias("iso"))


@register("SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
def nonfinite_to_null(spark, sf_dir):
    e = F.col("event_id")
    v = F.when(e % 3 == 0, float("nan")).when(e % 5 == 0, float("inf")).when(e % 7 == 0, float("-inf")).otherwise(F.col("value"))
    return fx.table(spark, sf_dir, "events").select("event_id", values.finite_or_null(v).alias("value"))


@register("SELECT c_custkey AS sample_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def pending_samples(spark, sf_dir):
    done = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"))
    return fx.cust_samples(spark, sf_dir).select("sample_id").join(done, "sample_id", "left_anti")


@register("""WITH RECURSIVE sizes AS (SELECT n_nationkey AS id, (n_nationkey * 37) % 50 + 1 AS size FROM nation),
  g AS (SELECT id, size AS used, 0 AS part FROM sizes WHERE id = 0
    UNION ALL SELECT s.id, CASE WHEN g.used + s.size > 100 THEN s.size ELSE g.used + s.size END, CASE WHEN g.used + s.size > 100 THEN g.part + 1 ELSE g.part END FROM g JOIN sizes s ON s.id = g.id + 1)
  SELECT CAST(id AS BIGINT) AS n_nationkey, CAST(part AS INT) AS part_id FROM g""")
def bin_pack_parts(spark, sf_dir):
    sizes = fx.table(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_nationkey") * 37) % 50 + 1).alias("size"))
    return blocks.bin_pack(sizes, "n_nationkey", "size", 100)


@register("""SELECT event_id, user_id FROM (SELECT event_id, user_id, lag(user_id) OVER (ORDER BY event_id) AS before FROM events) WHERE user_id <= before""")
def order_check(spark, sf_dir):
    return checks.order_violations(fx.table(spark, sf_dir, "events").select("event_id", "user_id"), F.col("event_id"), ["user_id"])


@register("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_check(spark, sf_dir):
    return checks.duplicates(fx.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("""SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_ids, CAST(min(c_custkey) AS BIGINT) AS min_id, CAST(max(c_custkey) AS BIGINT) AS max_id, count(DISTINCT c_name) AS n_keys,
  CAST(0 AS BIGINT) AS null_keys, min(c_custkey) = 0 AND max(c_custkey) = count(*) - 1 AND count(DISTINCT c_custkey) = count(*) AND count(DISTINCT c_name) = count(*) AS ok FROM customer""")
def dense_id_check(spark, sf_dir):
    return axes.dense_id_report(fx.table(spark, sf_dir, "customer"), "c_custkey", "c_name")


@register("""SELECT c_custkey AS sample_id, n_orders, last_order FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, max(o_orderkey) AS last_order FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def meta_enrich(spark, sf_dir):
    extra = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.count("*").alias("n_orders"), F.max("o_orderkey").alias("last_order"))
    return checks.enrich(fx.cust_samples(spark, sf_dir).select("sample_id"), extra, "sample_id")


@register(f"WITH {fx.EMB_RAW} SELECT x.sample_id, x.value AS x, y.value AS y FROM emb x JOIN emb y ON x.sample_id = y.sample_id WHERE x.feature_id = 3 AND y.feature_id = 8")
def scatter_xy(spark, sf_dir):
    raw = scalar.clean_raw(fx.emb_raw(spark, sf_dir))
    x, y = (raw.where(F.col("feature_id") == f).select("sample_id", F.col("value").alias(n)) for f, n in ((3, "x"), (8, "y")))
    return x.join(y, "sample_id")


@register(f"WITH {fx.EVENTS} SELECT sample_id, feature_id, trace_len, CAST(0 AS BIGINT) AS n FROM idx WHERE false")
def trace_length_check(spark, sf_dir):
    return checks.length_mismatches(*_traces(spark, sf_dir)).select("sample_id", "feature_id", "trace_len", "n")


@register("SELECT CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS n WHERE false")
def coverage_check(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    return checks.coverage_gaps(e, "vec_id", e.count())


def _scalar_set(spark, sf_dir):
    raw, path = fx.cust_raw(spark, sf_dir), storage.scratch_path(spark, "scalar")
    return scalar_store.build(raw, fx.cust_samples(spark, sf_dir), fx.cust_features(spark), path, ["y"], per_part=4)


@register(f"""WITH {fx.CUST_RAW} SELECT CAST(f AS INT) AS feature_id, c_custkey AS sample_id, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS mask, round(value, 4) AS value, CAST(f // 4 AS INT) AS part_id
  FROM (SELECT unnest(generate_series(0, 14)) AS f) CROSS JOIN customer LEFT JOIN cust ON feature_id = f AND sample_id = c_custkey""")
def scalar_store_roundtrip(spark, sf_dir):
    d = _scalar_set(spark, sf_dir).dense
    return d.select("feature_id", "sample_id", F.col("mask").cast("int").alias("mask"), F.round(values.finite_or_null(F.col("value")), 4).alias("value"), "part_id")


@register(f"WITH {SELECTED} SELECT feature_id, round(r2y, {DIGITS}) AS r2y FROM ranked ORDER BY r2y DESC NULLS LAST, feature_id LIMIT 5")
def scalar_store_top(spark, sf_dir):
    return rounded(_scalar_set(spark, sf_dir).top_features("y", 5).select("feature_id", "r2y"), "r2y")


EVENT_SCHEMA = PointSchema((PointColumn("ts", "int64", "timestamp_ns"), PointColumn("value", "float64", "continuous")))


def _trace_axes(spark, sf_dir):
    n = fx.table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] + 1
    features = spark.createDataFrame(list(enumerate(fx.EVENT_TYPES)), "feature_id int, feature_key string")
    return spark.range(n).select(F.col("id").alias("sample_id")), features, n


@register(f"WITH {fx.EVENTS}, {REGROUPED} SELECT sample_id, feature_id, trace_len, ts_list, value_sum FROM re")
def trace_store_roundtrip(spark, sf_dir):
    index, points = _traces(spark, sf_dir)
    samples, features, _ = _trace_axes(spark, sf_dir)
    found = trace_store.build(index, points, EVENT_SCHEMA, samples, features, storage.scratch_path(spark, "traces"))
    t = traces.regroup(found.index, found.points, ["ts", "value"])
    return t.select("sample_id", "feature_id", "trace_len", _joined("ts").alias("ts_list"), _value_sum().alias("value_sum"))


@register(f"WITH {fx.EVENTS}, {REGROUPED} SELECT sample_id, feature_id, trace_len, CASE WHEN trace_len = 0 THEN 3 ELSE 1 END AS flags, ts_list, value_sum FROM re")
def binary_blocks_roundtrip(spark, sf_dir):
    index, points = _traces(spark, sf_dir)
    _, features, n = _trace_axes(spark, sf_dir)
    path = storage.scratch_path(spark, "blocks")
    binary_blocks.write(index, points, EVENT_SCHEMA, n, len(fx.EVENT_TYPES), path, PER_BLOCK, codec="zstd")
    t = binary_blocks.read(spark, path)
    return t.select("sample_id", "feature_id", "trace_len", F.col("flags").cast("int").alias("flags"), _joined("ts").alias("ts_list"), _value_sum().alias("value_sum"))


@register("""SELECT user_id AS sample_id, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INT) AS feature_id, value, event_id FROM events""")
def stream_ingest(spark, sf_dir):
    """Events read as a stream, staged exactly once, and read back from the stage."""
    root = storage.scratch_path(spark, "stream")
    schema = fx.table(spark, sf_dir, "events").schema
    staged = session.Session(spark, f"{root}/stage", {"cells": StructType([*RAW.fields, StructField("event_id", LongType())])})
    feature = F.array_position(F.array(*[F.lit(t) for t in fx.EVENT_TYPES]), F.col("event_type")) - 1
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    cells = stream.select(F.col("user_id").alias("sample_id"), feature.cast("int").alias("feature_id"), "value", "event_id")
    ingest.stage(cells, staged, lambda batch: {"cells": batch}, f"{root}/checkpoint").awaitTermination()
    return staged.table("cells")


@register("SELECT c_custkey AS sample_id FROM customer WHERE c_custkey % 3 = 2")
def session_pending(spark, sf_dir):
    """Two batches, one of them given twice, leave a third of the samples pending."""
    staged = session.Session(spark, storage.scratch_path(spark, "session"), {"cells": RAW})
    raw, samples = fx.cust_raw(spark, sf_dir), fx.cust_samples(spark, sf_dir).select("sample_id")
    for k in (0, 1, 1):
        mine = F.col("sample_id") % 3 == k
        staged.write(f"third-{k}", samples.where(mine), cells=raw.where(mine))
    return staged.pending(samples)


@register(f"WITH {fx.CUST_RAW} SELECT sample_id, feature_id, round(value, 4) AS value FROM cust")
def session_compact(spark, sf_dir):
    """Cells staged in three batches, compacted into one and read back."""
    staged = session.Session(spark, storage.scratch_path(spark, "session"), {"cells": RAW})
    raw, samples = fx.cust_raw(spark, sf_dir), fx.cust_samples(spark, sf_dir).select("sample_id")
    for k in range(3):
        mine = F.col("sample_id") % 3 == k
        staged.write(f"third-{k}", samples.where(mine), cells=raw.where(mine))
    staged.compact("merged", samples, cleanup=True)
    return rounded(staged.table("cells"), "value", digits=4)
