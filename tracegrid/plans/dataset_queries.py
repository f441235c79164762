"""Registered queries of stored datasets, selection by stages, checks that have something to find, and value functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid import axes
from tracegrid.functions import temporal, values
from tracegrid.operators import checks, scalar, selection, stats, traces
from tracegrid.plans import fixtures as fx
from tracegrid.plans.grid_queries import (
    EVENT_SCHEMA, GRID, OPTIONS, PER_BLOCK, PER_PART, SELECTED, _cust_cells, _joined, _list, _ranked, _trace_axes, _traces, _value_sum, register, rounded,
)
from tracegrid.schema import RAW
from tracegrid.sources import binary_blocks, block_dataset, bundles, raw_files, scalar_store, storage, synthetic

FEATURES, SAMPLES = [5, 3, 5, 63], [9, 0, 4, 9]
SIXTEEN = list(range(3, 67, 4))
CELL_SQL = f"""WITH {fx.EMB_RAW}, {GRID}"""


def _stored(spark, sf_dir):
    """The embedding grid as a written dataset with keys."""
    samples = fx.emb_samples(spark, sf_dir).withColumn("sample_key", F.format_string("s%06d", "sample_id"))
    return scalar_store.build(fx.emb_raw(spark, sf_dir), samples, fx.emb_features(spark), storage.scratch_path(spark, "grid"), ["y", "y_alt"], per_part=PER_PART)


@register(f"{CELL_SQL} SELECT feature_id, sample_id, mask = 1 AS present, value FROM grid WHERE feature_id = 5")
def stored_feature(spark, sf_dir):
    return _stored(spark, sf_dir).feature(5)


@register(f"{CELL_SQL} SELECT feature_id, sample_id, mask = 1 AS present, value FROM grid WHERE sample_id = 7")
def stored_sample(spark, sf_dir):
    return _stored(spark, sf_dir).sample(7)


@register(f"{CELL_SQL} SELECT CAST(row_number() OVER (PARTITION BY sample_id ORDER BY feature_id) - 1 AS INT) AS feature_ordinal, CAST((sample_id - 3) // 4 AS INT) AS sample_ordinal, feature_id, sample_id, mask = 1 AS present, value FROM grid WHERE sample_id IN ({', '.join(map(str, SIXTEEN))})")
def stored_16_samples_64_features(spark, sf_dir):
    return _stored(spark, sf_dir).cells(list(range(64)), SIXTEEN)


@register(f"""{CELL_SQL}, f(fo, fid) AS (VALUES {_list(FEATURES)}), s(so, sid) AS (VALUES {_list(SAMPLES)})
  SELECT fo AS feature_ordinal, so AS sample_ordinal, 'dim_' || lpad(CAST(fid AS VARCHAR), 2, '0') AS feature_key, 's' || lpad(CAST(sid AS VARCHAR), 6, '0') AS sample_key, mask = 1 AS present, value
  FROM f CROSS JOIN s JOIN grid ON feature_id = fid AND sample_id = sid""")
def stored_cells_by_key(spark, sf_dir):
    """Asked for by keys and given keys again: ids are resolved, and rows decorated by left joins."""
    d = _stored(spark, sf_dir)
    rows = d.cells(feature_keys=[f"dim_{f:02d}" for f in FEATURES], sample_keys=[f"s{s:06d}" for s in SAMPLES])
    return d.decorate(rows).select("feature_ordinal", "sample_ordinal", "feature_key", "sample_key", "present", "value")


@register(f"{CELL_SQL} SELECT feature_id, CAST(feature_id % {PER_PART} AS INT) AS offset_in_part, sample_id, mask = 1 AS present, value FROM grid WHERE feature_id IN (32, 35, 47)")
def stored_rows_by_offset(spark, sf_dir):
    return _stored(spark, sf_dir).rows(2, [0, 3, 15, 3, 99])


@register(f"""{CELL_SQL}, f(fo, fid) AS (VALUES {_list(FEATURES)}), s(so, sid) AS (VALUES {_list(SAMPLES)})
  SELECT CAST(row_number() OVER (ORDER BY fid // {PER_PART}, fid % {PER_PART}, so, fo) AS INT) AS place, fo AS feature_ordinal, fid AS feature_id, CAST(sid AS BIGINT) AS sample_id, value
  FROM f CROSS JOIN s JOIN grid ON feature_id = fid AND sample_id = sid""")
def stored_physical_order(spark, sf_dir):
    """Not the request's order but that of the parts; the places are those in which rows come out."""
    from pyspark.sql import Window

    rows = scalar.physical_order(_stored(spark, sf_dir).cells(FEATURES, SAMPLES), PER_PART)
    order = Window.orderBy("part_id", "offset_in_part", "sample_ordinal", "feature_ordinal")
    return rows.select(F.row_number().over(order).alias("place"), "feature_ordinal", "feature_id", "sample_id", "value")


@register(f"{CELL_SQL} SELECT feature_id, sample_id, value FROM grid WHERE feature_id IN (1, 2, 3, 4, 5) AND sample_id IN (0, 9) AND mask = 1")
def stored_cells_in_batches(spark, sf_dir):
    out = None
    for part in _stored(spark, sf_dir).iter_cells([1, 2, 3, 4, 5], [0, 9], batch_size=2):
        out = part if out is None else out.unionByName(part)
    return out.where("present").select("feature_id", "sample_id", "value")


@register(f"{CELL_SQL} SELECT sample_id, feature_id, value FROM emb WHERE sample_id < 40")
def raw_files_without_ids(spark, sf_dir):
    """One folder of files a sample; the sample's number is in the path alone."""
    path = storage.scratch_path(spark, "raw")
    raw = fx.emb_raw(spark, sf_dir).where("sample_id < 40")
    raw.select(F.format_string("sample_%06d", "sample_id").alias("file"), "feature_id", "value").repartition("file").write.partitionBy("file").parquet(path)
    return raw_files.read_raw(spark, path)


@register("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(2 AS INT), CAST(0.5 AS DOUBLE)), (3, 4, NULL), (5, 6, -1.5)) t(sample_id, feature_id, value)")
def values_relation(spark, sf_dir):
    path = storage.scratch_path(spark, "values")
    spark.createDataFrame([(1, 2, 0.5), (3, 4, None), (5, 6, -1.5)], RAW).write.parquet(path)
    return spark.read.schema(RAW).parquet(path)


@register("SELECT CAST(0 AS BIGINT) AS differing, CAST(1 AS BIGINT) AS has_rows")
def synthetic_range(spark, sf_dir):
    """Samples 10 to 19 made alone are those of the whole grid."""
    alone, whole = synthetic.scalar_cells(spark, 20, 30, start=10), synthetic.scalar_cells(spark, 20, 30).where("sample_id >= 10")
    return checks.unequal_rows(alone, whole).agg(F.count("*").alias("differing")).crossJoin(alone.agg((F.count("*") > 0).cast("long").alias("has_rows")))  # one row each


@register(f"WITH RECURSIVE {SELECTED}, near AS (SELECT r.rank, coalesce(list(e.lo) FILTER (e.lo IS NOT NULL), []) AS lower FROM ranked r LEFT JOIN edges e ON e.hi = r.rank GROUP BY r.rank),\n"
          """g(k, sel) AS (SELECT 0, CAST([] AS INT[]) UNION ALL SELECT g.k + 1, CASE WHEN len(sel) < 8 AND NOT list_has_any(sel, lower) THEN list_append(sel, near.rank) ELSE sel END
    FROM g JOIN near ON near.rank = g.k + 1)
  SELECT rank, feature_id, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][feature_id // 3 + 1] || '/' || ['count', 'sum', 'max'][feature_id % 3 + 1] AS feature_key,
    n_y_overlap, list_contains((SELECT sel FROM g ORDER BY k DESC LIMIT 1), rank) AS selected FROM ranked""")
def selection_with_candidates(spark, sf_dir):
    raw = _cust_cells(spark, sf_dir)
    found = selection.selection_result(raw, fx.cust_features(spark), fx.cust_samples(spark, sf_dir), OPTIONS)
    return found.select("rank", "feature_id", "feature_key", "n_y_overlap", "selected")


@register("""SELECT CAST(NULL AS INT) AS rank, CAST('' AS VARCHAR) AS side WHERE false""")
def staged_equals_unstaged(spark, sf_dir):
    """Selection by stages of 2, 4, 6, ... candidates against one walk over all: no row differs."""
    raw, ranked = _ranked(spark, sf_dir)
    whole = selection.greedy(ranked, selection.redundancy_edges(raw, ranked, OPTIONS), OPTIONS.top_m)
    return checks.unequal_rows(selection.staged(raw, ranked, OPTIONS, first=2, most=2).select("rank"), whole.select("rank"))


@register(f"WITH {SELECTED} SELECT rank, feature_id FROM ranked WHERE rank <= 4")
def candidates_capped(spark, sf_dir):
    from dataclasses import replace

    raw = scalar.clean_raw(fx.cust_raw(spark, sf_dir))
    st = stats.selection_stats(raw, fx.cust_features(spark), fx.cust_samples(spark, sf_dir), ["y"])
    return selection.candidates(st, replace(OPTIONS, max_candidates=4)).select("rank", "feature_id")


@register(f"""WITH {fx.CUST_RAW}, sets AS (SELECT feature_id, list(sample_id ORDER BY sample_id) AS s FROM cust GROUP BY 1), g AS (SELECT s, min(feature_id) AS group_id, count(*) AS n_features FROM sets GROUP BY 1)
  SELECT feature_id, group_id, n_features FROM sets JOIN g USING (s)""")
def mask_groups(spark, sf_dir):
    return selection.mask_groups(scalar.clean_raw(fx.cust_raw(spark, sf_dir)))


@register(f"""WITH {fx.EMB_RAW}, {fx.EMB_Y} SELECT f AS feature_id, count(ys.sample_id) AS n FROM (SELECT CAST(unnest(generate_series(0, 63)) AS INT) AS f)
  LEFT JOIN emb ON emb.feature_id = f LEFT JOIN ys ON ys.sample_id = emb.sample_id AND y_col = 'y' GROUP BY 1""")
def overlap_by_outer_joins(spark, sf_dir):
    """The overlap of each feature with a target, by two outer joins and a count that skips nulls."""
    raw, f = scalar.clean_raw(fx.emb_raw(spark, sf_dir)), fx.emb_features(spark).select("feature_id")
    ys = stats.targets_long(fx.emb_samples(spark, sf_dir), ["y"]).select(F.col("sample_id").alias("y_sample"))
    return f.join(raw, "feature_id", "left").join(ys, F.col("sample_id") == F.col("y_sample"), "left").groupBy("feature_id").agg(F.count("y_sample").alias("n"))


@register("SELECT c_custkey AS sample_id, c_acctbal AS y FROM customer, (SELECT avg(c_acctbal) AS mean FROM customer) m WHERE c_acctbal < m.mean")
def below_the_mean(spark, sf_dir):
    """A theta join with a table of one row."""
    s = fx.cust_samples(spark, sf_dir)
    return s.join(F.broadcast(s.agg(F.avg("y").alias("mean"))), F.col("y") < F.col("mean")).select("sample_id", "y")


@register(f"""WITH {fx.CUST_RAW}, a AS (SELECT sample_id, feature_id FROM cust WHERE sample_id % 5 <> 0), b AS (SELECT sample_id, feature_id FROM cust WHERE sample_id % 7 <> 0)
  SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def except_both_ways(spark, sf_dir):
    raw = scalar.clean_raw(fx.cust_raw(spark, sf_dir)).select("sample_id", "feature_id")
    return checks.unequal_rows(raw.where("sample_id % 5 != 0"), raw.where("sample_id % 7 != 0"))


@register("""WITH ids AS (SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 3 UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 100 = 7 UNION ALL SELECT -1), n AS (SELECT count(*) AS n FROM embeddings)
  SELECT coalesce(i, vec_id) AS id, count(vec_id) AS n FROM (SELECT unnest(generate_series(0, (SELECT n - 1 FROM n))) AS i) FULL JOIN ids ON i = vec_id GROUP BY 1 HAVING count(vec_id) <> 1 OR id < 0""")
def coverage_faults(spark, sf_dir):
    """Ids left out, given twice and outside the axis are all found."""
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id")
    ids = e.where("vec_id % 10 != 3").unionByName(e.where("vec_id % 100 = 7")).unionByName(spark.createDataFrame([(-1,)], "vec_id long"))
    return checks.coverage_gaps(ids, "vec_id", e.count())


@register(f"""WITH {fx.EVENTS}, kept AS (SELECT * FROM pts WHERE sample_id % 11 <> 0), less AS (SELECT * FROM idx WHERE sample_id % 13 <> 0),
  n AS (SELECT sample_id, feature_id, count(*) AS n FROM kept GROUP BY ALL)
  SELECT coalesce(i.sample_id, n.sample_id) AS sample_id, coalesce(i.feature_id, n.feature_id) AS feature_id, trace_len, coalesce(n, 0) AS n
  FROM less i FULL JOIN n ON i.sample_id = n.sample_id AND i.feature_id = n.feature_id WHERE trace_len IS NULL OR trace_len <> coalesce(n, 0)""")
def trace_length_faults(spark, sf_dir):
    """Points taken away and index rows taken away are both found."""
    index, points = _traces(spark, sf_dir)
    return checks.length_mismatches(index.where("sample_id % 13 != 0"), points.where("sample_id % 11 != 0")).select("sample_id", "feature_id", "trace_len", "n")


@register("SELECT c_custkey AS sample_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey IS NOT NULL)")
def pending_of_few(spark, sf_dir):
    done = fx.table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("sample_id"))
    return fx.cust_samples(spark, sf_dir).select("sample_id").join(done, "sample_id", "left_anti")


@register(f"""WITH {fx.EVENTS}, swapped AS (SELECT *, row_number() OVER (ORDER BY sample_id, feature_id) + CASE WHEN sample_id % 9 = 4 THEN 3 ELSE 0 END AS place FROM idx)
  SELECT sample_id, feature_id FROM (SELECT sample_id, feature_id, lag(sample_id * 100 + feature_id) OVER (ORDER BY place, sample_id, feature_id) AS before FROM swapped) WHERE sample_id * 100 + feature_id <= before""")
def trace_index_order_faults(spark, sf_dir):
    """Rows of a trace index moved out of (sample, feature) order are found, by ranges of their places."""
    from pyspark.sql import Window

    index = _traces(spark, sf_dir)[0]
    place = F.row_number().over(Window.orderBy("sample_id", "feature_id")) + F.when(F.col("sample_id") % 9 == 4, 3).otherwise(0)
    at = F.struct(place.alias("p"), "sample_id", "feature_id")
    rows = index.select("sample_id", "feature_id", at.alias("at"))
    return checks.order_report(rows, F.col("at"), ["sample_id", "feature_id"], tasks=8).select("sample_id", "feature_id")


@register("""SELECT event_id, user_id FROM (SELECT event_id, user_id, lag(user_id) OVER (ORDER BY event_id) AS before FROM events) WHERE user_id <= before""")
def order_by_ranges(spark, sf_dir):
    return checks.order_report(fx.table(spark, sf_dir, "events").select("event_id", "user_id"), F.col("event_id"), ["user_id"], tasks=16)


@register("SELECT c_name AS sample_key, row_number() OVER (ORDER BY c_name) - 1 AS sample_id FROM customer")
def assigned_ids(spark, sf_dir):
    return axes.assign_dense_ids(fx.cust_samples(spark, sf_dir).select("sample_key"), "sample_key", "sample_id")


@register("SELECT event_id, event_id * 1000000007 AS raw_ns FROM events")
def raw_nanoseconds(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", temporal.format_ns(F.col("event_id") * 1000000007, "timestamp_ns", "raw_ns").alias("raw_ns"))


@register("SELECT event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 1000 AS ns FROM events")
def interval_nanoseconds(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    first = e.agg(F.min("ts").alias("first"))
    return e.join(F.broadcast(first)).select("event_id", temporal.interval_to_ns(F.col("ts") - F.col("first")).alias("ns"))  # one row


@register("SELECT event_id, user_id BETWEEN 0 AND 255 AS u8, event_id * 10 BETWEEN 0 AND 65535 AS u16, event_id - 5 BETWEEN 0 AND 4294967295 AS u32 FROM events")
def unsigned_ranges(spark, sf_dir):
    ok = values.in_unsigned_range
    return fx.table(spark, sf_dir, "events").select("event_id", ok(F.col("user_id"), "uint8").alias("u8"), ok(F.col("event_id") * 10, "uint16").alias("u16"), ok(F.col("event_id") - 5, "uint32").alias("u32"))


@register("""WITH m AS (SELECT c_custkey AS id, list_transform(range(20), lambda i: (c_custkey * (i + 3)) % 7 < 3) AS a, list_transform(range(20), lambda i: (c_custkey + i) % 3 = 0) AS b FROM customer),
  p AS (SELECT id, CAST(list_sum(list_transform(range(20), lambda i: CASE WHEN a[i + 1] THEN 1 << i ELSE 0 END)) AS BIGINT) AS pa, CAST(list_sum(list_transform(range(20), lambda i: CASE WHEN b[i + 1] THEN 1 << i ELSE 0 END)) AS BIGINT) AS pb FROM m)
  SELECT id, pa AS packed, CAST(bit_count(pa & pb) AS INT) AS shared FROM p""")
def packed_masks(spark, sf_dir):
    k, i = F.col("c_custkey"), F.sequence(F.lit(0), F.lit(19))
    a, b = F.transform(i, lambda i: (k * (i + 3)) % 7 < 3), F.transform(i, lambda i: (k + i) % 3 == 0)
    m = fx.table(spark, sf_dir, "customer").select(k.alias("id"), values.packed_bits(a).alias("packed"), values.packed_bits(b).alias("other"))
    return m.select("id", "packed", values.bits_shared(F.col("packed"), F.col("other")).alias("shared"))


@register("SELECT n_nationkey, url_encode(n_name || ' / é') || '.parquet' AS file FROM nation")
def quoted_names(spark, sf_dir):
    return fx.table(spark, sf_dir, "nation").select("n_nationkey", values.quoted_name(F.concat("n_name", F.lit(" / é")), ".parquet").alias("file"))


@register("SELECT CAST(c_custkey AS BIGINT) AS n_samples, greatest(1, 128, (32 << 20) // greatest(1, 21 * c_custkey)) AS per_part FROM customer WHERE c_custkey < 30")
def features_of_a_part(spark, sf_dir):
    """Sizes of parts by driver arithmetic, as a build computes them."""
    n = [r[0] for r in fx.table(spark, sf_dir, "customer").where("c_custkey < 30").select("c_custkey").collect()]
    return spark.createDataFrame([(x, scalar.features_per_part(x, 32 << 20)) for x in n], "n_samples long, per_part long")


@register(f"""WITH {fx.EVENTS} SELECT i.sample_id, i.feature_id, trace_len, coalesce(string_agg(CAST(ts AS VARCHAR), ',' ORDER BY point_idx), '') AS ts_list, coalesce(round(sum(value), 4), 0.0) AS value_sum
  FROM idx i LEFT JOIN pts p ON i.sample_id = p.sample_id AND i.feature_id = p.feature_id GROUP BY ALL""")
def bundles_roundtrip(spark, sf_dir):
    path = storage.scratch_path(spark, "bundles")
    bundles.write_bundles(*_traces(spark, sf_dir), ["ts", "value"], path)
    return bundles.read_bundles(spark, path).select("sample_id", "feature_id", "trace_len", _joined("ts").alias("ts_list"), _value_sum().alias("value_sum"))


@register(f"WITH {fx.EVENTS} SELECT CAST(count(*) AS BIGINT) AS n, true AS sorted FROM idx")
def bundles_in_order(spark, sf_dir):
    """Rows of each file ascend by (sample, feature), judged by their places in the file."""
    path = storage.scratch_path(spark, "bundles")
    bundles.write_bundles(*_traces(spark, sf_dir), ["ts"], path, files=3)
    return bundles.file_order(bundles.read_bundles(spark, path)).agg(F.sum("n").alias("n"), F.bool_and("sorted").alias("sorted"))


def _block_dataset(spark, sf_dir):
    index, points = _traces(spark, sf_dir)
    samples, features, n = _trace_axes(spark, sf_dir)
    path = storage.scratch_path(spark, "blocks")
    binary_blocks.write(index, points, EVENT_SCHEMA, n, len(fx.EVENT_TYPES), path, PER_BLOCK, codec="zstd")
    block_dataset.save_axes(path, samples.withColumn("sample_key", F.format_string("user-%04d", "sample_id")), features)
    return block_dataset.BlockDataset(spark, path)


@register(f"""WITH {fx.EVENTS}, f(fo, fid) AS (VALUES (0, 4), (1, 0), (2, 4)), s(so, sid) AS (VALUES (0, 7), (1, 3))
  SELECT fo AS feature_ordinal, so AS sample_ordinal, trace_len IS NOT NULL AS present, coalesce(trace_len, 0) AS trace_len,
    coalesce((SELECT string_agg(CAST(ts AS VARCHAR), ',' ORDER BY point_idx) FROM pts p WHERE p.sample_id = sid AND p.feature_id = fid), '') AS ts_list
  FROM f CROSS JOIN s LEFT JOIN idx ON sample_id = sid AND feature_id = fid""")
def block_traces_by_key(spark, sf_dir):
    d = _block_dataset(spark, sf_dir)
    t = d.traces(feature_keys=["view", "click", "view"], sample_keys=["user-0007", "user-0003"])
    return t.select("feature_ordinal", "sample_ordinal", "present", "trace_len", _joined("ts").alias("ts_list"))


@register("SELECT true AS has_feature, true AS has_sample, false AS has_other, CAST(0 AS BIGINT) AS violations")
def block_presence(spark, sf_dir):
    d = _block_dataset(spark, sf_dir)
    rows = [(d.has("feature", "view"), d.has("sample", "user-0003"), d.has("feature", "none"), d.violations().count())]
    return spark.createDataFrame(rows, "has_feature boolean, has_sample boolean, has_other boolean, violations long")


@register(f"""WITH {fx.EVENTS}, b AS (SELECT * FROM idx WHERE sample_id IN (0, 3, 7)) SELECT feature_id, count(*) AS n_traces FROM b GROUP BY 1""")
def trace_counts(spark, sf_dir):
    """How many traces a request would return, feature by feature, from the index alone."""
    index = _traces(spark, sf_dir)[0]
    ids = [r[0] for r in index.where("sample_id IN (0, 3, 7)").select("feature_id").distinct().collect()]
    return spark.createDataFrame([(f, traces.count_traces(index, [0, 3, 7, 3], [f])) for f in ids], "feature_id int, n_traces long")
