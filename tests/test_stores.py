"""Stores, sessions, binary blocks and synthetic sources: round trips, resuming, faults and refusals."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tracegrid.errors import DataError, NotFoundError, RequestError, TooLargeError
from tracegrid.operators import selection
from tracegrid.schema import RAW, PointColumn, PointSchema
from tracegrid.sources import binary_blocks, scalar_store, storage, synthetic, trace_store
from tracegrid.sources.session import Session

NAN, INF = float("nan"), float("inf")
POINTS = PointSchema((PointColumn("time", "float64", "continuous"), PointColumn("value", "float64", "continuous")))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    raw = spark.createDataFrame([(0, 0, 10.0), (1, 0, 11.0), (1, 1, 21.0), (2, 1, 20.0), (0, 2, None), (3, 2, NAN)], RAW)
    samples = spark.createDataFrame([(i, f"s{i}", float(i + 1), 7.0) for i in range(4)], "sample_id long, sample_key string, y double, y_const double")
    features = spark.createDataFrame([(i, f"feature_{k}") for i, k in enumerate("abc")], "feature_id int, feature_key string")
    path = f"file://{tmp_path_factory.mktemp('scalar')}/set"
    return raw, samples, features, path, scalar_store.build(raw, samples, features, path, ["y", "y_const"], per_part=2)


def test_scalar_cells_and_stats(small):
    d = small[4]
    assert d.dense.count() == 12 and d.value(0, 1) == (True, 11.0) and d.value(0, 2) == (False, None) and d.value(9, 9) == (False, None)
    assert [r["value"] for r in d.cells(feature_keys=["feature_b", "feature_a"], sample_keys=["s1", "s0", "s1"]).orderBy("feature_ordinal", "sample_ordinal").collect()] == [21.0, None, 21.0, 11.0, 10.0, 11.0]
    assert {r["feature_id"]: r["n_y_overlap"] for r in d.stats("y").collect()} == {0: 2, 1: 2, 2: 0}
    assert {r["r2y"] for r in d.stats("y_const").collect()} == {0.0}
    assert d.locate(2) == {"feature_id": 2, "global_rank": 2, "part_id": 1, "offset_in_part": 0, "first_row_in_part": 0} and d.locate(3) is None
    assert not d.violations().head(1)


def test_scalar_slice_is_pruned(small):
    plan = small[4].feature(2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part_id" in plan and "PushedFilters: [IsNotNull(feature_id), EqualTo(feature_id,2)" in plan


def test_scalar_refusals(spark, small):
    raw, samples, features, path, d = small
    for request, error in (({"feature_ids": [0], "feature_keys": ["a"], "sample_ids": [0]}, RequestError), ({"feature_ids": [], "sample_ids": [0]}, RequestError), ({"feature_keys": ["?"], "sample_ids": [0]}, NotFoundError)):
        with pytest.raises(error):
            d.cells(**request)
    with pytest.raises(NotFoundError):
        d.cells([5], [0], strict=True)
    with pytest.raises(TooLargeError):
        d.cells([0, 1], [0, 1], max_cells=3)
    with pytest.raises(NotFoundError):
        d.top_features("other")
    with pytest.raises(DataError):
        scalar_store.build(raw, samples, features, path)
    for bad in ([(0, 0, 1.0), (0, 0, 2.0)], [(4, 0, 1.0)], [(0, -1, 1.0)]):
        with pytest.raises(DataError):
            scalar_store.build(spark.createDataFrame(bad, RAW), samples, features, path + "-bad")
        assert not storage.exists(spark, path + "-bad/manifest.json")


def test_scalar_empty(spark, small, tmp_path):
    none = spark.createDataFrame([], RAW)
    d = scalar_store.build(none, small[1], small[2], f"file://{tmp_path}/a")
    assert d.dense.where("mask = 1").count() == 0 and d.dense.count() == 12
    assert scalar_store.build(none, small[1].limit(0), small[2], f"file://{tmp_path}/b").dense.count() == 0


def test_synthetic_selection_prunes_groups(spark, tmp_path):
    raw = synthetic.scalar_cells(spark, 300, 24, seed=3, noise=0.2)
    assert raw.exceptAll(synthetic.scalar_cells(spark, 300, 24, seed=3, noise=0.2)).count() == 0
    d = scalar_store.build(raw, synthetic.scalar_samples(spark, 300, seed=3), synthetic.scalar_features(spark, 24), f"file://{tmp_path}/s", ["y"])
    got = d.select_features(selection.SelectionOptions(y_r2_threshold=0.0, min_non_null_y=50, min_non_null_pair=50, ff_r2_threshold=0.6)).collect()
    assert sorted(r["feature_id"] // 8 for r in got) == [0, 1, 2] and got[0]["feature_id"] < 8


def test_spans_split_long_features(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scalar_store, "SPAN", 7)
    raw = synthetic.scalar_cells(spark, 50, 5, density=0.5)
    d = scalar_store.build(raw, synthetic.scalar_samples(spark, 50), synthetic.scalar_features(spark, 5), f"file://{tmp_path}/s", target_bytes=600, per_part=2)
    assert d.dense.count() == 250 and d.raw.exceptAll(raw).count() == 0 and raw.exceptAll(d.raw).count() == 0


def test_session_resumes(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/stage", {"cells": RAW})
    samples = spark.range(4).select(F.col("id").alias("sample_id"))
    rows = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], RAW)
    assert s.status(samples) == {"n_samples": 4, "completed": 0, "pending": 4, "batches": 0}
    assert s.write("a", samples.where("sample_id IN (0, 3)"), cells=rows)
    assert not s.write("a", samples, cells=rows)
    assert [r[0] for r in s.table("cells").select("sample_id").collect()] == [0]
    assert s.write("b", cells=rows)
    assert s.table("cells").count() == 2 and [r[0] for r in s.pending(samples).collect()] == [2]
    (tmp_path / "stage" / "commits" / "b.json").unlink()  # as after a writer that died before its commit
    assert s.table("cells").count() == 1
    assert s.write("b", cells=rows) and s.table("cells").count() == 2
    with pytest.raises(RequestError):
        s.write("../c", cells=rows)
    with pytest.raises(DataError):
        s.write("d", cells=rows.withColumn("extra", F.lit(1)))


@pytest.fixture(scope="module")
def hand(spark):
    """10 samples x 3 features, with empty traces, NaN and an infinity; feature 2 has none."""
    cells = {(0, 0): [(0.0, 10.0), (1.0, 11.0), (2.0, 12.0)], (2, 0): [(0.0, 20.0), (1.0, 21.0)], (5, 0): [], (8, 0): [(0.0, 80.0), (NAN, INF)], (1, 1): [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], (7, 1): [(5.0, 7.0)]}
    index = spark.createDataFrame([(s, f, len(p)) for (s, f), p in cells.items()], "sample_id long, feature_id int, trace_len int")
    points = spark.createDataFrame([(s, f, i, *x) for (s, f), p in cells.items() for i, x in enumerate(p)], "sample_id long, feature_id int, point_idx int, time double, value double")
    return cells, index, points


@pytest.mark.parametrize("codec", ["none", "zstd"])
@pytest.mark.parametrize("shard_bytes", [1, 1 << 20])
def test_binary_blocks(spark, hand, tmp_path, codec, shard_bytes):
    cells, index, points = hand
    uri = f"file://{tmp_path}/b"
    root = binary_blocks.write(index, points, POINTS, 10, 3, uri, per_block=4, shard_bytes=shard_bytes, codec=codec)
    assert sum(s["block_count"] for s in root["shards"]) == 9 and root["n_shards"] == (3 if shard_bytes == 1 else 1)
    got = {(r["sample_id"], r["feature_id"]): r for r in binary_blocks.read(spark, uri).collect()}
    assert {k: repr(list(zip(r["time"], r["value"]))) for k, r in got.items()} == {k: repr(p) for k, p in cells.items()}
    assert {k: r["flags"] for k, r in got.items()} == {k: 1 if p else 3 for k, p in cells.items()}
    assert {(r["sample_id"], r["feature_id"]) for r in binary_blocks.read(spark, uri, [0, 2], [2, 5, 7]).collect()} == {(2, 0), (5, 0)}
    assert binary_blocks.read(spark, uri, [2]).count() == 0


def test_binary_types_and_faults(spark, hand, tmp_path):
    with pytest.raises(DataError):
        binary_blocks.write(*hand[1:], PointSchema((PointColumn("time", "string", "categorical"),)), 10, 3, f"file://{tmp_path}/x")
    schema = PointSchema((PointColumn("a", "uint32", "categorical"), PointColumn("b", "uint64", "integer"), PointColumn("c", "int64", "timedelta_ns")))
    points = spark.createDataFrame([(0, 0, 0, 2**32 - 1, Decimal(2**64 - 1), -5)], "sample_id long, feature_id int, point_idx int, a long, b decimal(20,0), c long")
    index = spark.createDataFrame([(0, 0, 1)], "sample_id long, feature_id int, trace_len int")
    uri = f"file://{tmp_path}/y"
    binary_blocks.write(index, points, schema, 1, 1, uri, dictionaries={"a": ["ok", "bad"]})
    r = binary_blocks.read(spark, uri).first()
    assert (r["a"], [int(x) for x in r["b"]], r["c"]) == ([2**32 - 1], [2**64 - 1], [-5])
    assert json.loads((tmp_path / "y/categorical_dictionaries/a.json").read_text())["items"][1] == {"code": 2, "label": "bad"}
    raw = (tmp_path / "y/array_binary_feature_shards/shard_0000.blocks.bin").read_bytes()[64:]
    with pytest.raises(DataError):
        binary_blocks.decode(raw[:-1], ["<u4", "<u8", "<i8"])


def test_trace_store(spark, hand, tmp_path):
    cells, index, points = hand
    samples = spark.createDataFrame([(i, f"s{i}") for i in range(10)], "sample_id long, sample_key string")
    features = spark.createDataFrame([(i, f"f{i}") for i in range(3)], "feature_id int, feature_key string")
    d = trace_store.build(index, points, POINTS, samples, features, f"file://{tmp_path}/t", rows_per_part=4, rows_per_file=3)
    assert d.root["samples_per_part"] == 3 and not d.violations().head(1)
    got = d.get_traces(sample_keys=["s5", "s0", "s1"], feature_ids=[0, 2], include_missing=True, finite=True).collect()
    assert [(r["sample_id"], r["feature_id"], r["present"], r["trace_len"]) for r in got] == [(0, 0, True, 3), (0, 2, False, None), (1, 0, False, None), (1, 2, False, None), (5, 0, True, 0), (5, 2, False, None)]
    assert d.count_traces(sample_ids=[0, 1, 5, 5], feature_keys=["f0"]) == 2 and d.count_traces(sample_ids=[0, 5], feature_ids=[0, 1], include_missing=True) == 4
    shown = json.loads(d.get_traces_json(sample_ids=[8]).first()["json"])
    assert shown["traces"][0]["columns"] == {"time": [0.0, None], "value": [80.0, None]}
    with pytest.raises(TooLargeError):
        d.get_traces(sample_ids=[0, 1], max_traces=1)
    with pytest.raises(RequestError):
        d.get_traces(sample_ids=[0], feature_ids=[0], feature_keys=["f0"])
    with pytest.raises(RequestError):
        d.get_traces_json("wide", sample_ids=[0])
    with pytest.raises(NotFoundError):
        d.get_traces(sample_ids=[10])
    for bad_index, bad_points in ((index.where("sample_id != 7"), points), (index.unionByName(index.limit(1)), points), (index, points.withColumn("value", F.when(F.col("sample_id") == 7, None).otherwise(F.col("value")))), (index, points.withColumn("point_idx", F.col("point_idx") + 1))):
        with pytest.raises(DataError):
            trace_store.build(bad_index, bad_points, POINTS, samples, features, f"file://{tmp_path}/u")
    empty = trace_store.build(index.limit(0), points.limit(0), POINTS, samples, features, f"file://{tmp_path}/v")
    assert empty.get_traces(sample_ids=[0]).count() == 0 and not empty.violations().head(1)


def test_synthetic_traces(spark, tmp_path):
    index = synthetic.trace_lengths(spark, 12, 8, 8, seed=5)
    points = synthetic.trace_points(index, seed=5)
    d = trace_store.build(index, points, POINTS, synthetic.scalar_samples(spark, 12), synthetic.scalar_features(spark, 8), f"file://{tmp_path}/t")
    binary_blocks.write(index, points, POINTS, 12, 8, f"file://{tmp_path}/b", per_block=5)
    cols = ["sample_id", "feature_id", "trace_len", "time", "value"]
    a, b = d.get_traces(sample_ids=list(range(12))).select(cols), binary_blocks.read(spark, f"file://{tmp_path}/b").select(cols)
    assert a.count() == index.count() > 50 and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
