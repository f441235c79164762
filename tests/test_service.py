"""The HTTP routes, the command line, and compaction of staged batches."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tracegrid.__main__ import main
from tracegrid.errors import DataError, RequestError
from tracegrid.functions import values
from tracegrid.schema import RAW, PointColumn, PointSchema
from tracegrid.sources import binary_blocks, block_dataset, scalar_store, trace_store
from tracegrid.sources.builders import ScalarBuilder, TraceBuilder
from tracegrid.sources.service import Service, serve
from tracegrid.sources.session import Session

POINTS = PointSchema((PointColumn("time", "int64", "timestamp_ns"), PointColumn("value", "float64", "continuous")))


@pytest.fixture(scope="module")
def sets(spark, tmp_path_factory):
    """A scalar grid, traces, and blocks, with their services' folders; tables for the command line lie beside them."""
    root = f"file://{tmp_path_factory.mktemp('service')}"
    raw = spark.createDataFrame([(0, 0, 10.0), (1, 0, 11.0), (1, 1, float("inf")), (2, 1, 20.0), (2, 0, 13.0)], RAW)
    samples = spark.createDataFrame([(i, f"s{i}", float(i)) for i in range(3)], "sample_id long, sample_key string, y double")
    features = spark.createDataFrame([(0, "a"), (1, "b")], "feature_id int, feature_key string")
    for name, df in (("raw", raw), ("samples", samples), ("features", features)):
        df.write.parquet(f"{root}/{name}")
    scalar_store.build(raw, samples, features, f"{root}/scalar", ["y"])
    index = spark.createDataFrame([(0, 0, 2), (2, 1, 0)], "sample_id long, feature_id int, trace_len int")
    points = spark.createDataFrame([(0, 0, 0, 5, 1.5), (0, 0, 1, 1_000_000_007, float("nan"))], "sample_id long, feature_id int, point_idx int, time long, value double")
    trace_store.build(index, points, POINTS, samples, features, f"{root}/traces")
    binary_blocks.write(index, points, POINTS, 3, 2, f"{root}/blocks", per_block=2)
    block_dataset.build(index, points, POINTS, samples.drop("y"), features, f"{root}/keyed", per_block=2)
    for name, df in (("index", index), ("points", points)):
        df.write.parquet(f"{root}/{name}")
    return root


def test_scalar_routes(spark, sets):
    s, path = Service(spark), f"{sets}/scalar/manifest.json"
    assert s.handle("GET", "/healthz") == (200, {"ok": True})
    status, got = s.handle("POST", "/scalar/features", {"manifest_path": path, "feature_keys": ["b", "a"], "sample_ids": [2, 1]})
    assert status == 200 and [[(v["sample_key"], v["present"], v["value"]) for v in f["values"]] for f in got["features"]] == [[("s2", True, 20.0), ("s1", True, None)], [("s2", True, 13.0), ("s1", True, 11.0)]]
    status, got = s.handle("POST", "/scalar/sample", {"manifest_path": path, "sample_key": "s0"})
    assert status == 200 and [(v["feature_key"], v["present"], v["value"]) for v in got["values"]] == [("a", True, 10.0), ("b", False, None)]
    status, got = s.handle("POST", "/scalar-feature", {"manifest_path": path, "feature_id": 0})
    assert status == 200 and got["feature_key"] == "a" and [v["value"] for v in got["values"]] == [10.0, 11.0, 13.0]
    status, got = s.handle("POST", "/scalar/top-features", {"manifest_path": path, "top_k": 1})
    assert status == 200 and [f["feature_key"] for f in got["features"]] == ["a"] and got["features"][0]["n_y_overlap"] == 3
    status, got = s.handle("POST", "/run-selection", {"manifest_path": path, "min_non_null_y": 2, "min_non_null_pair": 2})
    assert status == 200 and got["candidate_count"] == 1 and [r["feature_key"] for r in got["selected"]] == ["a"] and got["elapsed_ms"] > 0
    assert s.handle("POST", "/scalar/schema", {"manifest_path": path})[1]["selection_stats"] == ["y"]
    assert [e["manifest_path"] for e in s.handle("GET", "/cache-stats")[1]["entries"]] == [f"{sets}/scalar"]


@pytest.mark.parametrize(
    "route,body,status",
    [
        ("/scalar/features", {"feature_ids": [0], "feature_keys": ["a"], "sample_ids": [0]}, 400),
        ("/scalar/features", {"feature_ids": [0], "sample_ids": []}, 400),
        ("/scalar/features", {"feature_keys": ["?"], "sample_ids": [0]}, 404),
        ("/scalar/features", {"feature_ids": [7], "sample_ids": [0]}, 404),
        ("/scalar/features", {"feature_ids": [7], "sample_ids": [0], "strict": False}, 200),
        ("/scalar/features", {"feature_ids": [0, 1], "sample_ids": [0, 1], "max_cells": 3}, 413),
        ("/scalar/sample", {"sample_ids": [0, 1]}, 400),
        ("/scalar/sample", {"sample_id": 0, "max_features": 1}, 413),
        ("/scalar-feature", {"feature_id": 0, "max_cells": 2}, 413),
        ("/scalar/top-features", {"y_col": "z"}, 404),
        ("/array-sample-parquet/traces", {"sample_ids": [0]}, 400),
        ("/array-feature", {"feature_id": 0}, 400),
        ("/nowhere", {}, 404),
    ],
)
def test_refusals(spark, sets, route, body, status):
    got = Service(spark).handle("POST", route, {"manifest_path": f"{sets}/scalar", **body})
    assert got[0] == status and (status == 200 or got[1]["detail"])


def test_requests_without_dataset(spark, sets):
    s = Service(spark)
    assert s.handle("POST", "/scalar/schema", {})[0] == 400 and s.handle("POST", "/scalar/schema", {"manifest_path": f"{sets}/none"})[0] == 404
    assert s.handle("POST", "/scalar/schema", [1])[0] == 400


def test_trace_routes(spark, sets):
    s, path = Service(spark, max_open=1), f"{sets}/traces"
    assert s.handle("POST", "/array-sample-parquet/schema", {"manifest_path": path})[1]["point_schema"][0] == {"name": "time", "storage_type": "int64", "logical_type": "timestamp_ns"}
    asked = {"manifest_path": path, "sample_keys": ["s0", "s2"], "layout": "flat"}
    status, got = s.handle("POST", "/array-sample-parquet/traces", asked)
    times = ["1970-01-01T00:00:00.000000005", "1970-01-01T00:00:01.000000007"]
    assert status == 200 and [(t["sample_id"], t["trace_len"], t["columns"]) for t in got["traces"]] == [(0, 2, {"time": times, "value": [1.5, None]}), (2, 0, {"time": [], "value": []})]
    assert len(s.handle("POST", "/array-sample-parquet/traces", asked | {"layout": "nested"})[1]["samples"]) == 2
    assert s.handle("POST", "/array-sample-parquet/traces", asked | {"max_traces": 1})[0] == 413 and s.handle("POST", "/array-sample-parquet/traces", asked | {"layout": "?"})[0] == 400
    blocks = {"manifest_path": f"{sets}/blocks", "feature_ids": [1, 0], "sample_ids": [2, 0]}
    status, got = s.handle("POST", "/array-feature", blocks)
    assert status == 200 and [[(t["sample_id"], t["flags"], t["columns"]["time"]) for t in f["traces"]] for f in got["features"]] == [[(2, 3, []), (0, 0, [])], [(2, 0, []), (0, 1, times)]]
    assert s.handle("POST", "/array-schema", blocks | {"include_dictionaries": True})[1]["categorical_dictionaries"] == {}
    keyed = {"manifest_path": f"{sets}/keyed", "feature_keys": ["b", "a"], "sample_keys": ["s2", "s0"]}
    status, same = s.handle("POST", "/array-feature", keyed)
    assert status == 200 and [[(t["sample_key"], t["flags"], t["columns"]["time"]) for t in f["traces"]] for f in same["features"]] == [[("s2", 3, []), ("s0", 0, [])], [("s2", 0, []), ("s0", 1, times)]]
    assert s.handle("POST", "/array-feature", keyed | {"feature_keys": ["?"]})[0] == 404 and s.handle("POST", "/array-feature", {"manifest_path": f"{sets}/blocks", "feature_keys": ["a"]})[0] == 400
    assert s.handle("POST", "/array-feature", blocks | {"feature_keys": ["a"]})[0] == 400 and s.handle("POST", "/array-feature", blocks | {"feature_ids": [2]})[0] == 404
    assert len(s.cache_stats({})["entries"]) == 1


def test_over_the_network(spark, sets):
    server = serve(Service(spark), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        body = json.dumps({"manifest_path": f"{sets}/scalar"}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{url}/scalar/schema", body), timeout=60) as answer:
            assert json.loads(answer.read())["n_samples"] == 3
        with pytest.raises(urllib.error.HTTPError) as fault:
            urllib.request.urlopen(urllib.request.Request(f"{url}/scalar/schema", b"{"), timeout=60)
        assert fault.value.code == 400
    finally:
        server.shutdown()
        server.server_close()


def test_command_line(spark, sets, tmp_path, capsys):
    out = f"file://{tmp_path}/d"
    assert main(["build-scalar", f"{sets}/raw", f"{sets}/samples", f"{sets}/features", out, "--y", "y"], spark) == 0
    assert main(["build-scalar", f"{sets}/raw", f"{sets}/samples", f"{sets}/features", out], spark) == 2
    assert main(["locate", out, "1"], spark) == 0 and main(["locate", out, "5"], spark) == 1 and main(["validate", out], spark) == 0
    capsys.readouterr()
    assert main(["select", out, "--min-non-null-y", "2", "--min-non-null-pair", "2"], spark) == 0
    assert json.loads(capsys.readouterr().out)["feature_id"] == 0
    traces = f"file://{tmp_path}/t"
    assert main(["build-traces", *[f"{sets}/{x}" for x in ("index", "points", "samples", "features")], traces, "--column", "time:int64:timestamp_ns", "--column", "value:float64:continuous"], spark) == 0
    assert main(["validate", traces], spark) == 0
    blocks = f"file://{tmp_path}/b"
    made = ["build-blocks", *[f"{sets}/{x}" for x in ("index", "points", "samples", "features")], blocks, "--column", "time:int64:timestamp_ns", "--column", "value:float64:continuous", "--per-block", "2", "--codec", "zstd"]
    assert main(made, spark) == 0 and main(made, spark) == 2 and main([*made, "--overwrite"], spark) == 0
    capsys.readouterr()
    assert main(["locate", blocks, "1"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert (found["first_record"], found["n_records"]) == (2, 2) and main(["locate", blocks, "5"], spark) == 1 and main(["validate", blocks], spark) == 0


def test_scalar_builder(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    samples = spark.createDataFrame([(0, "s0", 1.0), (1, "s1", 2.0), (2, "s2", 3.0)], "sample_id long, sample_key string, y double")
    features = spark.createDataFrame([(0, "a"), (1, "b")], "feature_id int, feature_key string")
    with pytest.raises(RequestError):
        ScalarBuilder(spark, path)
    b = ScalarBuilder(spark, path, samples, features)
    cell = lambda *rows: spark.createDataFrame(list(rows), RAW)
    assert b.write("x", cell((0, 0, 1.0), (1, 0, 2.0))) and b.status()["pending"] == 1
    cell((2, 0, 9.0)).write.parquet(f"{path}/stage/cells/died")
    b = ScalarBuilder(spark, path)  # goes on where it was left
    assert [r[0] for r in b.pending().collect()] == [2] and b.recover() == ["died"] and b.recover() == []
    with pytest.raises(DataError):
        b.build(f"{path}/out")
    assert b.write("y", cell((2, 0, 4.0), (0, 1, 7.0)))  # sample 0 is complete already
    b.update_features(spark.createDataFrame([(0, "m"), (1, "s")], "feature_id int, unit string"), require_all=True)
    with pytest.raises(DataError):
        b.update_features(spark.createDataFrame([(0, "m")], "feature_id int, unit string"))
    d = b.build(f"{path}/out", ["y"])
    assert d.value(0, 2) == (True, 4.0) and d.value(1, 0) == (False, None) and "unit" in d.features.columns


def test_trace_builder(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    samples = spark.createDataFrame([(i, f"s{i}") for i in range(3)], "sample_id long, sample_key string")
    features = spark.createDataFrame([(0, "a"), (1, "b")], "feature_id int, feature_key string")
    b = TraceBuilder(spark, path, POINTS, samples, features)
    b.add_trace(2, 1, {"time": [], "value": []})
    b.add_trace(0, 0, {"time": [5, 9], "value": [1.5, 2.5]})
    for bad in ({"time": [1]}, {"time": [1], "value": []}):
        with pytest.raises(RequestError):
            b.add_trace(0, 1, bad)
    with pytest.raises(RequestError):
        b.add_trace(0, 0, {"time": [], "value": []})
    assert b.commit(2) and b.commit(0) and not b.commit(0)
    with pytest.raises(DataError):
        b.finish()
    assert b.commit(1)  # without traces
    d = b.build(f"{path}/out")
    assert [(r["sample_id"], r["feature_id"], r["time"]) for r in d.get_traces(sample_ids=[0, 1, 2]).collect()] == [(0, 0, [5, 9]), (2, 1, [])]
    blocks = b.build_blocks(f"{path}/blocks", per_block=2)
    assert blocks.trace("a", "s0")["value"] == [1.5, 2.5] and blocks.trace("b", "s2")["present"] and not blocks.trace("b", "s0")["present"] and blocks.violations().count() == 0


def test_compaction(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/stage", {"cells": RAW})
    samples = spark.range(4).select(F.col("id").alias("sample_id"))
    rows = spark.createDataFrame([(i, 0, float(i)) for i in range(4)], RAW)
    for i in range(3):
        s.write(f"b{i}", samples.where(F.col("sample_id") == i), cells=rows)
    with pytest.raises(DataError):
        s.compact("all", samples)
    assert s.compact("first") and not s.compact("first") and s.live() == ["first"]
    assert not s.write("b1", cells=rows) and not s.write("first", cells=rows)  # names stay known
    assert s.write("b3", samples, cells=rows) and s.live() == ["b3", "first"]
    assert s.compact("all", samples, cleanup=True) and s.live() == ["all"] and sorted(p.name for p in (tmp_path / "stage/cells").iterdir()) == ["all", "b0", "b1", "b2"]
    assert sorted(r[0] for r in s.table("cells").select("value").collect()) == [0.0, 1.0, 2.0, 3.0] and not s.pending(samples).head(1)
    assert not s.compact("again")


def test_extended_dictionary(spark):
    old = spark.createDataFrame([("x", 1), ("y", 2)], "label string, code int")
    rows = spark.createDataFrame([(1, "q"), (2, "y"), (3, None), (4, "b"), (5, "q")], "n int, label string")
    assert dict(values.extend_dictionary(old, rows, "label", "n").collect()) == {"x": 1, "y": 2, "q": 3, "b": 4}
    assert dict(values.extend_dictionary(old.limit(0), rows, "label", "n").collect()) == {"q": 1, "y": 2, "b": 3}
