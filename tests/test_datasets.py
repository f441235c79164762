"""Sources over HTTP, raw files, blocks by key, selection by stages, and statistics far from zero."""

import builtins
import importlib
import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracegrid.errors import NotFoundError, RequestError
from tracegrid.functions import temporal
from tracegrid.operators import checks, scalar, selection, stats
from tracegrid.plans import dataset_queries, grid_queries
from tracegrid.plans import fixtures as fx
from tracegrid.schema import RAW
from tracegrid.sources import http_values, raw_files
from tracegrid.sources.session import Session


class Values(BaseHTTPRequestHandler):
    """Every third cell is missing, sample 2 fails at first."""

    failed = False

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if body["sample_id"] == 2 and not Values.failed:
            Values.failed = True
            self.send_error(503)
            return
        found = [{"feature_id": f, "present": (f + body["sample_id"]) % 3 > 0, "value": None if f == 4 else f * 10.0 + body["sample_id"]} for f in body["feature_ids"]]
        raw = json.dumps({"values": found}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *args):
        pass


def test_values_over_http(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Values)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/values"
        staged = Session(spark, f"file://{tmp_path}/stage", {"cells": RAW})
        assert http_values.stage(staged, "first", spark.range(2).withColumnRenamed("id", "sample_id"), 10, url, chunk=4)
        assert http_values.stage(staged, "rest", spark.range(5).withColumnRenamed("id", "sample_id"), 10, url, chunk=4)
        want = {(s, f, f * 10.0 + s) for s in range(5) for f in range(10) if (f + s) % 3 and f != 4}
        assert Values.failed and sorted(map(tuple, staged.table("cells").collect())) == sorted(want)
        assert staged.pending(spark.range(5).withColumnRenamed("id", "sample_id")).count() == 0
    finally:
        server.shutdown()


def test_raw_files_need_a_number(spark, tmp_path):
    spark.createDataFrame([(0, 1.0)], "feature_id int, value double").write.parquet(f"file://{tmp_path}/raw/other")
    with pytest.raises(PySparkException, match="no sample number"):
        raw_files.read_raw(spark, f"file://{tmp_path}/raw").collect()


def test_blocks_refuse_unknown_keys(spark, sf):
    d = dataset_queries._block_dataset(spark, sf)
    with pytest.raises(NotFoundError):
        d.traces(feature_keys=["none"], sample_ids=[1])
    with pytest.raises(NotFoundError):
        d.traces(feature_ids=[99], sample_ids=[1], strict=True)
    with pytest.raises(RequestError):
        d.traces(feature_ids=[1], feature_keys=["view"], sample_ids=[1])
    assert d.traces(feature_ids=[99], sample_ids=[1]).first()["present"] is False
    assert [n for n, _ in d.schema()] == ["ts", "value"] and d.trace("view", "user-0003")["feature_id"] == 4


def test_r2_far_from_zero(spark):
    """Nanosecond times: an offset of 1.7e18 with a spread of thousands."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 10_000, 400)
    y = x * 3.0 + rng.normal(0, 3000, 400)
    rows = spark.createDataFrame([(i, 0, 1.7e18 + 1024.0 * int(v)) for i, v in enumerate(x)], RAW)
    targets = spark.createDataFrame([(i, float(v) + 1e12) for i, v in enumerate(y)], "sample_id long, y double")
    got = stats.selection_stats(rows, spark.createDataFrame([(0,)], "feature_id int"), targets, ["y"]).first()["r2y"]
    assert abs(got - np.corrcoef(x, y)[0, 1] ** 2) < 1e-3


@pytest.mark.parametrize("first,most", [(1, 1), (5, 100)])
@pytest.mark.parametrize("top_m", [4, 100])
def test_stages_take_what_one_walk_takes(spark, first, most, top_m):
    from tracegrid.sources import synthetic

    raw = synthetic.scalar_cells(spark, 60, 24, seed=3, noise=0.6).cache()
    o = selection.SelectionOptions(y_r2_threshold=0.0, min_non_null_y=10, ff_r2_threshold=0.3, min_non_null_pair=10, top_m=top_m)
    ranked = selection.candidates(stats.selection_stats(raw, synthetic.scalar_features(spark, 24), synthetic.scalar_samples(spark, 60, seed=3), ["y"]), o).cache()
    whole = {r["rank"] for r in selection.greedy(ranked, selection.redundancy_edges(raw, ranked, o), top_m).collect()}
    assert {r["rank"] for r in selection.staged(raw, ranked, o, first, most).collect()} == whole and whole


@pytest.mark.parametrize("tile,span", [(stats.TILE, stats.SPAN), (3, 7), (1, 100)])
@pytest.mark.parametrize("after", [None, 4])
def test_pair_moments_in_tiles(spark, tile, span, after):
    """Against numpy, with absent cells, a constant, one that is constant beside some others, infinities and a far offset."""
    r = np.random.default_rng(8)
    grid = r.standard_normal((60, 10)) @ r.standard_normal((10, 10))
    grid[:, 2] = 7.25
    grid[:, 3] = 1.7e18 + 1e9 * grid[:, 3]  # nanoseconds, whose last digits a double does not hold: means of spans are rounded to 256
    grid[:30, 5] = 0.1
    grid[4, 6] = np.inf
    there = r.random((60, 10)) < 0.8
    there[30:, 7] = False
    raw = spark.createDataFrame([(s, f, float(grid[s, f])) for s in range(60) for f in range(10) if there[s, f]], RAW)
    got = {(x["lo"], x["hi"]): x for x in stats.pair_moments(raw, after, tile, span).withColumn("r2", stats.r2_of_moments()).collect()}
    want = {(a, b) for a in range(10) for b in range(a + 1, 10) if after is None or b > after}
    assert set(got) == want
    for a, b in want:
        both = there[:, a] & there[:, b]
        x, y = (v[both] - v[both][0] if np.isfinite(v[both]).all() else v[both] for v in (grid[:, a], grid[:, b]))  # numpy's own mean is inexact far from zero
        flat = len(set(x)) == 1 or len(set(y)) == 1 or not np.isfinite(x).all() or not np.isfinite(y).all()
        expected = 0.0 if flat else np.corrcoef(x, y)[0, 1] ** 2
        assert got[a, b]["n"] == both.sum() and got[a, b]["r2"] == pytest.approx(expected, abs=1e-6 if 3 in (a, b) else 1e-9)
        assert not flat or got[a, b]["r2"] == 0.0
    assert stats.pair_moments(raw.limit(0)).count() == 0


@pytest.mark.parametrize("at", [[], [0], [4], [0, 1, 2, 3, 4], [1, 3], [3, 1]])
def test_slots(spark, at):
    df = spark.createDataFrame([([(a, a * 1.5) for a in at],)], "c array<struct<at:int,value:double>>")
    assert df.select(scalar.slots(F.col("c"), 5).alias("s")).first()["s"] == [k * 1.5 if k in at else None for k in range(5)]


def test_registry_without_a_library_of_the_corpus_operators(monkeypatch):
    import __spark_entry__

    real = builtins.__import__

    def without(name, *args, **kw):
        if name == "tokenizers":
            raise ModuleNotFoundError("No module named 'tokenizers'", name="tokenizers")
        return real(name, *args, **kw)

    for m in [m for m in sys.modules if m.startswith("tracegrid.llm") or m == "tokenizers"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", without)
    importlib.reload(__spark_entry__)
    assert "pair_r2" in __spark_entry__.queries() and __spark_entry__.queries().keys() == __spark_entry__.oracle_sql().keys()


def iso(ns):
    a = abs(ns)
    t, f = divmod(a, 10**9)
    f = f"{f:09d}".rstrip("0")
    clock = (f"{t % 86400 // 3600}H" if t % 86400 >= 3600 else "") + (f"{t % 3600 // 60}M" if t % 3600 >= 60 else "") + (f"{t % 60}{'.' * bool(f)}{f}S" if t % 60 or f else "")
    return "PT0S" if not a else "-" * (ns < 0) + "P" + (f"{t // 86400}D" if t >= 86400 else "") + ("T" + clock if clock else "")


def test_durations_beyond_a_long(spark, tmp_path):
    """Event 106,758 times a day is the first product that no LONG holds; the SQL is held against ids that DuckDB multiplies in 128 bits."""
    ids = [*range(12), 106_753, 106_754, 106_755, 106_758, 106_759, 36_000_001, 36_000_002, -106_762]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"file://{tmp_path}/events.parquet")
    got = {r["event_id"]: r["iso"] for r in grid_queries.timedelta_iso(spark, f"file://{tmp_path}").collect()}
    assert got == {i: iso((i - 5) * (10**9, 3600 * 10**9, 86400 * 10**9, 1234567890)[i % 4]) for i in ids if i >= 0} | {-106_762: got[-106_762]}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT CAST(event_id AS HUGEINT) AS event_id FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(duck.sql(grid_queries.oracle_sql()["timedelta_iso"]).fetchall())
    least = [-(2**63), 2**63 - 1, -1, 0]
    rows = spark.createDataFrame([(n,) for n in least], "ns long").select(temporal.timedelta_iso(F.col("ns")).alias("iso")).collect()
    assert [r["iso"] for r in rows] == [iso(n) for n in least]


def counted(rows, seen):
    """The same rows; seen counts them each time that they are computed."""

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema)


@pytest.mark.parametrize("name", ["staged_equals_unstaged", "select_features", "selection_with_candidates", "redundancy_edges"])
def test_cells_are_computed_once(spark, sf, monkeypatch, name):
    seen, cells = spark.sparkContext.accumulator(0), fx.cust_raw
    monkeypatch.setattr(fx, "cust_raw", lambda *a: counted(cells(*a), seen))
    grid_queries.queries()[name](spark, sf).collect()
    assert seen.value == cells(spark, sf).count() > 0


def test_unequal_rows_in_one_pass(spark):
    """Nulls, NaN and repeats, one more often than a block holds, against exceptAll."""
    a = spark.createDataFrame([(1, None), (1, None), (2, float("nan")), (None, 0.5), (3, 1.0)], "k int, v double").unionByName(spark.range(150_000).selectExpr("9 AS k", "2.5D AS v"))
    b = spark.createDataFrame([(1, None), (2, float("nan")), (4, 1.0), (4, 1.0), (9, 2.5)], "k int, v double")
    want = a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    seen = spark.sparkContext.accumulator(0)
    got = checks.unequal_rows(counted(a, seen), counted(b, seen))
    by = lambda df: sorted((repr(tuple(r)) for r in df.groupBy("k", "v", "side").count().collect()))
    assert got.columns == want.columns and by(got) == by(want)
    assert seen.value == a.count() + b.count()


def test_cells_of_one_tile_move_once(spark):
    raw = spark.createDataFrame([(s, f, float(s * f % 7)) for s in range(20) for f in range(5)], RAW)
    moved = lambda tile: stats.pair_moments(raw, tile=tile)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert (moved(stats.TILE), moved(2)) == (2, 3)  # to squares and to pairs' sums; more tiles move the squares too


def test_order_of_a_whole_table_by_many_tasks(spark, tmp_path, monkeypatch):
    """Ranges of 100 rows against the SQL, with null users and a null position; rows of the result lie in many tasks."""
    monkeypatch.setattr(checks, "RANGE_ROWS", 100)
    user = F.when(F.col("id") % 17 == 3, None).otherwise(F.col("id") * 7919 % 1009)
    events = spark.range(3000).select(F.when(F.col("id") != 1234, F.col("id")).alias("event_id"), user.alias("user_id"))
    events.write.parquet(f"file://{tmp_path}/events.parquet")
    found = grid_queries.order_check(spark, f"file://{tmp_path}")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, duck.sql(grid_queries.oracle_sql()["order_check"]).fetchall()))
    assert found.select(F.spark_partition_id()).distinct().count() > 10


def test_order_with_ties_and_two_keys(spark, monkeypatch):
    """Equal positions go by their keys, within a range and across its edge."""
    monkeypatch.setattr(checks, "RANGE_ROWS", 5)
    rows = [(i // 4, i % 3, i * 5 % 7, i) for i in range(60)] + [(3, 1, 1, 60), (3, 1, 1, 61), (9, None, 2, 62), (9, 2, None, 63)]
    df = spark.createDataFrame(rows, "at int, a int, b int, id int")
    low = lambda v: (v is not None, v or 0)
    line = sorted(rows, key=lambda r: (r[0], low(r[1]), low(r[2])))

    def falls(now, before):
        for x, y in zip(now, before):
            if x is None or y is None:
                return False
            if x != y:
                return x < y
        return True

    want = sorted(repr(n[:3]) for p, n in zip(line, line[1:]) if falls(n[1:3], p[1:3]))
    whole = checks.order_violations(df, F.col("at"), ["a", "b"])
    alone = checks.order_violations(df.withColumn("f", F.lit(1)), F.col("at"), ["a", "b"], ["f"])
    for got in (whole, alone):
        assert sorted(repr(tuple(r)) for r in got.select("at", "a", "b").collect()) == want and want
