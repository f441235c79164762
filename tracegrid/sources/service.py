"""Datasets over HTTP: JSON in, JSON out, by the standard library's server. Faults of a request become status codes.

Every answer is assembled on the driver, so each route has a bound on cells or traces that is checked before data are
read. A dataset is named by ``manifest_path``: its folder, or the JSON root in it.
"""

from __future__ import annotations

import json
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid import axes
from tracegrid.errors import DataError, NotFoundError, RequestError, TooLargeError
from tracegrid.functions.temporal import format_ns_array
from tracegrid.functions.values import finite_or_null, finite_or_null_array
from tracegrid.operators import selection
from tracegrid.sources import binary_blocks, block_dataset, scalar_store, storage, trace_store

#: Defaults of the bounds, and of the store of open datasets.
MAX_CELLS, MAX_FEATURES, MAX_TRACES, MAX_OPEN, IDLE_SECONDS = 100_000, 10_000, 10_000, 16, 1800
MAX_BODY = 16 << 20
STATUS = ((NotFoundError, 404), (TooLargeError, 413), (RequestError, 400), (DataError, 400), (ValueError, 400), (TypeError, 400))
Body = dict


def _keys(meta: DataFrame, axis: str, ids: list[int]) -> dict[int, str]:
    """The keys of the ids asked for; none where the axis has no keys."""
    if f"{axis}_key" not in meta.columns:
        return {}
    return {r[0]: r[1] for r in meta.where(F.col(f"{axis}_id").isin(sorted(set(ids)))).select(f"{axis}_id", F.col(f"{axis}_key").cast("string")).collect()}


def _at_most(n: int, most: int, what: str) -> None:
    if n > most:
        raise TooLargeError(f"the request has {n} {what}, more than {most}")


def _one(body: Body, axis: str) -> tuple[list | None, list | None]:
    """(ids, keys) of a request that may also name a single id or key."""
    found = {k: body.get(k) if body.get(k) is not None else [body[k[:-1]]] if body.get(k[:-1]) is not None else None for k in (f"{axis}_ids", f"{axis}_keys")}
    return found[f"{axis}_ids"], found[f"{axis}_keys"]


class Service:
    """The routes, without a network: ``handle`` takes a request and gives a status and an answer."""

    def __init__(self, spark: SparkSession, max_open: int = MAX_OPEN, idle_seconds: float = IDLE_SECONDS) -> None:
        self.spark, self.max_open, self.idle_seconds = spark, max_open, idle_seconds
        self._lock, self._open = threading.Lock(), OrderedDict()
        self.routes: dict[tuple[str, str], Callable[[Body], dict]] = {
            ("GET", "/healthz"): lambda body: {"ok": True},
            ("GET", "/cache-stats"): self.cache_stats,
            ("POST", "/scalar/schema"): self.scalar_schema,
            ("POST", "/scalar/features"): self.scalar_features,
            ("POST", "/scalar/sample"): self.scalar_sample,
            ("POST", "/scalar/top-features"): self.top_features,
            ("POST", "/scalar-feature"): self.scalar_feature,
            ("POST", "/run-selection"): self.run_selection,
            ("POST", "/array-sample-parquet/schema"): self.trace_schema,
            ("POST", "/array-sample-parquet/traces"): self.traces,
            ("POST", "/array-schema"): self.block_schema,
            ("POST", "/array-feature"): self.block_feature,
        }

    def handle(self, method: str, route: str, body: Body | None = None) -> tuple[int, dict]:
        found = self.routes.get((method, route.partition("?")[0].rstrip("/")))
        if found is None:
            return 404, {"detail": f"there is no {method} {route}"}
        if not isinstance(body if body is not None else {}, dict):
            return 400, {"detail": "a request is a JSON object"}
        try:
            return 200, found(body or {})
        except tuple(kind for kind, _ in STATUS) as fault:
            return next(code for kind, code in STATUS if isinstance(fault, kind)), {"detail": str(fault.args[0] if fault.args else fault)}

    # open datasets

    def _sweep(self) -> None:
        limit = time.monotonic() - self.idle_seconds
        for path in [p for p, (_, used) in self._open.items() if used < limit]:
            del self._open[path]
        while len(self._open) > self.max_open:
            self._open.popitem(last=False)

    def _dataset(self, body: Body, kind: type | str):
        path = body.get("manifest_path")
        if not isinstance(path, str) or not path:
            raise RequestError("a request names its manifest_path")
        path = path.rstrip("/").removesuffix("/manifest.json").removesuffix(f"/{binary_blocks.ROOT}")
        with self._lock:
            self._sweep()
            if path not in self._open:
                self._open[path] = (self._opened(path), 0.0)
            found = self._open[path][0]
            self._open[path] = (found, time.monotonic())
            self._open.move_to_end(path)
            self._sweep()
        if not (isinstance(found, dict) if kind == "blocks" else isinstance(found, kind)):
            raise RequestError(f"{path} holds another kind of dataset")
        return found

    def _opened(self, path: str):
        if storage.exists(self.spark, f"{path}/{binary_blocks.ROOT}"):
            return storage.read_json(self.spark, f"{path}/{binary_blocks.ROOT}") | {"path": path}
        kind = storage.read_json(self.spark, f"{path}/manifest.json").get("format")
        kinds = {scalar_store.KIND: scalar_store.ScalarDataset, trace_store.KIND: trace_store.TraceDataset}
        if kind not in kinds:
            raise RequestError(f"{path} holds {kind!r}")
        return kinds[kind](self.spark, path)

    def cache_stats(self, body: Body) -> dict:
        with self._lock:
            self._sweep()
            now = time.monotonic()
            entries = [{"manifest_path": p, "idle_seconds": round(now - used, 3)} for p, (_, used) in self._open.items()]
        return {"entries": entries, "max_entries": self.max_open, "ttl_seconds": self.idle_seconds}

    # scalar grids

    def scalar_schema(self, body: Body) -> dict:
        d = self._dataset(body, scalar_store.ScalarDataset)
        return {"manifest_path": d.path, "format": d.root["format"], "n_samples": d.n_samples, "n_features": d.n_features, "selection_stats": sorted(d.root["y_cols"])}

    def _cells(self, d, features, feature_keys, samples, sample_keys, body: Body) -> list[dict]:
        """One entry a feature asked for, each with its values in the order of the samples asked for."""
        f, s = d._ids(features, feature_keys, "feature"), d._ids(samples, sample_keys, "sample")
        rows = d.cells(f, s, strict=bool(body.get("strict", True)), max_cells=int(body.get("max_cells", MAX_CELLS)))
        sanitize = bool(body.get("sanitize_nonfinite", True))
        value = finite_or_null(F.col("value")) if sanitize else F.col("value")
        got = {(r[0], r[1]): (r[2], r[3]) for r in rows.select("feature_ordinal", "sample_ordinal", "present", value).collect()}
        f_keys, s_keys = _keys(d.features, "feature", f), _keys(d.samples, "sample", s)
        return [
            {
                "feature_id": fid,
                "feature_key": f_keys.get(fid),
                "values": [{"sample_id": sid, "sample_key": s_keys.get(sid), "present": got[i, j][0], "value": got[i, j][1]} for j, sid in enumerate(s)],
            }
            for i, fid in enumerate(f)
        ]

    def scalar_features(self, body: Body) -> dict:
        d = self._dataset(body, scalar_store.ScalarDataset)
        found = self._cells(d, body.get("feature_ids"), body.get("feature_keys"), body.get("sample_ids"), body.get("sample_keys"), body)
        return {"manifest_path": d.path, "layout": "features", "feature_count": len(found), "sample_count": len(found[0]["values"]), "features": found}

    def scalar_sample(self, body: Body) -> dict:
        d = self._dataset(body, scalar_store.ScalarDataset)
        sample = d._ids(*_one(body, "sample"), "sample")
        if len(sample) != 1:
            raise RequestError("name one sample")
        ids, keys = body.get("feature_ids"), body.get("feature_keys")
        if ids is None and keys is None:
            ids = range(d.n_features)
        _at_most(len(ids if ids is not None else keys), int(body.get("max_features", MAX_FEATURES)), "features")
        found = self._cells(d, ids, keys, sample, None, body)
        rows = [{"feature_id": r["feature_id"], "feature_key": r["feature_key"], "present": r["values"][0]["present"], "value": r["values"][0]["value"]} for r in found]
        return {"manifest_path": d.path, "layout": "sample", "sample_id": sample[0], "sample_key": found[0]["values"][0]["sample_key"], "feature_count": len(rows), "values": rows}

    def scalar_feature(self, body: Body) -> dict:
        d = self._dataset(body, scalar_store.ScalarDataset)
        samples, keys = body.get("sample_ids"), body.get("sample_keys")
        if samples is None and keys is None:
            _at_most(d.n_samples, int(body.get("max_cells", MAX_CELLS)), "cells")
            samples = range(d.n_samples)
        found = self._cells(d, *_one(body, "feature"), samples, keys, body)
        if len(found) != 1:
            raise RequestError("name one feature")
        return {"manifest_path": d.path, "sample_count": len(found[0]["values"]), **found[0]}

    def top_features(self, body: Body) -> dict:
        d = self._dataset(body, scalar_store.ScalarDataset)
        y, k = str(body.get("y_col", "y")), int(body.get("top_k", 256))
        _at_most(k, MAX_FEATURES, "features")
        rows = [r.asDict() for r in d.top_features(y, k).drop("y_col").collect()]
        keys = _keys(d.features, "feature", [r["feature_id"] for r in rows])
        return {"manifest_path": d.path, "y_col": y, "top_k": k, "features": [r | {"feature_key": keys.get(r["feature_id"])} for r in rows]}

    def run_selection(self, body: Body) -> dict:
        d = self._dataset(body, scalar_store.ScalarDataset)
        o = selection.SelectionOptions(
            str(body.get("y_col", "y")), float(body.get("y_r2", 0.01)), int(body.get("min_non_null_y", 20)), float(body.get("ff_r2", 0.8)),
            int(body.get("min_non_null_pair", 20)), int(body.get("top_m", 100)), int(body.get("max_candidates", 0)),
        )
        _at_most(o.top_m, MAX_FEATURES, "features")
        began = time.monotonic()
        n = selection.candidates(d.stats(o.y_col), o).count()
        ranked = time.monotonic()
        rows = [r.asDict() for r in d.select_features(o).orderBy("rank").collect()]
        ended = time.monotonic()
        keys = _keys(d.features, "feature", [r["feature_id"] for r in rows])
        took = {"candidate_build_ms": ranked - began, "selection_ms": ended - ranked, "elapsed_ms": ended - began}
        picked = [r | {"feature_key": keys.get(r["feature_id"])} for r in rows]
        return {"manifest_path": d.path, "y_col": o.y_col, "top_m": o.top_m, "candidate_count": n, "selected_count": len(rows), "selected": picked} | {k: round(1000 * v, 3) for k, v in took.items()}

    # traces

    def trace_schema(self, body: Body) -> dict:
        d = self._dataset(body, trace_store.TraceDataset)
        columns = [{"name": c.name, "storage_type": c.storage, "logical_type": c.logical} for c in d.point_schema.columns]
        return {"manifest_path": d.path, **{k: d.root[k] for k in ("format", "version", "n_samples", "n_features")}, "point_schema": columns}

    def traces(self, body: Body) -> dict:
        d = self._dataset(body, trace_store.TraceDataset)
        layout, most = str(body.get("layout", "nested")), int(body.get("max_traces", MAX_TRACES))
        asked = {k: body.get(k) for k in ("sample_ids", "sample_keys", "feature_ids", "feature_keys")}
        rows = d.get_traces_json(layout, **asked, include_missing=bool(body.get("include_missing", False)), max_traces=most, temporal_format=str(body.get("temporal_format", "iso")))
        found = [json.loads(r["json"]) for r in rows.orderBy(*[c for c in ("sample_id", "feature_id") if c in rows.columns]).collect()]
        return {"manifest_path": d.path, "layout": layout, "samples" if layout == "nested" else "traces": found}

    def _dictionaries(self, root: dict) -> dict[str, dict[int, str]]:
        named = {c["name"]: c["dictionary_path"] for c in root["point_schema"] if "dictionary_path" in c}
        return {name: {i["code"]: i["label"] for i in storage.read_json(self.spark, f"{root['path']}/{p}")["items"]} for name, p in named.items()}

    def block_schema(self, body: Body) -> dict:
        root = self._dataset(body, "blocks")
        out = {"manifest_path": root["path"], **{k: root[k] for k in ("version", "n_samples", "n_features", "samples_per_block", "default_codec", "point_schema")}}
        return out | ({"categorical_dictionaries": self._dictionaries(root)} if body.get("include_dictionaries") else {})

    def block_feature(self, body: Body) -> dict:
        """Traces of features in request order, by ids or keys; a sample without a trace has flags 0. Blocks without axes have ids only."""
        root = self._dataset(body, "blocks")
        (features, f_keys), (samples, s_keys) = _one(body, "feature"), _one(body, "sample")
        d = block_dataset.BlockDataset(self.spark, root["path"])
        features = d._ids("feature", features, f_keys, strict=False)
        samples = list(range(root["n_samples"])) if samples is None and s_keys is None else d._ids("sample", samples, s_keys, strict=False)
        axes.check_range(features, root["n_features"], "feature")
        axes.check_range(samples, root["n_samples"], "sample")
        _at_most(len(features) * len(samples), int(body.get("max_traces", MAX_TRACES)), "traces")
        rows, decoded = binary_blocks.read(self.spark, root["path"], features, samples), self._dictionaries(root) if body.get("decode_categorical") else {}
        for c in root["point_schema"]:
            name, logical = c["name"], c["logical_type"]
            if logical in ("timestamp_ns", "timedelta_ns"):
                rows = rows.withColumn(name, format_ns_array(F.col(name), logical, str(body.get("temporal_format", "iso"))))
            elif c["storage_type"] == "float64" and body.get("sanitize_nonfinite", True):
                rows = rows.withColumn(name, finite_or_null_array(F.col(name)))
        names, got = [c["name"] for c in root["point_schema"]], {}
        for r in rows.collect():
            columns = {n: [decoded[n].get(x) for x in r[n]] if n in decoded else list(r[n]) for n in names}
            got[r["feature_id"], r["sample_id"]] = {"flags": r["flags"], "trace_len": r["trace_len"], "columns": columns}
        missing = {"flags": 0, "trace_len": 0, "columns": {n: [] for n in names}}
        f_named, s_named = (_keys(d._axis(a), a, ids) for a, ids in (("feature", features), ("sample", samples))) if d.has_axes() else ({}, {})
        items = [{"feature_id": f, "feature_key": f_named.get(f), "traces": [{"sample_id": s, "sample_key": s_named.get(s)} | got.get((f, s), missing) for s in samples]} for f in features]
        return {"manifest_path": root["path"], "feature_count": len(features), "sample_count": len(samples), "features": items}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server for the routes, bound but not yet running: call its serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            if length > MAX_BODY:
                status, answer = 413, {"detail": f"a request has at most {MAX_BODY} bytes"}
                self.close_connection = True
            else:
                try:
                    status, answer = service.handle(method, self.path, json.loads(self.rfile.read(length)) if length else None)
                except json.JSONDecodeError as fault:
                    status, answer = 400, {"detail": f"not JSON: {fault}"}
            raw = json.dumps(answer, default=str).encode()
            self.send_response(status)
            for name, value in (("Content-Type", "application/json"), ("Content-Length", str(len(raw))), ("Access-Control-Allow-Origin", "*")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
