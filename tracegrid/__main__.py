"""Command line: build, locate, select, validate, compact and serve datasets. Results are printed as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tracegrid.errors import DataError, NotFoundError, RequestError
from tracegrid.operators import selection
from tracegrid.schema import RAW, PointColumn, PointSchema
from tracegrid.sources import binary_blocks, block_dataset, scalar_store, service, storage, trace_store
from tracegrid.sources.session import Session


def _show(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), default=str))


def _open(spark: SparkSession, path: str) -> scalar_store.ScalarDataset | trace_store.TraceDataset | block_dataset.BlockDataset:
    if storage.exists(spark, f"{path}/{binary_blocks.ROOT}"):
        return block_dataset.BlockDataset(spark, path)
    kind = storage.read_json(spark, f"{path}/manifest.json").get("format")
    return (trace_store.TraceDataset if kind == trace_store.KIND else scalar_store.ScalarDataset)(spark, path)


def _build_scalar(spark: SparkSession, a: argparse.Namespace) -> int:
    d = scalar_store.build(*[spark.read.parquet(p) for p in (a.raw, a.samples, a.features)], a.out, a.y or [], a.target_bytes, overwrite=a.overwrite)
    print(json.dumps(d.schema()))
    return 0


def _build_traces(spark: SparkSession, a: argparse.Namespace) -> int:
    columns = tuple(PointColumn(*c.split(":")) for c in a.column)
    d = trace_store.build(spark.read.parquet(a.index), spark.read.parquet(a.points), PointSchema(columns), spark.read.parquet(a.samples), spark.read.parquet(a.features), a.out, overwrite=a.overwrite)
    print(json.dumps(d.schema()))
    return 0


def _build_blocks(spark: SparkSession, a: argparse.Namespace) -> int:
    columns = PointSchema(tuple(PointColumn(*c.split(":")) for c in a.column))
    tables = [spark.read.parquet(p) for p in (a.index, a.points, a.samples, a.features)]
    d = block_dataset.build(*tables[:2], columns, *tables[2:], a.out, overwrite=a.overwrite, per_block=a.per_block, shard_bytes=a.shard_bytes, codec=a.codec)
    print(json.dumps(d.schema()))
    return 0


def _locate(spark: SparkSession, a: argparse.Namespace) -> int:
    d = _open(spark, a.path)
    if isinstance(d, trace_store.TraceDataset):
        raise RequestError("traces by sample have no place of a feature")
    found = d.locate(a.feature)
    print(json.dumps(found) if found else "NOT_FOUND")
    return 0 if found else 1


def _select(spark: SparkSession, a: argparse.Namespace) -> int:
    o = selection.SelectionOptions(a.y, a.y_r2, a.min_non_null_y, a.ff_r2, a.min_non_null_pair, a.top_m, a.max_candidates)
    _show(scalar_store.ScalarDataset(spark, a.path).select_features(o).orderBy("rank"))
    return 0


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    faults = _open(spark, a.path).violations()
    _show(faults.limit(a.most))
    return 1 if faults.head(1) else 0


def _compact(spark: SparkSession, a: argparse.Namespace) -> int:
    print(json.dumps(Session(spark, a.path, {"cells": RAW}).compact(a.batch, cleanup=a.cleanup)))
    return 0


def _serve(spark: SparkSession, a: argparse.Namespace) -> int:
    service.serve(service.Service(spark), a.host, a.port).serve_forever()
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracegrid", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *positional: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for x in positional:
            p.add_argument(x)
        return p

    p = command("build-scalar", _build_scalar, "raw", "samples", "features", "out")
    p.add_argument("--y", action="append", help="a target column; may be repeated")
    p.add_argument("--target-bytes", type=int, default=32 << 20)
    p.add_argument("--overwrite", action="store_true")
    p = command("build-traces", _build_traces, "index", "points", "samples", "features", "out")
    p.add_argument("--column", action="append", required=True, help="name:storage:logical of a point column; may be repeated")
    p.add_argument("--overwrite", action="store_true")
    p = command("build-blocks", _build_blocks, "index", "points", "samples", "features", "out")
    p.add_argument("--column", action="append", required=True, help="name:storage:logical of a point column; may be repeated")
    p.add_argument("--per-block", type=int, default=16)
    p.add_argument("--shard-bytes", type=int, default=32 << 20)
    p.add_argument("--codec", choices=sorted(binary_blocks.CODECS), default="none")
    p.add_argument("--overwrite", action="store_true")
    command("locate", _locate, "path").add_argument("feature", type=int)
    p = command("select", _select, "path")
    o = selection.SelectionOptions()
    p.add_argument("--y", default=o.y_col)
    p.add_argument("--y-r2", type=float, default=o.y_r2_threshold)
    p.add_argument("--min-non-null-y", type=int, default=o.min_non_null_y)
    p.add_argument("--ff-r2", type=float, default=o.ff_r2_threshold)
    p.add_argument("--min-non-null-pair", type=int, default=o.min_non_null_pair)
    p.add_argument("--top-m", type=int, default=o.top_m)
    p.add_argument("--max-candidates", type=int, default=o.max_candidates)
    command("validate", _validate, "path").add_argument("--most", type=int, default=100, help="how many faults to print")
    command("compact", _compact, "path", "batch").add_argument("--cleanup", action="store_true")
    p = command("serve", _serve)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(spark or SparkSession.builder.getOrCreate(), a)
    except (RequestError, NotFoundError, DataError) as fault:
        print(fault.args[0], file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
