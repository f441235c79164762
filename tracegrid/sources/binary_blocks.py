"""Feature-major binary trace files: an index of fixed-size records and a file of block payloads for each shard.

Shards are written by the tasks themselves and renamed into place, so a repeated task replaces its own file. Reading
is a Python data source: a task takes a run of index records and reads the payloads they name. Files are reached
through pyarrow's file systems; executors need this package on their Python path.
"""

from __future__ import annotations

import json
import struct
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracegrid.errors import DataError, RequestError
from tracegrid.operators import blocks, traces
from tracegrid.schema import PointSchema
from tracegrid.sources import storage

#: The file format.
FORMAT, VERSION = "array-binary-shard", 3
FILE_HEADER = "<8sHHHHQQI28x"
INDEX_MAGIC, DATA_MAGIC = b"ABLOCKIX", b"ABLOCKSB"
RECORD = [("data_offset", "<u8"), ("data_length", "<u8"), ("point_count", "<u8"), ("codec", "u1"), ("block_flags", "u1"), ("reserved0", "<u2"), ("crc32_optional", "<u4")]
PAYLOAD_HEADER = "<iiqIBBHQIIII"
CODECS = {"none": 0, "zstd": 1}
ITEMS = {"float64": "<f8", "int32": "<i4", "int64": "<i8", "uint32": "<u4", "uint64": "<u8"}
HEADER_BYTES = 64

FOLDER, ROOT = "array_binary_feature_shards", "array_binary_shard_manifest.json"


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def _names(shard: int) -> tuple[str, str]:
    return f"shard_{shard:04d}.blocks.idx", f"shard_{shard:04d}.blocks.bin"


def _payload(feature: int, block: int, per_block: int, n_samples: int, flags, offsets, columns: list[np.ndarray], codec: int) -> tuple[bytes, int]:
    first = block * per_block
    count = min(per_block, n_samples - first)
    flags = np.zeros(count, np.uint8) if flags is None else np.asarray(flags, np.uint8)
    offsets = np.zeros(count + 1, "<i8") if offsets is None else np.asarray(offsets, "<i8")
    points, body = int(offsets[-1]), b"".join(c.tobytes() for c in columns)
    if codec == CODECS["zstd"]:
        import zstandard

        body = zstandard.ZstdCompressor().compress(body)
    head = struct.pack(PAYLOAD_HEADER, feature, block, first, count, codec, 0, len(columns), points, flags.nbytes, offsets.nbytes, len(body), 0)
    return head + flags.tobytes() + offsets.tobytes() + body, points


class _ShardWriter:
    """Writes one shard from rows in (feature, block) order; blocks without traces are filled in."""

    def __init__(self, uri: str, shard: int, geometry: dict) -> None:
        self.uri, self.shard, self.g = uri, shard, geometry
        self.data, self.at, self.records, self.features, self.next = tempfile.TemporaryFile(), HEADER_BYTES, [], [], 0

    def _put(self, feature: int, block: int, flags, offsets, columns) -> None:
        raw, points = _payload(feature, block, self.g["per_block"], self.g["n_samples"], flags, offsets, columns, self.g["codec"])
        self.data.write(raw)
        self.records.append((self.at, len(raw), points, self.g["codec"], 0, 0, 0))
        self.at += len(raw)

    def _fill(self, upto: int) -> None:
        for b in range(self.next, upto):
            self._put(self.features[-1], b, None, None, [np.zeros(0, d) for d in self.g["dtypes"]])
        self.next = upto

    def feature(self, feature: int) -> None:
        if self.features:
            self._fill(self.g["blocks"])
        self.features.append(feature)
        self.next = 0

    def block(self, feature: int, block: int, flags, offsets, columns) -> None:
        self._fill(block)
        self._put(feature, block, flags, offsets, columns)
        self.next = block + 1

    def close(self) -> dict:
        self._fill(self.g["blocks"])
        fs, base = _open(self.uri)
        fs.create_dir(base, recursive=True)
        index_name, data_name = _names(self.shard)
        head = lambda magic, size, aux: struct.pack(FILE_HEADER, magic, VERSION, HEADER_BYTES, size, 0, len(self.records), aux, self.shard)
        attempt = uuid.uuid4().hex
        with fs.open_output_stream(f"{base}/{data_name}.{attempt}") as out:
            out.write(head(DATA_MAGIC, 0, self.at - HEADER_BYTES))
            self.data.seek(0)
            while piece := self.data.read(8 << 20):
                out.write(piece)
        with fs.open_output_stream(f"{base}/{index_name}.{attempt}") as out:
            records = np.array(self.records, RECORD)
            out.write(head(INDEX_MAGIC, records.dtype.itemsize, len(self.features)))
            out.write(records.tobytes())
        for name in (data_name, index_name):
            fs.move(f"{base}/{name}.{attempt}", f"{base}/{name}")
        self.data.close()
        return {"shard_id": self.shard, "feature_id_start": self.features[0], "feature_id_end": self.features[-1], "feature_count": len(self.features), "block_count": len(self.records)}


SHARD_ROW = "shard_id int, feature_id_start int, feature_id_end int, feature_count int, block_count long"


def _write_rows(uri: str, geometry: dict, names: list[str]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, at = [], None
        for batch in batches:
            cols = [batch.column(batch.schema.names.index(n)) for n in names]
            shard, feature, block = (batch.column(batch.schema.names.index(n)).to_pylist() for n in ("shard_id", "feature_id", "block_id"))
            flags, offsets = (batch.column(batch.schema.names.index(n)) for n in ("flags", "offsets"))
            for i in range(batch.num_rows):
                if at is None or at.shard != shard[i]:
                    if at is not None:
                        done.append(at.close())
                    at = _ShardWriter(uri, shard[i], geometry)
                if block[i] < 0:
                    at.feature(feature[i])
                else:
                    arrays = [np.array(c[i].values.to_numpy(zero_copy_only=False)).astype(d) for c, d in zip(cols, geometry["dtypes"])]
                    at.block(feature[i], block[i], flags[i].values.to_numpy(zero_copy_only=False), offsets[i].values.to_numpy(zero_copy_only=False), arrays)
        if at is not None:
            done.append(at.close())
        if done:
            kinds = pa.schema([("shard_id", pa.int32()), ("feature_id_start", pa.int32()), ("feature_id_end", pa.int32()), ("feature_count", pa.int32()), ("block_count", pa.int64())])
            yield pa.RecordBatch.from_pylist(done, kinds)

    return write


def write(index: DataFrame, points: DataFrame, schema: PointSchema, n_samples: int, n_features: int, uri: str, per_block: int = 16, shard_bytes: int = 32 << 20, codec: str = "none", dictionaries: dict[str, list[str]] | None = None) -> dict:
    """Write the shards and then the JSON root, which is returned. Shards are runs of features of about shard_bytes.

    Categorical columns hold codes, of which ``dictionaries`` gives the labels from code 1 on. A task writes whole
    shards and holds one block at a time; a feature larger than a shard has a shard of its own.
    """
    if codec not in CODECS:
        raise RequestError(f"unknown codec {codec!r}")
    for c in schema.columns:
        if c.storage not in ITEMS:
            raise DataError(f"column {c.name!r}: {c.storage} cannot be stored in binary blocks")
    spark, n_blocks = index.sparkSession, -(-n_samples // per_block)
    width = sum(np.dtype(ITEMS[c.storage]).itemsize for c in schema.columns)
    known = blocks.feature_estimates(index, per_block).select("feature_id", "n_points")
    fixed = n_blocks * (struct.calcsize(PAYLOAD_HEADER) + 32) + 9 * n_samples
    sizes = spark.range(n_features).select(F.col("id").cast("int").alias("feature_id")).join(known, "feature_id", "left").select("feature_id", (F.coalesce("n_points", F.lit(0)) * width + fixed).alias("size"))
    shards = blocks.bin_pack(sizes, "feature_id", "size", shard_bytes).select(F.col("feature_id").cast("int").alias("feature_id"), F.col("part_id").alias("shard_id"))
    full = blocks.assemble(index, traces.regroup(index, points, schema.names).select(*traces.CELL, "trace_len", *schema.names), schema.names, n_samples, per_block)
    empty = shards.select("feature_id", F.lit(-1).alias("block_id"), *[F.lit(None).cast(full.schema[n].dataType).alias(n) for n in ("flags", "offsets", *schema.names)])
    rows = full.unionByName(empty).join(shards, "feature_id").repartition("shard_id").sortWithinPartitions("shard_id", "feature_id", "block_id")
    geometry = {"per_block": per_block, "n_samples": n_samples, "blocks": n_blocks, "codec": CODECS[codec], "dtypes": [ITEMS[c.storage] for c in schema.columns]}
    done = rows.mapInArrow(_write_rows(f"{uri}/{FOLDER}", geometry, schema.names), SHARD_ROW).orderBy("shard_id").collect()  # one small row a shard
    listed = [r.asDict() | dict(zip(("blocks_index_name", "blocks_data_name"), _names(r["shard_id"]))) for r in done]
    columns = []
    for c in schema.columns:
        columns.append({"name": c.name, "storage_type": c.storage, "logical_type": c.logical})
        if c.logical == "categorical":
            columns[-1]["dictionary_path"] = f"categorical_dictionaries/{c.name}.json"
            labels = (dictionaries or {}).get(c.name, [])
            storage.write_json(spark, f"{uri}/categorical_dictionaries/{c.name}.json", {"column": c.name, "items": [{"code": i, "label": x} for i, x in enumerate(labels, 1)]})
    root = {
        "format": FORMAT, "version": VERSION, "endianness": "little", "n_samples": n_samples, "n_features": n_features, "shard_path": FOLDER, "n_shards": len(listed), "samples_per_block": per_block,
        "blocks_per_feature": n_blocks, "feature_id_dtype": "INT32", "flags_dtype": "UINT8", "offset_dtype": "INT64", "default_codec": codec, "id_scheme": "dense_row_ids", "point_schema": columns, "shards": listed,
    }
    storage.write_json(spark, f"{uri}/{ROOT}", root)
    return root


class _Run(InputPartition):
    def __init__(self, shard: dict, first: int, last: int) -> None:
        self.shard, self.first, self.last = shard, first, last


def decode(raw: bytes, dtypes: Sequence[str]) -> tuple[dict, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Header, flags, offsets and columns of a payload; DataError if its lengths do not agree."""
    size = struct.calcsize(PAYLOAD_HEADER)
    h = dict(zip("feature block first count codec flags columns points flags_bytes offsets_bytes body_bytes reserved".split(), struct.unpack_from(PAYLOAD_HEADER, raw)))
    a, b = size + h["flags_bytes"], size + h["flags_bytes"] + h["offsets_bytes"]
    if len(raw) != b + h["body_bytes"] or h["columns"] != len(dtypes) or h["flags_bytes"] != h["count"] or h["offsets_bytes"] != 8 * (h["count"] + 1):
        raise DataError("a block's lengths do not agree")
    body = raw[b:]
    if h["codec"] == CODECS["zstd"]:
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=sum(np.dtype(d).itemsize for d in dtypes) * h["points"] or 1)
    elif h["codec"] != CODECS["none"]:
        raise DataError(f"unknown codec {h['codec']}")
    columns, at = [], 0
    for d in dtypes:
        columns.append(np.frombuffer(body, d, h["points"], at))
        at += h["points"] * np.dtype(d).itemsize
    if at != len(body):
        raise DataError("a block's columns do not fill it")
    return h, np.frombuffer(raw, np.uint8, h["count"], size), np.frombuffer(raw, "<i8", h["count"] + 1, a), columns


def _root(uri: str) -> dict:
    fs, base = _open(uri)
    with fs.open_input_stream(f"{base}/{ROOT}") as f:
        root = json.loads(f.read())
    if (root.get("format"), root.get("version")) != (FORMAT, VERSION):
        raise DataError(f"{uri} holds {root.get('format')} {root.get('version')}")
    return root


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.uri, self.root = options["path"].rstrip("/"), _root(options["path"].rstrip("/"))
        self.features, self.samples = (set(json.loads(options[k])) if options.get(k) else None for k in ("featureids", "sampleids"))
        self.step = int(options.get("blockspertask", 4096))

    def partitions(self) -> list[_Run]:
        per, runs = self.root["blocks_per_feature"], []
        for s in self.root["shards"]:
            if self.features is None:
                runs += [_Run(s, a, min(a + self.step, s["block_count"])) for a in range(0, s["block_count"], self.step)]
                continue
            for f in sorted(x for x in self.features if s["feature_id_start"] <= x <= s["feature_id_end"]):
                a = (f - s["feature_id_start"]) * per
                runs += [_Run(s, b, min(b + self.step, a + per)) for b in range(a, a + per, self.step)]
        return runs or [_Run({}, 0, 0)]

    def read(self, run: _Run) -> Iterator[pa.RecordBatch]:
        if run.first == run.last:
            return
        fs, base = _open(f"{self.uri}/{self.root['shard_path']}")
        columns, per = self.root["point_schema"], self.root["blocks_per_feature"]
        dtypes = [ITEMS[c["storage_type"]] for c in columns]
        size = np.dtype(RECORD).itemsize
        with fs.open_input_file(f"{base}/{run.shard['blocks_index_name']}") as f:
            head = struct.unpack(FILE_HEADER, f.read_at(HEADER_BYTES, 0))
            if head[:2] != (INDEX_MAGIC, VERSION) or head[5] != run.shard["block_count"]:
                raise DataError(f"{run.shard['blocks_index_name']} does not go with its root")
            records = np.frombuffer(f.read_at(size * (run.last - run.first), HEADER_BYTES + size * run.first), RECORD)
        wanted = None if self.samples is None else {x // self.root["samples_per_block"] for x in self.samples}
        with fs.open_input_file(f"{base}/{run.shard['blocks_data_name']}") as f:
            for k, r in enumerate(records, run.first):
                if wanted is not None and k % per not in wanted:
                    continue
                h, flags, offsets, values = decode(f.read_at(int(r["data_length"]), int(r["data_offset"])), dtypes)
                ids = h["first"] + np.arange(h["count"])
                keep = (flags & blocks.PRESENT) > 0
                if self.samples is not None:
                    keep &= np.isin(ids, list(self.samples))
                if not keep.any():
                    continue
                at = np.flatnonzero(keep)
                lists = []
                for v, c in zip(values, columns):
                    kind = _arrow(c["storage_type"])
                    v = v.astype("<i8") if c["storage_type"] == "uint32" else v
                    picked = np.concatenate([v[offsets[i] : offsets[i + 1]] for i in at])
                    stops = np.r_[0, np.cumsum(offsets[at + 1] - offsets[at])].astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(stops), pa.array(picked).cast(kind)))
                n = len(at)
                cells = [pa.array(ids[at], pa.int64()), pa.array(np.full(n, h["feature"], np.int32)), pa.array(flags[at].astype(np.int16)), pa.array((offsets[at + 1] - offsets[at]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cells + lists, names=["sample_id", "feature_id", "flags", "trace_len"] + [c["name"] for c in columns])


def _arrow(kind: str) -> pa.DataType:
    return {"float64": pa.float64(), "int32": pa.int32(), "int64": pa.int64(), "uint32": pa.int64(), "uint64": pa.decimal128(20, 0)}[kind]


class BinaryBlocks(DataSource):
    """Present traces of a binary dataset. Options: featureIds and sampleIds (JSON lists), blocksPerTask."""

    @classmethod
    def name(cls) -> str:
        return "tracegrid_blocks"

    def schema(self) -> T.StructType:
        from tracegrid.schema import STORAGE

        head = T.StructType().add("sample_id", T.LongType()).add("feature_id", T.IntegerType()).add("flags", T.ShortType()).add("trace_len", T.IntegerType())
        for c in _root(self.options["path"].rstrip("/"))["point_schema"]:
            head.add(c["name"], T.ArrayType(STORAGE[c["storage_type"]]), True, {"logical": c["logical_type"]})
        return head

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options, schema)


def read(spark: SparkSession, uri: str, feature_ids: Sequence[int] | None = None, sample_ids: Sequence[int] | None = None) -> DataFrame:
    """(sample_id, feature_id, flags, trace_len, one array for each column) of the present traces among those asked for."""
    spark.dataSource.register(BinaryBlocks)
    reader = spark.read.format(BinaryBlocks.name()).option("path", uri)
    for option, ids in (("featureIds", feature_ids), ("sampleIds", sample_ids)):
        if ids is not None:
            if not len(ids):
                raise RequestError(f"{option} is empty")
            reader = reader.option(option, json.dumps([int(i) for i in ids]))
    return reader.load()
