"""Row types of the feature x sample grid, and the point schema of traces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RAW = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("feature_id", T.IntegerType()), T.StructField("value", T.DoubleType())])
DENSE = T.StructType([T.StructField("feature_id", T.IntegerType()), T.StructField("sample_id", T.LongType()), T.StructField("mask", T.ShortType()), T.StructField("value", T.DoubleType())])
LOCATOR = "feature_id int, global_rank int, part_id int, offset_in_part int, first_row_in_part long"
TRACE_INDEX = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("feature_id", T.IntegerType()), T.StructField("trace_len", T.IntegerType())])

#: Storage types with the Spark type that holds their values, and the storage types of each logical type.
STORAGE = {"float64": T.DoubleType(), "int32": T.IntegerType(), "int64": T.LongType(), "string": T.StringType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0)}
LOGICAL = {"continuous": ("float64",), "integer": ("int32", "int64", "uint32", "uint64"), "categorical": ("string", "uint8", "uint16", "uint32"), "timestamp_ns": ("int64",), "timedelta_ns": ("int64",)}
UNSIGNED = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}


@dataclass(frozen=True)
class PointColumn:
    name: str
    storage: str
    logical: str

    def __post_init__(self) -> None:
        if self.logical not in LOGICAL or self.storage not in LOGICAL[self.logical]:
            raise ValueError(f"column {self.name!r}: {self.logical} values cannot be stored as {self.storage}")

    def field(self) -> T.StructField:
        kind = T.StringType() if self.logical == "categorical" and self.storage == "string" else STORAGE[self.storage]
        return T.StructField(self.name, kind, True, {"logical": self.logical, "storage": self.storage})


@dataclass(frozen=True)
class PointSchema:
    columns: tuple[PointColumn, ...]

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if not names or len(set(names)) < len(names):
            raise ValueError("a point schema needs at least one column, and distinct names")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def points(self) -> T.StructType:
        head = [T.StructField("sample_id", T.LongType()), T.StructField("feature_id", T.IntegerType()), T.StructField("point_idx", T.IntegerType())]
        return T.StructType(head + [c.field() for c in self.columns])
