"""Scalar cells: cleaning, densifying, parts, and slices of the grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.axes import request
from tracegrid.errors import DataError

#: Bytes of a dense row, and the fewest features of a part.
ROW_BYTES, LEAST_FEATURES = 21, 128


def clean_raw(raw: DataFrame, sample_col: str = "sample_id", feature_col: str = "feature_id", value_col: str = "value") -> DataFrame:
    """(sample_id long, feature_id int, value double) without NULL and NaN values; infinities stay."""
    v = F.col(value_col).cast("double")
    rows = raw.select(F.col(sample_col).cast("long").alias("sample_id"), F.col(feature_col).cast("int").alias("feature_id"), v.alias("value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def duplicate_cells(raw: DataFrame) -> DataFrame:
    return raw.groupBy("sample_id", "feature_id").agg(F.count("*").alias("n")).where("n > 1")


def require_valid_cells(raw: DataFrame, n_samples: int, n_features: int) -> None:
    """DataError on ids outside the axes or on repeated cells; one pass over the cells."""
    cells = raw.groupBy("sample_id", "feature_id").agg(F.count("*").alias("n"))
    r = cells.agg(F.min("sample_id").alias("a"), F.max("sample_id").alias("b"), F.min("feature_id").alias("c"), F.max("feature_id").alias("d"), F.max("n").alias("n")).first()
    if r["n"] is None:
        return
    if r["a"] < 0 or r["b"] >= n_samples or r["c"] < 0 or r["d"] >= n_features:
        raise DataError(f"cell ids {r.asDict()} are outside {n_samples} samples x {n_features} features")
    if r["n"] > 1:
        raise DataError("a cell has more than one value")


def features_per_part(n_samples: int, target_bytes: int) -> int:
    return max(1, LEAST_FEATURES, target_bytes // max(1, ROW_BYTES * n_samples))


def slots(cells: Column, n: int | Column) -> Column:
    """An array of n values from (at, value) pairs, null where no pair points: pairs are sorted once and the gaps filled between them."""
    n = F.lit(n).cast("int") if isinstance(n, int) else n.cast("int")
    ordered = F.array_sort(cells)
    gap = lambda k: F.array_repeat(F.lit(None).cast("double"), k)
    before = F.transform(ordered, lambda c: c["at"].cast("int"))
    filled = F.transform(
        F.zip_with(ordered, F.concat(F.array(F.lit(-1)), F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0)))), lambda c, b: F.struct(c["value"].alias("v"), (c["at"].cast("int") - b - 1).alias("k"))),
        lambda x: F.concat(gap(x["k"]), F.array(x["v"])),
    )
    last = F.coalesce(F.element_at(before, -1), F.lit(-1))
    return F.when(F.size(ordered) == 0, gap(n)).otherwise(F.concat(F.flatten(filled), gap(n - last - 1)))


def densify(raw: DataFrame, samples: DataFrame, n_features: int, per_part: int | None = None) -> DataFrame:
    """The full grid (feature_id, sample_id, mask, value): missing cells have mask 0 and NaN.

    Only the sparse cells are shuffled, by sample; each sample's row is then spread over all features. A row is as
    long as the feature axis, so no task holds more than one sample's features for each row in flight.
    """
    by_sample = raw.groupBy("sample_id").agg(slots(F.collect_list(F.struct(F.col("feature_id").alias("at"), "value")), n_features).alias("cells"))
    rows = samples.select(F.col("sample_id").cast("long")).join(by_sample, "sample_id", "left")
    full = F.coalesce("cells", F.array_repeat(F.lit(None).cast("double"), n_features))
    wide = rows.select("sample_id", F.posexplode(full).alias("feature_id", "cell"))
    cell = F.col("cell")
    out = wide.select(F.col("feature_id").cast("int").alias("feature_id"), "sample_id", cell.isNotNull().cast("short").alias("mask"), F.coalesce(cell, F.lit(float("nan"))).alias("value"))
    return out.withColumn("part_id", F.floor(F.col("feature_id") / per_part).cast("int")) if per_part else out


def locator(spark, n_features: int, n_samples: int, per_part: int) -> DataFrame:
    """(feature_id, global_rank, part_id, offset_in_part, first_row_in_part), by arithmetic alone."""
    f = F.col("id").cast("int")
    offset = F.pmod(f, F.lit(per_part)).cast("int")
    return spark.range(n_features).select(f.alias("feature_id"), f.alias("global_rank"), F.floor(f / per_part).cast("int").alias("part_id"), offset.alias("offset_in_part"), (offset.cast("long") * n_samples).alias("first_row_in_part"))


def part_stats(dense: DataFrame) -> DataFrame:
    return dense.groupBy("part_id").agg(F.min("feature_id").alias("first_feature_id"), F.max("feature_id").alias("last_feature_id"), F.count("*").alias("row_count"), F.sum(F.col("mask").cast("long")).alias("n_present"))


def present(dense: DataFrame) -> DataFrame:
    """What callers see of cells: `present`, and a value that is NULL where the cell is missing."""
    seen = F.col("mask") == 1
    return dense.withColumn("present", seen).withColumn("value", F.when(seen, F.col("value"))).drop("mask")


def feature_slice(dense: DataFrame, feature_id: int, per_part: int | None = None) -> DataFrame:
    """One feature over all samples; with per_part the part directory is pruned as well."""
    rows = dense.where(F.col("feature_id") == feature_id)
    if per_part:
        rows = rows.where(F.col("part_id") == feature_id // per_part)
    return present(rows)


def sample_slice(dense: DataFrame, sample_id: int) -> DataFrame:
    return present(dense.where(F.col("sample_id") == sample_id))


def part_rows(dense: DataFrame, part_id: int, offsets: Sequence[int], per_part: int) -> DataFrame:
    """The features at the given places of one part: (feature_id, offset_in_part, sample_id, present, value)."""
    wanted = sorted({part_id * per_part + o for o in offsets if 0 <= o < per_part})
    rows = dense.where((F.col("part_id") == part_id) & F.col("feature_id").isin(wanted))
    return present(rows).select("feature_id", F.pmod("feature_id", F.lit(per_part)).alias("offset_in_part"), "sample_id", "present", "value")


def physical_order(cells: DataFrame, per_part: int) -> DataFrame:
    """Cells of a request in the order in which they are stored, by part and place, whatever the request's order."""
    part, offset = F.floor(F.col("feature_id") / per_part).cast("int"), F.pmod("feature_id", F.lit(per_part)).cast("int")
    return cells.withColumns({"part_id": part, "offset_in_part": offset}).orderBy("part_id", "offset_in_part", "sample_ordinal", "feature_ordinal")


def cells(dense: DataFrame, feature_ids: Sequence[int], sample_ids: Sequence[int], per_part: int | None = None) -> DataFrame:
    """(feature_ordinal, sample_ordinal, feature_id, sample_id, present, value), repeats included: order by the ordinals for the request's order.

    Ids that the grid lacks come back as not present. The ids reach the scan as filters.
    """
    spark = dense.sparkSession
    rows = dense.where(F.col("feature_id").isin(sorted(set(feature_ids))) & F.col("sample_id").isin(sorted(set(sample_ids))))
    if per_part:
        rows = rows.where(F.col("part_id").isin(sorted({f // per_part for f in feature_ids})))
    f = request(spark, feature_ids, "feature_id", "int").withColumnRenamed("ordinal", "feature_ordinal")
    s = request(spark, sample_ids, "sample_id", "long").withColumnRenamed("ordinal", "sample_ordinal")
    wanted = f.crossJoin(F.broadcast(s))  # as many rows as the caller asked for cells
    out = wanted.join(rows.select("feature_id", "sample_id", "mask", "value"), ["feature_id", "sample_id"], "left")
    seen = F.coalesce(F.col("mask") == 1, F.lit(False))
    return out.select("feature_ordinal", "sample_ordinal", "feature_id", "sample_id", seen.alias("present"), F.when(seen, F.col("value")).alias("value"))
