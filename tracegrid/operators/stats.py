"""Masked squared correlation, from centred moments of the cells present: one feature against targets, and feature pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOMENTS = ("n", "vx", "vy", "cov")
#: Features and samples of a square of cells, whose pairs are formed as a product of matrices.
TILE, SPAN = 256, 4096


def moments(x: Column, y: Column) -> list[Column]:
    """Centred as they are gathered and merged, so that a large offset costs no digits."""
    return [F.count("*").alias("n"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cov")]


def r2_of_moments(least: int = 2) -> Column:
    """0.0 with fewer than max(2, least) pairs, for constant input and where infinities leave no number."""
    n, vx, vy, cov = (F.col(m) for m in MOMENTS)
    ok = (n >= max(2, least)) & (vx > 0) & (vy > 0) & ~F.isnan(vx) & ~F.isnan(vy)
    r2 = (cov / F.when(ok, vx)) * (cov / F.when(ok, vy))
    return F.when(ok & ~F.isnan(r2), F.least(r2, F.lit(1.0))).otherwise(F.lit(0.0))


def targets_long(samples: DataFrame, y_cols: Sequence[str], id_col: str = "sample_id") -> DataFrame:
    """(sample_id, y_col, y) for targets that are neither null nor NaN."""
    entries = [F.struct(F.lit(c).alias("y_col"), F.col(c).cast("double").alias("y")) for c in y_cols]
    rows = samples.select(F.col(id_col).cast("long").alias("sample_id"), F.explode(F.array(*entries)).alias("e")).select("sample_id", "e.y_col", "e.y")
    return rows.where(F.col("y").isNotNull() & ~F.isnan("y"))


def selection_stats(raw: DataFrame, features: DataFrame, samples: DataFrame, y_cols: Sequence[str], per_part: int = 128, least: int = 2) -> DataFrame:
    """(y_col, feature_id, part_id, offset_in_part, r2y, n_y_overlap) for every feature and target; no targets, no rows.

    All targets share one pass over the cells; sums are combined before they are shuffled.
    """
    if not y_cols:
        return features.sparkSession.createDataFrame([], "y_col string, feature_id int, part_id int, offset_in_part int, r2y double, n_y_overlap int")
    sums = raw.join(targets_long(samples, y_cols), "sample_id").groupBy("y_col", "feature_id").agg(*moments(F.col("value"), F.col("y")))
    f = F.col("feature_id").cast("int")
    wanted = features.select(f.alias("feature_id"), F.explode(F.array(*[F.lit(c) for c in y_cols])).alias("y_col"))
    both = wanted.join(sums, ["y_col", "feature_id"], "left")
    return both.select(
        "y_col", "feature_id", F.floor(F.col("feature_id") / per_part).cast("int").alias("part_id"), F.pmod("feature_id", F.lit(per_part)).cast("int").alias("offset_in_part"),
        r2_of_moments(least).alias("r2y"), F.coalesce("n", F.lit(0)).cast("int").alias("n_y_overlap"),
    )


def top_features(stats: DataFrame, k: int, y_col: str | None = None) -> DataFrame:
    rows = stats if y_col is None else stats.where(F.col("y_col") == y_col)
    return rows.orderBy(F.desc_nulls_last("r2y"), F.asc("feature_id")).limit(k)


def _tile_pair(after: int | None):
    """Centred moments of every pair of features of two tiles over one span of samples, by products of dense matrices."""

    def dense(cells: list[np.ndarray], rows: np.ndarray):
        feature, sample, own = cells
        ids = np.unique(feature)
        place = np.searchsorted(rows, sample), np.searchsorted(ids, feature)
        value, seen, odd = (np.zeros((len(rows), len(ids))) for _ in range(3))
        value[place] = own
        seen[place] = 1.0
        odd[place] = ~np.isfinite(value[place])
        value[odd > 0] = 0.0
        mean = value.sum(axis=0) / np.maximum(seen.sum(axis=0), 1)
        return ids, value, seen, odd, mean

    def exact(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float, float]:
        """For pairs whose spread is tiny against their distance from the feature's mean, constant ones above all."""
        mx, my = (v[0] if v.min() == v.max() else v.mean() for v in (x, y))  # so that a constant's means agree in all spans
        dx, dy = x - mx, y - my
        dx, dy = dx - dx.mean(), dy - dy.mean()  # a mean far from zero is rounded
        return mx, my, dx @ dx, dy @ dy, dx @ dy

    def run(table: pa.Table) -> pa.Table:
        first = table.column("first").to_pylist()
        cells = {t: [c.to_numpy(zero_copy_only=False) for c in own.values.flatten()] for t, own in zip(first, table.column("cells"))}
        rows = np.unique(np.concatenate([own[1] for own in cells.values()]))
        a, b = (dense(cells[t], rows) if t in cells else None for t in (table.column("i")[0].as_py(), table.column("j")[0].as_py()))
        names = ["lo", "hi", "n", "mx", "my", "sx", "sy", "sxy"]
        if a is None or b is None:
            kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.float64()] * 5
            return pa.table([pa.array([], k) for k in kinds], names=names)
        (lo, va, ma, oa, ca), (hi, vb, mb, ob, cb) = a, b
        xa, xb = (va - ca) * ma * (oa == 0), (vb - cb) * mb * (ob == 0)
        n = ma.T @ mb
        k = np.maximum(n, 1)
        x, y, xx, yy = xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb)
        sx, sy, sxy = xx - x * x / k, yy - y * y / k, xa.T @ xb - x * y / k
        mx, my = ca[:, None] + x / k, cb[None, :] + y / k
        keep = (n > 0) & (lo[:, None] < hi[None, :])
        if after is not None:
            keep &= hi[None, :] > after
        never = oa.T @ mb + ma.T @ ob > 0
        for p, q in zip(*np.nonzero(keep & ~never & ((sx <= 1e-8 * xx) | (sy <= 1e-8 * yy)))):
            both = (ma[:, p] > 0) & (mb[:, q] > 0)
            mx[p, q], my[p, q], sx[p, q], sy[p, q], sxy[p, q] = exact(va[both, p], vb[both, q])
        sx[never] = sy[never] = sxy[never] = np.nan
        p, q = np.nonzero(keep)
        got = [lo[p].astype(np.int32), hi[q].astype(np.int32), n[p, q].astype(np.int64), *(m[p, q] for m in (mx, my, sx, sy, sxy))]
        return pa.table([pa.array(g) for g in got], names=names)

    return run


def _merged(e: Column) -> Column:
    """The moments of all spans of a pair, from a list of each span's: means and centred sums lose no digits when they are joined so."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(m) for m in ("mx", "my", "sx", "sy", "sxy")])

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + x["n"]
        dx, dy, share = x["mx"] - acc["mx"], x["my"] - acc["my"], acc["n"] * x["n"] / n
        both = F.struct(
            n.alias("n"), (acc["mx"] + dx * x["n"] / n).alias("mx"), (acc["my"] + dy * x["n"] / n).alias("my"), (acc["sx"] + x["sx"] + dx * dx * share).alias("sx"),
            (acc["sy"] + x["sy"] + dy * dy * share).alias("sy"), (acc["sxy"] + x["sxy"] + dx * dy * share).alias("sxy"),
        )
        return F.when(acc["n"] == 0, x).otherwise(both)

    return F.aggregate(e, zero, step)


def pair_moments(raw: DataFrame, after: int | None = None, tile: int = TILE, span: int = SPAN) -> DataFrame:
    """Moments of each pair of features (lo < hi; with `after`, hi > after) over the samples that have both; a cell occurs once.

    Cells are gathered in squares of `tile` features and `span` samples. Each square meets those of its span once, as
    matrices, so what moves is the cells times the number of tiles, never a row for each pair and sample, and a task
    holds two squares. Restrict `raw` to candidates first: the result has a row for each pair.
    """
    f, s = F.col("feature_id").cast("int"), F.col("sample_id").cast("long")
    cells = raw.select(f.alias("feature_id"), s.alias("sample_id"), "value").withColumn("first", F.col("feature_id") - F.pmod("feature_id", F.lit(tile)))
    ends = raw.agg(F.min("feature_id").alias("a"), F.max("feature_id").alias("b")).first()
    if ends["a"] is None:
        return raw.sparkSession.createDataFrame([], "lo int, hi int, n long, vx double, vy double, cov double")
    low, high = (int(x) // tile * tile for x in ends)
    # squares of one tile meet only themselves: dealt by span alone, they lie where the pairs are formed and are not moved again
    by = ["span"] if low == high else ["first", "span"]
    squares = cells.withColumn("span", F.col("sample_id") - F.pmod("sample_id", F.lit(span))).groupBy(*by).agg(F.collect_list(F.struct("feature_id", "sample_id", "value")).alias("cells"))
    squares = squares if "first" in by else squares.withColumn("first", F.lit(low))
    other = F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(tile)))
    met = squares.withColumn("other", other).withColumn("i", F.least("first", "other")).withColumn("j", F.greatest("first", "other"))
    if after is not None:
        met = met.where(F.col("j") + tile > after)
    found = met.select("i", "j", "span", "first", "cells").groupBy("i", "j", "span").applyInArrow(_tile_pair(after), "lo int, hi int, n long, mx double, my double, sx double, sy double, sxy double")
    joined = found.groupBy("lo", "hi").agg(_merged(F.collect_list(F.struct("n", "mx", "my", "sx", "sy", "sxy"))).alias("m"))
    n = F.col("m.n")
    return joined.select("lo", "hi", n.alias("n"), (F.col("m.sx") / n).alias("vx"), (F.col("m.sy") / n).alias("vy"), (F.col("m.sxy") / n).alias("cov"))


def pair_r2(raw: DataFrame, least: int = 2, after: int | None = None) -> DataFrame:
    return pair_moments(raw, after).select("lo", "hi", "n", r2_of_moments(least).alias("r2"))
