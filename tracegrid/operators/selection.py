"""Feature selection: rank by r2 with a target, then drop what is redundant with a better feature already taken."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.operators.stats import pair_r2, selection_stats
from tracegrid.sources import storage


@dataclass(frozen=True)
class SelectionOptions:
    """What a request may set; the names are the kept public interface of a selection."""

    y_col: str = "y"
    y_r2_threshold: float = 0.01
    min_non_null_y: int = 200
    ff_r2_threshold: float = 0.9
    min_non_null_pair: int = 200
    top_m: int = 100
    max_candidates: int = 0  # 0: all


def candidates(stats: DataFrame, o: SelectionOptions) -> DataFrame:
    """(rank, feature_id, r2y, n_y_overlap), the best first; one row a feature, so ranks are given in one task."""
    rows = stats.where((F.col("y_col") == o.y_col) & (F.col("n_y_overlap") >= o.min_non_null_y) & (F.col("r2y") >= o.y_r2_threshold))
    order = F.row_number().over(Window.orderBy(F.desc("r2y"), F.asc("feature_id")))
    ranked = rows.select(order.cast("int").alias("rank"), "feature_id", "r2y", "n_y_overlap")
    return ranked.where(F.col("rank") <= o.max_candidates) if o.max_candidates > 0 else ranked


def redundancy_edges(raw: DataFrame, ranked: DataFrame, o: SelectionOptions, after: int | None = None) -> DataFrame:
    """(lo, hi, n, r2) in ranks, lo < hi (with `after`, hi > after): pairs of candidates that say the same."""
    cells = raw.join(ranked.select("feature_id", "rank"), "feature_id").select("sample_id", F.col("rank").alias("feature_id"), "value")
    return pair_r2(cells, o.min_non_null_pair, after).where((F.col("n") >= o.min_non_null_pair) & (F.col("r2") >= o.ff_r2_threshold))


def greedy(ranked: DataFrame, edges: DataFrame, top_m: int) -> DataFrame:
    """Walk the ranks upward; take a candidate unless one already taken has an edge to it; stop at top_m.

    The walk is a fold over the list of candidates, each with its better neighbours: as long as the feature axis.
    """
    better = edges.groupBy(F.col("hi").alias("rank")).agg(F.collect_list("lo").alias("better"))
    none = F.array().cast("array<int>")
    listed = ranked.select("rank").join(better, "rank", "left").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("better", none).alias("better")))).alias("all"))
    taken = F.aggregate("all", none, lambda acc, c: F.when((F.size(acc) < top_m) & ~F.arrays_overlap(acc, c["better"]), F.concat(acc, F.array(c["rank"]))).otherwise(acc))
    return listed.select(F.explode(taken).alias("rank")).join(ranked, "rank")


def grow_cap(cap: int, most: int) -> int:
    """How many candidates the next stage looks at: twice as many, but at most `most` more."""
    return cap + min(cap, most)


def staged(raw: DataFrame, ranked: DataFrame, o: SelectionOptions, first: int = 256, most: int = 2048) -> DataFrame:
    """The features that `greedy` takes, by stages of candidates that stop once top_m are taken.

    A candidate is judged only by better ones that were taken, so a stage compares its own candidates with each other
    and with what was taken before: pairs grow with top_m and the stage, not with the square of all candidates. The
    driver keeps the ranks taken, at most top_m. `raw` and `ranked` are read anew by every stage: have them stored where
    they are costly to compute.
    """
    total, taken, before, cap = ranked.count(), [], 0, max(1, first)
    while before < total and len(taken) < o.top_m:
        stage = ranked.where(F.col("rank").isin(taken) | F.col("rank").between(before + 1, cap))
        edges = redundancy_edges(raw, stage, o, after=before)
        taken = sorted(r["rank"] for r in greedy(stage, edges, o.top_m).select("rank").collect())
        before, cap = cap, grow_cap(cap, most)
    return ranked.where(F.col("rank").isin(taken))


def stored_candidates(raw: DataFrame, features: DataFrame, samples: DataFrame, o: SelectionOptions) -> DataFrame:
    """candidates from the cells, written once: the stages ask for them many times, and each time would be a pass over the cells."""
    ranked = candidates(selection_stats(raw, features, samples, [o.y_col]), o)
    return storage.stored(ranked, storage.scratch_path(raw.sparkSession, "ranked"))


def select_features(raw: DataFrame, features: DataFrame, samples: DataFrame, o: SelectionOptions) -> DataFrame:
    """(rank, feature_id, r2y, n_y_overlap) of the selected features."""
    return staged(raw, stored_candidates(raw, features, samples, o), o)


def selection_result(raw: DataFrame, features: DataFrame, samples: DataFrame, o: SelectionOptions) -> DataFrame:
    """Every candidate (rank, feature_id, feature_key where the axis has keys, r2y, n_y_overlap) and whether it was selected."""
    ranked = stored_candidates(raw, features, samples, o)
    chosen = staged(raw, ranked, o).select("rank", F.lit(True).alias("selected"))
    out = ranked.join(chosen, "rank", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    return out.join(features.select(F.col("feature_id").cast("int").alias("feature_id"), "feature_key"), "feature_id", "left") if "feature_key" in features.columns else out


def mask_groups(raw: DataFrame) -> DataFrame:
    """(feature_id, group_id, n_features): features present in the same samples share a group, named by its smallest feature.

    Sets of samples are told apart by their size and two sums of 64-bit hashes, combined before the shuffle.
    """
    h = lambda salt: F.sum(F.xxhash64("sample_id", F.lit(salt)).cast("decimal(38,0)"))
    marks = raw.groupBy("feature_id").agg(F.struct(F.count("*"), h("a"), h("b")).alias("mark"))
    groups = marks.groupBy("mark").agg(F.min("feature_id").alias("group_id"), F.count("*").alias("n_features"))
    return marks.join(groups, "mark").select("feature_id", "group_id", "n_features")
