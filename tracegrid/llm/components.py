"""Connected components: links are first contracted to forests by tasks, then by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import materialise, ship

#: Links that a task holds at once.
CHUNK = 1 << 19
#: Links are contracted again as long as that leaves no more than this share of them.
SHRINKS = 0.75


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the links with the smallest end that it can reach, other than itself; of ends with self links only, the self link."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    least = np.arange(len(nodes))
    loops = np.zeros(len(nodes), bool)
    loops[a[a == b]] = True
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    moved = least != np.arange(len(nodes))
    loops[least[moved]] = False
    out = moved | loops
    return nodes[out], nodes[least[out]]


def _contracted(chunk: int) -> Callable:
    """Stars in place of links, over at most about `chunk` links at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        out = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        for b in batches:
            held.append((np.asarray(b.column(0)), np.asarray(b.column(1))))
            n += b.num_rows
            if n >= chunk:
                u, v = stars(*(np.concatenate(c) for c in zip(*held)))
                held, n = [(u, v)], len(u)
                if 2 * n > chunk:  # little to gain from going on with these
                    yield out(u, v)
                    held, n = [], 0
        if n:
            yield out(*stars(*(np.concatenate(c) for c in zip(*held))))

    return run


def _signature(edges: DataFrame) -> tuple:
    # decimal sums cannot overflow under ANSI rules
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join below deals out both sides itself and can split a hub's rows
    least = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _contract(edges: DataFrame, chunk: int) -> tuple[DataFrame, bool]:
    """Fewer links that connect the same nodes, and whether they are one forest of stars already.

    A task replaces its links, at most a chunk at a time, by stars: one link a node, however dense its group. Links of
    one chunk or less are settled by one task; more are dealt to as many tasks as there are chunks, while that pays.
    """
    ship(edges.sparkSession)
    run = _contracted(chunk)
    edges = materialise(edges.select("u", "v"), "links")  # whatever makes them runs once
    n = edges.count()
    while n:
        tasks = -(-n // chunk)
        edges = materialise(edges.coalesce(tasks).mapInArrow(run, "u long, v long"), "links")
        if tasks == 1:
            return edges, True
        before, n = n, edges.count()
        if n > SHRINKS * before:
            return edges, False
    return edges, True


def connected_components(edges: DataFrame, max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """(node, component) for every node of edges (u long, v long); component is the smallest node reachable.

    Self links count as nodes. No edges: no rows. Links are contracted to stars first, so that a dense group has about
    one link a node in each task, and not one a pair; the rounds that join them run only if they exceed a chunk. Each
    round is written in the shared folder. A hub costs its degree once a round: minima are combined before the shuffle,
    and the join's skewed partitions can be split.
    """
    edges, settled = _contract(edges, chunk)
    if settled:
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    loops = edges.where("u = v").select(F.col("u").alias("node"))
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges = materialise(edges, "edges")
    before = _signature(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = materialise(_small_star(_large_star(edges)), "stars")
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select("node", F.col("node").alias("component"))
    return ends.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
