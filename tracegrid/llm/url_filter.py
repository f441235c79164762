"""URL filtering by a sorted array of 64-bit digests, memory-mapped and probed by vectorised binary search.

A rule is a host and a path written together (`example.net/en/`); it holds for its host and all subdomains of it, if
the url's path starts with the rule's. For each url the candidates are every suffix of its host at a label boundary
with every prefix of its path that has the length of some rule's path. Their xxhash digests are looked up in the
sorted array, and the stored strings confirm each hit, so a collision decides nothing. The longest rule wins; an
unmatched url gets the default verdict. (Rules of equal length for one url are the same string.)

Rule lists of any size go one way: Spark sorts them by digest, the driver writes the sorted arrays, a chunk at a time,
once in the shared folder, Spark gives each executor one copy, and all its workers map that copy into memory. The
driver holds a chunk, a worker the pages that it probes.

Null urls and those without `://` have empty host and path and match no rule. Repeated rows get equal verdicts; of
several verdicts for one rule the greatest by name counts (`block` before `allow`); rules with a null host, path or
verdict are ignored. An empty table gives no rows, an empty rule list the default for all. Other columns, whatever their
names, are ignored. Long urls cost one candidate for each host label and path length, whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm.common import SharedFile, ascii_lower, scratch_path, ship

#: The rules of the registered query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Spark's seed of xxhash64.
SEED = 42


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _sorted_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of sorted rules (digest, rule, verdict's number) as raw arrays in one row."""
    for b in batches:
        rules = [x.encode() for x in b.column(1).to_pylist()]
        raw = [np.asarray(b.column(0)).tobytes(), np.array([len(x) for x in rules], np.int64).tobytes(), np.asarray(b.column(2)).astype(np.int32).tobytes(), b"".join(rules)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in raw], names=["digests", "lengths", "verdicts", "rules"])


class SortedDigests:
    """The rules' digests in order, with the rules and verdicts beside them, as files that are mapped into memory."""

    PARTS = ("digests", "ends", "verdicts", "rules")

    def __init__(self, spark: SparkSession, rules: DataFrame):
        """rules: (host, path, verdict). The files are written and handed to all executors."""
        rules = rules.dropna(subset=["host", "path", "verdict"]).select(F.concat("host", "path").alias("rule"), F.length("path").alias("n"), "verdict")
        self.lengths = sorted(r["n"] for r in rules.select("n").distinct().collect())  # path lengths only: few
        self.names = sorted(r["verdict"] for r in rules.select("verdict").distinct().collect())
        number = F.array_position(F.array(*map(F.lit, self.names)), F.col("verdict")) - 1 if self.names else F.lit(0)
        ordered = rules.groupBy("rule").agg(F.max("verdict").alias("verdict")).select(F.xxhash64("rule").alias("digest"), "rule", number.cast("int").alias("verdict")).orderBy("digest", "rule")
        folder = scratch_path(spark, "digests")
        files = {k: SharedFile(spark, f"{folder}.{k}") for k in self.PARTS}
        self.count = end = 0
        for c in ordered.mapInArrow(_sorted_chunks, "digests binary, lengths binary, verdicts binary, rules binary").toLocalIterator():
            lengths = np.frombuffer(c["lengths"], np.int64)
            files["digests"].write(c["digests"])
            files["ends"].write((end + np.cumsum(lengths)).tobytes())
            files["verdicts"].write(c["verdicts"])
            files["rules"].write(c["rules"])
            self.count, end = self.count + len(lengths), end + int(lengths.sum())
        for f in files.values():
            f.close()
            if self.count:
                spark.sparkContext.addFile(f.path)
        self.folder = folder.rsplit("/", 1)[-1]

    def map_into_memory(self, place: Callable[[str], str] = SparkFiles.get) -> None:
        kinds = {"digests": np.int64, "ends": np.int64, "verdicts": np.int32, "rules": np.uint8}
        for k, kind in kinds.items():
            setattr(self, k, np.memmap(place(f"{self.folder}.{k}"), kind, "r") if self.count else np.zeros(0, kind))

    def rule(self, k: int) -> str:
        return self.rules[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])].tobytes().decode()

    def verdict(self, k: int) -> str:
        return self.names[self.verdicts[k]]

    def find(self, probes: list[str]) -> np.ndarray:
        """For each probe the index of its rule, or -1."""
        out = np.full(len(probes), -1)
        if not self.count or not probes:
            return out
        want = np.fromiter(map(xxhash.xxh64_intdigest, probes, repeat(SEED)), np.uint64, len(probes)).view(np.int64)
        at = np.searchsorted(self.digests, want)
        for i in np.flatnonzero(self.digests[np.minimum(at, self.count - 1)] == want):
            k = int(at[i])
            while k < self.count and self.digests[k] == want[i]:  # rules under one digest lie side by side
                if self.rule(k) == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """The rules that could hold, the longest first."""
    hosts, at = [host], host.find(".")
    while at >= 0:
        hosts.append(host[at + 1 :])
        at = host.find(".", at + 1)
    found = {h + path[:n] for h in hosts if h for n in lengths if n <= len(path)}
    return sorted(found, key=len, reverse=True)


def _judge(index: SortedDigests, default: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index.map_into_memory()
        for b in batches:
            probes, owner = [], []
            for i, (h, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                c = candidates(h, p, index.lengths)
                probes += c
                owner += repeat(i, len(c))
            rule, verdict = [None] * b.num_rows, [default] * b.num_rows
            found = index.find(probes)
            for j in np.flatnonzero(found >= 0)[::-1]:  # the longest of a url comes last and stays
                rule[owner[j]], verdict[owner[j]] = index.rule(found[j]), index.verdict(found[j])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page. rules: a list, or (host, path, verdict) rows of any number."""
    spark = pages.sparkSession
    ship(spark)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    kind = pages.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(_judge(SortedDigests(spark, rules), default), f"page_id {kind}, host string, path string, rule string, verdict string")
