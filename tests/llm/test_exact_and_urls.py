import hashlib

import duckdb
import numpy as np
import pytest

from tracegrid.llm import exact_dedup, url_filter
from tracegrid.llm.common import scratch_path
from tracegrid.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op7_url_filter"])
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = c.sql(oracle_sql()[name])
    df = queries()[name](spark, sf).select(*rel.columns)
    assert sorted(map(repr, rel.fetchall())) == sorted(repr(tuple(r)) for r in df.collect())


def test_dedup_edges(spark, edge, empty):
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "i"), buckets=4)
    rows = exact_dedup.dedup_report(edge, index).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == edge.count() and by[1]["keep_id"] == 2 and by[1]["group_size"] == 2 and not by[1]["kept"]
    assert by[4]["keep_id"] == 5 and by[6]["kept"] and by[7]["kept"] and by[None]["kept"]
    assert bytes(by[5]["digest"]) == hashlib.sha256(b"abc def ghi").digest()
    assert [r["kept"] for r in rows if r["doc_id"] == 9] == [True, True]
    other = exact_dedup.DigestIndex(spark, scratch_path(spark, "i"), buckets=4)
    assert exact_dedup.dedup_report(empty, other).count() == 0
    kept = exact_dedup.dedup(edge)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 5, 6, 7, 8, 9, 10, 11, None}


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(None, "A"), (1, "a"), (None, "b"), (None, "b")], [(1, "a"), (None, "b")]),  # null loses to any id
        ([(1, "a"), (1, "a"), (2, "b")], [(1, "a"), (2, "b")]),  # repeated rows
        ([(1, "a"), (1, "only here"), (2, "a")], [(1, "only here"), (2, "a")]),  # one id, two texts
    ],
)
def test_dedup_by_id_and_text(spark, rows, want):
    got = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_dedup_with_clashing_columns_leaves_no_table(spark):
    names = "__id", "__gone", "__digest", "__kept", "__own_digest", "digest", "u", "v", "node", "dir"
    docs = spark.createDataFrame([(1, "a", *range(10)), (2, "A", *range(10)), (2, "A", *range(10)), (None, "b", *range(10))], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    before = spark.sql("SHOW TABLES").count()
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and sorted(repr(r["doc_id"]) for r in kept.collect()) == ["2", "None"]
    assert queries()["op5_exact_dedup"](spark, "/root/testdata/sf0.001").count() == 200 and spark.sql("SHOW TABLES").count() == before


def test_index_lasts(spark):
    path = scratch_path(spark, "i")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    assert {r["doc_id"] for r in exact_dedup.dedup(first, index).collect()} == {1, 2}
    index.drop()  # a later session finds the files only
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    second = spark.createDataFrame([(3, "B"), (4, "c"), (5, "c")], "doc_id long, text string")
    assert {r["doc_id"] for r in exact_dedup.dedup(second, index).collect()} == {5}
    assert index.read().count() == 3
    plan = index.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "digest" in plan


URLS = [(1, None), (2, ""), (3, "no-scheme.net/x"), (4, "http://a.net/x"), (5, "http://A.Example.NET/en/1?q"), (6, "x://example.com/de/"), (7, "x://notexample.com/de/"), (8, "x://deexample.org/fr/?/"), (9, "x://net"), (10, "x://net/"), (11, "x://é.org/fr/"), (12, "x:///en/"), (13, "http://a.net/" + "y" * 100_000), (14, "a://b://c.net/"), (15, "x://example.net:80/en/"), (16, "x://a.net#/en/"), (16, "x://a.net#/en/"), (None, "x://.net/")]


def test_judge_by_all_ways(spark):
    pages = spark.createDataFrame([(i, u, 0, "r") for i, u in URLS], "page_id long, url string, digest int, rule string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    c = duckdb.connect()
    arrow = pages.toArrow()
    c.register("pages", arrow)
    rel = c.sql(oracle_sql()["op7_url_filter"])
    want = sorted({repr(x) for x in rel.fetchall()})
    for got in (url_filter.judge(pages), url_filter.judge(pages, rules)):
        assert sorted({repr(tuple(r)) for r in got.select(*rel.columns).collect()}) == want
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}


def index_of(spark, rules, monkeypatch):
    index = url_filter.SortedDigests(spark, spark.createDataFrame(rules, "host string, path string, verdict string"))
    index.map_into_memory()
    return index


def test_collisions_decide_nothing(spark, monkeypatch):
    index = index_of(spark, url_filter.RULES, monkeypatch)
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x, seed: 7)
    index.digests = np.full(4, 7)
    names = [index.rule(k) for k in range(4)]
    assert index.find(["net/", "org/", "org/fr/"]).tolist() == [names.index("net/"), -1, names.index("org/fr/")]


def test_many_rules_against_plain_search(spark, monkeypatch):
    """A list beyond any bound on what is sent, in one sorted array, with repeated, contradictory and null rules."""
    hosts = [f"h{k}.site{k % 97}.org" for k in range(60_000)]
    rules = [(h, "/" if k % 3 else f"/p{k % 5}/", "block" if k % 2 else "allow") for k, h in enumerate(hosts)]
    rules += [("twice.org", "/", "allow"), ("twice.org", "/", "block"), (None, "/", "block"), ("null.org", "/", None), ("é.org", "/ü/", "block")]
    index = index_of(spark, rules, monkeypatch)
    assert (np.diff(index.digests) >= 0).all() and index.count == 60_002
    table = {h + p: v for h, p, v in rules if h and v}
    probes = [h + p for h, p, _ in rules[::50] if h] + ["twice.org/", "é.org/ü/", "null.org/", "absent.org/"]
    found = index.find(probes)
    assert [index.verdict(k) if k >= 0 else None for k in found] == [table.get(p) for p in probes]
    urls = [(k, f"http://www.{hosts[k]}/p{k % 5}/x") for k in range(0, 60_000, 500)]
    got = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {k: (rules[k][0] + rules[k][1], rules[k][2]) for k, _ in urls}
