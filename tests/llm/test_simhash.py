import random

import numpy as np
import pytest
import xxhash

from tracegrid.llm import components, similar, simhash
from tracegrid.llm.components import connected_components


def plain_words(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()


def plain_fingerprint(text):
    words = plain_words(text)
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(nodes, pairs):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " ", "a", "A b", "a b c", "The the THE the the", "É é x y z", "w " * 700, "\x0b\x0ca\x1fb c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_text_in_slabs(monkeypatch):
    text = " ".join(random.Random(1).choice("alpha beta gamma delta".split()) for _ in range(4000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLAB", 97)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def clustered(n, seed=3):
    """Fingerprints in chains and dense clusters, so that links cross every combination of bytes."""
    r, out = random.Random(seed), set()
    while len(out) < n:
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 40])):
            out.add(f)
            for b in r.sample(range(64), r.randint(1, 4)):
                f ^= 1 << b
    return sorted(out)


def brute(fps):
    a = np.array(fps, np.uint64)
    return [(i, j) for i in range(len(a)) for j in i + 1 + np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_pair_meets_in_a_posting():
    assert (simhash._CANON[np.bitwise_count(np.arange(256, dtype=np.uint8)) >= simhash.NEEDED] >= 0).all()


@pytest.mark.parametrize("short,hot", [(16, 1 << 16), (2, 1 << 16), (2, 5), (2, 2)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, short, hot):
    """By both indexes, and by the table of open bits where hot is small."""
    fps = clustered(300)
    place = {signed(f): i for i, f in enumerate(fps)}
    monkeypatch.setattr(simhash, "SHORT", short)
    found = simhash.links(spark.createDataFrame([(f,) for f in place], "fp long").repartition(5), hot=hot).collect()
    pairs = [(place[r["u"]], place[r["v"]]) for r in found]
    assert hot <= 5 or all(bin(fps[u] ^ fps[v]).count("1") <= 3 for u, v in pairs)
    assert plain_components(range(len(fps)), pairs) == plain_components(range(len(fps)), brute(fps))


@pytest.mark.parametrize("five", [0, 17, 55])
def test_table_of_open_bits(five):
    r = random.Random(five)
    free = [p for p in range(8) if p not in simhash.FIVES[five]]
    base = r.getrandbits(64) & ~sum(255 << 8 * p for p in free)
    fps = sorted({base | sum(r.choice([0, 1, 3, 7, 255, 128, 99]) << 8 * p for p in free) for _ in range(200)})
    table = simhash.OpenBits(five)
    for k in range(0, len(fps), 33):
        table.add(np.array(fps[k : k + 33], np.uint64))
    place = {f: i for i, f in enumerate(fps)}
    pairs = [(place[int(u)], place[int(v)]) for a, b in table.links(block=41) for u, v in zip(a, b)]
    assert plain_components(range(len(fps)), pairs) == plain_components(range(len(fps)), brute(fps))


def test_near_duplicates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = plain_components([r["doc_id"] for r in rows], [(rows[i]["doc_id"], rows[j]["doc_id"]) for i, j in brute(fps)])
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r["doc_id"]: (f, want[r["doc_id"]]) for r, f in zip(rows, fps)}


def test_edges_of_input(spark, edge, empty):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(edge).collect()]
    assert len(got) == edge.count()
    assert dict(x for x in got if x[0] in (1, 2, 3)) == {1: 1, 2: 1, 3: 1}
    assert dict(got)[5] == 4 and simhash.near_duplicates(empty).count() == 0


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    rows = [(7, "one two three four"), (7, "five six seven eight"), (8, "FIVE six seven eight"), (None, "one two three four"), (None, "nine ten")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r["doc_id"]), repr(r["component_id"])) for r in got) == [("7", "7"), ("7", "7"), ("8", "7"), ("None", "7"), ("None", "None")]


def shingle_set(text):
    words = plain_words(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_near(rows):
    """Rows that go: (doc_id, text) linked to a row with a smaller doc_id, null last, by five-word Jaccard of 0.8 or more."""
    sets = [shingle_set(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    links = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = plain_components(range(len(rows)), links)
    best = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0)
        if group[i] not in best or key < best[group[i]][0]:
            best[group[i]] = (key, rows[i])
    return [r for i, r in enumerate(rows) if best[group[i]][1] != r]


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_near_copies_against_all_pairs(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = {d for d, _ in plain_near(rows)}
    gone = {r["doc_id"] for r in similar.near_copies(docs).collect()}
    assert gone <= want and len(gone) >= 0.95 * len(want)
    assert {r["doc_id"] for r in similar.keep_one(docs).collect()} == {d for d, _ in rows} - gone


def edited(words, rate, r):
    return [f"z{r.random()}" if r.random() < rate else w for w in words]


@pytest.mark.parametrize("hot,block", [(similar.HOT, similar.BLOCK), (3, 6000)])
def test_planted_near_copies(spark, hot, block):
    """Bases with copies of one word in 100 to 30 edited, a large family whose members meet only through their base, and texts apart."""
    r, rows = random.Random(4), []
    add = lambda words: rows.append((len(rows), " ".join(words)))
    for k in range(120):
        base = [f"w{k}x{r.randrange(400)}" for _ in range(r.choice([40, 150, 400]))]
        add(base)
        for _ in range(r.choice([0, 1, 3])):
            add(edited(base, r.choice([0.01, 0.02, 0.03]), r))
    base = [f"v{r.randrange(400)}" for _ in range(300)]
    for _ in range(80):
        add(edited(base, 0.018, r))
    add(base)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {d for d, _ in plain_near(rows)}
    gone = {x["doc_id"] for x in similar.near_copies(docs, hot=hot, block=block).collect()}
    assert gone <= want and len(gone) >= 0.97 * len(want) > 100


@pytest.mark.parametrize("leaders", [8, 1])
def test_one_long_family(spark, monkeypatch, leaders):
    """One family in many blocks, of two groups and texts apart, gives exactly what all pairs give, however many leaders there are."""
    monkeypatch.setattr(similar, "LEADERS", leaders)
    r, rows = random.Random(5), []
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    far = edited(base, 0.08, r)
    for k in range(150):
        rows.append((k, " ".join(edited(far if k % 3 else base, 0.004 if k % 5 else 0.06, r))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {d for d, _ in plain_near(rows)}
    gone = {x["doc_id"] for x in similar.near_copies(docs, hot=3, block=14_000).collect()}
    assert gone == want and 20 < len(gone) < 149


def test_shared_bytes_are_tallied(spark):
    """In a posting the bytes of the next keys are counted as by plain loops, around the end too; pairs of equal bits that share none but the key's go."""
    r = np.random.default_rng(3)
    tables, per = similar.TABLES, similar.PER_KEY
    for none in (False, True):
        own = r.integers(0, 256, (2, tables, per))
        own[1] = np.where(r.random((tables, per)) < (0 if none else 0.3), own[0], (own[0] + 1) % 256)
        met = [0, 7, tables - 3, tables - 1]
        own[1, met] = own[0, met] if not none else own[1, met]
        keys = [[int(t << 24 | sum(int(b) << 8 * i for i, b in enumerate(own[d, t]))) for t in range(tables)] for d in (0, 1)]
        if none:
            keys[1][9] = keys[0][9]
        rows = similar._postings(spark.createDataFrame([(keys[d], 5, 6, d) for d in (0, 1)], "keys array<int>, fp long, fp2 long, node long")).collect()
        by_key = [{x["key"]: x for x in rows if x["node"] == d} for d in (0, 1)]
        for t in [9] if none else met:
            a, b = (np.array([[x[keys[0][t]][c] for c in ("fp", "fp2", "next", "next2")]]).view(np.uint64) for x in by_key)
            shared = per + sum(int(own[0, (t + k) % tables, i] == own[1, (t + k) % tables, i]) for k in range(1, 5) for i in range(per))
            assert similar.shared_bytes(a ^ b).tolist() == [shared]
            assert similar._loose(a ^ b).tolist() == [shared >= similar.NEEDED]
        assert not none or shared == per


def test_near_copies_of_edges(spark, edge, empty):
    kept = similar.keep_one(edge)
    got = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    assert kept.columns == edge.columns and got == [(False, d) for d in (1, 4, 6, 7, 8, 9, 9, 10, 11)] + [(True, None)]
    assert similar.keep_one(empty).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(7, "unlike any other text"), (7, text), (9, text.upper()), (None, text), (9, "unlike this one too"), (None, "alone"), (3, text + " more")]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, node long, __gone long, __id long")
    assert sorted((repr(r["doc_id"]), r["text"]) for r in similar.keep_one(docs).collect()) == sorted((repr(d), t) for d, t in (rows[0], rows[4], rows[5], rows[6]))


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(1, 2), (2, 3), (9, 8), (5, 5)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)]])
def test_components(spark, pairs):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == plain_components({x for p in pairs for x in p}, pairs)


def dense(r, groups, size):
    """All pairs within groups of random numbers, and some self links."""
    pairs = []
    for _ in range(groups):
        own = [r.getrandbits(64) - (1 << 63) for _ in range(size)]
        pairs += [(a, b) for a in own for b in own if a < b] + [(own[0], own[0])]
    alone = r.getrandbits(60)
    return pairs + [(alone, alone)]


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(1, 2), (2, 3), (9, 8), (5, 5), (1, 1)], [(i, i + 1) for i in range(300)], [(299 - i, 300 - i) for i in range(300)], dense(random.Random(8), 5, 30)])
def test_stars(pairs):
    u, v = np.array(pairs, np.int64).reshape(-1, 2).T
    got = list(zip(*(x.tolist() for x in components.stars(u, v))))
    want = plain_components({x for p in pairs for x in p}, pairs)
    assert len(got) == len({a for a, _ in got}) and all(want[a] == b for a, b in got)
    assert {x for p in got for x in p} == want.keys()


@pytest.mark.parametrize("size,chunk", [(40, 1 << 19), (80, 1 << 19), (40, 250), (80, 500)])
def test_joins_of_components_take_a_link_a_node(spark, monkeypatch, size, chunk):
    """What the rounds join grows with the size of dense groups, not with its square; links of one chunk need no join."""
    joined, large_star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: joined.append(edges.count()) or large_star(edges))
    pairs = dense(random.Random(size), 6, size)
    random.Random(9).shuffle(pairs)
    links = spark.createDataFrame(pairs, "u long, v long").repartition(3)
    got = {r["node"]: r["component"] for r in connected_components(links, chunk=chunk).collect()}
    assert got == plain_components({x for p in pairs for x in p}, pairs)
    assert max(joined, default=0) <= (0 if chunk > len(pairs) else 6 * 6 * size) < len(pairs)
