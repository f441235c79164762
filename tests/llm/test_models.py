import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.llm import decontamination, langid, licenses, quality, toxicity
from tracegrid.llm.queries import op6_toxicity, op8_language, op9_decontamination, op10_quality

SF = "/root/testdata/sf0.01"


def held(d, m, k):
    return zlib.crc32(str(d).encode()) % m == k


def test_language_query(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_language(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(lang) and all(r["held_out"] == held(r["doc_id"], 4, 2) for r in rows)
    out = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(out) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def plain_bucket(gram):
    """The bucket of an n-gram of letters and blanks, by whole numbers modulo 2**32."""
    mix, cut = [int(x) for x in langid._MIX], (1 << 32) - 1
    h = ord(gram[0]) * mix[0] & cut
    for c in gram[1:]:
        h = ((h ^ h >> 15) * mix[1] + ord(c) * mix[2]) & cut
    return ((h ^ h >> 13) * mix[len(gram) - 1] & cut) >> 32 - langid.BUCKET_BITS


def plain_grams(text):
    t = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()}  ")
    grams = [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - 2)]
    return [plain_bucket(g) for g in grams if g.strip() and len(g)]


def plain_scores(model, text):
    return np.array([sum(float(row[b]) for b in plain_grams(text) if b) for row in model.table])


def test_language_model_against_plain_naive_bayes(spark):
    """Learned counts, prior, prediction and score from first principles."""
    rows = [(1, "der Hund und die Katze", "de"), (2, "the dog and the cat", "en"), (3, "Straße und İstanbul!", "de"), (4, "a cat, a hat", "en"), (4, "a cat, a hat", "en"), (5, None, "en"), (6, "le chat", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("de", "en") and np.allclose(np.exp(model.prior), [3, 4])
    for k, lang in enumerate(model.languages):
        counts = np.full(1 << langid.BUCKET_BITS, 0.5)
        for _, text, own in rows:
            if text and own == lang:
                np.add.at(counts, [b for b in plain_grams(text) if b], 1)
        want = np.log(counts / counts.sum())
        assert np.allclose(model.table[k][1:], want[1:], atol=1e-4)
    texts = ["the cat", "die Katze", "x", "Der Hund sat on the cat", "ß", "12", "", None]
    langs, scores = model.score(texts)
    for text, lang, score in zip(texts, langs, scores):
        logs = plain_scores(model, text) + model.prior
        p = np.exp(logs - logs.max())
        assert (lang, round(float(score), 6)) == (("und", 0.0) if not any(map(str.isalpha, text or "")) else (model.languages[int(p.argmax())], round(float(p.max() / p.sum()), 6)))


def test_language_edges(spark, edge, empty):
    model = langid.train(edge)
    got = {r["doc_id"]: r for r in langid.identify(edge, model).collect()}
    assert {d for d, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 3} and all(got[d]["score"] == 0 for d in (1, 2, 3))
    assert langid.keep_known(edge, model).columns == edge.columns and langid.keep_known(edge, model).count() == edge.count() - 3
    none = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(edge, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


@pytest.mark.parametrize("slab", [3, 101, 1 << 20])
def test_long_texts_are_scored_whole(monkeypatch, slab):
    """Scores equal those of a plain sum over the whole text, wherever the seams fall and whatever stands beside it."""
    model = langid.LanguageModel(("a", "b"), np.zeros(2), np.random.default_rng(1).normal(0, 1, (2, 1 << langid.BUCKET_BITS)).astype(np.float32) * 1e-2)
    model.table[:, 0] = 0
    monkeypatch.setattr(langid, "SLAB", slab)
    texts = ["Ein langer Text, İn Stücken. " * 40, None, "kurz", "", "x" * 300 + " Ende"]
    langs, scores = model.score(texts)
    for text, lang, score in zip(texts, langs, scores):
        logs = plain_scores(model, text)
        p = np.exp(logs - logs.max())
        assert lang == ("und" if not text else "ab"[int(p.argmax())]) and (not text or abs(score - p.max() / p.sum()) < 1e-6)


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    pos = y == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("query,label,m,k,least", [(op6_toxicity, "toxic", 5, 0, 0.75), (op10_quality, "quality", 3, 1, 0.95)])
def test_classifiers_on_held_out_rows(spark, query, label, m, k, least):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == 1000 and all(r["held_out"] == held(r["doc_id"], m, k) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    test = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    y, s, p = map(np.array, zip(*test))
    assert auc(y, s) > least and (y == p).mean() > 0.93


@pytest.mark.parametrize("word,want", [("idiot", 0), ("idoit", None), ("idiott", 1), ("id1ot", 1), ("worthlss", 1), ("wrthlss", 2), ("thing", None), ("scam", None), ("xyzfoo", 0), ("xy", None), ("", None)])
def test_automaton(word, want):
    a = toxicity.Automaton(("idiot", "worthless", "scum", "xyz*"))
    assert a.distance(word) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_brute_force():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 12))) for _ in range(500)]
    entries = tuple(dict.fromkeys(words[:25]))
    a = toxicity.Automaton(entries)
    for w in words:
        hits = [d for e in entries if (d := distance(w, e)) <= toxicity.edits_allowed(len(e))]
        assert a.distance(w) == (min(hits) if hits else None)


def plain_quoted(text, start, end):
    left, right = text[max(0, start - 60) : start], text[end : end + 60]
    inside = left.count('"') % 2 == 1 and '"' in right
    for opening, closing in (("“", "”"), ("„", "“”"), ("«", "»"), ("»", "«"), ("‘", "’"), ("‹", "›")):
        inside |= opening in left and not any(c in left[left.rindex(opening) + 1 :] for c in closing) and any(c in right for c in closing)
    return inside or any(w in toxicity.REPORTING for w in re.findall(r"\w+(?:[*@$!]\w+)*", left))


def plain_features(entries, ordinary, text):
    """By the edit distance of every word to every entry."""
    text = text.lower()
    tokens = [(m[0], m.start(), m.end()) for m in re.finditer(r"\w+(?:[*@$!]\w+)*", text)]
    exact = fuzzy = 0
    for w, start, end in tokens:
        hits = [distance(w, e) for e in entries if not e.endswith("*") and distance(w, e) <= toxicity.edits_allowed(len(e))]
        hits += [0 for e in entries if e.endswith("*") and w.startswith(e[:-1])]
        if hits and not (min(hits) and w in ordinary):
            counts = 0.25 if plain_quoted(text, start, end) else 1
            exact, fuzzy = (exact + counts, fuzzy) if min(hits) == 0 else (exact, fuzzy + counts / min(hits))
    return np.log1p(exact), np.log1p(fuzzy), np.log1p(100 * (exact + fuzzy) / max(1, len(tokens)))


def test_features_against_plain_version(monkeypatch):
    rng = np.random.default_rng(6)
    entries, ordinary = (*toxicity.LEXICON, "xyz*", "müll*"), ("idiom", "bascard")
    words = ["idiot", "idoit", "id1ot", "idiom", "bastard", "bascard", "b*stard", "xyzzy", "Müllmann", "said", "the", "a", "calm", "worthlss", "STUPID", '"', "“", "”", "«", "»", "„", ",", "wort"]
    monkeypatch.setattr(toxicity, "STATES", 20)  # states are forgotten time and again
    e = toxicity.Evidence(entries, ordinary)
    for _ in range(400):
        text = " ".join(rng.choice(words, rng.integers(1, 30)))
        assert np.allclose(e.features(text), plain_features(entries, ordinary, text)), text
        assert len(e.automaton.states) < 20 + 40 * 30


def test_lexicon_has_no_bound_but_its_rows(spark):
    """More learned terms than any list would hold; misspellings of words that a stem covers are found."""
    rows = [(f"fine calm day number{k} here", 0) for k in range(6000)]
    terms = [f"{a}{b}{c}orbleth" for a in "bcdfghjklmnpqrstvwxz" for b in "aeiou" for c in "bcdfghklmnprstvz"]
    for k in range(0, len(terms), 40):
        rows += [(" ".join(f"{t} filler{(i * 7 + j) % 50}" for i, t in enumerate(terms[k : k + 40])), 1) for j in range(8)]
    learned = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    automaton = toxicity.Automaton(tuple(learned))
    assert all(automaton.distance(t) == 0 for t in terms) and sum(not t.endswith("*") for t in learned) >= len(terms) == 1600
    assert automaton.distance(terms[3][0] + "u" + terms[3][1:]) is not None


@pytest.mark.parametrize("name", ["y", "__id", "__doc", "text2", "f0"])
def test_toxicity_with_clashing_columns(spark, edge, name):
    docs = edge.withColumn(name, F.lit(1))
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1)], f"doc_id long, toxic int, {name if name != '__id' else 'y'} int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == edge.count()


def test_quotation_counts_less():
    e = toxicity.Evidence(tuple(toxicity.LEXICON))
    plain, said, quoted = (e.features(t)[0] for t in ("you stupid person", "they said stupid things were called that", 'the label "stupid" is unkind'))
    assert plain > said > 0 and plain > quoted > 0 and e.features("a fine day") == (0, 0, 0) == e.features(None)
    assert e.features("what a stup1d moronn")[1] > 0


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (6, 0)], "doc_id long, toxic int")
    model = toxicity.train(edge, labels)
    got = toxicity.score(edge, model).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] < 0.5 for r in got)
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (6, 0), (8, 1), (9, 1), (10, 0)], "doc_id long, quality int")
    stats = quality.document_statistics(edge)
    got = quality.score(stats, quality.train(stats, labels)).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score(stats, quality.train(stats, labels.limit(0))).collect()} == {0.5}
    assert quality.score(quality.document_statistics(empty), quality.train(stats, labels)).count() == 0


def plain_isotonic(x, y):
    """The rising function nearest to y in squares, by the min-max formula over means of runs of x."""
    xs = np.unique(x)
    means = lambda i, j: y[(x >= xs[i]) & (x <= xs[j])].mean()
    return xs, np.array([max(min(means(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))])


def test_isotonic_against_plain_version():
    """Blocks are those of the min-max formula; each block's value is its mean drawn half a row towards one half."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.integers(0, 12, 60).astype(float)
        y = (rng.random(60) < x / 12).astype(float)
        xs, want = plain_isotonic(x, y)
        kx, ky = quality.isotonic(x, y)
        got = np.interp(xs, kx, ky)
        for v in np.unique(want):
            block = np.isin(x, xs[want == v])
            # equal fitted values are one block or neighbours, whose values rise together
            assert np.allclose(got[want == v], (y[block].sum() + 0.5) / (block.sum() + 1), atol=0.12)
        assert (np.diff(got) >= -1e-12).all()


def test_quality_model_against_plain_ridge(spark):
    """Statistics, moments, normal equations and weights by numpy over all learning rows at once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stats = quality.document_statistics(docs).cache()
    model = quality.train(stats, labels)
    rows = stats.join(labels.groupBy("doc_id").agg(F.max("quality").alias("y")).dropna(), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(16))).toPandas()
    s, y = rows[quality.STATS].to_numpy(), rows["y"].to_numpy(float)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert np.allclose(s, [quality.statistics(texts[d]) for d in rows["doc_id"]])
    assert np.allclose(model.mean, s.mean(axis=0)) and np.allclose(model.scale, np.where(s.std(axis=0) > 0, s.std(axis=0), 1))
    z = np.clip((s - s.mean(axis=0)) / model.scale, -8, 8)
    a = np.c_[np.sqrt(2 / quality.WAVES) * np.cos(z @ model.waves + model.phase), np.ones(len(z))]
    fit = (rows["half"] < 8).to_numpy()
    weights = np.linalg.solve(a[fit].T @ a[fit] + quality.RIDGE * np.eye(a.shape[1]), a[fit].T @ y[fit])
    assert np.allclose(model.weights, weights, atol=1e-6)
    assert np.allclose(model.score(s), np.clip(np.interp(a @ weights, *quality.isotonic(a[~fit] @ weights, y[~fit])), 0, 1), atol=1e-6)
    stats.unpersist()


def test_fourier_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(5)
    d = len(quality.STATS)
    waves, phase = rng.normal(0, 1 / np.sqrt(d), (d, 4096)), rng.uniform(0, 2 * np.pi, 4096)
    m = quality.QualityModel(np.zeros(d), np.ones(d), waves, phase, np.zeros(4097), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(30, d))
    f = m.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * d))
    assert np.abs(f @ f.T - want).max() < 0.1


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500).round(1)
    kx, ky = quality.isotonic(x, (rng.random(500) < 1 / (1 + np.exp(-x))).astype(float))
    assert (np.diff(kx) >= 0).all() and (np.diff(ky) >= 0).all() and 0 <= ky.min() and ky.max() <= 1


def plain_alignment(a, b):
    h, best = [[0] * (len(b) + 1)], 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, h[-1][j] + (2 if x == y else -1), h[-1][j + 1] - 1, row[-1] - 1))
        best = max(best, *row)
        h.append(row)
    return best


def test_alignment():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        score, start, end = decontamination.align(a, b)
        assert score == plain_alignment(a, b)
        assert score == 0 or plain_alignment(a, b[start:end]) == score


def test_contamination_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    join = lambda t: " ".join(decontamination.words_of(t))
    texts = {d["doc_id"]: f" {join(d['text'])} " for d in docs}
    copies = {(d, i["item_id"]) for i in items for d, t in texts.items() if f" {join(i['text'])} " in t}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in op9_decontamination(spark, SF).collect()}
    assert copies and copies <= got.keys() and all(got[p] == 1 for p in copies)
    for d, i in got.keys() - copies:
        a, b = decontamination.words_of(next(x["text"] for x in items if x["item_id"] == i)), texts[d].split()
        assert plain_alignment(a, b) >= len(a)


def test_edited_copies_and_edges(spark, edge, empty):
    item = "which of these seven planets has the greatest number of moons known so far in our own solar system"
    edited = item.replace("seven", "eight").replace("greatest", "largest").replace(" own", "")
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "x y " * 50 + edited + " z w" * 50), (21, "planets and moons in the sky"), (22, item)], "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "Two words"), (None, "abc")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(docs, bench).collect()}
    assert got == {(20, 1), (22, 1)}
    assert decontamination.find_contamination(empty, bench).count() == 0 == decontamination.find_contamination(docs, bench.limit(0)).count()
    assert decontamination.drop_contaminated(edge, bench).columns == edge.columns


def test_hot_items_keep_their_seeds(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(i, f"{i} {item} {i}") for i in range(50)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontamination.find_contamination(docs, bench).count() == 50


@pytest.mark.parametrize("exact", [0, 1])
def test_edited_items_in_many_documents(spark, exact):
    """One edited copy in hundreds of documents, with or without a whole copy elsewhere, against plain alignment."""
    words = [f"w{k}" for k in range(40)]
    edited = [f"x{k}" if k % 4 == 3 and k < 24 else w for k, w in enumerate(words)]
    texts = [f"{i} {' '.join(edited)} {i}" for i in range(400)] + [" ".join(words)] * exact + [f"{i} w0 w1 w2 {i}" for i in range(200)]
    want = {i for i, t in enumerate(texts) if plain_alignment(words, t.split()) >= len(words)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"] for r in decontamination.find_contamination(docs, bench).collect()}
    assert got == want and len(want) == 400 + exact


def test_repeats_in_one_document_lose_no_other(spark):
    """An edited passage 150 times in one document and once in another; an item under 150 ids."""
    words = [f"w{k}" for k in range(40)]
    edited = " ".join("x" if k % 4 == 3 and k < 24 else w for k, w in enumerate(words))
    for times, ids in ((150, 1), (1, 150)):
        docs = spark.createDataFrame([(1, (edited + " y" * 100 + " ") * times), (2, f"a {edited} b")], "doc_id long, text string")
        bench = spark.createDataFrame([(i, " ".join(words)) for i in range(ids)], "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(docs, bench).collect()}
        assert got == {(d, i) for d in (1, 2) for i in range(ids)}


def test_filter_by_id_and_text(spark):
    """Null ids, one id on several texts, clashing columns."""
    item = "which of these seven planets has the greatest number of moons known so far"
    rows = [(None, f"x {item} y"), (None, "clean and without an id"), (3, item.upper()), (3, "clean, under an id that leaks"), (4, "moons known so far")]
    docs = spark.createDataFrame([(d, t, 1, 2, "s") for d, t in rows], "doc_id long, text string, item long, digest int, seed string")
    bench = spark.createDataFrame([(1, item, 5)], "item_id long, text string, doc_id int")
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == sorted(t for _, t in (rows[1], rows[3], rows[4]))
    assert sorted(map(repr, ((r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(docs, bench).collect()))) == ["(3, 1)", "(None, 1)"]


@pytest.mark.parametrize("full", [False, True])
def test_one_pass_for_any_benchmark(spark, monkeypatch, full):
    """Found among many items; a table of bits that is full lets false hits through, which change nothing."""
    if full:
        monkeypatch.setattr(decontamination, "MOST_BITS", 6)
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    items = [(i, words(int(rng.integers(8, 40)))) for i in range(800)]
    docs = [(d, f"{words(60)} {items[d * 7][1]} {words(60)}") for d in range(100)] + [(d, words(150)) for d in range(100, 160)]
    found = decontamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(d, d * 7) for d in range(100)}


def test_recall_of_edited_items(spark):
    """Items of the test tables planted in documents with 5 to 20 in 100 words edited, against plain alignment of every pair."""
    rng = np.random.default_rng(3)
    items = [(r["item_id"], " ".join(decontamination.words_of(r["text"]))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(60).collect()]
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 500 and 1500").limit(60).collect()]
    docs, planted = [], {}
    for k, (item_id, item) in enumerate(items):
        for rate in (0.05, 0.1, 0.15, 0.2):
            ws = [w if rng.random() > rate else f"edit{rng.integers(99)}" for w in item.split()]
            planted[len(docs)] = item_id, rate
            docs.append((len(docs), f"{texts[k % len(texts)]} {' '.join(ws)} {texts[(k + 7) % len(texts)]}"))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    by_id = dict(items)
    for rate, least in ((0.05, 1.0), (0.1, 1.0), (0.15, 0.95), (0.2, 0.9)):
        own = [(d, i) for d, (i, r) in planted.items() if r == rate]
        reach = [p for p in own if plain_alignment(by_id[p[1]].split(), decontamination.words_of(docs[p[0]][1])) >= len(by_id[p[1]].split())]
        assert set(reach) <= found and len(reach) >= least * len(own), (rate, len(reach), len(own))


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.py", "code"),
        (3, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/b/c/y.py", None),
        (5, "a/z.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (6, "q/w.py", ""),
        (7, None, "licensed under cc by-nc 4.0"),
        (8, "LICENSED", "Licensed under CC BY 4.0."),
        (9, "ab/x.py", "we sell a licence to drive"),
        (10, "a/b/x.py", "text " * 5000 + "\nThis work is licensed under the GNU General Public License, version 3.\n" + "text " * 5000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in licenses.scan_licenses(df).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("GPL-3.0", "own", None), 4: ("GPL-3.0", "inherited", "a/b"), 5: ("Apache-2.0", "own", None),
        6: ("CC-BY-4.0", "inherited", ""), 7: ("CC-BY-NC-4.0", "own", None), 8: ("CC-BY-4.0", "own", None), 9: ("CC-BY-4.0", "inherited", ""), 10: ("GPL-3.0", "own", None),
    }


HEADERS = {
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met.\n1. Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the documentation.\n3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from this\nsoftware without specific prior written permission.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files, to deal\nin the Software without restriction",
}


@pytest.mark.parametrize("name", HEADERS)
@pytest.mark.parametrize("mark,end", [("", "\n"), (" * ", "\n"), ("# ", "\r\n"), ("// ", " ")])
def test_wrapped_headers_in_long_paragraphs(name, mark, end):
    """A header wrapped over lines, or within one line of 100 kB, with code right above and below it."""
    code = [f"value{i} = compute(value{i + 1}, other{i % 7})" for i in range(1600)]
    lines = code + [mark + x for x in HEADERS[name].split("\n")] + code
    text = end.join(lines)
    assert len(text) > 100_000 and "\n\n" not in text
    score, found = licenses.Templates(licenses.TEMPLATES).scan(text, False)
    assert found == name and score >= licenses.THRESHOLD, (found, score)


def cosine_to(words, template):
    """Plain TF-IDF cosine over the templates' own words."""
    split = lambda t: re.findall(r"\w+", t.lower())
    all_words = [set(split(t)) for _, t in licenses.TEMPLATES]
    idf = lambda w: np.log((1 + len(all_words)) / (1 + sum(w in x for x in all_words))) + 1
    vector = lambda ws: {w: (1 + np.log(ws.count(w))) * idf(w) for w in set(ws)}
    a, b = vector(words), vector(split(template))
    return sum(x * b.get(w, 0) for w, x in a.items()) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_cosines_against_plain_version():
    t = licenses.Templates(licenses.TEMPLATES)
    words = "licensed under the the cc by nc 4 0 license version 3 zebra".split()
    got = t.cosines(words)
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        assert abs(got.get(k, 0.0) - cosine_to(words, text)) < 1e-9 and abs(t._cosine(words, k) - cosine_to(words, text)) < 1e-9
        # the bound that passes templates over
        assert k in t.within_reach(set(words)) or cosine_to(words, text) < licenses.THRESHOLD


@pytest.mark.parametrize("k", range(len(licenses.TEMPLATES)))
@pytest.mark.parametrize("how", ["alone", "file", "commented", "long line", "long paragraph"])
def test_every_template_is_named_right(k, how):
    """Each notice, head, licence text and SPDX line: alone, under a holder's line, in comments, in a line or a paragraph beyond the old bounds."""
    name, text = licenses.TEMPLATES[k]
    wrapped = textwrap.wrap(text, 72)
    code = " ".join(f"value{i} = compute{i % 7}(value{i + 1})" for i in range(900))
    shown = {
        "alone": text,
        "file": "Copyright (c) 2021 Jane Example\n\n" + "\n".join(wrapped) + "\n",
        "commented": "\n".join([f"x{i} = {i}" for i in range(50)] + ["# " + w for w in wrapped] + [f"y{i} = {i}" for i in range(50)]),
        "long line": f"{code} {text} {code}",
        "long paragraph": "\n".join([code[i : i + 80] for i in range(0, len(code), 80)] * 2 + wrapped + [code[:80]] * 90),
    }[how]
    score, found = licenses.Templates(licenses.TEMPLATES).scan(shown, how == "file")
    assert found == name and score >= licenses.THRESHOLD, (found, score)


@pytest.mark.parametrize("text,want", [("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("// SPDX-License-Identifier: BSD-2-Clause\nint x;", "BSD-2-Clause"), ("we sell a licence to drive", None), ("no hint at all", None), ("Copyright 2020 Jane Example. All rights reserved.", None)])
def test_short_texts(text, want):
    score, found = licenses.Templates(licenses.TEMPLATES).scan(text, False)
    assert (found if score >= licenses.THRESHOLD else None) == want


def test_licence_ties_go_to_the_first_path(spark):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY 4.0."
    for a, b in ((mit, cc), (cc, mit)):
        df = spark.createDataFrame([(1, "p/COPYING", a), (2, "p/LICENSE", b), (3, "p/x", "code")], "doc_id long, path string, text string")
        got = {r["doc_id"]: (r["license"], round(r["score"], 6)) for r in licenses.scan_licenses(df).collect()}
        assert got[3] == got[1] and got[1][1] == got[2][1] == 1.0


def test_licence_query_finds_all_notices(spark, edge, empty):
    from tracegrid.llm.queries import op3_licenses

    notices = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    got = {r["doc_id"]: r["license"] for r in op3_licenses(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[d["doc_id"]] == next((v for k, v in notices.items() if k in (d["text"] or "")), None)
    assert licenses.scan_licenses(edge).count() == edge.count() and licenses.scan_licenses(empty).count() == 0


def test_licence_query_inherits_where_the_table_has_paths(spark, tmp_path):
    from tracegrid.llm.queries import op3_licenses

    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "c/x.py", "code"), (4, None, "code"), (5, "a/y.py", "Licensed under CC BY 4.0.")]
    spark.createDataFrame([(d, t, "src0", p) for d, p, t in rows], "doc_id long, text string, source string, path string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["path"], r["license"], r["origin"], r["license_dir"]) for r in op3_licenses(spark, str(tmp_path)).collect()}
    assert got == {1: ("a/LICENSE", "MIT", "own", None), 2: ("a/b/x.py", "MIT", "inherited", "a"), 3: ("c/x.py", None, "none", None), 4: (None, None, "none", None), 5: ("a/y.py", "CC-BY-4.0", "own", None)}


def test_pipeline_stages_on_edges(spark, sf, edge, empty):
    """Every stage on null, empty, repeated and very long texts, null ids and clashing columns, one after the other; and on no rows."""
    import corpus_pipeline

    names = "__id", "__gone", "y", "u", "v", "node", "dir", "digest"
    docs = edge.select("*", *[F.lit(1).alias(n) for n in names])
    left = {"language": [4, 5, 6, 7, 8, 9, 9, 10, 11, None], "exact": [5, 6, 7, 8, 9, 10, 11, None], "near": [5, 6, 7, 8, 9, 10, 11, None], "decontaminated": [5, 6, 7, 8, 9, 10, 11, None]}
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty, sf)
        assert none.count() == 0
        columns, docs = docs.columns, stage(spark, docs, sf)
        if name in left:
            assert docs.columns == columns
            assert sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=lambda d: (d is None, d)) == left[name], name
    assert {r["doc_id"] for r in docs.collect()} == set(left["decontaminated"])


def test_pipeline(spark, sf):
    """Against a plain version: each stage's decisions on what its predecessor kept."""
    import corpus_pipeline
    from tests.llm.test_simhash import plain_near

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    left = {d: t for d, t in docs.items() if t and any(c.isalpha() for c in t)}
    last = {}
    for d in sorted(left):
        last["".join(c.lower() if c.isascii() else c for c in left[d])] = d
    left = {d: docs[d] for d in last.values()}
    left = {d: docs[d] for d in left.keys() - {d for d, _ in plain_near(sorted(left.items()))}}
    items = [decontamination.words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = {d: decontamination.words_of(t) for d, t in left.items()}
    number = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws])
    leaked = {d for d, w in words.items() for i in items if len(set(i) & set(w)) * 2 >= len(set(i)) * 0.5 and decontamination.align(code(i), code(w))[0] >= len(i)}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == left.keys() - leaked
    from tests.llm.test_tokens_packing_files import check_packing, library

    t = library("byte_bpe_50k.json")
    assert check_packing(rows, {d: t.encode(left[d], add_special_tokens=False).ids + [0] for d in left.keys() - leaked}) < 0.001
