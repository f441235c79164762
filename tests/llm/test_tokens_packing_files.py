import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracegrid.llm import bitplane, packing, tokens
from tracegrid.llm.common import scratch_path
from tracegrid.llm.queries import op2_packing, op4_bitplane

KINDS = [("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "words")]


@functools.cache
def library(name):
    return Tokenizer.from_file(tokens.vocabulary(name))  # on its default settings


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,cut", KINDS)
@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("aBz ÉéßİΣς'.,!1²\n\t\r\u00a0\u2028\x1c\x00‘世́<|>") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_pieces_give_the_ids_of_whole_texts(name, cut, text):
    assert tokens.encoder(tokens.vocabulary(name), cut).encode([text])[0].tolist() == library(name).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name,cut", KINDS)
def test_ids_of_random_texts(name, cut):
    """Added tokens, letters whose lower case is a letter and a mark, marks and punctuation, side by side."""
    r = random.Random(11)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "İ", "i\u0307", "ǰ", "ẞ", "\u0307", "\u0301", "e", "Straße", "hello", "World", " ", "  ", "\n", "!", "?!", "...", "'s", "'", '"', "<", "1", "²", "Σ", "ς", "世界", "\U0001f600"]
    texts = ["hello <|endoftext|> world", "İ!", "İ"] + ["".join(r.choices(parts, k=r.randint(1, 9))) for _ in range(100_000)]
    got = tokens.encoder(tokens.vocabulary(name), cut).encode(texts)
    want = library(name).encode_batch(texts, add_special_tokens=False)
    assert [t for t, g, w in zip(texts, got, want) if g.tolist() != w.ids] == []


@pytest.mark.parametrize("name,cut", KINDS)
def test_ids_of_documents(spark, sf, name, cut):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["it's we'll  <|endoftext|> x", None, ""]
    t = library(name)
    got = tokens.encoder(tokens.vocabulary(name), cut).encode(texts)
    assert [g.tolist() for g in got] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def check_packing(rows, ids, limit=1024, segments=256):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc]) and p["length"] > 0
            assert p["ids_crc32"] == crc(ids[doc][at : at + p["length"]])
            at += p["length"]
        assert at == len(ids[doc])
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limit and len(pieces) <= segments
        total += at
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding / total


def test_packing_query(spark, sf):
    t = library("byte_bpe_50k.json")
    ids = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_packing(op2_packing(spark, sf).collect(), ids) < 0.001


def test_packer_limits():
    r, out = random.Random(5), []
    limits = packing.Limits(tokens=64, segments=3, loss=40)
    p = packing.Packer(limits, out.append)
    want = {}
    for i in range(2000):
        n = r.choice([1, 2, 5, 30, 64, 200])
        want[i] = n
        p.add(packing.Item(i, 0, np.full(n, i % 100, np.uint16), r.randint(0, n), n))
    p.finish()
    got = defaultdict(list)
    for b in out:
        assert sum(len(x.ids) for x in b) <= 64 and len(b) <= 3 and sum(x.loss for x in b) <= 40
        for x in b:
            got[x.doc].append((x.start, len(x.ids)))
    for i, pieces in got.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == want[i]
    assert len(got) == 2000


@pytest.mark.parametrize("wrong", [{"tokens": 0}, {"segments": 0}, {"loss": 0}, {"loss": -1}])
def test_limits_that_hold_nothing(wrong):
    with pytest.raises(ValueError):
        packing.Limits(**wrong)


def test_prompts_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "answer here", "a question"), (2, None, None)], "doc_id long, text string, prompt string")
    rows = {r["doc_id"]: r for r in packing.pack(df, prompt_col="prompt", keep_ids=True).collect()}
    assert rows[1]["loss_tokens"] < rows[1]["doc_tokens"] and rows[2]["loss_tokens"] == 1
    assert zlib.crc32(rows[1]["ids"]) == rows[1]["ids_crc32"]


def test_packing_edges(spark, edge, empty):
    rows = packing.pack(edge.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    assert {r["doc_id"] for r in rows} == set(range(1, 12))
    assert packing.pack(edge).where("doc_id is null").count() >= 1 and packing.pack(empty).count() == 0


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("kind", ["<u2", "<u4"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(bits, kind, n):
    ids = np.random.default_rng(n).integers(0, 60_000, n).astype(kind)
    assert (bitplane.from_planes(bitplane.to_planes(ids, bits), n, ids.itemsize) == ids).all()


@given(st.lists(st.binary(max_size=50), max_size=6))
@settings(deadline=None)
def test_joined_checksums(parts):
    assert bitplane.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def want_documents(rows):
    t, out, at = library("word_bpe_49k.json"), [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_token_files_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op4_bitplane(spark, sf).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want_documents(rows)


@pytest.mark.parametrize("block,bits", [(5, False), (64, True)])
def test_documents_that_span_chunks(spark, edge, block, bits):
    small = edge.where("doc_id is null or doc_id != 8")
    path = scratch_path(spark, "t")
    bitplane.write_ids(small, path, block=block, bits=bits)
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    assert sorted(map(tuple, bitplane.read_documents(spark, path).collect()), key=lambda r: r[1]) == want_documents(rows)
    segments = bitplane.read_segments(spark, path).collect()
    assert all(zlib.crc32(s["ids"]) == s["crc"] for s in segments) and sum(s["n"] for s in segments) == sum(x[2] for x in want_documents(rows))


def test_empty_token_files(spark, empty):
    path = scratch_path(spark, "t")
    bitplane.write_ids(empty, path)
    assert bitplane.read_documents(spark, path).count() == 0
