import random

import pytest

from tidemark.llm import bpe
from tidemark.llm.queries import QUERIES


def texts():
    r = random.Random(5)
    parts = ["the", " cat", "'s", " 12345", "   ", "\n\n", "été", " 日本語", "!?", "x" * 70, " " * 60, "\t", " don't", " ", "🙂"]
    return ["", None, "a", " ", "x" * 300, " " * 300, *("".join(r.choices(parts, k=r.randint(1, 80))) for _ in range(120))]


@pytest.mark.parametrize("chunk", [17, 24, 40])
def test_chunks_give_the_ids_of_whole_texts(spark, chunk):
    codec = bpe.Codec(bpe.read_ranks())
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk, overlap=chunk).collect()}
    assert got.keys() == {i for i, _ in rows}
    for i, t in rows:
        assert got[i].tokens == (None if t is None else codec.encode(t).tolist())
        assert got[i].exact == (None if t is None else True)


def test_decode_gives_the_bytes_back(spark):
    rows = list(enumerate(texts()))
    done = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), chunk=24, overlap=24))
    assert {r.doc_id: r.bytes and bytes(r.bytes) for r in done.collect()} == {i: t and t.encode() if t != "" else b"" for i, t in rows}


def test_very_long_pretokens_and_texts(spark):
    codec = bpe.Codec(bpe.read_ranks())
    rows = [(1, " " * 5000), (2, "x" * 30_000), (3, "word " * 40_000), (3, "word " * 40_000), (None, "a b"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rid", "2 AS `a.b`", "3 AS tokens")
    got = sorted((r.doc_id or 0, tuple(r.tokens) if r.tokens is not None else None) for r in bpe.encode(docs, chunk=1000, overlap=1000).collect())
    # 30,000 equal letters are slow to merge, so that their ids are held against their bytes
    assert [x for x in got if x[0] != 2] == sorted(((i or 0, None if t is None else tuple(codec.encode(t).tolist())) for i, t in rows if i != 2))
    assert codec.decode(dict(got)[2]) == b"x" * 30_000
    assert bpe.encode(docs.limit(0)).count() == 0


def test_registered_over_every_document(spark):
    at = "/root/testdata/sf0.001"
    out = QUERIES["op5_byte_bpe"](spark, at).collect()
    assert len(out) == spark.read.parquet(f"{at}/documents.parquet").count()
    assert all(r.exact for r in out)
