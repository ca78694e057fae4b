"""Recursive byte-pair queries against the tokenizer library, and exact round trips."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitalgrid.llm.byte_bpe import _Vocabulary, decode, encode
from vitalgrid.llm.queries import QUERIES, tokenizer_file

RANKS = tokenizer_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return _Vocabulary(RANKS, public_tokenizers.PATTERN)


def ids_of(vocabulary, texts):
    begin, ids = vocabulary.encode(texts, {})
    return [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(max_size=120), min_size=1, max_size=5))
def test_any_text(vocabulary, library, texts):
    assert ids_of(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_words(vocabulary, library):
    draw = random.Random(1)
    texts = ["x" * 30_000, "x" * 29_999 + " x", "ab" * 5000, " " * 5000 + "\n" * 501, "=-" * 777, "é" * 999, "0" * 4321,
             "".join(draw.choice("etaoinshrdlu") for _ in range(3000)),
             "".join(draw.choice("aàxyzöEß") for _ in range(1500)), "A" * 65 + "b" * 64, "\U0001f600" * 300]
    assert ids_of(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_recursion_that_starts_again(vocabulary, library, monkeypatch):
    monkeypatch.setattr("vitalgrid.llm.byte_bpe.HELD", 1)
    text = "".join(random.Random(2).choice("thequickbrown") for _ in range(400))
    assert ids_of(vocabulary, [text, "", text]) == [library.encode_ordinary(t) for t in (text, "", text)]


def test_other_vocabulary():
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Straße über Äpfel, 東京 1234!", "où est-ce que   l'été?"]
    assert ids_of(_Vocabulary(path, public_tokenizers.PATTERN), texts) == [other.encode_ordinary(t) for t in texts]


def test_rows(spark, library):
    rows = [(1, "Hello  world, it's 12 o'clock"), (1, "Hello  world, it's 12 o'clock"), (2, None), (3, ""),
            (None, "<|endoftext|> \x00\x1c"), (4, "word " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("*", *[F.lit("clash").alias(c) for c in ("ids", "decoded", "_text", "_id")])
    told = encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    got = sorted(((r[0] or 0, list(r["ids"]), bytes(r["decoded"])) for r in told.collect()))
    want = sorted((i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert got == want
    back = {r[0]: bytes(r[1]) for r in decode(told, RANKS).collect()}
    assert back[4] == rows[5][1].encode() and back[2] == b""
    assert encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    assert decode(told.limit(0), RANKS).count() == 0
    assert bytes(decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS).first()[1]) == b""


def test_query_against_the_library(spark, library):
    import hashlib
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op12_byte_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
