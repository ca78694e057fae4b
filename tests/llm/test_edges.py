"""Defined results for nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns whose names clash with result columns."""

import pytest
from pyspark.sql import functions as F

from vitalgrid.llm.embedding_dedup import embedding_groups
from vitalgrid.llm.exact_dedup import content_sort, drop_copies
from vitalgrid.llm.html_extract import extract_main_text
from vitalgrid.llm.language import identify
from vitalgrid.llm.licenses import scan_licenses
from vitalgrid.llm.mixing import mix, repeat
from vitalgrid.llm.packing import pack
from vitalgrid.llm.pii import pseudonymise
from vitalgrid.llm.queries import URL_RULES, tokenizer_file
from vitalgrid.llm.simhash import drop_near_copies, simhash_groups
from vitalgrid.llm.url_graph import judge_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
    (2, "The Quick brown fox jumps over the lazy dog", "en", "a", 1),
    (2, "The Quick brown fox jumps over the lazy dog", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "de", "b", 0),
    (5, " \t\n", None, "b", 3),
    (7, "1234 !!! 5678", "de", None, 9),
    (8, "der schnelle braune fuchs springt", "de", "b", 9),
    (10, "x" * 30_000 + " tail", "en", "a", 9),
    (11, "word " * 6000, "en", "c", 9),
]
CLASH = ["kept", "keep_id", "fingerprint", "component_id", "size", "target", "lang_pred", "score", "piece", "_row", "_h"]


@pytest.fixture
def docs(spark):
    d = spark.createDataFrame(ROWS, DOCS)
    return d.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture
def empty(docs):
    return docs.filter("doc_id < 0")


def by_id(df, *cols, key="doc_id"):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect()}


def test_content_sort(docs, empty):
    rows = content_sort(docs, keep="largest").collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r for r in rows}
    assert (got[1]["keep_id"], got[1]["group_size"], got[1]["kept"]) == (2, 3, False)
    assert sum(r["kept"] for r in rows if r["doc_id"] == 2) == 1
    assert got[3]["keep_id"] == 4 and got[4]["kept"] and got[3]["group_size"] == 2
    assert content_sort(docs).filter("doc_id = 2").select(F.max("keep_id")).first()[0] == 1
    assert content_sort(empty).count() == 0
    kept = drop_copies(docs, keep="largest")
    assert kept.columns == docs.columns and kept.count() == 7
    assert drop_copies(empty).count() == 0


def test_simhash(docs, empty):
    got = by_id(simhash_groups(docs), "fingerprint", "component_id")
    zero = {d for d, (f, _) in got.items() if f == "0" * 16}
    assert zero == {3, 4, 5}
    assert {got[d][1] for d in zero} == {3} and got[1][1] == got[2][1] == 1
    assert simhash_groups(docs).count() == len(ROWS) and simhash_groups(empty).count() == 0
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 7, 8, 10, 11]


def test_pack(docs, empty):
    path = tokenizer_file("word_bpe_49k.json")
    rows = pack(docs, path, size=64, partition_pieces=50).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total[3] == total[4] == total[5] == 1 and total[2] == 2 * total[1] and total[11] == 6001
    assert pack(empty, path).count() == 0


def test_identify(docs, empty):
    path = tokenizer_file("piece_bpe_32k.model")
    got = by_id(identify(docs, path), "lang_pred", "score")
    assert [got[d] for d in (3, 4, 5, 7)] == [("und", 0.0)] * 4
    assert got[11][0] == "en" and got[8][0] in ("de", "en") and 0 <= got[10][1] <= 1
    assert identify(empty, path).count() == 0
    none = identify(docs.withColumn("lang", F.lit(None).cast("string")), path)
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    whole = identify(docs, path, keep_columns=True)
    assert whole.columns == [*docs.columns, "_lang", "_score"]


def test_mix(docs, empty):
    rows = mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["epochs"] * r["size"] for r in rows)
    got = {r["doc_id"]: r for r in rows}
    assert got[3]["size"] == got[4]["size"] == got[5]["size"] == got[3]["taken"] == 0
    assert got[3]["source_size"] == got[7]["source_size"] == 3  # the null source
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs).collect()))
    assert mix(empty).count() == 0
    all_ = repeat(mix(docs, keep=docs.columns), docs.columns)
    assert all_.columns == docs.columns and all_.count() == sum(r["epochs"] for r in rows)
    odd = docs.withColumn("epochs", F.lit("clash")).withColumn("mix_epochs", F.lit("clash")).withColumn("col", F.lit(1))
    assert repeat(mix(odd, keep=odd.columns), odd.columns).count() == all_.count()
    assert repeat(mix(empty, keep=docs.columns), docs.columns).count() == 0


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], 0, "k"), (2, [2.0, 0.0], 0, "k"), (3, [1.0, 0.0], 0, "k"), (3, [1.0, 0.0], 0, "k"),
            (4, [1.0, 0.0], 1, "k"), (5, [0.0, 0.0], 0, "k"), (6, None, 0, "k"), (7, [float("nan"), 1.0], 0, "k"),
            (8, [None, 1.0], 0, "k"), (9, [1.0, 0.0], None, "k"), (10, [1.0, 0.0, 0.0], 0, "k"), (11, [], 0, "k"),
            (12, [float("inf"), 0.0], 0, "k"), (13, [0.97, 0.2431], 0, "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    out = embedding_groups(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = by_id(out, "n_links", "component_id", "kept", key="vec_id")
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False)
    for d in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13):
        assert got[d] == (0, d, True)
    assert out.count() == len(rows) and embedding_groups(df.filter("vec_id < 0")).count() == 0


def test_pages(spark):
    rows = [(1, "http://A.Example.NET/en/x", "<article><p>One &amp; two<br>three", "k"), (2, None, None, "k"),
            (3, "nonsense", "", "k"), (4, "http://b.net?x", "plain text", "k"), (4, "http://b.net?x", "plain text", "k"),
            (5, "http://c.org/fr/", "<p>" + "long " * 50_000 + "</p>", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    df = df.withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    got = by_id(extract_main_text(df), "text", "n_chars", key="page_id")
    assert got[1] == ("One & two three", 15) and got[2] == got[3] == ("", 0) and got[5][1] == 5 * 50_000 - 1
    assert extract_main_text(df).count() == 6 and extract_main_text(df.filter("page_id < 0")).count() == 0
    got = by_id(judge_urls(df, URL_RULES), "host", "path", "rule", "verdict", key="page_id")
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == got[3] == ("", "", None, "allow")
    assert got[4][:3] == ("b.net", "", None) and got[5][2:] == ("org/fr/", "allow")
    assert judge_urls(df, URL_RULES).count() == 6 and judge_urls(df.filter("page_id < 0"), URL_RULES).count() == 0


def test_pii_and_licenses(docs, empty):
    got = by_id(pseudonymise(docs, "k"), "text", "n_replaced")
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[7] == ("1234 !!! 5678", 0) and got[11][0] == "word " * 6000
    assert pseudonymise(docs, "k").count() == len(ROWS) and pseudonymise(empty, "k").count() == 0
    got = by_id(scan_licenses(docs), "licenses", "n_sentences")
    assert set(got.values()) == {("", 0)}
    assert scan_licenses(docs).count() == len(ROWS) and scan_licenses(empty).count() == 0
