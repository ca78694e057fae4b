"""Operators against brute-force versions on small tables."""

import datetime
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

import __spark_entry__ as entry
import corpus_pipeline
from vitalgrid.llm import packing, pii, queries
from vitalgrid.llm.components import connected_components
from vitalgrid.llm.embedding_dedup import embedding_groups
from vitalgrid.llm.exact_dedup import content_sort
from vitalgrid.llm.html_extract import blocks, extract_main_text, style_tree
from vitalgrid.llm.language import fit, word_score
from vitalgrid.llm.licenses import Recogniser, scan_licenses
from vitalgrid.llm.simhash import fingerprint, near_pairs, simhash_groups
from vitalgrid.llm.url_graph import judge_urls, personalised_pagerank

SF = "/root/testdata/sf0.001"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out + ([word] if word else [])


def slow_fingerprint(text, width=4):
    w = words_of(text)
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < width else [" ".join(w[i:i + width]) for i in range(len(w) - width + 1)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet' ORDER BY doc_id").df()


def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    links += [(600, 600), (601, 602), (602, 601)]
    got = connected_components(spark.createDataFrame(links, "a int, b int")).collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r["node"]: r["component"] for r in got} == roots(nodes, [x for x in links if x[0] != x[1]])


def test_simhash_against_all_pairs(spark, documents):
    got = {r["doc_id"]: r for r in simhash_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    prints = {d: slow_fingerprint(t) for d, t in zip(documents.doc_id, documents.text, strict=True)}
    ids = list(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = roots(ids, links)
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == prints
    assert {d: r["component_id"] for d, r in got.items()} == want and len(set(want.values())) < len(ids)
    assert fingerprint("ONE two") == slow_fingerprint("one TWO") and fingerprint("É a b c") == slow_fingerprint("É a b c")


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_pigeonring_loses_no_pair(spark, segments):
    rng = random.Random(segments)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base:
        for k in range(1, 7):
            for _ in range(4):
                x = b
                for bit in rng.sample(range(64), k):
                    x ^= 1 << bit
                prints.add(x)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in prints}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {(r["fp_a"], r["fp_b"]) for r in near_pairs(df, 4, segments).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 4}
    assert got == want and want


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer
    path = queries.tokenizer_file("word_bpe_49k.json")
    odd = ["", "  ", "don't STOP<|endoftext|>now it's", "İstanbul Ω ΑΣ éa ﬁne", "a b\x1cc d", "日本語 テスト 123.45!"]
    texts = [*documents.text.fillna(""), *odd]
    tok = Tokenizer.from_file(path)
    want = []
    for d, e in enumerate(tok.encode_batch(texts, add_special_tokens=False)):
        ids = [*e.ids, 1]
        want += [(d, k, k * 256, len(x := ids[k * 256:(k + 1) * 256]), zlib.crc32(np.array(x, "<u4").tobytes()))
                 for k in range(-(-len(ids) // 256))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(df, path, size=256, partition_pieces=200).toPandas()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[cols].to_numpy().tolist())) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, g.length.cumsum()[:-1]]).all() and g.length.sum() <= 256
    bound = packing.bin_lower_bound(got.length.to_numpy(), 256)
    assert bound <= got.sequence_id.nunique() <= bound + 2


def test_bin_bounds_never_exceed_the_optimum():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = rng.integers(1, 101, rng.integers(1, 40))
        bins, offsets, fill = packing.best_fit_decreasing(x, 100)
        assert packing.bin_lower_bound(x, 100) <= len(fill) and fill.max() <= 100 and fill.sum() == x.sum()
    assert packing.bin_lower_bound(np.full(9, 60), 100) == 9  # volume alone gives 6
    assert packing.bin_lower_bound(np.full(9, 34), 100) == 5


def test_exact_groups_cut_by_partition_bounds(spark):
    rows = [(i, "SAME text" if i % 3 else "same TEXT") for i in range(3000)] + [(5000 + i, f"t{i % 50}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = content_sort(df, keep="largest").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    hot = got[got.doc_id < 3000]
    assert set(hot.keep_id) == {2999} and set(hot.group_size) == {3000} and hot.kept.sum() == 1
    rest = got[got.doc_id >= 5000]
    assert set(rest.group_size) == {6} and rest.kept.sum() == 50 and (rest[rest.kept].doc_id >= 5250).all()


def test_language_models(spark, documents):
    langs, table = fit(spark.read.parquet(f"{SF}/documents.parquet"), queries.tokenizer_file("piece_bpe_32k.model"))
    assert langs == sorted(set(documents.lang))
    probs = {p: tuple(v.tolist()) for p, v in table.items()}

    def total(w, lang):  # every segmentation, one by one
        if not w:
            return 1.0
        return sum((probs[w[:k]][lang] if w[:k] in probs else 1e-7 if k == 1 else 0.0) * total(w[k:], lang)
                   for k in range(1, len(w) + 1))

    for word in ("theing", "eau", "ж", "schüber"):
        for k, score in enumerate(word_score(word, probs, len(langs))):
            assert score == pytest.approx(np.log(total("▁" + word, k)), rel=1e-9)
    assert np.isfinite(word_score("zq" * 5000, probs, len(langs))).all()
    got = entry.queries()["op7_language"](spark, SF).toPandas().merge(documents[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) == h for d, h in zip(got.doc_id, got.held_out, strict=True))


def test_embeddings_in_cells_and_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([c + rng.normal(scale=0.06, size=(20, 16)) for c in centres] + [rng.normal(size=(100, 16))])
    label = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))],
                               "vec_id long, embedding array<double>, label int")
    got = embedding_groups(df, 0.98, cell_vectors=40, block=16).toPandas().set_index("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    want = roots(range(len(x)), zip(*np.nonzero(hit), strict=True))
    assert hit.sum() > 500
    assert (got.n_links.sort_index().to_numpy() == hit.sum(axis=1)).all()
    assert got.component_id.to_dict() == want


def test_style_tree_removes_repeated_branches(spark):
    page = ("<html><body><div class='top'>Welcome to the site</div><div class='text'><p>Story {0} begins</p><p>and ends {0}"
            "</p></div><div class='box'>We use cookies</div><ul class='links'><li>Home<li>News</ul></body></html>")
    rows = [(i, f"http://h{i % 2}.com/{i}", page.format(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    assert got == {i: f"Story {i} begins and ends {i}" for i in range(20)}
    tree = {r["path"]: r for r in style_tree(df.selectExpr("'h' host", "html")).collect()}
    assert tree[">html>body>div.box"]["importance"] == pytest.approx(0.0)
    assert tree[">html>body>div.text>p"]["importance"] == pytest.approx(1.0)


def test_page_blocks():
    page = ("<title>T</title><nav><a href=x>Menu</a></nav><article><header><h1>Head &amp; line</h1></header><p><b>One<br>two"
            "<p>three <i>four</i>five<script>var a='</p>'</script><ul><li>x<li>y</ul><div class=comments><p>Nice!</div>"
            "<form>Name <input></form></article><aside>more</aside><!-- <p>no</p> --><p>a < b &lt;c&gt;</p>")
    kept = [t for _, furniture, t in blocks(page) if not furniture]
    assert kept == ["Head & line", "One two", "three fourfive", "x", "y", "a < b <c>"]


def test_url_graph_against_power_iteration(spark):
    link = "<a href='http://{}/'>x</a>"
    pages = [("s.net", ["a.com"]), ("a.com", ["s.net", "b.com"]), ("b.com", ["a.com"]), ("t.org", ["c.com", "b.com"]),
             ("c.com", ["d.com"]), ("d.com", [])]
    rows = [(i, f"http://{h}/fr/p", "".join(link.format(x) for x in out)) for i, (h, out) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["host"]: r for r in judge_urls(df, queries.URL_RULES).collect()}
    hosts = [h for h, _ in pages]
    w = np.zeros((6, 6))
    for h, out in pages:
        for x in out:
            w[hosts.index(h), hosts.index(x)] = 1

    def rank(m, seed):
        p = m / np.maximum(1, m.sum(axis=1, keepdims=True))
        s = np.array([h == seed for h in hosts], float)
        r = 0.15 * s
        for _ in range(400):
            r = 0.15 * s + 0.85 * (p.T @ r)
        return r

    for k, h in enumerate(hosts):
        assert got[h]["trust"] == pytest.approx(rank(w, "t.org")[k], abs=1e-5)
        assert got[h]["distrust"] == pytest.approx(rank(w.T, "s.net")[k], abs=1e-5)
    assert [got[h]["verdict"] for h in hosts] == ["block", "block", "allow", "allow", "allow", "allow"]
    edges = spark.createDataFrame([], "src string, dst string, n long")
    assert personalised_pagerank(edges, edges.selectExpr("src host")).count() == 0


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    rng = random.Random(2)
    cards = []
    while len(cards) < 40:
        c = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        cards += [c] if luhn(c) and c not in cards else []
    days = [str(datetime.date(1990, 1, 1) + datetime.timedelta(days=i)) for i in range(60)]
    ips = [f"10.{a}.{b}.7" for a in range(5) for b in range(8)]
    phones = [f"+1 (415) 555-{n:04d}" for n in range(40)]
    ssns = [f"{a:03d}-12-{n:04d}" for a in (1, 665, 667, 899) for n in (1, 9999)]
    mails = [f"Jo.{n:02d}@mail.example.com" for n in range(20)]
    values = cards + days + ips + phones + ssns + mails
    rows = [(i, f"a {v}, b") for i, v in enumerate(values)] + [(1000 + i, f"{v} again") for i, v in enumerate(values)]
    rows += [(2000, "4" * 15 + "5 1999-02-30 999.1.1.1 000-12-3456 +2 (115) 555-1234x 12345"), (2001, cards[0][:4] + " " + cards[0][4:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, "k1").collect()}
    new = [got[i][2:-3] for i in range(len(values))]
    assert all(got[1000 + i] == f"{v} again" for i, v in enumerate(new)) and len(set(new)) == len(values)
    assert sum(a == b for a, b in zip(new, values, strict=True)) <= 2
    at = iter(new)
    assert all(len(c := next(at)) == 16 and c[0] == "4" and luhn(c) for _ in cards)
    assert all(datetime.date.fromisoformat(next(at)) for _ in days)
    assert all(all(0 <= int(p) <= 255 for p in next(at).split(".")) for _ in ips)
    assert all((p := next(at))[:4] == "+1 (" and p[4] > "1" and p[9] > "1" and len(p) == 17 for _ in phones)
    assert all((s := next(at))[3] == s[6] == "-" and s[:3] not in ("000", "666") and s[:3] < "900" for _ in ssns)
    assert all((m := next(at))[2] == "." and m[:2].isalpha() and m[0].isupper() and m[3:5].isdigit() for _ in mails)
    assert got[2000] == rows[-2][1] and got[2001].replace(" ", "") == new[0]
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, "k2").collect()}
    assert sum(other[i] == got[i] for i in range(len(values))) <= 2


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F
    df = spark.range(12 * 7 * 5).select(F.array(F.pmod("id", F.lit(12)), F.pmod((F.col("id") / 12).cast("long"), F.lit(7)),
                                                (F.col("id") / 84).cast("long")).alias("v"))
    radix = F.array(*[F.lit(x).cast("long") for x in (12, 7, 5)])
    out = [tuple(r[0]) for r in df.select(pii.feistel(F.col("v"), radix, F.lit("d"), "k")).collect()]
    assert len(set(out)) == 420 and all(a < 12 and b < 7 and c < 5 for a, b, c in out)


def test_licenses(spark):
    mit = ("MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and\n"
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, including\n"
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies\n"
           "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following\n"
           "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or\n"
           "substantial portions of the Software.")
    apache = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file"
    rows = [(1, "Text.\nLicensed under CC BY-NC 4.0.\nMore text"), (2, mit), (3, "x\nReleased under the MIT License."),
            (4, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY 4.0."),
            (5, "the license of a driver was not released under any law"), (6, "Licensed under the Apache License, Version 2.0.")]
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "CC-BY-NC-4.0", 2: "MIT", 3: "MIT", 4: "GPL-3,CC-BY-4.0", 5: "", 6: "Apache-2.0"}
    known = Recogniser()
    assert known.licences(["BSDgrant", "BSDsource", "BSDbinary", "BSDasis"]) == (["BSD-2-Clause"], 0)
    assert known.licences(["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"]) == (["BSD-3-Clause"], 0)
    assert known.licences(["BSDbinary", "GPLref-2"]) == (["GPL-2"], 1)
    assert apache  # a header with a parenthesis is two sentences
    for line in duckdb.sql(f"SELECT DISTINCT x FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM "
                           f"'{SF}/documents.parquet') WHERE x LIKE 'Licensed under%' OR x LIKE 'Released under%'").fetchall():
        assert known.licences(known.sentences(line[0]))[0]


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        a, b = queries.QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        cols = sorted(a.columns)
        key = [c for c in ("doc_id", "page_id", "vec_id", "conv_id") if c in cols]
        a, b = (x[cols].sort_values(key).reset_index(drop=True) for x in (a, b))
        pd.testing.assert_frame_equal(a, b, check_dtype=False)
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}


def test_pipeline_against_brute_force(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        kept[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(kept[name], docs.schema)
    text = dict(zip(documents.doc_id, documents.text, strict=True))
    said = {d for d, t in text.items() if t and any(c.isalpha() for c in t)}
    assert set(kept["language"].doc_id) == said
    fold = {}
    for d in sorted(said):
        fold["".join(c.lower() if "A" <= c <= "Z" else c for c in text[d])] = d
    assert sorted(kept["exact_dedup"].doc_id) == sorted(fold.values())
    prints = {d: slow_fingerprint(text[d]) for d in fold.values()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = roots(prints, links)
    assert sorted(kept["simhash"].doc_id) == sorted(set(want.values()))
    mixed = kept["mixing"].doc_id.value_counts()
    assert mixed.max() <= 3 and set(mixed.index) <= set(want.values())
    packed = kept["packing"]
    assert (packed[packed.start == 0].doc_id.value_counts().sort_index() == mixed.sort_index()).all()


def test_parts_of_any_text_against_the_tokenizer():
    import random

    from tokenizers import Tokenizer
    path = queries.tokenizer_file("word_bpe_49k.json")
    whole, mine = Tokenizer.from_file(path), packing.WordTokens(path)
    draw = random.Random(4)
    letters = "aBzéÄßſŽ0²9'.,<|>\t\n \x0b\x0c\x1c\x85\xa0  İΣς“—日ﬁ́­ªº¼µstreVEll"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 60))) for _ in range(400)]
    texts += ["they're we'll I'D 'S don''t <|endoftext|>x", "", " "]
    begin, ids = mine.ids(texts, {})
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [
        e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_url_verdicts_on_a_link_graph_match_their_sql(spark, tmp_path):
    """A made graph of 60 hosts with a chain of 30 links to a blocked host: the SQL walks the same graph."""
    import random
    draw = random.Random(8)
    hosts = [f"h{i}.com" for i in range(28)] + [f"c{i}.com" for i in range(30)] + ["s.net", "t.org"]
    out = {h: draw.sample(hosts[:28] + hosts[-2:], draw.randrange(0, 4)) for h in hosts[:28]}
    out |= {f"c{i}.com": [f"c{i + 1}.com" if i < 29 else "s.net"] for i in range(30)}
    out |= {"s.net": ["h1.com"], "t.org": ["h2.com", "h3.com"]}
    rows = [(i, f"http://{h}/x", "".join(f'<a href="http://{x}/">l</a>' for x in out[h])) for i, h in enumerate(hosts * 2)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(queries.URL_SQL).fetchall()}
    got = {r["page_id"]: tuple(r)[1:] for r in queries.QUERIES["op2_url_graph"](spark, str(tmp_path)).collect()}
    assert got == want
    verdicts = {r[1]: r[4] for r in con.sql(queries.URL_SQL).fetchall()}
    assert verdicts["c0.com"] == "block" and set(verdicts.values()) == {"allow", "block"}
