"""One registered query per operator, applied with production parameters to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.byte_bpe import encode
from vitalgrid.llm.conversations import repair_damaged
from vitalgrid.llm.embedding_dedup import embedding_groups
from vitalgrid.llm.exact_dedup import content_sort
from vitalgrid.llm.html_extract import extract_main_text
from vitalgrid.llm.language import identify
from vitalgrid.llm.licenses import scan_licenses
from vitalgrid.llm.mixing import mix
from vitalgrid.llm.packing import pack
from vitalgrid.llm.pii import pseudonymise
from vitalgrid.llm.simhash import simhash_groups
from vitalgrid.llm.url_graph import DAMPING, LINK, MAX_DISTRUST, TOLERANCE, judge_urls
from vitalgrid.llm.vector_codes import compress
from vitalgrid.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary, the same on every machine of the cluster."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_html_extract")
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


# Fixed values: (verdict, host, path) of the url rules.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/")]


#: Rounds of the power iteration in SQL: as far as the query goes and further.
RANK_ROUNDS = 150


def _rank_sql(name: str, arcs: str, seeds: str) -> str:
    """Power iteration as a recursive CTE ``name`` (k, host, score)."""
    return f"""{name}_b AS MATERIALIZED (SELECT host, {1 - DAMPING} / count(*) OVER () AS base FROM ({seeds})),
{name}(k, host, score) AS (
  SELECT 0, host, base FROM {name}_b
  UNION ALL
  SELECT k, host, sum(part) FROM (
    SELECT k + 1 AS k, dst AS host, w * score AS part FROM {name} JOIN {arcs} ON src = host
    UNION ALL SELECT k + 1, b.host, base FROM {name}_b b, (SELECT DISTINCT k FROM {name}))
  WHERE k <= {RANK_ROUNDS} GROUP BY k, host)"""


_LINK_SQL = LINK.replace("'", "''")
URL_SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                                     '{_UPPER}', '{_LOWER}') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, html FROM pages),
e AS (SELECT host AS src, dst, count(*) AS n FROM (
        SELECT DISTINCT page_id, host, translate(unnest(regexp_extract_all(html, '{_LINK_SQL}', 1)),
                                                 '{_UPPER}', '{_LOWER}') AS dst FROM u)
      WHERE host <> dst AND host <> '' GROUP BY 1, 2),
h AS (SELECT host FROM u UNION SELECT src FROM e UNION SELECT dst FROM e),
r(verdict, rule_host, rule_path) AS (VALUES {", ".join(str(x) for x in URL_RULES)}),
f AS (SELECT host, verdict, rule_path, rule_host || rule_path AS rule
      FROM h JOIN r ON host = rule_host OR ends_with(host, '.' || rule_host)),
ea AS (SELECT src, dst, {DAMPING} * n / sum(n) OVER (PARTITION BY src) AS w FROM e),
eb AS (SELECT dst AS src, src AS dst, {DAMPING} * n / sum(n) OVER (PARTITION BY dst) AS w FROM e),
{_rank_sql("t", "ea", "SELECT DISTINCT host FROM f WHERE verdict = 'allow'")},
{_rank_sql("d", "eb", "SELECT DISTINCT host FROM f WHERE verdict = 'block' AND rule_path = '/'")},
m AS (SELECT page_id, max_by((f.rule, f.verdict), (length(f.rule), f.rule)) AS fit
      FROM u JOIN f ON u.host = f.host AND starts_with(path, rule_path) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, fit[1] AS rule,
       coalesce(fit[2], CASE WHEN coalesce(d.score, 0) > {MAX_DISTRUST} * (coalesce(t.score, 0) + coalesce(d.score, 0)) + {TOLERANCE}
                             THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m USING (page_id) LEFT JOIN t ON u.host = t.host AND t.k = {RANK_ROUNDS}
LEFT JOIN d ON u.host = d.host AND d.k = {RANK_ROUNDS}"""


@query("op2_url_graph", URL_SQL)
def op2_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op3_pii_feistel")
def op3_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the key of a real run comes from the operator's secret store
    return pseudonymise(table(spark, sf_dir, "documents"), key="public-test-key")


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), width=4, max_bits=4, seed=42)


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), size=4096, end_id=1)


@query("op6_content_sort", f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""")
def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"), keep="largest")


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op8_embedding_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, p.b FROM r JOIN p ON r.seen = p.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept
FROM c LEFT JOIN l ON c.node = l.a""")
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.98)


# Sources in the order of cap / weight; the level is right at the first source whose cap is not reached.
@query("op9_mixing", """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5('42|' || doc_id), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap,
             (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(cap) OVER o, 0) AS caps_before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights
      FROM w WINDOW o AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, weight * (total - caps_before) >= cap * weights AS clamped FROM r),
l AS (SELECT max(total)::BIGINT - coalesce(sum(cap) FILTER (WHERE clamped), 0)::BIGINT AS rest,
             coalesce(sum(weight) FILTER (WHERE NOT clamped), 1)::BIGINT AS weights FROM c),
g AS (SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE
             ELSE weight::DOUBLE * rest::DOUBLE / l.weights::DOUBLE END AS target FROM c, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
o AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS goal,
             size > 0 AND sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)
                          <= e.target - e.epochs * e.source_size AS taken_first
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
n AS (SELECT source, size, count(*) AS n FROM o WHERE NOT taken_first AND size > 0 GROUP BY source, size),
z(source, rest, size, k, n) AS (
  SELECT source, max(goal) - coalesce(sum(size) FILTER (WHERE taken_first), 0), NULL::BIGINT, 0::BIGINT, 0::BIGINT FROM o GROUP BY source
  UNION ALL
  SELECT z.source, z.rest - n.size * least(n.n, floor(z.rest / n.size)::BIGINT), n.size,
         least(n.n, floor(z.rest / n.size)::BIGINT), n.n
  FROM z JOIN n ON z.source IS NOT DISTINCT FROM n.source AND n.size <= z.rest AND (z.size IS NULL OR n.size < z.size)
  QUALIFY row_number() OVER (PARTITION BY z.source ORDER BY n.size DESC) = 1),
y AS (SELECT source, min(rest) AS rest FROM z GROUP BY source),
x AS (SELECT n.source, min(n.size) AS size FROM n LEFT JOIN z ON n.source IS NOT DISTINCT FROM z.source AND n.size = z.size
      WHERE coalesce(z.k, 0) < n.n GROUP BY n.source),
q AS (SELECT source, size, sum(k) AS k FROM (
        SELECT source, size, k FROM z WHERE size IS NOT NULL
        UNION ALL SELECT x.source, x.size, 1 FROM x JOIN y ON x.source IS NOT DISTINCT FROM y.source AND x.size - y.rest < y.rest)
      GROUP BY source, size),
p AS (SELECT o.*, row_number() OVER (PARTITION BY source, size, taken_first ORDER BY h, doc_id) AS place FROM o)
SELECT doc_id, p.size, source_size, target, (p.size * (epochs + CASE WHEN p.size > 0 AND (taken_first OR place <= q.k)
                                                                     THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p LEFT JOIN q ON p.source IS NOT DISTINCT FROM q.source AND p.size = q.size""")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), max_epochs=3, period=3, seed=42).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


# crc32 by its table (made from the polynomial); the repair by states: written so far nothing (S), s (T), ..ua (C), ..u (O).
@query("op11_conversation_repair", r"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT b, b, 0 FROM (SELECT unnest(range(256))::BIGINT AS b)
  UNION ALL SELECT b, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                            lambda x: ascii(x)::BIGINT) AS bytes FROM conversations),
w AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
                                  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS what FROM o, crc),
d AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy FROM w WHERE what <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), sha256(text), copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
             regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM d),
f AS MATERIALIZED (SELECT *, left(role, 1) AS ini, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd'
                     WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM n),
dp(conv_id, i, state, way) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 'S', (0::BIGINT, '') FROM f
  UNION ALL
  SELECT conv_id, i, state, min(way) FROM (
    SELECT g.conv_id, f.i, e.a[1] AS state, (g.cost + e.a[2]::BIGINT, g.audit || e.a[3]) AS way
    FROM (SELECT conv_id, i, state, way[1] AS cost, way[2] AS audit FROM dp
          UNION ALL SELECT conv_id, i, CASE WHEN state = 'O' THEN 'C' ELSE 'O' END, way[1] + 2, way[2] || 'I' FROM dp) g
    JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i + 1,
    LATERAL (SELECT unnest([
      [g.state, '3', 'D'],
      CASE WHEN f.fault IN ('b', 'd') THEN NULL WHEN g.state = 'S' AND f.ini = 's' THEN ['T', (f.fault = 't')::INT::VARCHAR, 'K'] END,
      CASE WHEN f.fault IN ('b', 'd') THEN NULL
           WHEN g.state = 'O' THEN ['C', ((CASE WHEN f.ini = 'a' THEN 0 ELSE 2 END) + (f.fault = 't')::INT)::VARCHAR,
                                    CASE WHEN f.ini = 'a' THEN 'K' ELSE 'R' END]
           ELSE ['O', ((CASE WHEN f.ini = 'u' THEN 0 ELSE 2 END) + (f.fault = 't')::INT)::VARCHAR,
                 CASE WHEN f.ini = 'u' THEN 'K' ELSE 'R' END] END]) AS a) e
    WHERE e.a IS NOT NULL) GROUP BY conv_id, i, state),
best AS (SELECT dp.conv_id, min(CASE state WHEN 'O' THEN (way[1] + 2, way[2] || 'I')
                                        WHEN 'T' THEN (way[1] + 4, way[2] || 'II') ELSE way END) AS way
         FROM dp JOIN (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id) l
           ON dp.conv_id IS NOT DISTINCT FROM l.conv_id AND dp.i = l.i GROUP BY dp.conv_id),
e AS (SELECT conv_id, k, edit, sum((edit <> 'I')::INT) OVER o AS i, sum((edit <> 'D')::INT) OVER o AS place
      FROM (SELECT conv_id, unnest(string_split(way[2], '')) AS edit, unnest(range(length(way[2]))) AS k FROM best)
      WINDOW o AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
t AS (SELECT e.conv_id, e.k, e.edit, e.place, f.role, f.text,
             max((e.place = 1 AND e.edit = 'K' AND f.ini = 's')::INT) OVER (PARTITION BY e.conv_id) AS system
      FROM e LEFT JOIN f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.i = f.i AND edit <> 'I'),
r AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user'
                                      ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS lines
      FROM t WHERE edit <> 'D' GROUP BY conv_id),
j AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
             count(*) FILTER (WHERE fault = 't') AS truncated,
             count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way[1], 0) AS cost,
       coalesce(way[2], '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id""")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    told = encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                  decoded=True)
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def _codebook_sql(rounds: int) -> str:
    """k-means unrolled: entries c0 .. c<rounds>, assignments a0 .. a<rounds>."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (SELECT row, p, min((d, e)) AS near FROM (
  SELECT row, x.p, e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM x JOIN c{k} c ON x.p = c.p) GROUP BY row, p)""")
        if k < rounds:
            out.append(f"""c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, c{k}.v) AS v FROM c{k} LEFT JOIN (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
    SELECT p, near[2] AS e, j, sum(v[j])::BIGINT AS s, count(*) AS n
    FROM a{k} JOIN x USING (row, p), (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS j) GROUP BY ALL)
  GROUP BY p, e) m USING (p, e))""")
    return ",\n".join(out)


@query("op13_vector_codes", f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, embedding::DOUBLE[] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS MATERIALIZED (
  SELECT row, p, list_transform(v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)], lambda z: floor(4096 * z)::BIGINT) AS v
  FROM k, (SELECT unnest(range(8)) AS p)),
c0 AS (SELECT p, row - 1 AS e, v FROM x WHERE row <= 16),
{_codebook_sql(6)},
r AS (SELECT row, string_agg(printf('%02x', near[2]), '' ORDER BY p) AS code, sum(near[1])::BIGINT AS error
      FROM a6 GROUP BY row),
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM k JOIN r USING (row), b""")
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, books = compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    kept = materialize(kept, "vector-codes")
    sums = kept.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return kept.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
