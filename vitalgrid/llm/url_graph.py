"""URL filter: rules, and trust and distrust propagated over the host link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.session import materialize

#: Share of a host's score that follows its links, change of all scores together below which propagation has settled
#: (smaller scores count as none), and rounds between two looks at it.
DAMPING = 0.85
TOLERANCE = 1e-6
STRIDE = 5
#: A host is blocked when distrust makes up more than this part of its trust and distrust.
MAX_DISTRUST = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hosts of absolute and scheme-relative link targets in a page.
LINK = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #`` or the end,
    A-Z lower-cased; path from there up to ``? #`` or the end. Both empty for a
    null url or one without ``://``."""
    host = F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between hosts: ``src, dst, n`` (pages of ``src`` that link to ``dst``; own links left out)."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1),
                                           lambda h: F.translate(h, _UPPER, _LOWER)))
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    return links.filter((F.col("src") != F.col("dst")) & (F.col("src") != "")).groupBy("src", "dst").agg(
        F.count("*").alias("n"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING,
                          tolerance: float = TOLERANCE, stride: int = STRIDE) -> DataFrame:
    """Personalised PageRank ``host, score`` from the seeds (``host``, alike
    weighted, summing to 1) over weighted ``src, dst, n`` edges, by power
    iteration: score = (1 - damping) * seed + damping * what the hosts linking
    here pass on by weight. What a host without links holds is lost. Goes on
    until ``stride`` rounds change the sum of all scores by less than ``tolerance``
    (a change shrinks by ``damping`` a round, so that comes). A round is a join and
    a partially aggregated sum over hosts; every ``stride`` rounds are written to
    the shared folder.
    """
    whole = seeds.agg(F.count("*")).first()[0]
    base = seeds.select("host", F.lit((1 - damping) / max(1, whole)).alias("base"))
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    arcs = materialize(edges.join(out, "src").select("src", "dst", (F.lit(damping) * F.col("n") / F.col("all")).alias("w")),
                       "rank-arcs")
    score = materialize(base.select("host", F.col("base").alias("score")), "rank-score")
    if whole == 0 or arcs.isEmpty():
        return score
    while True:
        new = score
        for _ in range(stride):
            passed = arcs.join(new, arcs["src"] == new["host"]).select(
                F.col("dst").alias("host"), (F.col("w") * F.col("score")).alias("part"))
            new = passed.unionByName(base.select("host", F.col("base").alias("part"))).groupBy("host").agg(
                F.sum("part").alias("score"))
        new = materialize(new, "rank-score")
        # from the seeds alone scores only grow, so the change is the difference of the sums
        change = new.agg(F.sum("score")).first()[0] - score.agg(F.sum("score")).first()[0]
        score = new
        if change < tolerance:
            return score


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url",
               html: str = "html", damping: float = DAMPING, tolerance: float = TOLERANCE,
               max_distrust: float = MAX_DISTRUST) -> DataFrame:
    """Verdict on every page's url: the longest rule that fits, else its host's standing in the link graph.

    ``rules`` are (verdict, host, path). A rule fits its host and all
    subdomains, for urls whose path starts with the rule's; the longest wins
    (of equally long ones the first by name). Hosts that an allow rule fits are
    trusted seeds, hosts that a block rule for the whole host (path ``/``) fits
    are blocked seeds. Trust is personalised PageRank from the trusted seeds
    over the links between hosts; distrust is the same from the blocked seeds
    over the reversed links. A page that no rule fits is blocked if distrust is
    more than ``max_distrust`` of its host's trust and distrust together (by more
    than ``tolerance``, to which scores are exact).

    Returns ``page_id, host, path, rule, verdict, trust, distrust``, one row per
    input row. A null url and one without ``://`` have an empty host and path
    and are allowed unless a rule fits; null html has no links. An empty table
    gives an empty result; other columns are ignored. All steps are DataFrame
    operations: rules are matched once per host, and pages meet the host table
    by a join that adaptive execution splits for a host with many pages.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url).cast("string"))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"),
                        F.col(html).cast("string").alias("html"))
    edges = materialize(host_edges(rows.select("host", "html")), "host-edges")
    rows = rows.drop("html")
    hosts = materialize(rows.select("host").unionByName(edges.select(F.col("src").alias("host")))
                        .unionByName(edges.select(F.col("dst").alias("host"))).distinct(), "hosts")
    book = spark.range(1).select(F.inline(F.array(*[F.struct(
        F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules])))
    parts = F.split("host", "\\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)),
                         lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = hosts.select("host", F.explode(suffix).alias("rule_host")).join(book, "rule_host").select(
        "host", "verdict", "rule_path", F.concat("rule_host", "rule_path").alias("rule"))
    fits = materialize(fits, "host-rules")
    trusted = fits.filter("verdict = 'allow'").select("host").distinct()
    blocked = fits.filter("verdict = 'block' and rule_path = '/'").select("host").distinct()
    trust = personalised_pagerank(edges, trusted, damping, tolerance).withColumnRenamed("score", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_pagerank(back, blocked, damping, tolerance).withColumnRenamed("score", "distrust")
    # longest first: array_sort puts the smallest (-length, rule) in front
    listed = fits.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(
        (-F.length("rule")).alias("order"), "rule", "rule_path", "verdict"))).alias("rules"))
    standing = hosts.join(listed, "host", "left").join(trust, "host", "left").join(distrust, "host", "left")
    zero = F.lit(0.0)
    standing = materialize(standing.select(F.col("host").alias("site"), "rules", F.coalesce("trust", zero).alias("trust"),
                                           F.coalesce("distrust", zero).alias("distrust")), "host-standing")
    told = rows.join(standing, rows["host"] == standing["site"], "left")
    bad = F.col("distrust") > F.lit(max_distrust) * (F.col("trust") + F.col("distrust")) + F.lit(tolerance)
    # the first of a host's rules whose path the page's path starts with, or null
    told = told.withColumn("fit", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0)))
    return told.select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                       F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
                       "trust", "distrust")
