"""Main text of web pages by site style trees."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.session import materialize

#: Nodes whose text has an importance below this are removed.
MIN_IMPORTANCE = 0.2

# HTML element kinds.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
          "tbody": {"thead", "tr", "td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "nav", "aside", "header", "footer",
          "main", "blockquote", "td", "th", "form", "select"}
# Elements, ARIA roles and class or id words by which markup declares a part that is no article.
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "select", "head", *RAW}
# Elements and states whose declaration holds for all that is in them; that of others can end.
STRONG_TAGS = {"nav", "footer", "aside", "menu", "dialog", "button", "select", "head", *RAW}
# Words that inside an article name a subject as well: only links in such an element are no article text.
SUBJECT_WORDS = {"discussion", "related", "social", "promotion", "search", "share", "sharing", "legal", "notice", "header"}
#: Characters from which the upper part of a style path is told by its digest.
PATH_CHARS = 512
#: Share of a page's text from which a declared element is a wrapper of the page, not a part of it.
WRAPPER = 0.8
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog",
                   "alert", "menu", "menubar", "toolbar"}
FURNITURE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor",
                   "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
                   "sidebar", "aside", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice",
                   "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment",
                   "comments", "reply", "replies", "disqus", "discussion", "share", "sharing", "social", "related",
                   "recommended", "recommendations", "pagination", "pager", "toolbar", "widget", "search", "copyright",
                   "legal", "skip"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|$)",
                    re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORD = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")
_ABOUT = re.compile(r"(?<![a-z])(?:has|have|no|with|without|hide|show)[-_ ]+[a-z]+")
_ARTICLE = re.compile(">(?:article|main)(?:[.>]|$)")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))


def _named(attrs: dict[str, str]) -> set[str]:
    """Words of class and id; ``has-sidebar`` and the like describe other elements."""
    words = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", attrs.get("class", "") + " " + attrs.get("id", "")).lower()
    return set(_WORD.findall(_ABOUT.sub(" ", words))) & FURNITURE_WORDS


def declared_furniture(tag: str, attrs: dict[str, str], inside_article: bool) -> str:
    """How the markup itself declares the element to be no article text: ``"strong"``
    for it and all in it, ``"weak"`` for a declaration that can end, ``"links"`` for
    links only, else empty. A header inside an article is the article's own heading."""
    if tag in STRONG_TAGS:
        return "strong"
    if tag in FURNITURE_TAGS and not (tag == "header" and inside_article):
        return "weak"
    if _hidden(attrs):
        return "" if tag in ("body", "html", "main", "article") else "strong"
    if tag in ("body", "html", "main", "article"):
        return ""
    if attrs.get("role", "").lower() in FURNITURE_ROLES:
        return "weak"
    named = _named(attrs)
    if inside_article and named <= {"header", "notice", "legal"}:
        return ""
    return "links" if inside_article and named and named <= SUBJECT_WORDS else "weak" if named else ""


def _judged(found: list[tuple[str, tuple, int | None, str]]) -> list[tuple[str, bool, str]]:
    """Blocks with whether a declaration holds for them. Of a block are known its
    declarations from the outside in, as (number, strong), and how many of them
    lie outside its article or main part.

    Weak declarations around an article end at it if the page has no article
    outside declarations and less other undeclared text; a weak declaration
    around nearly the whole page ends unless an article lies outside.
    """
    size = sum(len(text) for *_, text in found)
    free = sum(len(text) for _, chain, _, text in found if not chain)
    has_article = any(outer == 0 for _, _, outer, _ in found)
    if not has_article:
        inner = [bool(outer) and not any(strong for _, strong in chain[:outer]) for _, chain, outer, _ in found]
        if sum(len(x[3]) for x, y in zip(found, inner, strict=True) if y) > free:
            found = [(path, chain[outer:], 0, text) if y else (path, chain, outer, text)
                     for (path, chain, outer, text), y in zip(found, inner, strict=True)]
            has_article = True
    while not has_article:
        share: dict[tuple[int, bool], int] = {}
        for _, chain, _, text in found:
            if chain and not chain[0][1]:
                share[chain[0]] = share.get(chain[0], 0) + len(text)
        wrapper = next((k for k, n in share.items() if n >= WRAPPER * size), None)
        if wrapper is None:
            break
        found = [(path, chain[1:] if chain[:1] == (wrapper,) else chain, outer, text) for path, chain, outer, text in found]
    return [(path, bool(chain), text) for path, chain, _, text in found]


def blocks(page: str) -> list[tuple[str, bool, str]]:
    """Text blocks of a page in order: (style path, lies in declared furniture, text).

    The style path names the elements from the root with their classes, which
    is what pages of one site share (of a very deep element the upper part is
    told by its digest, so paths stay short). Unclosed and stray tags are closed as
    browsers do in the common cases; character references are decoded; white
    space inside a block becomes one space.
    """
    out: list[tuple[str, tuple, int | None, str]] = []
    # tag, path, declarations, how many of them lie outside the article, whether only its links are furniture
    stack: list[tuple[str, str, tuple, int | None, bool]] = [("", "", (), None, False)]
    text: list[str] = []
    open_: dict[str, int] = {}  # elements of the stack by tag
    block = [0]  # place in the stack of the innermost element that is not inline, for every element
    declared = plain = 0

    def flush() -> None:
        nonlocal plain
        if text:
            joined = _BLANK.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if joined:
                _, path, chain, outer, links = stack[block[-1]]
                chain = max(chain, stack[-1][2], key=len)
                if links and not plain and not chain:
                    chain = ((0, True),)
                out.append((path, chain, outer, joined))
            plain = 0

    def add(chunk: str) -> None:
        nonlocal plain
        text.append(chunk)
        plain += bool(chunk.strip()) and not open_.get("a")

    def push(element: tuple[str, str, tuple, int | None, bool]) -> None:
        open_[element[0]] = open_.get(element[0], 0) + 1
        block.append(block[-1] if element[0] in INLINE else len(stack))
        stack.append(element)

    def pop() -> None:
        open_[stack.pop()[0]] -= 1
        block.pop()

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1 if open_.get(tag) else 0, 0, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE or block[-1] < i:
                        if stack[i][2] != stack[i - 1][2]:
                            flush()
                        while len(stack) > i:
                            pop()
                    else:  # an inline element that blocks were opened in: it ends, they go on
                        rest = stack[i + 1:]
                        while len(stack) > i:
                            pop()
                        for element in rest:
                            push(element)
                    break
                if stack[i][0] in ("article", "body") and tag in ("p", "li", "b", "i", "span"):
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag in ("hr",):
                flush()
            continue
        if tag not in INLINE:
            flush()
        shut = CLOSES.get(tag, {"p"} if tag not in INLINE and tag not in RAW else set())
        for i in range(len(stack) - 1 if any(open_.get(x) for x in shut) else 0, 0, -1):
            if stack[i][0] in shut:
                while len(stack) > i:
                    pop()
            elif stack[i][0] in SCOPES and not (tag in ("tr", "td", "th", "tbody") and stack[i][0] in ("td", "th")):
                break
        attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])} if m[3] else {}
        parent = stack[-1]
        kind = declared_furniture(tag, attrs, open_.get("article", 0) > 0)
        chain, outer = parent[2], parent[3]
        if kind in ("strong", "weak"):
            declared += 1
            chain += ((declared, kind == "strong"),)
        starts = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
        if starts and outer is None and not _hidden(attrs) and (tag == "main" or not _named(attrs)):
            outer = len(chain)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if chain != parent[2]:
            flush()
        style = tag if tag in INLINE else f"{parent[1]}>{tag}" + "".join(
            "." + c for c in sorted(attrs.get("class", "").lower().replace(">", "_").split()))
        if (m[3] or "").rstrip().endswith("/") and tag in INLINE:
            continue
        if len(style) > PATH_CHARS and tag not in INLINE:
            style = f">{_digest(style):x}" + (">article" if _ARTICLE.search(style) else "")
        push((tag, parent[1] if tag in INLINE else style, chain, outer, parent[4] or kind == "links"))
    flush()
    return _judged(out)


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little",
                          signed=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page as rows of its style tree: (host, style node, feature, times,
    body). The feature of a block is a digest of its text; the children an
    element is made of in this page give the presentation feature of the
    element. Blocks that the markup declares to be furniture have no content
    feature: they go anyway, and must not weigh on others of the same style. The
    body is a digest of all other blocks of the page's article, without one of
    all others on the page, by which copies of a page are known; one row of kind ``page`` stands for the page itself."""
    for batch in batches:
        cols: list[list] = [[], [], [], [], [], []]
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            seen: dict[tuple[str, str, int], int] = {}
            children: dict[str, set[str]] = {}
            texts: dict[bool, list[str]] = {True: [], False: []}
            for path, furniture, text in blocks(page or ""):
                if not furniture:
                    key = (path, "content", _digest(text))
                    seen[key] = seen.get(key, 0) + 1
                    texts[bool(_ARTICLE.search(path))].append(text)
                while path:
                    path, _, child = path.rpartition(">")
                    children.setdefault(path, set()).add(child)
            for path, kids in children.items():
                seen[path, "style", _digest("|".join(sorted(kids)))] = 1
            if children:
                seen["", "page", 0] = 1
            body = _digest("\n".join(texts[True] or texts[False]))
            for (path, kind, feature), n in seen.items():
                for c, x in zip(cols, (host, path, kind, feature, n, body), strict=True):
                    c.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()),
             *[pa.array(c, pa.int64()) for c in cols[3:]]], ["host", "path", "kind", "feature", "n", "body"])


def style_tree(pages: DataFrame) -> DataFrame:
    """Site style trees: for every host and style node its importance.

    ``pages``: ``host, html``. All pages of a host are merged by style path;
    pages with the same undeclared texts in the article (without one: in the
    page) are copies and count as one page.
    Content importance of a node is one minus the mean entropy of its features,
    where a feature seen n_p times in page p has the entropy of n_p / sum n_p to
    the base of the host's number of pages: text that every page repeats has
    entropy 1, text of one page 0. Declared furniture does not count. Node
    presentation importance is the entropy of the child sequences that the
    element has over the pages that hold it (one page: 1). The composite
    importance of a node is its content importance if it holds text of its own,
    else its presentation importance. Returns ``host, path, content,
    presentation, pages, importance``. Features are counted per page before the
    shuffle, copies fall together by (host, node, feature, body) and the rest is
    summed by (host, node, feature), so a host with a third of all pages is
    spread by its features and a repeated feature by its pages.
    """
    seen = pages.select("host", "html").mapInArrow(
        _features, "host string, path string, kind string, feature long, n long, body long")
    seen = seen.groupBy("host", "path", "kind", "feature", "body").agg(F.max("n").alias("n"))
    # entropy of n_p / s over pages: log2 s - sum(n_p log2 n_p) / s
    per = seen.groupBy("host", "path", "kind", "feature").agg(
        F.sum("n").cast("double").alias("s"), F.sum(F.col("n") * F.log2("n")).alias("nl"), F.count("*").alias("pages"))
    sums = materialize(per.groupBy("host", "path", "kind").agg(
        F.count("*").alias("features"), F.sum(F.log2("s") - F.col("nl") / F.col("s")).alias("bits"),
        F.sum("s").alias("all"), F.sum("pages").alias("pages"),
        F.sum(F.col("pages") * F.log2("pages")).alias("plp")), "style-nodes")
    sites = sums.filter("kind = 'page'").select(F.col("host").alias("site"), F.col("pages").alias("m"))
    base = F.when(F.col("m") > 1, F.log2("m"))
    node = sums.filter("kind <> 'page'").join(sites, F.col("host") == F.col("site")).drop("site")
    style = F.col("kind") == "style"
    text = F.col("kind") == "content"
    # on a site of one page features add no entropy
    spread = F.sum(F.when(text, F.coalesce(F.col("bits") / base, F.lit(0.0))))
    count = F.sum(F.when(text, F.col("features")))
    variety = F.max(F.when(style, F.when(F.col("pages") > 1, (F.log2("pages") - F.col("plp") / F.col("pages")) / base)
                           .otherwise(1.0)))
    out = node.groupBy("host", "path").agg((1 - spread / count).alias("content"), variety.alias("presentation"),
                                           F.max("m").alias("pages"))
    return out.withColumn("importance", F.coalesce("content", "presentation", F.lit(1.0)))


def host_of(url: Column) -> Column:
    """Lower-cased host between ``://`` and the next ``/ ? #``; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^.*?://([^/?#]*)", 1)), F.lit(""))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = []
        for page, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True):
            text.append(" ".join(_left([(path, t) for path, furniture, t in blocks(page or "") if not furniture],
                                       set(low or ()))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()),
             pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _left(found: list[tuple[str, str]], drop: set[str]) -> list[str]:
    """Texts outside the removed nodes, and all of the article if the larger part
    of it would go: it is then told again by other pages, not full of notices."""
    article = [(path, len(t)) for path, t in found if _ARTICLE.search(path)]
    whole = 2 * sum(n for path, n in article if path in drop) > sum(n for _, n in article)
    return [t for path, t in found if path not in drop or (whole and _ARTICLE.search(path))]


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_col: str = "html",
                      min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """Main text of every page: blocks left after low-importance nodes go.

    The pages of a host form a style tree (``style_tree``); text in nodes of an
    importance below ``min_importance`` and declared furniture are removed from
    each page, and the text blocks left are joined by one space in page order.
    Importance is judged per style node, never per passage, inside articles as
    elsewhere. Copies of a page count once, so a page that a site repeats keeps
    its text, and an article keeps all of it if the larger part would go.

    Returns ``page_id, url, text, n_chars`` (code points), one row per input
    row; null or empty html gives an empty text. Pages without a host form one
    site. Repeated pages give equal results. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), host_of(F.col(url)).alias("host"))
    low = style_tree(rows).filter((F.col("content") < min_importance) & (F.col("path") != ""))
    # one row per host with its removed nodes; its size on disk decides whether Spark broadcasts it
    low = materialize(low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low"))
                      .withColumnRenamed("host", "site"), "low-branches")
    told = rows.join(low, rows["host"] == low["site"], "left").select("page_id", "url", "html", "low")
    kind = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return told.mapInArrow(_extract, kind)
