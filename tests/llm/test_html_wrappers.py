"""Wrappers around whole pages, subject words inside articles, and pages that a site repeats."""

import pytest

from vitalgrid.llm.html_extract import blocks, extract_main_text

STORY = "<h1>Head</h1><p>One long story that only this page tells.</p><p>And its end.</p>"
TEXT = "Head One long story that only this page tells. And its end."


def kept(page):
    return " ".join(t for _, furniture, t in blocks(page) if not furniture)


@pytest.mark.parametrize("wrapper", ["form", "div class='layout has-sidebar'", "div id='search-results'", "div role='search'",
                                     "div class='widget'"])
def test_a_wrapper_does_not_decide_for_the_page(wrapper):
    end = wrapper.split()[0]
    for inner in ("<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>",
                  "<form><div class='widget'><div>{}</div></div></form>"):
        page = f"<body><{wrapper}><nav>Menu</nav>Own{inner.format(STORY)}<div class='ad'>Buy</div></{end}></body>"
        assert TEXT in kept(page) and "Menu" not in kept(page) and "Buy" not in kept(page)


def test_parts_stay_furniture():
    page = f"<body><article>{STORY}</article>"
    for part in ("<div class='related'><article>Other story</article></div>", "<aside><article>Other</article></aside>",
                 "<div class='comments'>" + "<p>long comment</p>" * 50 + "</div>", "<nav>" + "<a>x</a>" * 500 + "</nav>",
                 "<div id='comments'><article class='comment'>Nice</article></div>", "<form>Name</form>",
                 "<div hidden><article>No</article></div>"):
        assert kept(page + part) == TEXT
        assert kept("<body>" + part + page) == TEXT
    assert kept("<body><div hidden><p>gone</p></div><nav>Menu</nav>") == ""


def test_subject_words_inside_an_article():
    for word in ("discussion", "related", "social", "promotion"):
        page = f"<article><p>Begin</p><section class='{word}'><p>We found <a href=x>this</a>.</p><ul><li><a>Link</a></ul></section>"
        assert kept(page).startswith("Begin We found this")
        assert "Link" not in kept(page)


def test_wrapped_site(spark):
    page = "<body>Site<form>Find<div><p>Story {0} begins</p><p>and ends {0}</p></div><div class='ad'>Ad {0}</div></form>"
    rows = [(i, f"http://h.com/{i}", page.format(i)) for i in range(6)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Story {i} begins and ends {i}" for i in range(6)}


def extracted(spark, pages):
    rows = [(i, f"http://{host}/a?utm_source={i}", html) for i, (host, html) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_pages_that_a_site_repeats(spark):
    div = "<body><nav>Menu {1}</nav><div class='box'>We use many words</div><div class='text'><p>Story {0} begins</p><p>ends {0}</p></div>"
    one = "<body><nav>Menu {0}</nav><div class='text'><p>Story begins</p><p>and ends</p></div>"
    art = ("<body>Seen {1} times<article><p>Story {0} begins here and goes on</p><p>it ends {0}</p>"
           "<div class='box'>Write to us</div></article>")
    parts = [f"Part {k} that both copies have in common." for k in range(12)]
    near = "<article><h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in parts) + "<p>Version {0}</p></article>"
    five = "<div class='a b c d {0}'>{1}</div>"
    pages = [("two.com", one.format(i)) for i in range(2)]
    pages += [("mixed.com", div.format(min(i, 2), i)) for i in range(6)]
    pages += [("small.com", art.format(i, i)) for i in range(2)]
    pages += [("many.com", art.format(max(i - 9, 0), i)) for i in range(12)]
    pages += [("near.com", near.format(i)) for i in range(2)]
    pages += [("five.com", "<body>" + five.format("e", f"Story {i}") + five.format("f", "Notice") * 3) for i in range(4)]
    got = iter(extracted(spark, pages))
    story = "Story {0} begins here and goes on it ends {0}"
    assert [next(got) for _ in range(2)] == ["Story begins and ends"] * 2
    assert [next(got) for _ in range(6)] == [f"Story {min(i, 2)} begins ends {min(i, 2)}" for i in range(6)]
    assert [next(got) for _ in range(2)] == [f"Seen {i} times " + story.format(i) for i in range(2)]
    assert [next(got) for _ in range(12)] == [f"Seen {i} times " + story.format(max(i - 9, 0)) for i in range(12)]
    assert [next(got) for _ in range(2)] == [f"Title {' '.join(parts)} Version {i}" for i in range(2)]
    assert [next(got) for _ in range(4)] == [f"Story {i}" for i in range(4)]
