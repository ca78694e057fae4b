"""Broken, deep and very long markup: the same blocks as before, in linear time and memory."""

import random
import time
import tracemalloc

import pyarrow.parquet as pq

from vitalgrid.llm.html_extract import blocks


def seconds(page):
    start = time.process_time()
    blocks(page)
    return time.process_time() - start


def test_hard_markup_takes_linear_time():
    for unit in ("<div>", '<a t="x>y ', "<a>x ", "<b></i>", "</b>x", "<p><a>x", "<li><b>x", "<a '", "<ul><li>x", "<span><div>x"):
        small, large = unit * 4000, unit * 32_000
        assert seconds(large) < 16 * max(seconds(small), 0.05), unit


def test_deep_markup_takes_little_memory():
    tracemalloc.start()
    got = blocks("<div>" * 200_000 + "deep <article><p>text</p></article>")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [t for _, _, t in got] == ["deep", "text"] and peak < 400e6
    assert got[1][0].endswith(">article>p") and len(got[0][0]) < 600


def test_deep_equal_branches_share_a_path():
    page = "<div class='box'>" * 300 + "a</div><div class='box'>b"
    one, two = (path for path, _, _ in blocks(page))
    assert one == two


def test_an_open_quote_gives_up_its_tag_only():
    assert [t for _, _, t in blocks("<p>one<a href=\"x>two</a></p><p>three")] == ["onetwo", "three"]
    assert [t for _, _, t in blocks("<p title='it>a</p><p>b</p>")] == ["a", "b"]


def test_a_megabyte_of_a_page_in_seconds():
    html = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    draw = random.Random(1)
    page = "".join(draw.choice(html) for _ in range(400))
    assert seconds(page) < 20 * len(page) / 1e6
