"""Main text: planted pages, malformed markup, edge cases."""

import html
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from rasterspark.llm import htmltext
from rasterspark.llm.queries import queries

LONG = "A sentence with some words in it, and then some more of them. " * 3


def test_registered_query_on_all_pages(spark):
    table = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    rows = {r.page_id: r for r in queries()["op3_html_text"](spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == len(table)
    for page in table:
        inner = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        got = rows[page["page_id"]]
        assert got.text == "\n\n".join(b for b in blocks if b)
        assert got.n_chars == len(got.text) and got.url == page["url"]


def page(body):
    return f"<!doctype html><html><head><title>T</title></head><body>{body}</body></html>"


BOILERPLATE = [
    '<nav><ul><li><a href="/a">Home</a></ul></nav>', "<header><h1>Site name</h1></header>", f"<footer><p>{LONG}</p></footer>", f"<aside>{LONG * 3}</aside>",
    f'<div class="sidebar-left"><p>{LONG * 3}</p></div>', f'<div id="cookieNotice">{LONG}</div>', f'<section class="comments"><article class="comment"><p>{LONG * 5}</p></article></section>',
    f'<form action="x"><label>{LONG}</label></form>', f"<script>var a = '<p>{LONG}</p>';</script>", f"<style>p {{ {LONG} }}</style>", f'<div style="display: none">{LONG}</div>',
    f'<div class="ad">{LONG}</div>', f'<div role="banner">{LONG}</div>', f"<!-- <p>{LONG}</p> -->", f"<noscript><p>{LONG}</p></noscript>",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div role="main">{}</div>', "{}"])
def test_boilerplate_goes_and_short_paragraphs_stay(wrap):
    text = f"<h2>Head &amp; line</h2><p>{LONG}<p>Short.</p><p>{LONG}&lt;end&gt;</p>"
    want = "\n\n".join(["Head & line", LONG.strip(), "Short.", f"{LONG}<end>"])
    for k in range(len(BOILERPLATE)):
        above, below = BOILERPLATE[:k], BOILERPLATE[k:]
        assert htmltext.extract(page("".join(above) + wrap.format(text) + "".join(below))) == want


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("   \n", ""), ("<html></html>", ""), ("just text", "just text"), ("a &lt; b&nbsp;&nbsp;c &eacute; &#233; &bogus; &am", "a < b c é é &bogus; &am"),
        ("<p>one<br>two\n three</p>", "one two three"), ("<p>un<b>clo</b>sed <i>mark", "unclosed mark"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ('<p title="a > b">x</p>', "x"),
        ("<p title='oops>x</p>", "x"), ("<p>cut <a hre", "cut"), ("<script>never closed", ""), ("<!-- never closed", ""), ("<p>a<p>b", "a\n\nb"),
        ("<article><p>in</p></article><p>" + LONG, "in"), ("<article>a<article>b</article>c</article>", "a\n\nb\n\nc"),
        ("<nav>menu</nav>", ""), ("<P>UPPER</P>", "UPPER"),
    ],
)
def test_edge_cases(source, text):
    assert htmltext.extract(source) == text


@pytest.mark.parametrize(
    "region",
    ['<h2 id="search-algorithms">{}</h2>', '<h2 id="social-effects">{}</h2>', '<section id="discussion"><p>{}</p></section>', '<p class="notice">{}</p>', '<p>a <span class="alert">{}</span></p>'],
)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<div class="layout no-sidebar">{}</div>', '<div class="has-cookie-banner">{}</div>', '<div class="sidebar"><main>{}</main></div>', '<div id="overlay-page" class="widget">{}</div>'])
def test_ordinary_words_and_wrappers_drop_no_text(region, wrap):
    text = f"<p>{LONG}</p>{region.format('Kept words.')}<p>{LONG}</p>"
    got = htmltext.extract(page('<div class="cookie-bar">Cookies!</div>' + wrap.format(text) + f'<div class="sidebar">{LONG}</div>'))
    assert got.count(LONG.strip()) == 2 and "Kept words." in got and "Cookies" not in got


@pytest.mark.parametrize("gap", ['<div class="ad">x</div>' * 3, '<ul><li><a href="/a">One</a><li><a href="/b">Two</a><li><a href="/c">Three</a><li><a href="/d">Four</a></ul>', '<div class="ad">x</div>' * 5 + "<h2>Next</h2>"])
def test_text_on_both_sides_of_a_gap_stays(gap):
    parts = [f"Part {k}. {LONG}".strip() for k in range(4)]
    body = f"<div><p>{parts[0]}</p>{gap}<p>{parts[1]}</p><p>{parts[2]}</p>{gap}<p>{parts[3]}</p></div>"
    got = htmltext.extract(page(body)).split("\n\n")
    assert [x for x in got if x.startswith("Part")] == parts and "x" not in got
    assert got.count("Next") == 2 * ("Next" in gap)


def test_core_is_the_heaviest_run_between_surge_and_dive():
    lengths = np.array([90, 0, 0, 0, 0, 200, 5, 300, 0, 0, 0, 0, 100], float)
    a, b = htmltext.core(lengths)
    assert a <= 5 and b >= 8 and lengths[a:b].sum() == 505
    assert htmltext.core(np.zeros(4)) == (0, 0) and htmltext.core(np.zeros(0)) == (0, 0)
    assert htmltext.core(np.array([3.0]))[1] == 1


def test_long_and_deep_pages_end():
    assert len(htmltext.extract("<article>" + "<p>word word</p>" * 20_000)) == 20_000 * 11 - 2
    assert htmltext.extract("<div>" * 3000 + LONG) == LONG.strip()


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "t", 5), (None, None, None, None, None), (1, "u", "<p>x", "t", 5)], "page_id long, url string, html string, text string, n_chars long")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in htmltext.extract_pages(df).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]
    assert htmltext.extract_pages(df.limit(0)).collect() == []


WRAPPERS = ['<form id="aspnetForm">{}</form>', '<div id="page" class="no-sidebar">{}</div>', '<div class="wrapper has-sidebar">{}</div>', '<div class="search-page">{}</div>', '<div class="comments-enabled">{}</div>', '<div class="banner-layout">{}</div>', '<fieldset><form><div class="ad-free">{}</div></form></fieldset>']


@pytest.mark.parametrize("wrap", [*WRAPPERS, "{}"])
@pytest.mark.parametrize("body", ["<article>{}</article>", '<article class="post comments-open social">{}</article>', "<div>{}</div>"])
def test_wrapping_forms_and_classes_keep_the_article(wrap, body):
    text = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    got = htmltext.extract(page("<nav><a href='/'>Home</a></nav>" + wrap.format(body.format(text) + f'<div class="comments"><p>{LONG * 9}</p></div>') + f"<footer>{LONG}</footer>"))
    assert got.split("\n\n") == ["Title", LONG.strip(), "Short.", LONG.strip()]


def test_small_forms_and_notices_outside_the_core_go():
    form = f'<form action="/subscribe"><p>{LONG}</p></form>'
    for body in ("<article>{}</article>", "<div>{}</div>"):
        got = htmltext.extract(page(form + body.format(f"<p>{LONG * 2}</p>{form}<p>{LONG * 2}</p>") + f'<div class="cookie-consent">{LONG}</div>'))
        assert got.split("\n\n") == [(LONG * 2).strip()] * 2


@pytest.mark.parametrize(
    "body",
    [
        f"<div>Welcome here</div><p><a href='/1'>one</a></p><p><a href='/2'>two</a></p><p><a href='/3'>three</a></p><p>{LONG}</p>",
        f"<article><p>First. {LONG}</p></article><article><p>Second. {LONG}</p><p>{LONG}</p></article>",
        f"<article>teaser a</article><article>teaser b</article><nav>x</nav><nav>y</nav><nav>z</nav><p>{LONG}</p><p>{LONG}</p>",
    ],
)
def test_windows_decide(monkeypatch, body):
    got = htmltext.extract(page(body))
    assert LONG.strip() in got and "Welcome" not in got and "First" not in got and "teaser" not in got
    monkeypatch.setattr(htmltext, "runs", lambda lengths, *_: [(0, len(lengths))] if len(lengths) else [])
    monkeypatch.setattr(htmltext, "core", lambda lengths, *_: (0, len(lengths)))
    monkeypatch.setattr(htmltext, "WINDOW", 10**6)
    monkeypatch.setattr(htmltext, "_article", lambda found, lengths: min((x.article for x in found if x.article), default=0))
    assert htmltext.extract(page(body)) != got


@pytest.mark.parametrize("kind", ["<div>", "<b>", "<p><b>", "<div class='ad'>", "<ul><li>", "<table><tr><td>", "<form>", "</div>", "<article>", "<a href='x'>", "<p title='", "<div class=sidebar><p>x"])
def test_reading_is_linear_in_the_page(kind):
    import time

    began = time.perf_counter()
    htmltext.extract(kind * 100_000 + f"<p>{LONG}</p>" + "<p>a</p></span></i>" * 20_000)
    assert time.perf_counter() - began < 15


def test_hot_regions_and_long_texts_are_whole():
    text = "x" * 3_000_000
    assert htmltext.extract(f"<form><p>{text}</p></form>") == text
    assert htmltext.extract("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>").count(LONG.strip()) == 5000


@pytest.mark.parametrize("mark", ['class="site-footer"', 'id="right-sidebar"', 'class="mainNav"', 'class="post-comments"', 'class="page__cookies"', 'class="top_menu navbar"'])
def test_regions_named_by_their_last_word_go(mark):
    got = htmltext.extract(page(f"<div><p>{LONG}</p><p>{LONG}</p></div><div {mark}><p>{LONG}</p></div>"))
    assert got.split("\n\n") == [LONG.strip()] * 2


@pytest.mark.parametrize("mark", ['<section id="search-engine-advertising">{}</section>', '<div class="without-ads">{}</div>', '<section id="how-to-subscribe"><h2>How</h2>{}</section>', '<article class="dark-footer">{}</article>'])
def test_sections_titled_like_regions_stay(mark):
    got = htmltext.extract(page(f"<div><p>{LONG}</p>{mark.format(f'<p>{LONG}</p>')}<p>{LONG}</p></div>"))
    assert got.count(LONG.strip()) == (3 if "article" not in mark else 1)


def test_all_pages_without_their_article_elements():
    """The windows alone find the same text on every page of the table."""
    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        plain = re.sub(r"<(/?)article>", r"<\1div>", row["html"])
        assert htmltext.extract(plain) == htmltext.extract(row["html"]) != ""
