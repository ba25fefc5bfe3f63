"""Main text of pages: the reader, the tree, and whole pages against a plain reading of their article."""

import html
import re

import numpy as np
import pytest

from lumenframe.llm.html_blocks import blocks
from lumenframe.llm.main_text import LABELLED, decide, features, main_blocks, main_text, trained

PAGES = "page_id long, url string, html string, text string, n_chars string, id string"
TREE = trained()
PROSE = " ".join(["The river rose again in spring and the mill stood still for days."] * 6)


def lines(page):
    return main_blocks(page, TREE)


def plain(page):
    """The article of a page of the test tables, by patterns alone."""
    article = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?p>|</?h1>", article)]
    return "\n".join(p for p in parts if p)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_tables_against_their_articles(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet")
    want = {r.page_id: (r.url, plain(r.html)) for r in table.collect()}
    got = main_text(table).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


def test_tree_fits_its_table_and_puts_places_first():
    for page in LABELLED:
        where = [{"article": 1, "inset": 1, "beside": -1, "away": -1}.get(b[0], 0) for b in page]
        aside = [b[0] in ("aside", "inset", "away") for b in page]
        x = features([b[1] for b in page], [b[2] for b in page], where, aside)
        assert decide(TREE, x).tolist() == [b[3] for b in page]
    rng = np.random.default_rng(1)
    n, linked = rng.integers(1, 300, 4_000), rng.random(4_000)
    x = features(n, (n * linked).astype(int), rng.choice([-1, 0, 1], 4_000), rng.random(4_000) < 0.5)
    keep = decide(TREE, x)
    assert not keep[x[:, 7] == 1].any() and not keep[x[:, 6] == -1].any() and keep[(x[:, 6] == 1) & (x[:, 7] == 0)].all()


def test_all_that_is_not_the_article_goes():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>if (a < b) "</p>";</script></head><body class="has-sidebar">
      <header><h1>Site name</h1><p>{PROSE}</p></header><nav><ul><li><a href="/a">Home</a><li><a>News</a></ul></nav><div class="cookie-notice">{PROSE}</div>
      <main><article><header><h1>Head &amp; line</h1></header><p>{PROSE}<p>One.<div class="ad-slot">Buy <b>now</b></div><aside>{PROSE}</aside>
      <form action="/s"><p>Your name</p><input><button>Send</button></form><p><a href="x>y">A link</a></p><footer>Filed under</footer></article></main>
      <div id="sidebar"><p>{PROSE}</p></div><section id="comments"><article class="comment"><p>{PROSE}</p></article></section>
      <dialog>{PROSE}</dialog><noscript>Turn scripts on</noscript><footer><p>{PROSE}</p></footer></body></html>"""
    assert lines(page) == ["Head & line", PROSE, "One.", "A link"]


def test_pages_without_marks_go_by_words_and_links():
    menu = "".join(f"<div><a href='/{i}'>Section {i}</a></div>" for i in range(6))
    related = "".join(f"<div><a href='/r{i}'>Another story from our paper {i}</a></div>" for i in range(4))
    page = f"<body>{menu}<div>A headline of six words here</div><div>{PROSE}</div><div>Short.</div><div>{PROSE}</div>{related}"
    assert lines(page) == ["A headline of six words here", PROSE, "Short.", PROSE]


def test_a_form_around_the_page_is_none():
    assert lines(f"<form id='all'><div>menu</div><article><p>{PROSE}</p><p>ok</p></article></form>") == [PROSE, "ok"]


def test_reader_of_malformed_pages():
    def texts(page):
        return [b.text for b in blocks(page)]
    assert texts("<p><b>one<br>two<p>three</b>four") == ["one two", "threefour"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert texts("a < b &lt;i&gt; &amp;amp; &#233;&copy 1 &nbsp; 2") == ["a < b <i> &amp; é© 1 2"]
    assert texts("x<!-- > -->y<!---->z<? pi >w</ >v<!-- open <p>lost") == ["xyzwv"]
    assert texts("</div></p>a<div/>b<script>1</script >c<style>") == ["a", "bc"]
    assert texts('<p title="a>b">c</p><a href="never closed>d<b') == ["c", "d"]
    assert texts("<p>a <svg><title>t</title><g>x</g></svg>b<button>no</button> c</p>d") == ["a b c", "d"]
    assert texts("<p>a<svg><text>t<p>b<select><option>x<div>c</div><object><p>no</p></object>d") == ["a", "b", "c", "d"]
    assert texts("") == texts("<p> \n </p>") == texts("<br>") == []
    linked = blocks("<p>one <a>two three</a><a> four</a> five</p><p><a>x<p>y</p>")
    assert [(b.words, b.linked) for b in linked] == [(5, 3), (1, 1), (1, 0)]


def test_odd_pages_take_linear_time():
    n = 200_000
    for page in ("<" * n, "<!--" * n, "<a b='>' " * n, '<a x="' * n, "<div>" * n + "text" + "</x>" * n, "<p>" * n, "<a" * n, "<li><ul>" * n):
        assert len(lines(page)) <= 1


def test_edges(spark):
    long_page = f"<article>{'<p>' + PROSE + '</p>'}" + "<p>é</p>" * 20_000
    rows = [(1, "u", None, "t", "n", "i"), (2, None, "", "t", "n", "i"), (None, "u", "<article>a<br>b", "t", "n", "i"), (None, "u", "<article>a<br>b", "t", "n", "i"),
            (5, "u", long_page, None, None, None), (6, "u", "<nav>menu</nav>", "t", "n", "i"), (7, "u", "<article>&#x1F600; é</article>", "t", "n", "i")]
    got = main_text(spark.createDataFrame(rows, PAGES))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted([(r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got.collect()])
    assert found[:5] == [(0, "u", "a b", 3), (0, "u", "a b", 3), (1, "u", "", 0), (2, "", "", 0), (5, "u", PROSE + "\né" * 20_000, len(PROSE) + 40_000)]
    assert found[5:] == [(6, "u", "", 0), (7, "u", "😀 é", 3)]
    assert main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_article_against_body_by_words():
    card = "<article><p>A short teaser</p></article>"
    assert lines(f"<main><h1>Head</h1><p>{PROSE}</p>{card}</main>") == ["Head", PROSE, "A short teaser"]
    assert lines(f"<main><p>Lead</p><article><p>{PROSE}</p></article></main>") == [PROSE]
