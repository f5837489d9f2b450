"""Page text: blocks, roles, site style trees."""

from __future__ import annotations

import pytest

from fleetcohort.llm import sitetree
from fleetcohort.llm.html_blocks import blocks

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style>
<script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>One   two<br>three
<p>caf&eacute; &#x41;&#66; a &lt; b</p><ul><li>x<li>y</ul><aside>Side</aside>
<form><input value="q">Form</form><pre> kept   words </pre><table><tr><td>c1<td>c2</tr></table>
<div class="comments"><p>Reader says</p></div></article>
<div id="cookie-notice">Accept</div><footer>&copy; foot</footer></body></html>"""


def kept(html):
    return [t for _, _, noise, t in blocks(html) if not noise]


def test_an_article_without_its_surroundings():
    assert kept(PAGE) == [
        "Head & line", "One two three", "café AB a < b", "x", "y", "kept words", "c1", "c2",
    ]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", []),
        ("plain words", ["plain words"]),
        ("<p>a<p>b", ["a", "b"]),
        ("<article><p>unclosed <i>italic", ["unclosed italic"]),
        ("<div>a < b and c > d</div>", ["a < b and c > d"]),
        ("<p title='a > b'>x</p>", ["x"]),
        ("<p title='broken>x</p>", ["x"]),
        ("<script>never closed <p>x", []),
        ("<main><p>in</p></main><p>out</p>", ["in"]),
        ("<article><header><h1>own head</h1></header><p>x</p></article>", ["own head", "x"]),
        ("<p>a&nbsp;&nbsp;b</p>", ["a b"]),
        ("<p>in<span class='share'>Share</span>side</p>", ["in", "side"]),
        ("<P>UPPER</P><!-- <p>no</p> --><p>c", ["UPPER", "c"]),
        ("<p>&am;amp &amp;amp;</p>", ["&am;amp &amp;"]),
        ("</div></p>text</article>", ["text"]),
    ],
)
def test_tolerant_reading(html, text):
    assert kept(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='layout has-sidebar'><p>a</p></div><p>other text</p>", ["a", "other text"]),
        ("<div class='no-sidebar'><p>a</p></div><p>other text</p>", ["a", "other text"]),
        ("<article class='post category-advertising'><p>a</p></article>", ["a"]),
        ("<main class='search-results'><p>a</p></main>", ["a"]),
        ("<div id='social-science'><p>a</p></div><p>other text</p>", ["a", "other text"]),
        ("<form><h1>Head</h1><p>the whole page</p></form>", ["Head", "the whole page"]),
        ("<form><article>a</article></form><p>much longer than that</p>", ["a"]),
        ("<div class=widget><main><p>a</p></main></div><p>longer text</p>", ["a"]),
        ("<div class=comments>one</div><div class=sidebar>two</div>", ["one", "two"]),
        ("<form>Send</form><div class=sidebar>Side</div><p>text of the page</p>", ["text of the page"]),
        ("<div class=site-header>S</div><div class='x cookie-notice'>C</div><p>text</p>", ["text"]),
        ("<nav>menu only</nav>", []),
    ],
)
def test_names_do_not_cut_a_page_itself(html, text):
    assert kept(html) == text


ARTICLE = "<article><h1>H</h1><p>the text</p></article>"
LONG = "a comment that is much longer than the article " * 3


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"{ARTICLE}<section id='comments'><article class='comment'>{LONG}</article></section>", ["H", "the text"]),
        (f"{ARTICLE}<section id='comments'><article><p>{LONG}</article></section>", ["H", "the text"]),
        (f"{ARTICLE}<div class='comments'><p>{LONG}</p></div>", ["H", "the text"]),
        (f"<article><p>short</p><div class='x comment-list'><p>{LONG}</p></div></article>", ["short"]),
        (f"<div class='cookie-bar'>C</div><div class='ad-slot'>Buy</div>{ARTICLE}", ["H", "the text"]),
        (f"<p>short</p><div class='notice-box'>N</div><ol class='replies'><li>{LONG}</ol>", ["short"]),
        ("<article class='comment'>the only text</article>", ["the only text"]),
        ("<div class='comments'><main>main part</main></div><p>x</p>", ["main part"]),
        ("<div class='site-wrapper'><div class='list'><p>a</p></div></div><p>b</p>", ["a", "b"]),
        ("<div class='comments-open layout'><p>a</p></div><p>b</p>", ["a", "b"]),
    ],
)
def test_reader_comments_and_bars_go_whatever_they_hold(html, text):
    assert kept(html) == text


def test_repeated_branches_of_a_host_are_removed(spark):
    def page(n, host="one.example"):
        body = (
            f"<article><div class='box'>Follow us everywhere</div><h1>Title {n}</h1>"
            f"<p>Same words on all pages</p><p>own words {n}</p><div class='lead'>lead {n}</div></article>"
        )
        return n, f"http://{host}/p{n}", body

    rows = [page(n) for n in range(12)] + [page(n, "few.example") for n in range(100, 103)]
    got = {r["page_id"]: r["text"] for r in _texts(spark, rows)}
    assert got[3] == "Title 3\nSame words on all pages\nown words 3\nlead 3"
    assert got[101].startswith("Follow us everywhere\nTitle 101")  # too few pages to tell


def test_copies_of_an_article_stay(spark):
    rows = [(n, f"http://a.example/{n}", "<article><h1>T</h1><p>copied text</p></article>") for n in range(30)]
    rows += [(n, f"http://b.example/{n}", "<div><div class='x'>only this</div></div>") for n in range(30, 60)]
    got = {r["page_id"]: r["text"] for r in _texts(spark, rows)}
    assert {got[n] for n in range(30)} == {"T\ncopied text"}
    assert {got[n] for n in range(30, 60)} == {"only this"}


def test_awkward_rows(spark):
    long = "<article>" + "".join(f"<p>w{i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, None, PAGE), (1, None, PAGE), (None, "http://x/", "<p>t</p>"), (2, "no url", None),
            (3, "http://x/", ""), (4, "http://x/", long)]
    got = sorted(((r["page_id"] or 0, r["text"]) for r in _texts(spark, rows)), key=str)
    assert len(got) == 6
    assert [t for k, t in got if k == 1][0] == [t for k, t in got if k == 1][1] != ""
    assert dict(got)[0] == "t" and dict(got)[2] == dict(got)[3] == ""
    assert dict(got)[4].count("\n") == 19_999
    assert _texts(spark, []) == []


def test_importance_of_nodes(spark):
    rows = [(n, f"http://h/{n}", f"<div class=a>same</div><div class=b>own {n}</div>") for n in range(16)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    tree = {r["path"]: r for r in sitetree.site_tree(sitetree.merged(pages, "url", "html")).collect()}
    assert tree["body>div.a"]["content"] == pytest.approx(0.0)
    assert tree["body>div.b"]["content"] == pytest.approx(1.0)
    assert tree["body>div.a"]["importance"] < sitetree.LEAST < tree["body>div.b"]["importance"]


def _texts(spark, rows):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "row", "key", "blocks", "cut", "path"):
        pages = pages.withColumn(name, F.lit("clash"))
    return sitetree.main_text(pages).collect()
