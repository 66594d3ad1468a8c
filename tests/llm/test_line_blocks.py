"""op3 on pages of several makes."""

import html
import re
import time

import pytest
from llm.cases import clashing

from tessera.llm.line_blocks import extract_pages, main_text, stretches, tokens
from tessera.llm.op3_query import op3_html_extraction

BODY = "<p>A long paragraph with <b>many</b> words &amp; a <a href='x'>link</a>, going on and on for a while.</p><p>Short.</p>"
TEXT = "A long paragraph with many words & a link, going on and on for a while.\nShort."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain   text\n only", "plain text only"),
        (f"<article>{BODY}</article>", TEXT),
        (f"<nav><a href=/>Home</a></nav><div class='post'>{BODY}</div><footer>Copyright by somebody of some length</footer>", TEXT),
        (f"<header><h1>Site name</h1></header><main>{BODY}<form>Name <input></form></main><aside>Some related words to read</aside>", TEXT),
        (f"<main>{BODY}<div class='ad'>Buy now</div><section id='comments'><p>{'A very long comment of a reader. ' * 20}</p></section></main>", TEXT),
        (f"<div id='cookie-notice'>{'We use cookies. ' * 30}</div><article>{BODY}</article>", TEXT),
        (f"<article><script>var a = '<p>no</p>';</script><style>p {{}}</style>{BODY}<!-- <p>no</p> --></article>", TEXT),
        ("<article><p>One&nbsp;two &#233;&#x4e2d;&lt;b&gt;<br>three<p>four<ul><li>a<li>b</ul>", "One two é中<b> three\nfour\na\nb"),
        ("<article><p>cut in the middle of a wor", "cut in the middle of a wor"),
        ("<article><p>unclosed <b>bold <p>next</p></article><footer>no</footer>", "unclosed bold\nnext"),
        ("<nav>only</nav><footer>furniture</footer>", ""),
        (f"<div class='page-header'>The Daily</div><div class='entry'><div class='entry-header'><h2>Head</h2></div>{BODY}</div><ol class='commentlist'><li>{'So true. ' * 50}</ol>", "Head\n" + TEXT),
        (f"<div class='commentary'>{BODY}</div><div id='navTop'><a href=x>x</a></div><div class='topMenu'>Some plain words of a menu here</div>", TEXT),
        ("<article><p class=\"a\"\">stray quote</p><p title='a > b' data-x=\"c>d\">fine</p></article>", "stray quote\nfine"),
        ("<p hidden>no</p><article><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


LONG = "Words of a paragraph that is long enough to make a surge of its own in any window of lines here."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body class='single comments-open'>{BODY}</body>", TEXT),
        (f"<article class='post comments-enabled'>{BODY}</article>", TEXT),
        (f"<div class='content has-sidebar'><article>{BODY}</article></div>", TEXT),
        (f"<div id='page' class='nav-open'><main>{BODY}</main></div>", TEXT),
        (f"<div class='widget-area'><article>{BODY}</article>no</div>", TEXT),
        (f"<html><head><meta charset=utf-8><title>no</title><link rel=x><article>{BODY}</article>", TEXT),
        (f"<html><head><title>no</title><body>{BODY}", TEXT),
        (f"<article><p>One</p><button>no{BODY}</article>", "One\n" + TEXT),
        (f"<article><p>One</p><textarea>{BODY}</article>", "One\n" + TEXT),
        (f"<article>{BODY}<select><option>no<option>no</select><p>after</p></article>", TEXT + "\nafter"),
        (f"<body><div class='text'><p>{LONG}</p></div><div class=ad><div><div>no</div></div></div><div class='text'><p>{LONG} Again.</p><p>End.</p></div></body>", f"{LONG}\n{LONG} Again.\nEnd."),
        (f"<body><section><p>{LONG}</p></section><section><p>{LONG} Two.</p><p><a href=x>A link alone</a></p><p>{LONG}</p></section></body>", f"{LONG}\n{LONG} Two.\nA link alone\n{LONG}"),
        (f"<body><div><a href=1>Home</a></div><div><a href=2>News</a></div><div><a href=3>Sport</a></div><p>{LONG}</p><p>if a <b and c> d, 1 < 2</p></body>", f"{LONG}\nif a <b and c> d, 1 < 2"),
        (f"<main><article>{BODY}</article><article><h2>Second</h2><p>{LONG}</p></article></main>", f"{TEXT}\nSecond\n{LONG}"),
        (f"<article>{BODY}<article class='comment'><p>{LONG}</p></article><div id='comment-7'>{LONG}</div></article>", TEXT),
        (f"<article><p class=x title='a=\"b' data-y=z>{LONG}</p><img alt=\"a > b\"><svg><text>no</text></svg></article>", LONG),
    ],
)
def test_structures(page, text):
    assert main_text(page) == text


def test_surge_and_dive():
    assert stretches([5, 0, 0, 0, 50, 0, 60, 0, 0, 0, 9]) == [(0, 1, False), (2, 7, True), (8, 11, False)]
    assert stretches([0, 0]) == []
    assert stretches([9, 0, 0, 0, 90, 0, 0, 0, 0, 81]) == [(0, 1, False), (2, 5, True), (7, 10, True)]


@pytest.mark.parametrize("piece", ["<a ", "<a b=\"", "<a b='x>", "<b><i>", "<div>", "<ul><li>", "<!--", "</p", "<p class=\"a", "<script", "<textarea>", "<button><p>", "</div>", "<a =\"\"", "&amp", "<table><tr><td>"])
def test_hostile_pages_take_linear_time(piece):
    start = time.perf_counter()
    main_text(piece * 100_000)
    assert time.perf_counter() - start < 5
    assert "".join(t for kind, _, t in tokens("a <b>c</b> < d<!x>e")) == "a c < de"


def test_long_page():
    paragraphs = [f"Paragraph {i} of a very long page with some words" for i in range(20_000)]
    assert main_text("<body><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body>") == "\n".join(paragraphs)


def test_query(spark, sf_dir):
    """The generated pages hold their text in the article element, with h1 and p as blocks."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}

    def expected(page):
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        inner = re.sub(r"<[^>]*>?", "", re.sub(r"</?(?:p|h1)>", "\n", inner).replace("<br>", " "))
        return "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in inner.split("\n")) if x)

    rows = op3_html_extraction(spark, sf_dir).collect()
    assert {r["page_id"] for r in rows} == set(pages)
    assert all(r["text"] == expected(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)


def test_awkward_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", f"<article>{BODY}</article>"), (1, "u", f"<article>{BODY}</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in extract_pages(pages).collect()) == [0, 0, len(TEXT), len(TEXT)]
    assert extract_pages(clashing(pages.withColumnRenamed("page_id", "doc_id"), ["text", "n_chars"])).count() == 4
    assert extract_pages(pages.limit(0)).count() == 0
