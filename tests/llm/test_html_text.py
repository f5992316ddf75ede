import time

import pytest

from scanloom.llm.html_text import extract, main_text

LONG = "A first sentence with some words, and a second part, that is long enough to count as text."
ARTICLE = f"<article><h1>Title &amp; more</h1><p>{LONG}</p><p>Short.</p><p><b>Bold start.<br><p>{LONG} Again.</p></article>"
TEXT = f"Title & more\n\n{LONG}\n\nShort.\n\nBold start.\n\n{LONG} Again."


@pytest.mark.parametrize("before, after", [
    ("", ""),
    ("<nav><ul><li><a href=/a>One</a></li></ul></nav>", "<footer>&copy; someone</footer>"),
    ("<header><h1>Site</h1><p>Slogan, with commas, and so on, for long.</p></header>", "<aside><p>" + LONG + "</p></aside>"),
    ('<div id="cookie-notice"><p>' + LONG + "</p></div>", '<div class="comments"><h2>Comments</h2><p>' + LONG + "</p></div>"),
    ('<div class="ad">' + LONG + "</div>", '<section id="related"><a href=/x>' + LONG + "</a></section>"),
    ("<script>var t='</p><article>';</script><style>p{}</style>", "<form><p>" + LONG + "</p><input></form>"),
    ('<div role="navigation">' + LONG + "</div>", '<div style="display: none">' + LONG + "</div>"),
    ("<!-- <p>" + LONG + "</p> -->", '<div class="sidebar-right widget">' + LONG + "</div>"),
])
def test_only_the_article_is_kept(before, after):
    assert main_text(f"<!DOCTYPE html><html><head><title>x</title></head><body>{before}{ARTICLE}{after}</body></html>") == TEXT


def test_containers_without_article_tags():
    page = f"<body class='has-sidebar'><div id=top><a href=/>Home</a> <a href=/b>More</a></div><div class=content><h2>Head</h2><div class=text>{LONG}<p>{LONG}<ul><li>one<li>two</ul></div></div><div class=sidebar>{LONG}</div></body>"
    assert main_text(page) == f"Head\n\n{LONG}\n\n{LONG}\n\none\n\ntwo"


def test_white_space_and_references():
    assert main_text("<p>a\n\t b&nbsp;&nbsp;c &lt;p&gt; &#233;&#x4E2D; &amp;amp;<br>d</p>") == "a b c <p> é中 &amp; d"


def test_article_header_keeps_headings_only():
    assert main_text(f"<article><header><h1>T</h1><p>By someone</p></header><p>{LONG}</p><footer>Filed</footer></article>") == f"T\n\n{LONG}"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>", "<a href='", "</div></p>", "<div>" * 50, "\x00\ufffd"])
def test_odd_pages(page):
    assert isinstance(main_text(page), str)


def test_plain_text_and_deep_pages_take_linear_time():
    assert main_text("just text") == "just text"
    started = time.time()
    main_text("<div>" * 30_000 + LONG + "</div>" * 30_000)
    main_text("<a '" * 3_000)
    main_text("<b>x " * 30_000)
    assert time.time() - started < 20


def test_every_page_has_a_row(spark):
    pages = spark.createDataFrame([(1, "u", f"<body>{ARTICLE}</body>", "x"), (1, "u", None, "x"), (None, None, "", "y")], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract(pages).collect()), key=str)
    assert got == sorted([(1, TEXT, len(TEXT)), (1, "", 0), (None, "", 0)], key=str)
    assert extract(pages.filter("false")).count() == 0


PARAGRAPHS = [f"This is paragraph {k} of an article, with commas, and with enough words to count as text." for k in range(5)]
BODY_TEXT = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize("name", [
    "layout sidebar-right", "page menu-open", "container header-fixed", "post share-enabled", "main-widget", "two-col nav-left", "rail-layout",
])
def test_names_of_wrappers_do_not_drop_the_article(name):
    assert main_text(f'<body><div class="{name}">{BODY_TEXT}</div></body>') == "\n\n".join(PARAGRAPHS)
    inner = f'<div class="sidebar"><p>Side text, which is short and not of it.</p></div><div>{BODY_TEXT}</div>'
    page = f'<body><div id="{name}">{inner}</div><div class="related"><p>Some other story, if you like this one.</p></div></body>'
    assert main_text(page) == "\n\n".join(PARAGRAPHS)


def test_names_count_beside_an_article():
    advert = '<div class="ad">An advert that is much longer than the article, with commas, and more commas, and a stop.</div>'
    assert main_text(f"<body>{advert}<article><h1>Short</h1><p>Few words.</article></body>") == "Short\n\nFew words."
    assert main_text(f'<body><div class="comments">{BODY_TEXT}</div><p>Few words, but they are the text.</p></body>') == "Few words, but they are the text."
    assert main_text(f"<article>{BODY_TEXT}<label>A caption</label><form><label>Your name</label></form></article>") == "\n\n".join([*PARAGRAPHS, "A caption"])
