import html
import re
import time

import pytest

from judgelake.llm import htmltext as H
from judgelake.llm.queries_htmltext import op5_html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>The&nbsp;title &amp; more</h1></header><p>First <b>bold<br>line</b> of text.<p>Second
 paragraph &#233;.</p><div class="ad">Buy now</div><p>Ok.</p><ul><li>one<li>two</ul><section id="comments"><p>Nice post!</p></section></article>
<aside>Side</aside><form><label>Mail</label><input></form><footer>&copy; 2020</footer></body></html>"""
WANT = ["The title & more", "First bold line of text.", "Second paragraph é.", "Ok.", "one", "two"]
BARE = """<html><body><div id="menu"><a href=a>Alpha</a> <a href=b>Beta</a></div><div><a href=c>Gamma link</a></div>
<div><p>{0}</p><p>Short.</p><p>{0}</p></div><div id="footer">Imprint</div></body></html>"""


def test_article_without_furniture():
    assert H.main_lines(PAGE) == WANT


def test_wrappers_comments_and_hidden_parts():
    page = """<div class="with-sidebar"><main><h1>Title here</h1><p>Body text of it.</p><p hidden>no</p><div style="display:none">no</div>
    <article class="comment"><p>I disagree strongly with all of this text.</p></article></main><div class="sidebar">Popular things</div></div>"""
    assert H.main_lines(page) == ["Title here", "Body text of it."]


def test_page_without_article_is_found_by_its_ratio():
    body = "Many words of running text without any tag in between, " * 4
    assert H.main_lines(BARE.format(body)) == [body.strip(), "Short.", body.strip()]


def test_short_lines_at_the_ends_of_a_content_box_stay():
    body = "Many words of running text without any tag in between, " * 4
    page = f"""<body><ul class="menu"><li><a href=a>Alpha</a></ul><div id="post"><h2>Title</h2><p>By me</p><p>So.</p><p>And.</p><p>{body}</p>
    <p>a</p><p>b</p><p>c</p><p>d</p><p>e</p><div class="share">Share it</div></div><div class="links"><a href=x>More things to read here</a></div><div>Imprint</div></body>"""
    assert H.main_lines(page) == ["Title", "By me", "So.", "And.", body.strip(), "a", "b", "c", "d", "e"]


def test_all_pages_against_their_plain_layout(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = {r.page_id: r for r in op5_html_text(spark, sf).collect()}
    assert out.keys() == pages.keys()
    for k, page in pages.items():
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert out[k].text == "\n".join(b for b in blocks if b) and out[k].n_chars == len(out[k].text)


def test_null_empty_long_broken_and_clashing_columns(spark):
    long = "<article>" + "<p>para graph</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "text here" + "</div>" * 10
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, deep), (5, "plain text"), (6, "<p>a<b>c</p><![CDATA[x]]><p>&bogus; &lt;</p>"), (7, "<nav>x</nav>")]
    df = spark.createDataFrame([(a, "u", b, "clash") for a, b in rows], "page_id long, url string, html string, text string")
    out = sorted((r.page_id, r.text) for r in H.extract(df).collect())
    assert out[0] == (1, "") and out[1] == (2, "") and out[2] == out[3] == (3, "\n".join(["para graph"] * 20_000))
    assert out[4] == (4, "text here") and out[5] == (5, "plain text") and out[6][1].startswith("ac\n&bogus; <") and out[7] == (7, "")
    assert H.extract(df.limit(0)).count() == 0


BODY = "Many words of running text without any tag in between, " * 4


@pytest.mark.parametrize("start", ["<body>", "<div>", "", "<p>", "<b></b>"])
def test_open_head_ends_where_the_body_begins(start):
    assert H.main_lines(f"<html><head><title>T</title><meta charset=utf-8>{start}{BODY}<p>{BODY}") == [BODY.strip()] * 2
    assert H.main_lines(f"<head><noscript><img src=x>gone</noscript><template><p>gone</p></template><style>p{{}}</style>{start}{BODY}") == [BODY.strip()]


def test_form_around_a_page_is_no_furniture():
    state = '<input type="hidden" value="v">' * 9
    ask = "<form><label>Your name</label><input><label>Message</label><textarea></textarea><button>Send</button></form>"
    box = '<input name="q"><button>Go</button>'
    assert H.main_lines(f"<body><form>{state}{box}<div><p>{BODY}</p><p>{BODY}</p></div></form></body>") == [BODY.strip()] * 2
    assert H.main_lines(f"<body><form>{box * 30}<article><p>{BODY}</p><p>Ok.</p>{ask}</article></form></body>") == [BODY.strip(), "Ok."]
    assert H.main_lines(f"<body><div><p>{BODY}</p></div>{ask}</body>") == [BODY.strip()]


def test_text_beside_an_article_stays():
    card = "<article><h3>Teaser</h3><p>A card of some words that leads to another page.</p></article>"
    found = H.main_lines(f"<body><div><p>{BODY}</p><p>So.</p><p>{BODY}</p></div>{card}<div id=footer>Imprint</div></body>")
    assert found[:3] == [BODY.strip(), "So.", BODY.strip()] and "Imprint" not in found
    # a short high line beside a long article is not
    page = f"<body><p>Some words outside of it</p><article><p>{BODY * 3}</p><p>{BODY * 3}</p></article></body>"
    assert H.main_lines(page) == [(BODY * 3).strip()] * 2


@pytest.mark.parametrize("name", ["side-by-side", "post related-reading", "side", "has-sidebar", "relatedReading", "price-alert-history"])
def test_a_name_alone_bars_no_article(name):
    page = f'<body><ul class="site-nav"><li>Home</ul><div class="{name}"><h2>Title</h2><p>{BODY}</p><p>So.</p><p>{BODY}</p></div><div class="site-footer">Imprint</div></body>'
    assert H.main_lines(page) == ["Title", BODY.strip(), "So.", BODY.strip()]


@pytest.mark.parametrize("name", ["ad", "ad-slot-3", "cookie-notice", "siteFooter", "main-menu", "share-buttons", "google-ad", "comment-list", "newsletter-signup-box"])
def test_names_of_furniture_bar_their_elements(name):
    page = f'<main><h1>Title</h1><p>{BODY}</p><div class="share-price-report"><p>Up 3.</p></div><div class="x {name}"><p>{BODY}</p></div></main>'
    assert H.main_lines(page) == ["Title", BODY.strip(), "Up 3."]


def test_long_furniture_is_no_article_where_there_is_one():
    assert H.main_lines(f'<article><h1>Title</h1></article><div class="side"><p>{BODY}</p><p>{BODY}</p></div>') == ["Title"]


def test_furniture_inside_a_line_leaves_the_line():
    assert H.main_lines('<article><p>Real <span class="share">Share</span>text</p><p><b class="ad">Ad</b> More</p></article>') == ["Real text", "More"]


def test_short_lines_after_the_text_go_with_their_box():
    assert H.main_lines(f"<body><div>{BODY}</div><div>{BODY}</div><div>You may like</div><div>Terms of use</div></body>") == [BODY.strip()] * 2
    assert H.main_lines(f"<body><h1>Title</h1><div><p>{BODY}</p><div>Ok.</div></div><div>Terms of use</div></body>") == ["Title", BODY.strip(), "Ok."]


def test_layout_table():
    page = f"<table><tr><td><ul><li><a href=x>Menu</a><li><a href=y>Other</a></ul></td><td><h1>Title</h1><p>{BODY}</p><p>{BODY}</p></td></tr></table><p>Imprint</p>"
    assert H.main_lines(page) == ["Title", BODY.strip(), BODY.strip()]


@pytest.mark.parametrize("start", ["<b>" * 20_000, "<thead>" * 20_000, "<svg>" + "<g>" * 20_000 + "</svg>"])
def test_open_elements_cost_no_square(start):
    begin = time.process_time()
    assert H.main_lines(f"<article>{start}" + "<p>para graph</p>" * 2000) == ["para graph"] * 2000
    assert H.main_lines("<body>" + f"<div>{BODY}</div>" * 5000) == [BODY.strip()] * 5000
    assert time.process_time() - begin < 5
