from __future__ import annotations

import html
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import htmltext as H
from gridlark.llm.dom import read

SMALL = "/root/testdata/sf0.001"


def one(page: str | None) -> str:
    return H.extract([page], H.model())[0]


def article(page: str) -> str:
    """The blocks of the article element, cut out by hand."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [re.sub(r"</?b>", "", b).replace("<br>", " ") for b in re.split(r"<(?:/?p|/?h1)>", body)]
    return "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


def test_query(spark, duck):
    got = {r["page_id"]: r for r in H.op1_html(spark, SMALL).collect()}
    pages = duck.sql("SELECT page_id, url, html FROM pages").fetchall()
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        r = got[page_id]
        assert (r["url"], r["text"], r["n_chars"]) == (url, article(page), len(article(page)))


def test_held_out_layouts():
    pages = [read(h) for h in H.labelled_pages(150, seed=999)]
    p = H.model().marginals(H.Trees(pages))[:, H.CONTENT]
    y = np.concatenate([H.states(x) for x in pages]) == H.CONTENT
    run = np.concatenate([np.array(x.tag) == "#text" for x in pages])
    assert ((p >= H.LEAST) == y)[run].mean() > 0.97


def test_marginals_equal_enumeration():
    """Sum-product on a small tree against all assignments of states."""
    from itertools import product

    m = H.model()
    t = H.Trees([read("<div><nav><a href=x>ab</a></nav><p>Some text here.</p></div>")])
    e, n = m.evidence(t), len(t.parent)
    total = np.zeros((n, 3))
    for states in product(range(3), repeat=n):
        s = m.root[states[0]] + sum(e[i, states[i]] for i in range(n)) + sum(m.pair[t.kind[i], states[t.parent[i]], states[i]] for i in range(1, n))
        for i in range(n):
            total[i, states[i]] += np.exp(s)
    assert np.allclose(m.marginals(t), total / total.sum(1, keepdims=True), atol=1e-9)


PAGE = """<html><head><title>T</title><script>var a = "</p>"; b < c;</script></head><body>
<header class="site-header"><a href="/">Site</a></header><nav class=menu><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies. Accept.</p></div>
<article><h1>A title &amp; more</h1><p>First  paragraph\n of   text, with <a href="x">a link</a> &lt;here&gt;.</p><p>Second one &#233;&nbsp;x.
<ul><li>One item of the list.<li>Another item.</ul><blockquote>Quoted words, indeed.</blockquote></article>
<aside class="sidebar"><h3>More</h3><p>Something else entirely.</p></aside><section id="comments"><div class="comment">I disagree with this text.</div></section>
<form action=/s><label>Find</label><input name=q><button>Go</button></form><div class="advert">Buy this now, please.</div><footer>&copy; 2020 Site. All rights.</footer></body></html>"""


def test_other_layout():
    assert one(PAGE).split("\n") == ["A title & more", "First paragraph of text, with a link <here>.", "Second one é x.", "One item of the list.", "Another item.", "Quoted words, indeed."]


@pytest.mark.parametrize("page", [None, "", "   ", "<div", "<!--", "<p", "</p>", "<script>x", "<a b='c", "<html></html>"])
def test_pages_without_text(page):
    assert one(page) == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a'>", "</div>", "<li>", "<td>", "<table>", "</table>", "<!-- x -->", "<script>", "</script>", "<a href=\"x>y\">", "</a>", "text", "&amp;", "&#0;", "'", '"', "<", ">", "<br/>", "<x y='", " "]), max_size=30).map("".join))
def test_any_markup_is_read(page):
    p = read(page)
    assert all(0 <= a < i for i, a in enumerate(p.parent) if i) and len(one(page)) <= len(page) + 10


def test_long_pages_stay_linear():
    long = "<p>" + "word " * 400_000 + "</p>"
    assert len(read(long).text) == 3 and len(read("<a '" * 20_000).tag) < 5
    assert len(read("<a b='" * 200_000).tag) < 5 and len(read("<p a=\"'>" * 100_000 + "x").tag) > 1
    assert len(read("<!--" * 100_000).tag) == 1 and len(read("<title>" * 100_000 + "x").text) == 2 and len(read("<x a='\">" * 50_000).tag) > 1
    assert len(read("<div>" * 3000 + "x").tag) == 3002
    one("<div>" * 3000 + "x")


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "", "t"), (None, PAGE, None), (3, "<p>" + "word " * 200_000, "t")], "page_id long, html string, text string")
    out = H.extract_text(df)
    assert out.columns == ["page_id", "html", "text"]
    got = {str(r["page_id"]): r["text"] for r in out.collect()}
    assert got["1"] == got["2"] == "" and got["None"].startswith("A title")
    assert H.extract_text(df.limit(0)).count() == 0


BLOCKS = [f"<p>Paragraph {n} of the article, with enough words in it to be read as prose, and a full stop.</p>" for n in ("one", "two", "three")]
LINES = [re.sub("<.*?>", "", b) for b in BLOCKS]


@pytest.mark.parametrize("name", sorted("select video audio svg math noscript object canvas iframe template title textarea".split()))
@pytest.mark.parametrize("attribute", ["", ' class="x"'])
def test_an_unclosed_element_loses_no_text(name, attribute):
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>The title of it</h1>{BLOCKS[0]}<{name}{attribute}>{BLOCKS[1]}{BLOCKS[2]}</article><footer>&copy; 2020 site</footer></body></html>"
    assert one(page).split("\n") == ["The title of it", *LINES]


@pytest.mark.parametrize("name", sorted("video audio svg noscript object canvas iframe template".split()))
def test_a_closed_element_is_skipped(name):
    page = f"<article><h1>The title of it</h1>{BLOCKS[0]}<{name}><p>Your browser shows nothing here, sorry.</p></{name}>{BLOCKS[1]}</article>"
    assert one(page).split("\n") == ["The title of it", *LINES[:2]]


def test_options_are_no_text():
    for end in ("</select>", ""):
        page = f"<article><h1>The title of it</h1>{BLOCKS[0]}<select name=a><option>Red<option value=b>Blue</option><optgroup label=x><option>Green{end}{BLOCKS[1]}</article>"
        assert one(page).split("\n") == ["The title of it", *LINES[:2]]


def test_an_unclosed_element_before_a_closed_one():
    page = f"<article><h1>The title of it</h1><video src=a>{BLOCKS[0]}<video src=b>none</video>{BLOCKS[1]}</article>{'<div>' * 3}"
    assert one(page).split("\n") == ["The title of it", *LINES[:2]]


@pytest.mark.parametrize("tag", ['<p title="a > b">', "<p title='it \"is\" > so'>", "<p a=b' c>", '<p title = "x">', "<p 'odd>", '<p =">">', "<p\ntitle='a\nb'>"])
def test_quotes_in_tags(tag):
    page = f"<article><h1>The title of it</h1>{tag}{LINES[0]}</p>{BLOCKS[1]}</article>"
    assert one(page).split("\n") == ["The title of it", *LINES[:2]]


def test_many_odd_quotes_are_read_like_few():
    """A quote that never closes ends its tag at the bracket, however many tags with odd quotes came before."""
    for n in (1, 99, 101, 400):
        page = f"<article><h1>The title of it</h1>{BLOCKS[0]}" + "<b 'x>" * n + f"{BLOCKS[1]}<p class=\"z>{LINES[2]}</article>"
        assert one(page).split("\n")[-1] == LINES[2] and LINES[1] in one(page)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<a ", "b", "=", " ", "'", '"', ">", "x=\"y\"", "z='w>'", "/", "t"]), max_size=24).map("".join))
def test_tag_ends_equal_a_state_machine(text):
    """Against a reading character by character."""
    from gridlark.llm.dom import TagEnds

    text = "<a" + text
    state, end, i = "in", -1, 2
    while i < len(text):
        c = text[i]
        if state in ('"', "'"):
            state = "in" if c == state else state
        elif c == ">":
            end = i
            break
        elif c == "=":
            j = i + 1
            while j < len(text) and text[j] == " ":
                j += 1
            if j < len(text) and text[j] in "\"'":
                state, i = text[j], j
        i += 1
    assert TagEnds(text)(2) == end


#: Layouts of other kinds of sites, each with the blocks that are its article.
SITES = [
    ("""<body><div id="page"><div id="masthead"><h1><a href=/>The Daily</a></h1></div><div id="main-nav"><a href=1>News</a> <a href=2>Sport</a></div>
<div class="post"><h2 class="entry-title">Rain is expected</h2><div class="byline">By A. Writer</div><div class="entry-content"><p>It will rain in the north today, and most of tomorrow too.</p><p>The south stays dry, with some wind in the evening.</p></div></div>
<div class="related-posts"><h3>Read next</h3><ul><li><a href=a>Snow</a><li><a href=b>Sun</a></ul></div><div class="comment-list"><div class="comment"><p>I do not believe a word of this.</p></div></div><div id="footer">Copyright 2021 The Daily</div></div>""",
     ["Rain is expected", "It will rain in the north today, and most of tomorrow too.", "The south stays dry, with some wind in the evening."]),
    ("""<body><header><nav><ul><li><a href=/>Home</a><li><a href=/docs>Docs</a></ul></nav></header><main><h1>How to install it</h1><p>First fetch the archive, then unpack it.</p><pre>tar xf it.tar</pre><ol><li>Open the folder that was made.<li>Run the program in it.</ol><blockquote>It takes a minute or so.</blockquote></main>
<aside class="widget"><h4>Tags</h4><a href=t>setup</a></aside><form class="newsletter"><label>Mail</label><input><button>Subscribe</button></form><footer><p>&copy; 2022 It</p><a href=p>Privacy</a></footer>""",
     ["How to install it", "First fetch the archive, then unpack it.", "tar xf it.tar", "Open the folder that was made.", "Run the program in it.", "It takes a minute or so."]),
]


@pytest.mark.parametrize("page, blocks", SITES)
def test_other_sites(page, blocks):
    assert [x for x in one(page).split("\n") if not x.startswith("By ")] == blocks
