import time

import pytest

from perfspark.llm import html_text


def runs(markup):
    page = html_text.parse(markup)
    return [t for t, k in zip(page.text, page.kind) if k == html_text.TEXT]


@pytest.mark.parametrize("markup, want", [
    ("<p title=it's>Hello one.</p><p>we don't stop</p><p>tail</p>", ["Hello one.", "we don't stop", "tail"]),
    ('<p>head</p><p title="x>Hello one.', ["head"]),
    ("a < b <3 </>c</3 x>d<!-- - -->e<!-->f<!--->g<!doctype x>h<?y?>i", ["a < b <3 ", "c", "d", "e", "f", "g", "h", "i"]),
    ("<a href=foo/>t</a><div/>u<p a= >v<p =x ==y z='>'>w<br/>x", ["t", "u", "v", "w", " ", "x"]),
    ("<script>if (a<b) {'</p>'}</script foo>x<textarea><p>&lt;</textarea>y<title>z", ["if (a<b) {'</p>'}", "x", "<p><", "y", "z"]),
    ("&amp;&#65;&#x41;&#" + "9" * 6000 + ";&unknown;", ["&AA�&unknown;"]),
    ("cut <!-- off", ["cut "]), ("cut <![CDATA[ off", ["cut "]), ("cut </", ["cut "]), ("", []), ("<", ["<"]),
])
def test_tokens(markup, want):
    assert runs(markup) == want


def test_flags_come_from_whole_attributes():
    page = html_text.parse("<div title=' class=ad ' class=main id='x'>a</div><div class='ad'>b</div>")
    group = lambda node: page.flags[node] >> len(html_text.KINDS)
    assert group(1) == 1 << html_text.GROUP["main"] and group(3) == 1 << html_text.GROUP["ad"]


@pytest.mark.parametrize("piece", [
    "<a b", '<a "', "<!", "<script>", "<div>", "<b>", "</", "<a b='", "<p>", "<li>", "<a =", "<x/", "&#1", "<p title=it's>", "</script",
    "<title></titl", "< ", "<table><tr><td>", "</b>", "<p><b>", "<!--", "<a b=c "])
def test_time_is_linear(piece):
    begun = time.perf_counter()
    html_text.parse("<article>" + piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - begun < 30


#: Pages written by hand, with the text that a reader would keep.
PAGES = [
    ("""<html><head><title>Rivers</title><script>var x = "<p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a> <a href="/about">About us</a></header>
<main><h1>How rivers bend</h1>
<p>A river that meets a soft bank wears it away, and lays the sand down on the other side of the bend.</p>
<p>Over the years the loops grow wider &amp; wider, until the water
   breaks through the neck.</p><ul><li>Wide loops</li><li>Narrow necks</li></ul></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">Lakes</a></li><li><a href="/2">Seas</a></li></ul></aside>
<footer><p>Copyright 2020 by the river society</p></footer></body></html>""",
     "How rivers bend\nA river that meets a soft bank wears it away, and lays the sand down on the other side of the bend.\n"
     "Over the years the loops grow wider & wider, until the water breaks through the neck.\nWide loops\nNarrow necks"),
    ("""<body><nav class=menu><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to keep this page running.</p><button>Accept</button></div>
<article class='post'><h2>Bread at home</h2><p title=baker's>Mix flour, water and salt, then let the dough rest for a whole night in a cool place.
<p>Bake it hot, until the crust is <b>dark</b> and <i>crisp</i>.</article>
<section class="comments"><div class="comment"><b>Ann</b><p>I tried this and it was very good indeed, thank you.</p></div></section>
<form><label>Your mail</label><input type=text><button>Sign up</button></form></body>""",
     "Bread at home\nMix flour, water and salt, then let the dough rest for a whole night in a cool place.\n"
     "Bake it hot, until the crust is dark and crisp."),
]


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.trained(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("markup, want", PAGES)
def test_pages_written_by_hand(trees, markup, want):
    assert html_text.extract(trees, [markup]) == [want]


def test_text_page_ids(spark):
    pages = spark.createDataFrame(
        [(f"p{i}", "u", f"<nav>n</nav><article><p>text {i} of the page</p></article>") for i in range(5)], "page_id string, url string, html string")
    got = html_text.texts(pages, html_text.trained(pages)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {f"p{i}": f"text {i} of the page" for i in range(5)}
