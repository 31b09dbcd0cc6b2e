"""Pages read as a browser reads them: golden pages, an independent parser, and time in proportion to length."""

import random
import time
from html.parser import HTMLParser

import pytest

from verdictlake.functions import html as H
from verdictlake.operators import web

LINKS = """<html><head><base target=x><base HREF='/docs/'><base href="/second/"></head><body>
<!-- <a href="in-comment.pdf">no</a> --><script>document.write('<a href="in-script.pdf">no</a>');</script>
<style>a::after{content:"<a href=in-style.pdf>"}</style><textarea><a href="in-textarea.pdf"></textarea>
<a title="a > b" class=k href = 'one.pdf?x=1&#38;y=2&amp;z=3'>1</a><A HREF=two.pdf>2</A><a data-href="no.pdf">-</a>
<a href="/abs&eacute;.pdf" href="second-of-a-name.pdf">3</a><a href="?a=1&copy=2.pdf">4</a><a href="  three.pdf
">5</a><a href="x.pdf"
"""
TEXT = """<!DOCTYPE html><head><title>no title</title></head><body><nav><ul><li>NAV</ul></nav>
<div id="k" class="ads">AD <div>inner <div>deep</div></div> TAIL OF AD</div><div class='ad'>SINGLE</div><DIV CLASS="big Ad wide">BIG</DIV>
<div class=ad>BARE</div><div class="address">Main street</div><span class="ad">INLINE <span>IN</span> IT</span>
<p>caf&#233; caf&eacute; &#x41;&amp;&lt;b&gt; 1&nbsp;2 &copy2 &unknown; a < b &</p><script>var t = "</p><p>JS</p>";</script>
<!-- comment <p>no</p> --><p title="a > b">one<br>two <b>bo<i>ld</b></i> three<p>four<noscript><p>NO</p></noscript>
<aside><div>ASIDE</div></aside><textarea>&lt;kept&gt; <b></textarea><!--><p>after an empty comment</p><? php > end
<p>five</p></body><footer>FOOT</footer>last <em"""


def test_links_of_a_golden_page(spark):
    base, found = H.links(LINKS)
    assert base == "/docs/"
    assert found == ["one.pdf?x=1&y=2&z=3", "two.pdf", "/absé.pdf", "?a=1&copy=2.pdf", "three.pdf"]
    pages = spark.createDataFrame([(1, "http://h.org/p/q.html", LINKS), (2, "http://h.org/p/q.html", None), (3, None, "<a href=k.pdf>")],
                                  "page_id int, url string, html string")
    got = [(r.page_id, r.pos, r.link) for r in web.extract_links(pages).orderBy("page_id", "pos").collect()]
    assert got == [(1, 0, "http://h.org/docs/one.pdf?x=1&y=2&z=3"), (1, 1, "http://h.org/docs/two.pdf"), (1, 2, "http://h.org/absé.pdf"),
                   (1, 3, "http://h.org/docs/?a=1&copy=2.pdf"), (1, 4, "http://h.org/docs/three.pdf")]


def test_text_of_a_golden_page(spark):
    want = "\n".join(["Main street", "café café A&<b> 1 2 ©2 &unknown; a < b &", "one", "two bold three", "four",
                      "<kept> <b>", "after an empty comment", " end", "five", "last"])
    got = [line.strip() for line in H.text(TEXT).split("\n")]
    assert got == [line.strip() for line in want.split("\n")]
    pages = spark.createDataFrame([(1, TEXT), (2, None), (3, "<p>short</p>")], "page_id int, html string")
    assert [(r.page_id, "TAIL" in r.content) for r in web.page_text(pages, min_chars=20).collect()] == [(1, False)]


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            first = dict(reversed(attrs))
            if "href" in first:
                self.found.append((first["href"] or "").strip(H.SPACE))


def test_anchors_as_another_parser_finds_them():
    draw = random.Random(3)
    parts = ["<a href=x>", "<a\nHREF = 'q&amp;r'>", '<a class="a>b" href="u v">', "<p>", "</p >", "<!-- <a href=no> -->", "<script>'<a href=no>'</script>", "<style><a href=no></style>",
             "text & more", "< ", "<3", "</>", "<br/>", "<a/href=y>", "<a x href>", "<A hRef=z title='\"'>", "<!doctype html>", "&lt;a href=no&gt;", "<b>", "</a>", "<a href=''>"]
    for _ in range(400):
        page = "".join(draw.choice(parts) for _ in range(draw.randrange(30)))
        other = Anchors()
        other.feed(page)
        other.close()
        assert H.links(page)[1] == other.found, page


def test_real_pages_as_another_parser_finds_them(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        other = Anchors()
        other.feed(r["html"])
        other.close()
        assert H.links(r["html"])[1] == other.found


@pytest.mark.parametrize("piece", ["<script", "<script>", "<style>", "<!--", "<a href=\"", "<a href='x", "<a href=", "<", "</", "<!", "<p><b>", "</p>", "&", "&#", "<div class=ad>", "<nav>", "<a ", "<title>", "<!-", "<? "])
def test_time_follows_the_length_whatever_is_left_open(piece):
    page = piece * (2_000_000 // len(piece))
    start = time.perf_counter()
    H.links(page)
    H.text(page)
    assert time.perf_counter() - start < 20
