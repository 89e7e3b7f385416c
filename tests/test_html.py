"""HTML extraction: pages with the text each reader makes of them, and properties of any page."""

import re

import pytest

from lorebase.functions import html as H

PAGES = [
    # page, index text, page-search text, distiller text
    ("", "", "", ""),
    ("plain text only", "plain text only", "plain text only", "plain text only"),
    ("<p>one<p>two<br>three</p>", "one\ntwo\nthree", "one\ntwo\nthree", "one\ntwo\nthree"),
    ("a<h4>b</h4>c<section>d</section>", "a\nbc\nd", "abcd", "abcd"),
    ("<head><style>p{}</style></head><body>a &amp; b &lt;c&gt; &#233;</body>", "a & b <c> é", "a & b <c> é", "p{}a & b <c> é"),
    ("x<script>if (a < b) { y = '<p>'; }</script>z", "xz", "xz", "xif (a < b) { y = '<p>'; }z"),
    ("x<!-- <p>no</p> -->y", "xy", "xy", "xy"),
    ("a<noscript>hidden</noscript>b", "ab", "ahiddenb", "ahiddenb"),
    ("x<img alt=' pic ' src='a.png'>y", "x\n[image] pic\ny", "x\n[image] pic\ny", "x\n[image] pic\ny"),
    ("x<img src=b.png>y", "xy", "xy", "xy"),
    ('<a href="x" title="a > b">link</a> tail', "link tail", "link tail", "link tail"),
    ("<div><div>deep</div>\n\n\n\n</div>end", "deep\n\nend", "deep\n\nend", "deep\n\nend"),
    ("<STYLE>b</STYLE><P>Upper</P>&nbsp;&nbsp;x", "Upper x", "Upper x", "b\nUpper x"),
]
READERS = (H.text_for_index, H.text_for_page_search, H.text_for_distiller)


@pytest.mark.parametrize("reader", range(3))
def test_pages(evaluate, reader):
    assert evaluate(READERS[reader], *(p[0] for p in PAGES)) == [p[1 + reader] for p in PAGES]


def test_import_text(evaluate):
    assert evaluate(H.text_for_import, "<p>one </p> <p>two</p>", "a<br>b", "") == ["one\ntwo", "a\nb", ""]


@pytest.fixture(scope="module")
def given(spark):
    return [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]


@pytest.mark.parametrize("reader", range(3))
def test_what_holds_for_any_page(evaluate, given, reader):
    for page, text in zip(given, evaluate(READERS[reader], *given), strict=True):
        assert text == text.strip() and "\n\n\n" not in text and "\xa0" not in text and "  " not in text
        if reader < 2:
            assert not re.search(r"</?(p|div|a|li|h1|body|script)\b[^>]*>", text)
            for script in re.findall(r"(?s)<(?:script|style)[^>]*>(.{20,}?)</(?:script|style)>", page):
                assert script.strip() not in text
        words = re.findall(r"<p>([a-zA-Z]{4,}) ", page)
        assert all(w in text for w in words)


def test_mail_text(evaluate):
    mail = "<style>x</style><p>a<br>b</p><script>\n1 < 2\n</script><td>c</td>&amp;&nbsp;d"
    assert evaluate(H.text_for_mail, mail) == ["a\nb\n c & d"]


def test_meta_and_attachments(evaluate):
    page = ('<html><head><title> A &amp; B </title><meta name="X-Original-Page-Id" content="p1"><meta content="7" name="n">'
            '<meta name="n" content="8"></head><body>x<img src="i.png"><embed src=\'d.pdf\'><img src="i.png"></body></html>')
    assert evaluate(H.title, page) == ["A & B"]
    assert evaluate(H.meta, page) == [{"X-Original-Page-Id": "p1", "n": "8"}]
    assert evaluate(H.attachments, page) == [["i.png", "d.pdf"]]
    assert evaluate(H.links, "<a href='/x'>1</a><a name=q>2</a><A HREF=\"y.html\">3</A>") == [["/x", "y.html"]]
