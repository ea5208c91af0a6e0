"""Postings by anchors and nearest cards."""

import re

import oracle
import pytest

from siftwell.functions.cards import PostingRules, read_postings
from siftwell.plans import catalog
from siftwell.plans.sources import PAGE_RULES

RULES = PostingRules(title=r"engineer|analyst", noise=r"senior|\.$", card=r"duties", elsewhere=r"^/news", skip="intern", hosts=frozenset(("video.example.com",)))
BASE = "https://x.example.com/jobs/"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<a href="1">· Data  <b>Engineer</b></a>', [("Data Engineer", BASE + "1", "detail"), ("Engineer", BASE + "1", "detail")]),
        ('<a href="#">Data Engineer</a>', [("Data Engineer", BASE, "list")]),
        ('<a href="JavaScript:x()">Data Engineer</a>', [("Data Engineer", BASE, "list")]),
        ('<a href="/news/1">Data Engineer</a>', []),
        ('<a href="https://video.example.com/1">Data Engineer</a>', []),
        ('<a href="1">Senior Engineer</a><a href="2">Engineer.</a><a href="3">Eng</a>', []),
        ('<a href="1">Engineer one</a><a href="2">Engineer one</a>', [("Engineer one", BASE + "1", "detail")]),
        # a text's own words are a title where the anchor's aren't
        (f'<a href="1"><i>Engineer two</i>{"word " * 20}</a>', [("Engineer two", BASE + "1", "detail")]),
        (f'<a href="1"><i>Engineer two</i>intern {"word " * 20}</a>', []),
        # nested cards: the inner one decides
        ('<div>duties <a href="9">view</a><div><h3>Engineer</h3><p>duties</p><a href="4">View</a></div></div>', [("Engineer", BASE + "4", "detail")]),
        # unclosed cards end with the element around them
        ('<ul><li><div><h3>Engineer</h3>duties<a href="5">apply</ul><a href="6">apply</a>', [("Engineer", BASE + "5", "detail")]),
        ("</div></p><div><h3>Engineer</h3>duties</div>", [("Engineer", BASE, "list")]),
        # a nearest card without a link to details isn't replaced by one around it
        ('<div><div><h3>Engineer</h3>duties</div><a href="7">apply</a></div>', [("Engineer", BASE, "list")]),
        ('<div><h3>Engineer</h3>duties <a href="/news/1">view</a><a href="8">other</a><a href="9">details</a></div>', [("Engineer", BASE + "9", "detail")]),
        (f'<div><h3>Engineer</h3>duties {"x" * 1600}<a href="9">details</a></div>', [("Engineer", BASE, "list")]),
        ("<div>" * 7 + "<h3>Engineer</h3>" + "</div>" * 6 + 'duties <a href="9">details</a></div>', [("Engineer", BASE, "list")]),
        ("<div>" * 6 + "<h3>Engineer</h3>" + "</div>" * 5 + 'duties <a href="9">details</a></div>', [("Engineer", BASE + "9", "detail")]),
        ("<script>Engineer</script><style>Engineer</style><noscript><p>Engineer</p></noscript><!-- Engineer -->", []),
        ('<p>Engineer<br>Analyst<img src="x"></p>', [("Engineer", BASE, "list"), ("Analyst", BASE, "list")]),
        ('<a href="http://[x">Engineer</a>', []),
        ("<a href>Engineer</a>", [("Engineer", BASE, "list")]),
        ("", []),
        (None, []),
    ],
)
def test_golden(html, want):
    assert read_postings(html, BASE, RULES) == want


def test_deep_pages():
    html = "<b><i></u>" * 50_000 + "Engineer" + "</i>" * 20_000
    assert read_postings(html, BASE, RULES) == [("Engineer", BASE, "list")]


def test_pages_by_plain_reading(spark):
    """Every simple anchor of the test's pages, read with one pattern, is there with its address, and no title is there twice."""
    got = {}
    for r in catalog.queries()["s20b_page_postings"](spark, oracle.FOLDER).collect():
        assert (r.page_id, r.title) not in got
        got[r.page_id, r.title] = (r.url, r.kind)
    from urllib.parse import urljoin

    seen, kinds = set(), {k for _, k in got.values()}
    for p in spark.read.parquet(f"{oracle.FOLDER}/pages.parquet").collect():
        for href, text in re.findall(r'<a href="([^"]*)">([^<&]*)</a>', p.html or ""):
            fits = 4 <= len(text) <= 40 and re.search(PAGE_RULES.title, text, re.I) and not re.search(PAGE_RULES.noise, text, re.I)
            if fits and href not in ("", "#") and not re.search(PAGE_RULES.elsewhere, href, re.I) and (p.page_id, text) not in seen:
                seen.add((p.page_id, text))
                assert got[p.page_id, text] == (urljoin(p.url, href), "detail")
    assert len(seen) > 100 and kinds == {"detail", "list"}
