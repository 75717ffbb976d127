"""Selectors and extraction by rules."""

import pytest

from gramtide.functions import selectors
from gramtide.operators import extraction

PAGE = """<html><head><title>T &amp; t</title><script>x</script>
<script type="application/ld+json">{"@type": "NewsArticle", "headline": "H", "articleBody": "&lt;b&gt;in&lt;/b&gt; json"}</script></head>
<body><div class="node content"><div class="field field--body me-3"><p>one <b>1</b></p><p> </p><p>two<script>no</script></p></div></div>
<div class="field">other</div><a rel="author" href="/x">Ann</a><time datetime="2024-01-02">2 Jan</time><img class="field">
<article id="main"><p>a</p><section><p>b</p></section></article><article><p>c</p></article></body></html>"""


@pytest.mark.parametrize(
    "selector, path, fits",
    [
        ("div p", ["body", "div", "b", "p"], True),
        ("div > p", ["body", "div", "b", "p"], False),
        ("body > div p", ["body", "div", "div", "p"], True),
        ("div > div p", ["div", "p", "div", "p"], False),
        ("section > div p", ["section", "div", "div", "p"], True),
        ("*", ["x"], True),
        ("h1, title", ["head", "title"], True),
    ],
)
def test_paths(selector, path, fits):
    assert selectors.matches([(t, {}) for t in path], selector) == fits


@pytest.mark.parametrize("selector, fits", [("a[rel=me]", True), ("a[rel='me you']", False), ("a[href]", True), ("[href^='/x']", True), ("a[href$=y]", True), ("a[class*=big]", True), ("a.big", False), ("a.bigger.b#i", True), ("a[class~=b]", True), ("A", True), ("a[data-x='p, q > r']", True)])
def test_attributes(selector, fits):
    assert selectors.matches([("a", {"rel": "me", "href": "/x/y", "class": "bigger b", "id": "i", "data-x": "p, q > r"})], selector) == fits


@pytest.mark.parametrize("wrong", ["", "> p", "div >", "a,,b", "p:first", "a[b", ".a..b", "div + p"])
def test_what_is_no_selector(wrong):
    with pytest.raises(ValueError):
        selectors.compiled(wrong)


def _got(**rule):
    return selectors.extract(PAGE, selectors.DEFAULT | rule)


def test_rules_of_a_body():
    assert _got(body="div.node div.field--body.me-3")["contenu"] == "one 1\ntwo"  # one element: its paragraphs
    assert _got(body="div.field")["contenu"] == "one 1 two\nother"  # several: themselves
    assert _got(body="div.field--body > p")["contenu"] == "one 1\ntwo"
    assert _got(body="article")["contenu"] == "a\nb"
    assert _got(body="#main p")["contenu"] == "a\nb"
    assert _got(body="json_ld")["contenu"] == "in json" and _got(body="nothing.here")["contenu"] == ""


def test_rules_of_fields():
    tags = _got(strategy="tags", titre="title", auteur="a[rel=author]", date="time[datetime]")
    assert (tags["titre"], tags["auteur"], tags["date"]) == ("T & t", "Ann", "2024-01-02")
    filled = _got(auteur="a[rel=author]", titre="title")
    assert filled["titre"] == "H" and filled["auteur"] == "Ann" and _got(date="")["date"] == ""
    assert set(selectors.extract(None, selectors.DEFAULT).values()) == {""}


def test_pages_meet_their_rules(spark):
    pages = spark.createDataFrame([(1, "m", PAGE), (2, "none", PAGE), (3, None, PAGE), (4, "m", None), (5, "half", PAGE)], "id int, media string, html string")
    rules = spark.createDataFrame([("m", "tags", "#main", "title", "", ""), ("m", "tags", "#main", "title", "", ""), ("half", None, "div.node", None, None, None)], "media string, strategy string, body string, titre string, auteur string, date string")
    got = {r.id: (r.article.titre, r.article.contenu) for r in extraction.by_rules(pages, rules).collect()}
    assert got == {1: ("T & t", "a\nb"), 2: ("H", "a\nb"), 3: ("H", "a\nb"), 4: ("", ""), 5: ("H", "one 1\ntwo")}
    assert extraction.by_rules(pages.limit(0), rules).count() == 0
