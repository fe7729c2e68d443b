"""Pages taken apart: malformed markup, linear time, and the same text as another parser on well-formed pages."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm import html_text, markup


def shown(html):
    return [(k, x) if k == "text" else (k, x, a) for k, x, a in markup.tokens(html)]


@pytest.mark.parametrize("html, want", [
    ("<p>a<![ x</p>b", [("start", "p", []), ("text", "a"), ("text", "b")]),
    ("<p>x <![foo bar</p>", [("start", "p", []), ("text", "x ")]),
    ("a<![CDATA[b]]>c", [("text", "a"), ("text", "c")]),
    ("a<!-->b<!--->c<!-- x -->d<!-- y --!>e<!-- open", [("text", x) for x in "abcde"]),
    ("a</>b</ x>c</", [("text", "a"), ("text", "b"), ("text", "c"), ("text", "</")]),
    ("1 < 2 <3<", [("text", "1 "), ("text", "<"), ("text", " 2 "), ("text", "<"), ("text", "3"), ("text", "<")]),
    ("<A HREF='x>y' b=\"1&amp;2\" c=d/e f>t</A z='>'>u", [("start", "a", [("href", "x>y"), ("b", "1&2"), ("c", "d/e"), ("f", "")]), ("text", "t"), ("end", "a", []), ("text", "u")]),
    ("<br/>x<p / >y<i a=/>z", [("empty", "br", []), ("text", "x"), ("start", "p", []), ("text", "y"), ("start", "i", [("a", "/")]), ("text", "z")]),
    ("<script>a</b>&amp;</scriptx></SCRIPT >b", [("start", "script", []), ("text", "a</b>&amp;</scriptx>"), ("end", "script", []), ("text", "b")]),
    ("<title>a&amp;<b></title>c<style>open", [("start", "title", []), ("text", "a&<b>"), ("end", "title", []), ("text", "c"), ("start", "style", []), ("text", "open")]),
    ("x<?php echo?>y<!doctype html>z<div a='open", [("text", "x"), ("text", "y"), ("text", "z")]),
])
def test_tokens(html, want):
    assert shown(html) == want


@pytest.mark.parametrize("unit", ["<a ", "<!--x", "<![ ", "<!", "</", "</a ", "<div a='", '<div a="x\' ', "<a b=", "&", "&#", "&#x1", "<", "<?", "<script>", "<title><", "</script", "<p", "<a/", "<p>x", "<!--->", "--!>", "<a b='c'd=", " =", "<x =", "\x00<\x00", "<b>", "<ul><li>"])
def test_a_megabyte_of_anything_in_seconds(unit):
    model = html_text.default_model()
    html = "<article><p>Some words that stand at the front of it.</p></article>" + unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    assert isinstance(model.text(html), str)
    assert time.perf_counter() - began < 30


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "<p>", "</p>", "<!--", "-->", "<![", "<!", "<?", "</", "'", '"', "=", " ", "a", "b c", "&amp", "&lt;", "/", "<a href=", "<script>", "</script>", "<td>", "<li>", "<br/>", "\n", "é"]), max_size=40))
def test_random_markup_never_fails(parts):
    html = "".join(parts)
    text = "".join(x for k, x, _ in markup.tokens(html) if k == "text")
    if "<" not in html:
        assert [(k, x) for k, x, _ in markup.tokens(html)] == ([("text", __import__("html").unescape(html))] if html else [])
    assert len(text) <= len(html) + 2
    html_text.blocks(html)


class Other(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("start", tag, [(k, v or "") for k, v in attrs]))

    def handle_endtag(self, tag):
        self.found.append(("end", tag, []))

    def handle_data(self, data):
        self.found.append(("text", data, []))


words = st.text(alphabet="abc é\n", min_size=1, max_size=8).map(lambda s: s.replace("<", ""))


@st.composite
def page(draw, depth=0):
    out = []
    for _ in range(draw(st.integers(0, 4))):
        kind = draw(st.integers(0, 4 if depth < 4 else 1))
        if kind == 0:
            out.append(draw(words))
        elif kind == 1:
            out.append(draw(st.sampled_from(["<!-- note -->", "<br>", "&eacute;", "<img src='x' alt=\"y z\">"])))
        else:
            tag = draw(st.sampled_from(["div", "p", "b", "li", "table"]))
            attrs = draw(st.sampled_from(["", " class='a b'", ' id="x"', " hidden", " data-x=1 y"]))
            out.append(f"<{tag}{attrs}>{draw(page(depth + 1))}</{tag}>")
    return "".join(out)


def joined(found):
    out = []
    for kind, x, attrs in found:
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + x, [])
        else:
            out.append((kind, x, attrs))
    return out


@settings(max_examples=200, deadline=None)
@given(page())
def test_as_another_parser_on_well_formed_pages(html):
    other = Other()
    other.feed(html)
    other.close()
    assert joined(markup.tokens(html)) == joined(other.found)
