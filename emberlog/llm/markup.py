"""Tags and text of a web page, as browsers take them apart, in time linear in its length, whatever it holds.

What a page leaves open at its end (a tag, a quote, a comment, a declaration) is dropped, as browsers do; each kind ends
the page, so nothing is searched for twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

#: Elements whose content holds no tags.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_name, _skip, _attr, _equals, _bare = re.compile(r"[^\s/>]+"), re.compile(r"[\s/]*"), re.compile(r"[^\s/>][^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]+")
_comment = re.compile(r"--!?>")
_end = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def _attributes(html: str, at: int) -> tuple[int, list[tuple[str, str]], bool]:
    """(where the tag ends, attributes, whether it closes itself) of a tag whose name ends at `at`; -1 if it never ends."""
    found = []
    while True:
        to = _skip.match(html, at).end()
        if to == len(html):
            return -1, found, False
        if html[to] == ">":
            return to + 1, found, to > at and html[to - 1] == "/"
        m = _attr.match(html, to)
        at, value = m.end(), ""
        if eq := _equals.match(html, at):
            at = eq.end()
            quote = html[at : at + 1]
            if quote in ('"', "'") and quote:
                end = html.find(quote, at + 1)
                if end < 0:
                    return -1, found, False
                value, at = html[at + 1 : end], end + 1
            elif bare := _bare.match(html, at):
                value, at = bare[0], bare.end()
        found.append((m[0].lower(), value))


def tokens(html: str) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """(kind, name or text, attributes) in page order; kind is text, start, end, or empty for a tag that closes itself."""
    at = 0
    while at < len(html):
        to = html.find("<", at)
        if to < 0:
            to = len(html)
        if to > at:
            yield "text", unescape(html[at:to]), []
        if to == len(html):
            return
        sign = html[to + 1 : to + 2]
        close = sign == "/"
        first = html[to + 2 : to + 3] if close else sign
        if first.isascii() and first.isalpha():
            m = _name.match(html, to + 1 + close)
            tag = m[0].lower()
            at, attributes, itself = _attributes(html, m.end())
            if at < 0:
                return
            yield "end" if close else "empty" if itself else "start", tag, [] if close else [(k, unescape(v)) for k, v in attributes]
            if tag in RAW and not close and not itself:
                end = _end[tag].search(html, at)
                to = end.start() if end else len(html)
                if to > at:
                    yield "text", unescape(html[at:to]) if tag in ("textarea", "title") else html[at:to], []
                at = to
        elif html.startswith("<!--", to):
            if html.startswith(("<!-->", "<!--->"), to):
                at = html.index(">", to) + 1
            elif end := _comment.search(html, to + 4):
                at = end.end()
            else:
                return
        elif sign in ("!", "?") and sign or close and first:
            at = html.find(">", to + 2) + 1
            if not at:
                return
        else:
            yield "text", "</" if close else "<", []
            at = to + 1 + close
