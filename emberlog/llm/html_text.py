"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is parsed into leaf blocks: stretches of text that no block-level tag interrupts. Scripts, styles, form
controls and the like hold no text. An element knows its parent and shares what is known of its ancestors with it,
so that nesting of any depth costs no more than the page is long. Each block has features of its ancestors' tags
and class words, of its text, and of the box it stands in (the nearest div, section, cell or the like) and the box
around that: its share of the page, its links, headings and number of blocks. Neighbours are tied by transition
weights. Weights are trained by gradient ascent on the regularised log-likelihood of labelled pages, a block's label
being whether it is main text, and a page is decoded by Viterbi's algorithm.

Labelled pages. The corpus has none, so pages are made, with labels known from the making: `labelled_pages` from
containers of articles and of boilerplate under usual tags and names, and `varied_pages`, where names are random or
missing in two of three pages, tags are plain divs in half of them, and columns, depth and what stands within an
article differ, so that box, text and place must tell. `fit` takes any other list. They are few and fixed, so
training doesn't grow with the input.

Output. White space inside a block becomes one space, blocks are joined by two newlines in page order.

Defined results. Null and empty pages, and pages without main text, give an empty text. Unclosed, crossed and
unknown tags are tolerated as browsers do; what is left open at the end of a page is dropped (see `markup`). Repeated rows each have their row. An empty table gives an empty
result. Extra columns aren't read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import markup
from emberlog.llm.common import pick, table

#: HTML's block-level elements, those whose content isn't shown text, and those without content.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = set("script style noscript template iframe object svg math canvas audio video select textarea button title datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes first, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SPACE, LEAST = re.compile(r"\s+"), 5


#: Elements that hold a part of a page; a cell does for what stands in it, but for its own text.
BOXES = set("address article aside body center details dialog div fieldset footer form header main menu nav section".split())
CELLS = {"td", "th"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    """An open element. above: names of the features of it and its ancestors; box: of what stands in it; outer: the box around that."""

    __slots__ = ("tag", "above", "own", "own_box", "box", "outer")

    def __init__(self, tag: str, above: frozenset[str], parent: Node | None):
        self.tag, self.above = tag, above
        self.own = tag if tag in BLOCK or parent is None else parent.own
        around, outer = (parent.box, parent.outer) if parent is not None else (None, None)
        self.box, self.outer = (self, around) if tag in BOXES or tag in CELLS or parent is None else (around, outer)
        self.own_box = self if tag in BOXES or parent is None else around if tag in BLOCK else parent.own_box


class Block(NamedTuple):
    """A leaf block; linked: its characters within links."""

    node: Node
    text: str
    linked: int


class _Blocks:
    """blocks: the leaf blocks; names: the class words that matter, all where it is None."""

    def __init__(self, names: set[str] | None = None):
        self.names, self.root = names, Node("none", frozenset(), None)
        self.stack: list[Node] = []
        self.at: dict[str, list[int]] = {}  # places in the stack of each open tag
        self.blocks_at: list[int] = []
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.linked, self.hidden, self.links = 0, 0, 0

    def flush(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.blocks.append(Block(self.stack[-1] if self.stack else self.root, text, self.linked))
            self.text, self.linked = [], 0

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks_at.pop()
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"

    def last(self, tags) -> int:
        """Place of the innermost open one of the tags, -1 without."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def start(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            if (k := self.last(("p",))) >= 0:
                self.cut(k)
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                if (k := self.last(ends)) > self.last(within):
                    self.cut(k)
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        own = {f"under={tag}"} if tag in BLOCK and tag not in ("html", "body") else set()
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                own.update(f"name={w}" for w in re.findall(r"[a-z]+", v.lower()) if self.names is None or w in self.names)
        parent = self.stack[-1] if self.stack else self.root
        above = parent.above if own <= parent.above else parent.above | own
        if tag in BLOCK:
            self.blocks_at.append(len(self.stack))
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Node(tag, above, parent))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def end(self, tag):
        if tag in BLOCK:
            self.flush()
        k = self.last((tag,))
        if k >= 0 and (tag in BLOCK or not self.blocks_at or self.blocks_at[-1] < k):  # an inline end tag doesn't leave its block
            self.cut(k)

    def data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None, names: set[str] | None = None) -> list[Block]:
    parser = _Blocks(names)
    for kind, x, attrs in markup.tokens(html or ""):
        if kind == "text":
            parser.data(x)
        elif kind == "end":
            parser.end(x)
        else:
            parser.start(x, attrs)
            if kind == "empty" and x in HIDDEN:
                parser.end(x)
    parser.flush()
    return parser.blocks


def _links(linked: int, chars: int) -> str:
    share = linked / max(1, chars)
    return "none" if share < 0.05 else "some" if share < 0.5 else "most"


def _share(x: float) -> int:
    return (x >= 0.02) + (x >= 0.1) + (x >= 0.3) + (x >= 0.6)


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features of each block, but for those of its node's `above`."""
    inside: dict[Node, list] = {}  # box -> [characters, linked, blocks, headings] of the blocks in it
    around: dict[Node, list] = {}  # the same of a box and the boxes in it
    for node, text, linked in page:
        box = node.own_box or node
        outer = box.outer or box
        for held in (inside.setdefault(box, [0, 0, 0, set()]), around.setdefault(box, [0, 0, 0, set()]), *([around.setdefault(outer, [0, 0, 0, set()])] if outer is not box else [])):
            held[0] += len(text)
            held[1] += linked
            held[2] += 1
            if node.own in HEADINGS:
                held[3].add(node.own)
    total = sum(len(b.text) for b in page)
    most = max((x[0] for x in inside.values()), default=0)

    def of(name: str, held: list) -> list[str]:
        chars, linked, n, heads = held
        head = "h1" if "h1" in heads else "h" if heads else "none"
        return [f"{name}.share={_share(chars / total)}", f"{name}.links={_links(linked, chars)}", f"{name}.head={head}", f"{name}.n={min(n.bit_length(), 4)}", f"{name}.each={min((chars // n).bit_length() // 2, 5)}"]

    known: dict[Node, list[str]] = {}
    for box, held in inside.items():
        known[box] = of("box", held) + of("outer", around[box.outer or box]) + of("all", around[box]) + ["box.most"] * (held[0] == most)
    out, top, seen = [], len(page) - 1, "before" if any(b.node.own == "h1" for b in page) else "no"
    words = [min((b.text.count(" ") + 1).bit_length(), 7) for b in page]
    links = [_links(b.linked, len(b.text)) for b in page]
    for i, (node, text, _) in enumerate(page):
        own, box = node.own, node.own_box or node
        if own == "h1":
            seen = "after"
        f = ["bias", f"own={own}", f"words={words[i]}", f"links={links[i]}", f"words,links={words[i]},{links[i]}", f"ends={text[-1] in '.!?…:\"»”'}", f"place={5 * i // (top + 1)}", f"h1={seen}"]
        f += [f"own,head={own},{k}" for k in known[box][2:3]]
        f += [f"next={words[i + 1]},{links[i + 1]}", f"next.box={(page[i + 1].node.own_box or page[i + 1].node) is box}"] if i < top else ["last"]
        f += [f"before={words[i - 1]},{links[i - 1]}", f"before.box={(page[i - 1].node.own_box or page[i - 1].node) is box}"] if i else ["first"]
        f += ["rights"] * ("©" in text[:40])
        out.append(f + known[box])
    return out


class Model:
    """weights: by feature, of main less other; moves[a, b]: of label b after a."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.names = {f.removeprefix("name=") for f in weights if f.startswith("name=")}

    def scores(self, page: list[Block]) -> np.ndarray:
        get, shared = self.weights.get, {}
        for b in page:
            if b.node.above not in shared:
                shared[b.node.above] = sum(get(f, 0.0) for f in b.node.above)
        return np.array([shared[b.node.above] + sum([get(f, 0.0) for f in fs]) for b, fs in zip(page, features(page), strict=True)])

    def labels(self, page: list[Block]) -> list[int]:
        """Viterbi: the best labelling, 1 for main text."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        back, a, b = [], 0.0, 0.0
        for k, s in enumerate(self.scores(page).tolist()):
            if k == 0:
                a, b = 0.0, s
                continue
            to0, to1 = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 > b + m11 else 1)
            a, b = (a + m00, b + m10)[to0], (a + m01, b + m11)[to1] + s
            back.append((to0, to1))
        at = int(b > a)
        out = [at]
        for step in reversed(back):
            at = step[at]
            out.append(at)
        return out[::-1]

    def text(self, html: str | None) -> str:
        page = blocks(html, self.names)
        return "\n\n".join(b.text for b, y in zip(page, self.labels(page), strict=True) if y)


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = 200, rate: float = 0.1, decay: float = 0.002) -> Model:
    """Trains on (blocks, labels) by Adam on the mean negative log-likelihood of a page, by the forward-backward algorithm.

    Class words of fewer than `LEAST` pages tell nothing of others and are left out. All pages go through a step together, longest first, so that those still going on at place t are the first left[t].
    """
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    ids: dict[str, int] = {}
    flat, owner, n = [], [], 0
    held = Counter(f for page, _ in pages for f in {f for b in page for f in b.node.above if f.startswith("name=")})
    for page, _ in pages:
        for b, fs in zip(page, features(page), strict=True):
            own = [ids.setdefault(f, len(ids)) for f in [*fs, *sorted(f for f in b.node.above if held.get(f, LEAST) >= LEAST)]]
            flat += own
            owner += [n] * len(own)
            n += 1
    flat, owner = np.array(flat, np.int64), np.array(owner, np.int64)
    sizes = np.array([len(p) for p, _ in pages], np.int64)
    y = np.array([v for _, labels in pages for v in labels], np.int64)
    many, longest = len(pages), int(sizes.max(initial=0))
    who, when = np.repeat(np.arange(many), sizes), np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = [int((sizes > t).sum()) for t in range(longest)]
    told = np.zeros((2, 2))
    inner = np.flatnonzero(when > 0)
    np.add.at(told, (y[inner - 1], y[inner]), 1)
    w, moves = np.zeros(len(ids)), np.zeros((2, 2))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, moves)]
    for step in range(1, rounds + 1):
        s = np.zeros((longest, many, 2))
        s[when, who, 1] = np.bincount(owner, w[flat], n)
        fwd, bwd, pair = s.copy(), np.zeros_like(s), np.zeros((2, 2))
        for t in range(1, longest):
            k = left[t]
            fwd[t, :k] += np.logaddexp(fwd[t - 1, :k, :1] + moves[0], fwd[t - 1, :k, 1:] + moves[1])
        for t in range(longest - 2, -1, -1):
            k = left[t + 1]
            x = moves + (s[t + 1, :k] + bwd[t + 1, :k])[:, None, :]
            bwd[t, :k] = np.logaddexp(x[..., 0], x[..., 1])
        z = np.logaddexp(*fwd[sizes - 1, np.arange(many)].T)
        for t in range(longest - 1):
            k = left[t + 1]
            pair += np.exp(fwd[t, :k, :, None] + moves + (s + bwd)[t + 1, :k, None, :] - z[:k, None, None]).sum(axis=0)
        p = np.exp(fwd + bwd - z[:, None])[when, who, 1]
        grads = (np.bincount(flat, (p - y)[owner], len(w)) / many + decay * w, (pair - told) / many + decay * moves)
        for x, g, (m, v) in zip((w, moves), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(w[i]) for f, i in ids.items()}, moves)


#: Names that the layouts of labelled pages draw from.
MAIN = [("article", ""), ("main", ""), ("article", "post"), ("div", "article"), ("div", "content"), ("div", "post-body"), ("section", "story"), ("div", "entry-content"), ("main", "content")]
PARTS = {
    "menu": [("nav", ""), ("nav", "menu"), ("div", "navbar"), ("ul", "menu"), ("div", "breadcrumb")],
    "header": [("header", ""), ("div", "header"), ("div", "banner"), ("div", "masthead")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "copyright")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("section", "related"), ("div", "widget")],
    "notice": [("div", "cookie-notice"), ("div", "notice"), ("div", "alert"), ("div", "consent")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "sponsored"), ("div", "promo")],
    "form": [("form", ""), ("form", "search"), ("div", "newsletter"), ("form", "login")],
    "comments": [("section", "comments"), ("div", "comments"), ("ol", "comment-list"), ("div", "reader-comments")],
}


def labelled_pages(n: int = 160, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """n made pages as (blocks, labels)."""
    rng = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice("aeiounrstlmdc") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int, hi: int) -> str:
        return words(lo, hi).capitalize() + rng.choice("...!?")

    def held(tag: str, name: str, body: str) -> str:
        return f'<{tag} {rng.choice(("class", "id"))}="{name}">{body}</{tag}>' if name else f"<{tag}>{body}</{tag}>"

    def boiler(kind: str) -> str:
        tag, name = rng.choice(PARTS[kind])
        if kind == "menu":
            body = "".join(f'<li><a href="#">{words(1, 2)}</a></li>' for _ in range(rng.randint(2, 8)))
            body = body if tag == "ul" else f"<ul>{body}</ul>"
        elif kind == "comments":
            item = "li" if tag == "ol" else rng.choice(("div", "p"))
            body = "".join(f"<{item}>{sentence(3, 40)}</{item}>" for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            body = f"<label>{words(1, 3)}</label><input><p>{sentence(2, 12)}</p>"
        elif kind == "footer":
            body = f"&copy; {words(1, 3)} &middot; {sentence(1, 25)}" if rng.random() < 0.7 else f"<p>{sentence(3, 20)}</p>"
        else:
            body = sentence(2, 30) if rng.random() < 0.6 else "".join(f"<p>{sentence(2, 25)}</p>" for _ in range(rng.randint(1, 3)))
        return held(tag, name, body)

    def main() -> str:
        out = [f"<h1>{words(2, 10)}</h1>"]
        for _ in range(rng.randint(1, 12)):
            x = rng.random()
            out.append(f"<p>{sentence(1, 80)}" + "</p>" * (x < 0.9) if x < 0.8 else f"<h2>{words(1, 6)}</h2>" if x < 0.86 else "<ul>" + "".join(f"<li>{sentence(1, 12)}</li>" for _ in range(3)) + "</ul>" if x < 0.92 else f"<blockquote>{sentence(3, 30)}</blockquote>" if x < 0.96 else f"<p><b>{sentence(2, 20)}<br>")
        return held(*rng.choice(MAIN), "".join(out))

    out = []
    for _ in range(n):
        before = [k for k in ("header", "menu", "notice", "advert", "sidebar", "form") if rng.random() < 0.45]
        after = [k for k in ("comments", "sidebar", "advert", "form", "notice", "menu", "footer") if rng.random() < 0.4]
        pieces = [*((boiler(k), 0) for k in before), (main(), 1), *((boiler(k), 0) for k in after)]
        page = blocks("<body>" + "".join(x for x, _ in pieces) + "</body>")
        labels = [y for x, y in pieces for _ in blocks(x)]
        out.append((page, labels))
    return out


MARK = "\ue000"  # before each text of an article while a page is made


def varied_pages(n: int = 480, seed: int = 17) -> list[tuple[list[Block], list[int]]]:
    """n made pages as (blocks, labels), in layouts that tags and names alone don't tell apart."""
    rng = random.Random(seed)
    some = lambda p: rng.random() < p

    def word() -> str:
        return "".join(rng.choice("aeiounrstlmdcghpbvkw") for _ in range(rng.randint(2, 9)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int, hi: int) -> str:
        return words(lo, hi).capitalize() + rng.choice(["."] * 6 + ["!", "?", ""])

    def link(lo: int = 1, hi: int = 4) -> str:
        return f'<a href="/{word()}">{words(lo, hi)}</a>'

    def page() -> str:
        plain, named = some(0.5), rng.choice(["usual", "random", "none"])

        def held(kind: str, body: str) -> str:
            tag, name = rng.choice(MAIN if kind == "main" else PARTS[kind])
            if plain and tag not in ("ul", "ol"):
                tag = "div"
            if kind == "menu" and tag == "ul":
                tag = "nav" if not plain else "div"
            name = {"usual": name, "random": word(), "none": ""}[named]
            return f'<{tag} {rng.choice(("class", "id"))}="{name}">{body}</{tag}>' if name else f"<{tag}>{body}</{tag}>"

        def wrapped(body: str, most: int = 3) -> str:
            for _ in range(rng.randint(0, most)):
                body = f'<div class="{word()}">{body}</div>' if some(0.5) else f"<div>{body}</div>"
            return body

        def listed(items: list[str]) -> str:
            tag = rng.choice(("ul", "ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{x}" + "</li>" * some(0.8) for x in items) + f"</{tag}>"

        def links() -> str:
            items = [link() for _ in range(rng.randint(2, 9))]
            return listed(items) if some(0.7) else rng.choice((" | ", " ", "")).join(items)

        def comments() -> str:
            def one() -> str:
                who = rng.choice((f"<b>{words(1, 2)}</b>", f"<div>{link(1, 2)}</div>", f"<span>{words(1, 2)} &middot; {rng.randint(1, 28)}</span>"))
                said = "".join(f"<p>{sentence(2, 30)}</p>" for _ in range(rng.randint(1, 2))) if some(0.7) else sentence(2, 30)
                return f"{who}{said}" + (link(1, 1) if some(0.4) else "")

            items = [one() for _ in range(rng.randint(1, 6))]
            head = f"<h{rng.choice('234')}>{words(1, 3)}</h{rng.choice('234')}>" if some(0.6) else ""
            return head + (listed(items) if some(0.3) else "".join(f"<div>{x}</div>" for x in items))

        def boiler(kind: str) -> str:
            if kind == "menu":
                body = links()
            elif kind == "comments":
                body = comments()
            elif kind == "form":
                body = f"<label>{words(1, 3)}</label><input>" + (f"<p>{sentence(2, 12)}</p>" if some(0.5) else words(1, 6)) + "<button>x</button>"
            elif kind == "footer":
                body = "".join(rng.sample([f"<p>&copy; {rng.randint(1990, 2030)} {words(1, 4)}</p>", links(), f"<p>{sentence(3, 25)}</p>", f"{words(1, 5)} &middot; {words(1, 5)}"], rng.randint(1, 3)))
            elif kind == "sidebar":
                head = f"<h3>{words(1, 3)}</h3>" if some(0.7) else ""
                body = head + (links() if some(0.6) else "".join(f"<p>{sentence(2, 20)}</p>" for _ in range(rng.randint(1, 3))))
            elif kind == "header":
                body = rng.choice((link(1, 3), f"<p>{words(1, 4)}</p>", f"<div>{link(1, 3)}</div><div>{words(2, 7)}</div>", words(1, 4)))
            else:
                body = sentence(2, 25) if some(0.5) else f"<p>{sentence(2, 25)}</p>" + (link(1, 2) if some(0.5) else "")
            return held(kind, body)

        def said(text: str) -> str:
            if some(0.25) and text.count(" ") > 8:
                cut = text.split(" ")
                at = rng.randint(1, len(cut) - 3)
                text = " ".join([*cut[:at], f'<a href="/{word()}">{cut[at]}</a>', *cut[at + 1 :]])
            return MARK + text

        def article() -> str:
            p = "div" if some(0.08) else "p"
            out = [f"<h1>{MARK}{words(2, 10)}</h1>" if some(0.85) else f"<h2>{MARK}{words(2, 10)}</h2>"] * some(0.93)
            for _ in range(rng.randint(1, 12)):
                x = rng.random()
                if x < 0.78 or p == "div":
                    out.append(f"<{p}>{said(' '.join(sentence(1, 30) for _ in range(rng.randint(1, 3))))}" + f"</{p}>" * (p == "div" or some(0.9)))
                elif x < 0.84:
                    out.append(f"<h{(k := rng.choice('23'))}>{MARK}{words(1, 6)}</h{k}>")
                elif x < 0.89:
                    out.append(listed([MARK + sentence(1, 14) for _ in range(rng.randint(2, 6))]))
                elif x < 0.92:
                    out.append(f"<blockquote>{said(sentence(3, 40))}</blockquote>" if some(0.5) else f"<blockquote><p>{said(sentence(3, 40))}</p></blockquote>")
                elif x < 0.94:
                    out.append("<table>" + "".join(f"<tr><td>{MARK}{words(1, 3)}</td><td>{MARK}{words(1, 3)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>")
                elif x < 0.96:
                    out.append(f"<figure><img src='x'><figcaption>{MARK}{sentence(2, 12)}</figcaption></figure>")
                elif x < 0.98:
                    out.append(f"<pre>{MARK}{words(2, 20)}</pre>")
                else:
                    out.append(boiler("advert"))
            body = "".join(out)
            if some(0.15):
                half = len(out) // 2
                body = f"<section>{''.join(out[:half])}</section><section>{''.join(out[half:])}</section>" if half else body
            if some(0.2):
                body += boiler(rng.choice(("comments", "comments", "sidebar", "menu")))
            return held("main", body)

        if some(0.08):  # nothing but an article, or a text
            return article() if some(0.6) else wrapped(f"<p>{MARK}{' '.join(sentence(3, 30) for _ in range(rng.randint(1, 60)))}</p>", 2)
        main = wrapped(article(), 2)
        sides = [boiler(rng.choice(("sidebar", "advert", "form", "sidebar"))) for _ in range(rng.randint(0, 3))]
        if some(0.1):
            cells = [f"<td>{x}</td>" for x in (links(), main, *sides)]
            row = "<table><tr>" + "".join(cells) + "</tr></table>"
        else:
            at = rng.randint(0, len(sides))
            row = wrapped("".join([*sides[:at], main, *sides[at:]]), 2)
        before = "".join(boiler(k) for k in ("header", "menu", "notice", "advert", "form") if some(0.4))
        after = "".join(boiler(k) for k in ("comments", "menu", "advert", "form", "notice", "footer") if some(0.4))
        return f"<html><body>{wrapped(before + row + after, 1)}</body></html>"

    out = []
    for _ in range(n):
        found = blocks(page())
        out.append(([b._replace(text=b.text.removeprefix(MARK)) for b in found], [int(b.text.startswith(MARK)) for b in found]))
    return out


@cache
def default_model() -> Model:
    return fit(labelled_pages() + varied_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [shared.value.text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pick(pages, "page_id", "url", "html")
    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
