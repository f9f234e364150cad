"""Main-text extraction from HTML: gradient-boosted trees over DOM-node features.

A tolerant parser makes a tree of elements. Each element has features of its subtree (text,
link and tag densities), its tag and attribute tokens, its depth and its siblings. Boosted
trees, trained on generated pages whose parts are known, give the chance that the element belongs
to the main text. Decoding goes down the tree: an element is dropped with everything
below it, or kept open, so that no descendant of a dropped element is kept; of all such
choices the one with the highest total likelihood is taken, bottom-up.

What is not shown is no text: scripts, styles, templates, the head, form fields and buttons, and what
stands in for graphics (svg, canvas, object). Text in ``math`` is; its annotations are not. A tag that the
page's end cuts off is markup, not text.

Rows: a null or empty page gives an empty text. Very long and broken pages are parsed whole, in linear
time and without recursion. Repeated rows each get the same result. An empty table gives an
empty result. Extra columns pass through; ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import functools
import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chunkwright.llm.textops import small_batches

# Fixed values of HTML: elements without content, with raw content, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
UNSEEN = frozenset("script style template head title noscript iframe svg object canvas annotation annotation-xml textarea select option button xmp noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Fixed values of HTML: an opening tag ends these open elements, up to the nearest of the limits.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# No part of these patterns is read twice: what a repetition has taken it never gives back.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)>")
_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")

#: Attribute tokens by what they say of an element.
HINTS = {
    "nav": "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs crumbs pagination pager tabs toc skip sitemap topbar".split(),
    "side": "sidebar side aside rail widget widgets related recommend recommended popular trending more teaser also tags tagcloud cloud archive".split(),
    "ad": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted commercial affiliate outbrain taboola dfp adsense".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall toast dialog disclaimer".split(),
    "foot": "footer foot copyright legal colophon bottom imprint".split(),
    "head": "header masthead banner logo branding tagline".split(),
    "form": "form search login signin input register contact poll survey".split(),
    "talk": "comment comments reply replies respond discussion disqus thread responses reviews feedback guestbook".split(),
    "share": "share sharing social follow facebook twitter like buttons toolbar tools print".split(),
    "hide": "hidden hide invisible offscreen sr".split(),
    "main": "article main content post entry story body text news primary blog maincontent articlebody prose".split(),
    "meta": "meta byline author date time posted published info category".split(),
}
_HINT_OF: dict[str, list[int]] = {}
for _k, _names in enumerate(HINTS.values()):
    for _name in _names:
        _HINT_OF.setdefault(_name, []).append(_k)
TAGS = "html body main article section div p h1 h2 h3 ul ol li a nav aside header footer form table tr td blockquote pre figure figcaption span b dl details".split()
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
N_HINTS = len(HINTS)


class Tree:
    """Elements in page order as parallel lists; texts are (element, text) in page order."""

    def __init__(self) -> None:
        self.tag, self.parent, self.attrs, self.breaks = ["#root"], [-1], [""], [[]]
        self.flow: list[tuple[int, str | None]] = []  # text of an element, or None: a block starts or ends here

    def open(self, tag: str, parent: int, attrs: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        return len(self.tag) - 1


def _markup(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(first, last, name, closing, attributes) of each piece of markup; the name is None for comments and the like.

    To go on after a raw element, send the place.
    """
    at, n, quoted = 0, len(page), True
    while (at := page.find("<", at)) >= 0:
        start, after = _START.match(page, at), page[at + 1 : at + 2]
        if start:
            m = _TAG.match(page, at) if quoted else None
            if m:
                end, attrs = m.end(), m[3]
            else:
                # A quote that nothing closes hides all that follows: from here on, quotes count no more.
                quoted = False
                end = page.find(">", at) + 1 or n
                attrs = page[start.end() : end - 1]
            whole = page[end - 1] == ">"
            to = yield at, end, start[2].lower() if whole else None, bool(start[1]), attrs
        elif page.startswith("<!--", at):
            empty = next((x for x in ("<!-->", "<!--->") if page.startswith(x, at)), None)
            m = None if empty else _COMMENT_END.search(page, at + 4)
            to = yield at, at + len(empty) if empty else m.end() if m else n, None, False, ""
        elif after and after in "!?/":
            to = yield at, page.find(">", at) + 1 or n, None, False, ""
        else:
            at += 1
            continue
        at = to


def parse(page: str) -> Tree:
    tree, stack = Tree(), [0]
    flow, tags = tree.flow, tree.tag
    where: dict[str, list[int]] = {}  # places in the stack by tag
    blocks: list[int] = []  # places in the stack of block elements
    absent: set[str] = set()  # raw elements that nothing closes any more

    def close(k: int) -> None:
        for node in stack[k:]:
            if tags[node] in BLOCK:
                flow.append((node, None))
        while len(stack) > k:
            tag = tags[stack.pop()]
            where[tag].pop()
            if tag in BLOCK:
                blocks.pop()

    def last(tag: str) -> int:
        return where[tag][-1] if where.get(tag) else 0

    pieces, at = _markup(page), 0
    piece = next(pieces, None)
    while piece:
        start, end, name, closing, attrs = piece
        if start > at:
            flow.append((stack[-1], page[at:start]))
        if name and closing:
            k = last(name)
            if k and (name in BLOCK or not blocks or k > blocks[-1]):
                close(k)
        elif name:
            if name in _IMPLIED:
                ends, limits = _IMPLIED[name]
                limit = max(map(last, limits))
                low = min((own[i] for t in ends if (own := where.get(t)) and (i := bisect_right(own, limit)) < len(own)), default=len(stack))
                close(low)
            elif name in _CLOSES_P and blocks and tags[stack[blocks[-1]]] == "p":
                close(blocks[-1])
            node = tree.open(name, stack[-1], attrs)
            if name in BLOCK:
                flow.append((node, None))
            if name == "br":
                flow.append((stack[-1], " "))
            if name in RAW and not attrs.endswith("/"):
                found = None if name in absent else _RAW_END[name].search(page, end)
                if found:
                    end = found.end()
                else:
                    absent.add(name)
                    if name in ("script", "style", "textarea", "title", "xmp"):
                        end = len(page)
            elif name not in VOID:
                where.setdefault(name, []).append(len(stack))
                if name in BLOCK:
                    blocks.append(len(stack))
                stack.append(node)
        at = end
        try:
            piece = pieces.send(at)
        except StopIteration:
            piece = None
    if at < len(page):
        flow.append((stack[-1], page[at:]))
    return tree


def hints(attrs: str) -> int:
    """What the attributes say of an element: a bit for each kind of ``HINTS``."""
    return _short_hints(attrs) if len(attrs) < 200 else _hints(attrs)


def _hints(attrs: str) -> int:
    out = 0
    for name, a, b, c in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-component", "data-role", "data-testid"):
            for word in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", html.unescape(a or b or c)).lower()):
                for k in _HINT_OF.get(word, ()):
                    out |= 1 << k
        elif name == "hidden" or name == "aria-hidden" and "true" in (a, b, c) or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a or b or c):
            out |= 1 << 9
    return out


_short_hints = functools.lru_cache(maxsize=8192)(_hints)


NUMERIC = 15
_ASIDE = frozenset("nav aside footer header form".split())
_RIGHTS = re.compile(r"©|&copy;|copyright|all rights reserved|privacy policy|terms of (?:use|service)", re.I)
N_FEATURES = len(TAGS) + 2 * N_HINTS + NUMERIC + 3


def features(tree: Tree) -> np.ndarray:
    """One row for each element."""
    n = len(tree.tag)
    x = np.zeros((n, N_FEATURES))
    own, links, words, stops, kids, nodes, paragraphs, rights = (np.zeros(n) for _ in range(8))
    for node, text in tree.flow:
        if text:
            size = len(text.strip())
            own[node] += size
            words[node] += text.count(" ") if size else 0
            stops[node] += text.count(".") + text.count(",")
            rights[node] += bool(_RIGHTS.search(text))
    tag, parent, attrs = tree.tag, tree.parent, tree.attrs
    chars = own.copy()
    mask, above, inside, article, deep = ([0] * n for _ in range(5))
    for i in range(1, n):
        p, t = parent[i], tag[i]
        if attrs[i]:
            mask[i] = hints(attrs[i])
        above[i] = mask[p] | above[p]
        inside[i] = 1 if t in _ASIDE else inside[p]
        article[i] = 1 if t in ("article", "main") else article[p]
        deep[i] = deep[p] + 1
    np.add.at(kids, parent[1:], 1)
    base, at_numeric, bits = len(TAGS), len(TAGS) + 2 * N_HINTS, np.arange(N_HINTS)
    depth = np.array(deep, float)
    named = [(i, k) for i, t in enumerate(tag) if (k := _TAG_AT.get(t)) is not None]
    if named:
        x[tuple(np.array(named).T)] = 1
    x[:, base : base + N_HINTS] = np.array(mask)[:, None] >> bits & 1
    x[:, base + N_HINTS : at_numeric] = np.array(above)[:, None] >> bits & 1
    x[:, at_numeric + NUMERIC], x[:, at_numeric + NUMERIC + 1] = inside, article
    links += np.where([t == "a" for t in tag], own, 0)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += chars[i] if tag[i] == "a" else links[i]
        words[p] += words[i]
        stops[p] += stops[i]
        nodes[p] += nodes[i] + 1
        rights[p] += rights[i]
        paragraphs[p] += paragraphs[i] + (tag[i] in ("p", "h1", "h2", "h3", "blockquote", "pre"))
    total = max(chars[0], 1)
    order = np.zeros(n)
    seen: dict[int, int] = {}
    for i in range(1, n):
        order[i] = seen[parent[i]] = seen.get(parent[i], 0) + 1
    up = np.maximum(np.array(parent), 0)
    sibling = np.maximum(kids[up], 1)
    x[:, at_numeric : at_numeric + NUMERIC] = np.stack(
        [
            np.log1p(chars), np.log1p(own), np.minimum(links / np.maximum(chars, 1), 1), np.log1p(words), stops / np.maximum(words + 1, 1), np.log1p(nodes), np.log1p(paragraphs),
            chars / total, chars / np.maximum(chars[up], 1), depth, np.log1p(kids), order / sibling, np.log1p(sibling), chars / (nodes + 1), np.minimum(rights, 3),
        ],
        1,
    )
    x[:, -1] = [t in BLOCK for t in tag]
    return x


class Boosted:
    """Gradient-boosted regression trees of fixed depth on quantile-binned features, logistic loss.

    Each tree is grown on a random share of the rows.
    """

    def __init__(self, depth: int = 4, rounds: int = 60, rate: float = 0.25, bins: int = 32, share: float = 0.35) -> None:
        self.depth, self.rounds, self.rate, self.bins, self.share = depth, rounds, rate, bins, share
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        coded = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        width = self.bins + 1
        flat = coded + np.arange(d) * width
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        value, rng = np.full(n, self.start), np.random.default_rng(0)
        for _ in range(self.rounds):
            some = np.sort(rng.choice(n, max(int(n * self.share), 1), replace=False))
            p = 1 / (1 + np.exp(-value[some]))
            g, h = y[some] - p, p * (1 - p)
            wide_g, wide_h, own, xs = np.repeat(g, d), np.repeat(h, d), flat[some], x[some]
            at, every = np.zeros(len(some), np.int64), np.arange(len(some))
            which, edge = np.zeros(2**self.depth, np.int64), np.full(2**self.depth, np.inf)
            for level in range(self.depth):
                leaves = 2**level
                key = (at[:, None] * (d * width) + own).ravel()
                shape = (leaves, d, width)
                sg = np.bincount(key, wide_g, leaves * d * width).reshape(shape).cumsum(2)
                sh = np.bincount(key, wide_h, leaves * d * width).reshape(shape).cumsum(2)
                tg, th = sg[:, :1, -1:], sh[:, :1, -1:]
                gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                gain[(sh < 1) | (th - sh < 1)] = -1
                for j, c in enumerate(cuts):
                    gain[:, j, len(c) :] = -1
                best = gain.reshape(leaves, -1).argmax(1)
                feature, cut = best // width, best % width
                for leaf in range(leaves):
                    node = leaves + leaf
                    which[node] = feature[leaf]
                    if gain[leaf, feature[leaf], cut[leaf]] > 1e-6:
                        edge[node] = cuts[feature[leaf]][cut[leaf]]
                at = at * 2 + (xs[every, which[leaves + at]] > edge[leaves + at])
            out = self.rate * np.bincount(at, g, 2**self.depth) / (np.bincount(at, h, 2**self.depth) + 1)
            self.trees.append((which, edge, out))
            value += out[self._leaf(which, edge, x)]
        return self

    def _leaf(self, which: np.ndarray, edge: np.ndarray, x: np.ndarray) -> np.ndarray:
        at, rows = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = at * 2 + (x[rows, which[at]] > edge[at])
        return at - 2**self.depth

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        value = np.full(len(x), self.start)
        for which, edge, out in self.trees:
            value += out[self._leaf(which, edge, x)]
        return value


_JUNK = sum(1 << k for k, name in enumerate(HINTS) if name not in ("main", "meta", "head"))


def decode(tree: Tree, odds: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which elements are kept: the likeliest choice in which a dropped element's subtree is dropped.

    ``weight`` says how much an element's odds count. An inline element goes the way of its parent
    and its text counts there, unless its attributes say that it is no part of the text.
    """
    n, weight = len(tree.tag), weight.copy()
    tied = np.array([t not in BLOCK and t not in UNSEEN and not (a and hints(a) & _JUNK) for t, a in zip(tree.tag, tree.attrs, strict=True)])
    tied[0] = False
    for i in np.flatnonzero(tied)[::-1].tolist():
        weight[tree.parent[i]] += weight[i]
    gain = np.where(tied, 0.0, odds * weight)
    best = np.zeros(n)
    for i in range(n - 1, 0, -1):
        best[i] += gain[i]
        if tree.tag[i] not in UNSEEN:
            best[tree.parent[i]] += best[i] if tied[i] else max(best[i], 0.0)
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[tree.parent[i]] and tree.tag[i] not in UNSEEN and (tied[i] or best[i] > 0)
    return kept


def text_of(tree: Tree, kept: np.ndarray) -> str:
    """Texts of kept elements: blocks in page order, white space inside a block made one space."""
    blocks, parts = [], []
    for node, text in [*tree.flow, (0, None)]:
        if text is not None:
            if kept[node]:
                parts.append(text)
        elif parts:
            block = _SPACE.sub(" ", html.unescape("".join(parts)))
            if block := " ".join(block.split()):
                blocks.append(block)
            parts = []
    return "\n".join(blocks)


def own_text(tree: Tree, within: float = 0.6) -> np.ndarray:
    """Weights of elements: by their own text, and by a share of what their subtree holds."""
    own = np.zeros(len(tree.tag))
    for node, text in tree.flow:
        if text:
            own[node] += len(text.strip())
    whole = own.copy()
    for i in range(len(own) - 1, 0, -1):
        whole[tree.parent[i]] += whole[i]
    return 0.2 + np.minimum(own, 200) ** 0.5 + within * np.minimum(whole - own, 600) ** 0.5


def extract(page: str | None, model: Boosted) -> str:
    if not page:
        return ""
    tree = parse(page)
    return text_of(tree, decode(tree, model.predict(features(tree)), own_text(tree)))


# Generated training pages. Each part is a piece of HTML with the label of all its elements.


def _sentence(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
    out = words[0].capitalize()
    for w in words[1:]:
        out += rng.choice([" ", " ", " ", " ", " ", ", "]) + w
    return out + rng.choice([".", ".", ".", "?", "!"])


def _prose(rng: random.Random) -> str:
    return " ".join(_sentence(rng, 1, 18) for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))


def _inline(rng: random.Random, text: str) -> str:
    words = text.split(" ")
    if len(words) > 3 and rng.random() < 0.4:
        k = rng.randrange(len(words) - 1)
        tag = rng.choice(["b", "i", "em", "strong", 'a href="/x"', "span", "code"])
        words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
    return " ".join(words)


def _linked(rng: random.Random, text: str) -> str:
    """Prose with several links."""
    words = text.split(" ")
    for k in sorted(rng.sample(range(len(words)), min(len(words), rng.randint(2, 7)))):
        words[k] = f'<a href="/{k}">{words[k]}</a>'
    return " ".join(words)


def _attr(rng: random.Random, kind: str) -> str:
    if rng.random() < 0.15:
        return ""
    if rng.random() < 0.3:
        return _mixed(rng, kind)
    name = rng.choice(HINTS[kind])
    if rng.random() < 0.4:
        name += rng.choice(["-box", "-wrap", "__inner", " block", "-list", "_1"])
    return f' {rng.choice(["class", "class", "id", "role"])}="{name}"'


_PLAIN = "wrapper container site page layout outer row col grid single wide clearfix wp js app root inner section area region".split()


def _mixed(rng: random.Random, kind: str | None) -> str:
    """Several class tokens, as page builders write them: plain ones and, with a kind, one of its own."""
    names = rng.sample(_PLAIN, rng.randint(1, 3))
    if kind:
        names.append(rng.choice([rng.choice(HINTS[kind]), f"{rng.choice(_PLAIN)}-{rng.choice(HINTS[kind])}", f"{rng.choice(HINTS[kind])}-{rng.choice(_PLAIN)}"]))
        rng.shuffle(names)
    return f' class="{" ".join(names)}"'


def _list(rng: random.Random, low: int = 2, high: int = 9) -> str:
    items = "".join(f'<li><a href="/{i}">{_sentence(rng, 1, 3).rstrip(".?!")}</a></li>' for i in range(rng.randint(low, high)))
    return f"<ul>{items}</ul>"


def _junk(rng: random.Random, where: str) -> str:
    kind = rng.choice({"top": ["nav", "head", "notice", "ad", "form", "nav", "hide"], "in": ["ad", "share", "side", "notice", "form", "ad", "hide"], "end": ["foot", "foot", "side", "talk", "ad", "notice", "share", "nav"]}[where])
    if kind == "foot" and rng.random() < 0.2:
        return f"<div>{rng.choice(['&copy; ', 'Copyright 2020 ', '(c) '])}{_sentence(rng, 1, 6)} {rng.choice(['', 'All rights reserved.', '<a href=p>Privacy policy</a>'])}</div>"
    if kind == "nav" and rng.random() < 0.15:
        return "<div>" + " ".join(f'<a href="/{k}">{_sentence(rng, 1, 2).rstrip(".?!")}</a>' for k in range(rng.randint(2, 7))) + "</div>"
    if kind == "hide":
        return f"<div{rng.choice([' hidden', ' style=\"display:none\"', ' style=\"display: none\"', ' aria-hidden=\"true\"'])}>{rng.choice([_prose(rng), f'<p>{_prose(rng)}</p>'])}</div>"
    tag = {"nav": ["nav", "div", "ul"], "head": ["header", "div"], "foot": ["footer", "footer", "div"], "side": ["aside", "div", "section"], "form": ["form", "div"], "talk": ["section", "div", "ol"]}.get(kind, ["div", "div", "section", "aside", "p"])
    tag = rng.choice(tag)
    attr = _attr(rng, kind)
    if not attr and tag in ("div", "section", "p", "ul", "ol"):
        attr = f' class="{rng.choice(HINTS[kind])}"'
    if rng.random() < 0.25 and kind in ("nav", "foot", "side", "form", "head") and tag in ("nav", "footer", "aside", "form", "header"):
        attr = ""
    body = {
        "nav": lambda: _list(rng),
        "head": lambda: f'<a href="/">{_sentence(rng, 1, 3)}</a>' + rng.choice(["", _list(rng), f"<h1>{_sentence(rng, 1, 4)}</h1>", f"<p>{_sentence(rng, 2, 8)}</p>"]),
        "foot": lambda: rng.choice(["&copy; ", "Copyright ", ""]) + _sentence(rng, 2, 14) + rng.choice(["", " &middot; " + _sentence(rng, 2, 14), _list(rng), f"<p>{_prose(rng)}</p>"]),
        "side": lambda: f"<h3>{_sentence(rng, 1, 3)}</h3>" + rng.choice([_list(rng), f"<p>{_prose(rng)}</p>", _list(rng)]),
        "form": lambda: f'<label>{_sentence(rng, 1, 3)}</label><input type="text"><button>{_sentence(rng, 1, 2)}</button>' + rng.choice(["", f"<p>{_prose(rng)}</p>"]),
        "talk": lambda: rng.choice([f"<h2>{_sentence(rng, 1, 3)}</h2><ol>" + "".join(f"<li><p>{_prose(rng)}</p></li>" for _ in range(rng.randint(1, 4))) + "</ol>", ""]) or f"<h3>{_sentence(rng, 1, 2)}</h3>" + "".join(f'<div class="{rng.choice(["comment", "reply", "item"])}"><b>{_sentence(rng, 1, 2)}</b><p>{_prose(rng)}</p></div>' for _ in range(rng.randint(1, 5))),
    }.get(kind, lambda: rng.choice([_prose(rng), f"<p>{_prose(rng)}</p>", f'<a href="/ad">{_sentence(rng, 2, 9)}</a>', f"<h4>{_sentence(rng, 1, 4)}</h4><p>{_prose(rng)}</p>"]))()
    return f"<{tag}{attr}>{body}</{tag}>"


def _main(rng: random.Random, headed: bool) -> list[tuple[str, bool]]:
    """Pieces of the main part with their labels; ``headed``: its title may be in a header of its own."""
    head = rng.choice(["h1", "h1", "h1", "h2", 'h1 class="title"', 'h2 class="entry-title"', 'h1 class="page-title"', 'h1 class="post-header"'])
    parts = [(f"<{head}>{_inline(rng, _sentence(rng, 2, 12))}</{head.split()[0]}>", True)] if rng.random() < 0.85 else []
    if parts and headed and rng.random() < 0.4:
        below = rng.choice(["", f"<p>{_sentence(rng, 2, 20)}</p>", f"<p>{_sentence(rng, 3, 20)}</p>", f"<h2>{_sentence(rng, 2, 9)}</h2>"])
        parts = [(f"<header{rng.choice(['', '', _attr(rng, 'main'), _attr(rng, 'head')])}>{parts[0][0]}{below}</header>", True)]
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
        r = rng.random()
        if r < 0.68:
            text = _linked(rng, _prose(rng)) if rng.random() < 0.2 else _inline(rng, _prose(rng))
            text = f"<b>{text}<br>" if rng.random() < 0.12 else text
            text = rng.choice(["", "", "", "", "", ' class="lead"', ' class="intro text"', ' class="has-drop-cap"']) + ">" + text
            parts.append((f"<p{text}" + ("</p>" if rng.random() < 0.85 else ""), True))
        elif r < 0.76:
            parts.append((f"<h2>{_sentence(rng, 1, 7)}</h2>", True))
        elif r < 0.82:
            tag = rng.choice(["ul", "ol"])
            parts.append((f"<{tag}>" + "".join(f"<li>{_inline(rng, _sentence(rng, 2, 14))}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>", True))
        elif r < 0.86:
            parts.append((f"<blockquote>{_prose(rng)}</blockquote>", True))
        elif r < 0.89:
            parts.append(("<table>" + "".join(f"<tr><td>{_sentence(rng, 1, 4)}</td><td>{_sentence(rng, 1, 4)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>", True))
        elif r < 0.92:
            parts.append((f"<div>{_inline(rng, _prose(rng))}</div>", True))
        elif r < 0.94:
            parts.append((f"<figure><img src='x'><figcaption>{_sentence(rng, 2, 9)}</figcaption></figure>", True))
        else:
            parts.append((_junk(rng, "in"), False))
    return parts


def _page(rng: random.Random) -> str:
    """A page in which ``data-keep`` tells the label of each piece."""

    def mark(piece: str, keep: bool) -> str:
        return re.sub(r"^<([a-z0-9]+)", rf'<\1 data-keep="{int(keep)}"', piece)

    top = "".join(mark(_junk(rng, "top"), False) for _ in range(rng.randint(0, 4)))
    end = "".join(mark(_junk(rng, "end"), False) for _ in range(rng.randint(0, 5)))
    wrap = rng.choice(["article", "article", "main", "div", "div", "section", ""])
    body = "".join(mark(*p) for p in _main(rng, wrap in ("article", "main")))
    if wrap:
        attr = _attr(rng, "main") if wrap in ("div", "section") or rng.random() < 0.3 else ""
        if rng.random() < 0.25:
            cut = body.find("</h") + 5 if "</h" in body[:400] else 0
            body = body[:cut] + f'<div data-keep="1"{_mixed(rng, "main")}>{body[cut:]}</div>'
        body = f'<{wrap} data-keep="1"{attr}>{body}</{wrap}>'
    if rng.random() < 0.35:
        body = f"<{rng.choice(['div', 'main', 'section'])} data-keep=\"1\"{_attr(rng, 'main')}>{body}" + "".join(mark(_junk(rng, "end"), False) for _ in range(rng.randint(0, 2))) + "</div>"
    whole = top + body + end
    if rng.random() < 0.4:
        whole = f'<div data-keep="1"{_mixed(rng, rng.choice([None, None, "main"]))}>{whole}</div>'
    attr = _mixed(rng, rng.choice([None, "main", "side", "talk"])) if rng.random() < 0.3 else ""
    return f"<html><head><title>{_sentence(rng, 2, 8)}</title></head><body{attr}>{whole}</body></html>"


@functools.lru_cache(maxsize=2)
def train(*, pages: int = 900, seed: int = 7) -> Boosted:
    """Trees fitted to generated pages; the same seed gives the same trees."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        tree = parse(_page(rng))
        x, label = features(tree), np.zeros(len(tree.tag))
        label[0] = 1
        for i in range(1, len(tree.tag)):
            own = re.search(r'data-keep="(\d)"', tree.attrs[i])
            label[i] = float(own[1]) if own and label[tree.parent[i]] else label[tree.parent[i]]
        xs.append(x)
        ys.append(label)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def add_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to each row of ``pages`` (html); drops html."""
    small_batches(pages.sparkSession)
    model = model or train()
    pages = pages.drop("text", "n_chars")
    names = [c for c in pages.columns if c.lower() != "html"]
    schema = T.StructType([*(pages.schema[c] for c in names), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = _extract_all(table.column("html").to_pylist(), model)
            table = table.select(names).append_column("text", pa.array(texts, pa.string()))
            yield from table.append_column("n_chars", pa.array([len(t) for t in texts], pa.int64())).to_batches()

    return pages.mapInArrow(run, schema)


def _extract_all(pages: list[str | None], model: Boosted, most_nodes: int = 20_000) -> list[str]:
    """Texts of pages, scored together in runs of about ``most_nodes`` elements."""
    out: list[str] = []
    trees: list[Tree] = []
    size = 0

    def flush() -> None:
        if trees:
            odds = model.predict(np.concatenate([features(t) for t in trees]))
            at = 0
            for t in trees:
                out.append(text_of(t, decode(t, odds[at : at + len(t.tag)], own_text(t))))
                at += len(t.tag)

    for page in pages:
        trees.append(parse(page or ""))
        size += len(trees[-1].tag)
        if size > most_nodes:
            flush()
            trees, size = [], 0
    flush()
    return out
