"""Main text of HTML pages by a tree-structured graphical model.

A page's block elements (and inline ones with a class or id) are nodes of the
DOM tree; each is main content or not. Node potentials weigh tag, names and
text measures, one parent-child potential connects each node with its parent.
Sum-product messages go once up and once down the tree and leave the exact
marginal of every node; text of nodes whose marginal is over one half is kept.
Weights maximise the likelihood of labelled pages, whose gradient needs the
same marginals.

Defined results: null, empty and text-free pages give an empty text; text and
elements outside any body get an implied one, after its end they go on in it; tags left
open are closed by their parents, stray end tags are ignored, unended comments
and scripts run to the end (a comment ends at --> or --!>, and <!--> is one),
svg and math tags that end in /> are empty; nested templates, objects, svg,
math and selects are left out as wholes, but of one that nothing closes only
the tag; a tag with an open quote ends at the next bracket, one that the page
cuts off is left out; very deep trees are fine, as no step recurses; repeated
rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

# Fixed values of HTML: elements by how they are parsed and laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hr main nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
OUTER = frozenset("html head body frameset".split())
SCOPE = frozenset("ul ol dl table body html article aside section nav div main header footer form".split())

TOKEN = re.compile(r"""
    <!--(?:-?>|.*?(?:--!?>|\Z))
  | <(script|style|noscript|iframe|textarea|title)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)
  | <[!?][^>]*(?:>|\Z)
  | <(/?)([a-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
  | <(/?)([a-z][^\s/>]*)([^>]*)(?:>|(?P<cut>\Z))
  | ([^<]++|<)""", re.X | re.S | re.I)
SKIPPED = frozenset("template object svg math select".split())
SKIPPED_TAG = re.compile(r"<(/?)(template|object|svg|math|select)(?=[\s/>])[^>]*>", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|data-y|hidden|aria-label)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# What names say, by group; a group is a feature.
NAMES = {
    "ad": r"ads?|advert\w*|adv|banner|promo\w*|sponsor\w*|outbrain|taboola|commercial",
    "nav": r"nav\w*|menu\w*|breadcrumbs?|pager|paginat\w*|toolbar|tabs?|toc|skip\w*|links?|navigation",
    "head": r"header|masthead|topbar|logo|site-?head\w*|brand\w*|head",
    "foot": r"footer|foot|copyright|legal|colophon|contentinfo|bottom",
    "side": r"side\w*|aside|widgets?|rail|related|recommend\w*|popular|trending|more|teasers?|complementary|readmore",
    "comment": r"comments?|repl(?:y|ies)|disqus|discussion|respond|feedback|reviews?|commentlist",
    "notice": r"cookies?|consent|notices?|popup|modal|overlay|alert|gdpr|newsletter|subscri\w*|signup|paywall|dialog|toast",
    "form": r"forms?|login|search|register|contact|poll|survey|vote",
    "social": r"share|sharing|social|follow|likes?|tweet|tags?|byline|meta|author|dateline|caption|credits?",
    "main": r"article\w*|content|main|posts?|entry|story\w*|body|text|articlebody|page",
}
NAME = re.compile(r"(?<![a-z])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in NAMES.items()) + r")(?![a-z])", re.I)
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "table", "nav", "header", "footer", "aside", "form",
        "blockquote", "pre", "figure", "body", "inline")
ALIKE = {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ol": "ul", "dl": "ul", "dt": "li", "dd": "li", "td": "table", "tr": "table",
         "th": "table", "tbody": "table", "thead": "table", "button": "form", "fieldset": "form", "dialog": "form",
         "figcaption": "figure", "html": "body", "head": "body", "menu": "nav", "center": "div", "details": "section"}
MEASURES = ("links", "own", "all", "sentences", "short", "paragraphs", "share")
FEATURES = ("bias", "other", "hidden", *(f"t:{t}" for t in TAGS), *(f"n:{n}" for n in NAMES), *MEASURES)
INDEX = {f: k for k, f in enumerate(FEATURES)}


def _skips(html: str) -> dict[int, int]:
    """Where elements whose content is no text end, by the end of their start
    tags; they may be nested. Those that nothing closes aren't among them."""
    ends, open_tags = {}, {}
    for m in SKIPPED_TAG.finditer(html):
        name = m[2].lower()
        if m[1]:
            if open_tags.get(name):
                ends[open_tags[name].pop()] = m.end()
        elif not (name in ("svg", "math") and m[0].endswith("/>")):
            open_tags.setdefault(name, []).append(m.end())
    return ends


def tokens(html: str) -> Iterator[tuple]:
    """(is an end tag, name, attributes, None) of tags, (.., text) of text."""
    at, skips = 0, None
    while m := TOKEN.match(html, at):
        at = m.end()
        close, name, attributes = m[2], m[3], m[4]
        if m[6] is not None:  # a quote is left open: the tag ends at the next bracket, or with the page
            close, name, attributes = m[5], m[6], m[7]
            if m["cut"] is not None:
                return
        if name is None:
            if m[9] is not None:
                yield None, None, None, m[9]
            continue
        if not close and name.lower() in SKIPPED:
            skips = _skips(html) if skips is None else skips
            at = skips.get(at, at)
            continue
        yield close, name, attributes, None


class Page:
    """Nodes in page order (a parent before its children), and the text."""

    def __init__(self, html: str):
        self.parent, self.static, self.own, self.links, self.stops, self.kids = [-1], [self.names("body", "")], [0], [0], [0], [0]
        self.labels: list[int] = [0]
        self.pieces: list[tuple[int, str]] = []  # (node, text); (-1, "") ends a block
        stack: list[tuple[str, int]] = [("html", 0)]
        self.body: tuple[str, int] | None = None  # the last body
        anchors = 0
        for close, name, attributes, text in tokens(html.removeprefix("\ufeff")):
            if text is not None:
                words = " ".join(unescape(text).split()) if text.strip() else ""
                if words:
                    self._body(stack)
                node = stack[-1][1]
                self.pieces.append((node, unescape(text)))
                if words:
                    self.own[node] += len(words)
                    self.stops[node] += words.count(". ") + words.count(", ") + (words[-1] in ".!?")
                    self.links[node] += len(words) if anchors else 0
                continue
            name = name.lower()
            if close:
                anchors = max(0, anchors - (name == "a"))
                self._close(stack, {name}, frozenset())
            else:
                if name == "br" or name == "hr":
                    self.pieces.append((-1, ""))
                if name in VOID:
                    continue
                if name not in OUTER:
                    self._body(stack)
                elif stack[-1] == self.body:
                    stack.pop()
                if name in ENDS_P:
                    self._close(stack, {"p"}, SCOPE)
                if name in SAME:
                    self._close(stack, SAME[name], SCOPE)
                anchors += name == "a"
                self._open(stack, name, attributes)

    def _body(self, stack: list) -> None:
        """Opens the body that a page leaves out, or goes on with one that ended early."""
        if stack[-1][0] == "html":
            if self.body:
                stack.append(self.body)
            else:
                self._open(stack, "body", "")

    def _open(self, stack: list, name: str, attributes: str) -> None:
        at = stack[-1][1]
        inline = name in INLINE
        if not inline:
            self.pieces.append((-1, ""))
        if not inline or ("class" in attributes or "id=" in attributes or "data-y" in attributes):
            if name == "p":
                self.kids[at] += 1
            self.parent.append(at)
            self.static.append(self.names("inline" if inline else name, attributes))
            y = re.search(r'data-y="(\d)"', attributes)
            self.labels.append(int(y[1]) if y else self.labels[at])
            for x in (self.own, self.links, self.stops, self.kids):
                x.append(0)
            at = len(self.parent) - 1
        stack.append((name, at))
        if name == "body":
            self.body = stack[-1]

    def _close(self, stack: list, names: set, scope: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                if any(n not in INLINE for n, _ in stack[k:]):
                    self.pieces.append((-1, ""))
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    @staticmethod
    @lru_cache(100_000)
    def names(tag: str, attributes: str) -> tuple[int, ...]:
        """The features that don't depend on text."""
        tag = ALIKE.get(tag, tag)
        found = {INDEX["bias"], INDEX.get(f"t:{tag}", INDEX["other"])}
        for key, *values in ATTRIBUTE.findall(attributes):
            if key.lower() == "hidden":
                found.add(INDEX["hidden"])
            elif key.lower() != "data-y":
                found |= {INDEX[f"n:{m.lastgroup}"] for m in NAME.finditer(re.sub(r"(?<=[a-z])(?=[A-Z])|_", "-", "".join(values)))}
        return tuple(sorted(found))

    def measures(self) -> list[tuple[float, ...]]:
        """MEASURES of each node; sums over its subtree where they say so."""
        total, linked = self.own[:], self.links[:]
        for i in range(len(total) - 1, 0, -1):
            total[self.parent[i]] += total[i]
            linked[self.parent[i]] += linked[i]
        return [(linked[i] / total[i] if total[i] else 0.0, math.log1p(self.own[i]) / 6, math.log1p(total[i]) / 8,
                 min(self.stops[i], 5) / 5, 1.0 if 0 < total[i] < 25 else 0.0, min(self.kids[i], 4) / 4,
                 self.own[i] / total[0] if total[0] else 0.0)
                for i in range(len(total))]

    def text(self, marginals: list[float]) -> str:
        blocks, block = [], []
        for node, piece in [*self.pieces, (-1, "")]:
            if node < 0:
                if block:
                    blocks.append(" ".join("".join(block).split()))
                    block = []
            elif marginals[node] > 0.5:
                block.append(piece)
        return " ".join(b for b in blocks if b)


class Model:
    """``weights`` of content by feature; ``pair[a][b]``: parent a, child b."""

    def __init__(self, weights: list[float], pair: list[list[float]]):
        self.weights, self.pair = weights, pair

    def logits(self, page: Page) -> list[float]:
        w, base = self.weights, len(FEATURES) - len(MEASURES)
        m = w[base:]
        return [sum(w[k] for k in static) + sum(a * b for a, b in zip(m, measured))
                for static, measured in zip(page.static, page.measures())]

    def marginals(self, page: Page, pairs: np.ndarray | None = None) -> list[float]:
        """P(content) of each node by messages up and down; ``pairs`` gets the
        expected number of parent-child pairs added."""
        (e00, e01), (e10, e11) = [[math.exp(x) for x in row] for row in self.pair]
        n, parent = len(page.parent), page.parent
        up = [1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in self.logits(page)]  # P(content) of what lies below
        sent = [0.5] * n  # message to the parent, as P(content of the parent)
        up[0] = 0.0  # the page itself is no content
        for i in range(n - 1, 0, -1):
            b = up[i]
            m0, m1 = e00 * (1 - b) + e01 * b, e10 * (1 - b) + e11 * b
            m = sent[i] = m1 / (m0 + m1)
            p = parent[i]
            q = up[p]
            up[p] = q * m / (q * m + (1 - q) * (1 - m) + 1e-300)
        full = up[:]  # what lies below together with what lies above
        for i in range(1, n):
            q, m = full[parent[i]], sent[i]
            c1, c0 = q / m if m else 0.0, (1 - q) / (1 - m) if m < 1 else 0.0  # the parent without this child
            b = up[i]
            j00, j01, j10, j11 = c0 * e00 * (1 - b), c0 * e01 * b, c1 * e10 * (1 - b), c1 * e11 * b
            z = j00 + j01 + j10 + j11 + 1e-300
            full[i] = min(1.0, (j01 + j11) / z)
            if pairs is not None:
                pairs += np.array([[j00, j01], [j10, j11]]) / z
        return full


# --- labelled pages ------------------------------------------------------------
# Skeletons: data-y="1" opens main content, data-y="0" leaves it; L and S are
# filled with long and short texts, W with words.
SKELETONS = (
    '<body><nav><ul><li><a>W</a></li><li><a>W</a></li></ul></nav><div class="ad">S</div><article data-y="1"><h1>W</h1><p>L</p><p>S</p>'
    '<p>W</p></article><footer>W S</footer></body>',
    '<body><header><h1>W</h1><p>S</p></header><main data-y="1"><h2>W</h2><p>L</p><blockquote>S</blockquote><ul><li>S</li><li>W</li></ul>'
    '<p>S</p></main><aside><h3>W</h3><p>S</p><p>L</p></aside><footer><p>S</p></footer></body>',
    '<body><div id="top"><div class="menu"><a>W</a> <a>W</a></div></div><div class="wrap"><div class="content" data-y="1"><h1>W</h1><p>S</p>'
    '<p>L</p><div class="share" data-y="0"><a>W</a></div><p>L</p></div><div class="sidebar"><p>S</p><ul><li><a>W</a></li></ul></div></div>'
    '<div id="footer">S</div></body>',
    '<body><article data-y="1"><header data-y="0"><p>W</p></header><h1>W</h1><p>L</p><aside data-y="0"><p>S</p></aside><p>S</p>'
    '<form data-y="0"><label>W</label><p>S</p><button>W</button></form><section class="comments" data-y="0"><h2>W</h2><p>L</p><p>S</p>'
    '</section></article><div class="cookie-notice"><p>S</p><button>W</button></div></body>',
    '<body><div id="header">W</div><div id="main"><div class="post" data-y="1"><h1>W</h1><p>L</p><p>L</p><p>W</p></div>'
    '<div id="comments"><h3>W</h3><div class="comment"><p>S</p></div><div class="comment"><p>L</p></div></div></div></body>',
    '<body><div class="banner">S</div><section><article data-y="1"><p>S</p><p>S</p><pre>S</pre><table><tr><td>W</td><td>W</td></tr></table>'
    '<figure><figcaption>S</figcaption></figure></article></section><section class="related"><h2>W</h2><p>S</p></section></body>',
    '<body><div class="newsletter"><form><p>S</p></form></div><main data-y="1"><section><h2>W</h2><p>L</p></section><section><h2>W</h2>'
    '<p>S</p><div class="ad" data-y="0"><p>S</p></div><p>W</p></section><nav data-y="0"><a>W</a><a>W</a></nav></main><footer>S</footer></body>',
    '<body><p>S</p><div class="notice"><p>L</p></div><article data-y="1"><div><p>S</p><div>L</div><p>L <span class="x">W</span></p></div></article>'
    '<div class="comments"><article class="comment"><p>L</p></article></div><aside>L</aside></body>',
    '<body><nav><p>S</p></nav><header><p>L</p></header><article data-y="1">W S <b>W</b> L<h2>W</h2>S</article><div class="promo">L</div></body>',
    '<body><div class="navbar"><span class="nav-item"><a>W</a></span><p>S</p></div><div class="page-head"><p>L</p></div><div data-y="1"><p>L</p>'
    '<div class="search-form" data-y="0"><p>S</p></div><p>L</p><p class="byline" data-y="0">W</p><p>L</p></div><div class="site-footer"><p>L</p></div></body>',
    '<body><div class="body-text" data-y="1"><p>L</p><div class="menu" data-y="0"><p>L</p></div><p>L</p><div class="login-form" data-y="0"><p>L</p></div>'
    '<div class="header" data-y="0"><p>L</p></div><div class="footer" data-y="0"><p>L</p></div><div class="popup" data-y="0"><p>L</p></div>'
    '<div class="sidebar" data-y="0"><p>L</p></div><p hidden data-y="0">L</p><p>W</p></div></body>',
    '<body><div class="header">W</div><div id="content" data-y="1"><p>S</p><div class="ad" data-y="0">W</div><p>W</p></div><div class="cookie-banner">S</div></body>',
    '<body><div class="article-body" data-y="1"><p>S</p><form data-y="0"><p>S</p></form><p>L</p><form data-y="0">S</form></div><form><p>L</p></form></body>',
    '<body><article data-y="1"><h1>W</h1><p>S</p><form data-y="0"><p>W</p></form><nav data-y="0"><p>S</p></nav><aside data-y="0"><p>S</p><p>L</p></aside>'
    '<footer data-y="0"><p>S</p></footer></article><div id="cookies"><p>S</p></div></body>',
    '<body><div id="page"><div id="entry" data-y="1"><h1>W</h1><p>W</p></div><div id="search"><form><p>S</p></form></div></div></body>',
    '<body><section class="main-text" data-y="1"><p>L</p><section class="reviews" data-y="0"><p>L</p></section><aside data-y="0">S</aside></section></body>',
    '<body><div><div><a>W</a><a>W</a><a>W</a></div></div><div><div data-y="1"><h1>W</h1><p>L</p><p>L</p><p>L</p><p>S</p></div></div><div>W</div></body>',
)

# Each kind of boilerplate around the main content and inside it, with long texts of its own, too.
NAMED = ("ad", "menu", "header", "footer", "sidebar", "comments", "cookie-notice", "login-form", "share", "promo", "banner", "related",
         "newsletter", "breadcrumb", "copyright")
SKELETONS += tuple(
    f'<body><div class="{n}">L</div><{main} data-y="1"><h1>W</h1><p>L</p><div class="{n}" data-y="0">L<p>S</p></div><p>S</p></{main[:7]}>'
    f'<div id="{n}"><p>L</p>S</div></body>' for n in NAMED for main in ("article", "main")) + tuple(
    f'<body><{t}>L</{t}><article data-y="1"><p>L</p><{t} data-y="0"><p>L</p></{t}><p>W</p></article><{t}><p>S</p>L</{t}></body>'
    for t in ("nav", "header", "footer", "aside", "form", "button"))
LISTS = tuple("<ul>" + f"<li><a>{w}</a></li>" * n + "</ul>" for n in (3, 6, 9) for w in ("W", "S"))
SKELETONS += tuple(
    f'<body><{t}>{links}</{t}><div class="ad">S</div><article data-y="1"><h1>W</h1><p><b>S<br></b></p><p>W</p><p>L</p></article><{t}>{links}</{t}>'
    f'<footer>W S</footer></body>' for links in LISTS for t in ("nav", "header", "footer", 'div class="menu"', "div"))
# Main content that stands directly in the body, tagged or implied (both give the same nodes), with and without boilerplate
# around, and a body's own short text beside main content.
TOP = ("L", "S", "L<br><br>S<br>L", "S <b>W</b> S", "<h1>W</h1>S <b>W</b>.<br>S", "<h1>W</h1>L<p>L</p>S<p>S</p>W", "<p>S</p><p>L</p>", "<p>S</p>",
       "<h1>W</h1><p>L</p><ul><li>S</li><li>W</li></ul><p>S</p>", "<h2>W</h2>W <i>W</i><br>W", "W", "W <b>W</b> W<br>W")
AROUND = (("", ""), ('<nav data-y="0"><a>W</a><a>W</a></nav>', '<footer data-y="0">W S</footer>'),
          ('<div class="menu" data-y="0"><a>W</a> <a>W</a></div>', '<div class="footer" data-y="0">S</div>'),
          ('<header data-y="0"><p>S</p></header><div class="ad" data-y="0">L</div>', '<aside data-y="0"><p>L</p></aside>'),
          ('<form data-y="0"><p>W</p></form>', '<section class="comments" data-y="0"><p>S</p></section><form data-y="0"><p>S</p></form>'))
SKELETONS += tuple(f'<body data-y="1">{a}{text}{b}</body>' for text in TOP for a, b in AROUND) + tuple(
    f'<body>{a}<{main} data-y="1"><h1>W</h1><p>L</p><p>S</p></{main[:7].split()[0]}>{b}</body>' for main in ("article", "main", 'div class="content"')
    for a, b in (("W", "W"), ("<a>W</a> <a>W</a>", "W W"), ("W <a>W</a>", "<a>W</a>"), ("", "W S"), ("S", ""))) + tuple(
    f'<body><nav><a>W</a></nav><article data-y="1"><h1>W</h1><p>S</p><p>W</p>{a}</article><footer>W</footer></body>'
    for a in ('<form data-y="0"><p>W</p></form>', '<form data-y="0"><p>S</p></form>', '<aside data-y="0"><p>W</p></aside><form data-y="0"><p>W</p></form>',
              '<section class="comments" data-y="0"><p>W</p></section>', '<aside data-y="0"><p>S</p></aside><form data-y="0"><p>S</p></form><p>W</p>'))


def labelled_pages(copies: int = 3) -> list[Page]:
    r = random.Random(11)

    def words(least: int, most: int) -> str:
        return " ".join("".join(r.choice("abdeilnorstu") for _ in range(r.randint(2, 8))) for _ in range(r.randint(least, most)))

    def fill(m: re.Match) -> str:
        kind = m[0]
        if kind == "W":
            return words(1, 3)
        return " ".join(words(4, 14).capitalize() + r.choice(".,.") for _ in range(r.randint(*((3, 12) if kind == "L" else (1, 3)))))

    return [Page(re.sub(r"\b[WSL]\b", fill, s)) for s in SKELETONS for _ in range(copies)]


@lru_cache(1)
def train(steps: int = 150) -> Model:
    """Maximum likelihood on the labelled pages, with a little weight decay."""
    pages = labelled_pages()
    rows, seen, pairs_seen = [], np.zeros(len(FEATURES)), np.zeros((2, 2))
    for page in pages:
        x = np.zeros((len(page.parent), len(FEATURES)))
        for i, (static, measured) in enumerate(zip(page.static, page.measures())):
            x[i, list(static)] = 1
            x[i, -len(MEASURES):] = measured
        rows.append(x)
        seen += np.array(page.labels[1:]) @ x[1:]
        for p, y in zip(page.parent[1:], page.labels[1:]):
            pairs_seen[page.labels[p], y] += 1
    nodes = sum(map(len, rows))
    theta = np.concatenate((np.zeros(len(FEATURES)), [1.0, -1.0, -1.0, 1.0]))
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for t in range(1, steps + 1):
        model = Model(theta[:-4].tolist(), theta[-4:].reshape(2, 2).tolist())
        expected, pairs = np.zeros(len(FEATURES)), np.zeros((2, 2))
        for page, x in zip(pages, rows):
            expected += np.array(model.marginals(page, pairs)[1:]) @ x[1:]
        g = np.concatenate((seen - expected, (pairs_seen - pairs).ravel())) / nodes - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.15 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return Model(theta[:-4].tolist(), theta[-4:].reshape(2, 2).tolist())


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              model: Model | None = None) -> DataFrame:
    """id, url, ``text`` and its length in code points, of every page."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for html in batch.column(2).to_pylist():
                page = Page(html) if html else None
                out.append(page.text(model.marginals(page)) if page else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = small_batches(pages).select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
