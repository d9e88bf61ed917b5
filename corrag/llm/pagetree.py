"""A small DOM of block elements, and simple tree matching between two of them."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import isqrt

import numpy as np

_BLOCKS = frozenset((
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody tfoot "
    "thead title tr ul").split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; without a closing tag the first three reach to the end.
_RAW = frozenset("script style textarea iframe".split())
#: Elements that are not shown, up to their closing tag or the end of their parent. Without a closing tag they are left out alone.
_UNSHOWN = frozenset("svg noscript template annotation annotation-xml".split())
_SPACE = frozenset("br td th img".split())
#: Elements that are never article text, whatever they are called.
_ASIDE = frozenset("head nav footer aside form menu dialog select option".split())
#: Words in class, id or role that name what is not article text. A name counts if it has one of these words and no
#: others but these and those of ``_HOLDERS`` ("comment-list", "ad-slot", but not "no-sidebar"); ids of sections,
#: headings and paragraphs are their titles.
_FURNITURE = frozenset((
    "ad ads advert advertisement adverts advertising breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer login masthead menu nav navbar navigation newsletter pager pagination popup promo promotion related "
    "share sharing sidebar signup social sponsor sponsored subscribe").split())
#: Words that also stand on article text: inside the article they count on template text and on lists of like parts only.
_DOUBTFUL = frozenset("banner discussion modal notice notices notification replies reply respond responses search toolbar widget".split())
_ROLES = _FURNITURE | _DOUBTFUL
_HOLDERS = frozenset("area bar block box buttons container form holder item items link links list panel posts section slot thread unit wrap wrapper".split())
_TITLED = frozenset("section h1 h2 h3 h4 h5 h6 p li dt dd".split())
#: An opening tag closes these open elements first.
_CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr",), "body": ("head",)}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """``dropped``: in an element that is never shown or never article text; ``named``: in one whose name says so, 2 if
    the name leaves no doubt or the element is a list of like parts, else 1."""

    __slots__ = ("tag", "sign", "parent", "children", "dropped", "named", "text", "index")

    def __init__(self, tag, sign, parent, dropped, named, index):
        self.tag, self.sign, self.parent, self.dropped, self.named, self.index = tag, sign, parent, dropped, named, index
        self.children: list[Node] = []
        self.text: list[str] = []


class Page:
    """``nodes`` in page order and ``blocks``: (node, text) in page order, white space made single."""

    def __init__(self, html: str | None):
        self.nodes = [Node("", "", None, False, 0, 0)]
        self.blocks: list[tuple[Node, str]] = []
        self._held: list[str] = []
        self._build(html or "")
        self._name()

    def _flush(self, node):
        if self._held:
            text = " ".join(unescape("".join(self._held)).split())
            self._held = []
            if text:
                node.text.append(text)
                self.blocks.append((node, text))

    def _build(self, html):
        now, at, find = self.nodes[0], 0, _TOKEN.search
        unshown, open_unshown, closed = "", 0, {}
        while True:
            token = find(html, at)
            if token is None:
                if not unshown:
                    self._held.append(html[at:])
                break
            if token.start() > at and not unshown:
                self._held.append(html[at:token.start()])
            at, name = token.end(), token[2]
            if name is None:
                continue
            name = name.lower()
            self_closed = not token[1] and re.search(r"(?:^|[\s\"'])/$", token[3]) is not None
            if unshown:
                if name == unshown:
                    open_unshown += -1 if token[1] else not self_closed
                    unshown = unshown if open_unshown else ""
                    continue
                if token[1]:  # the end of an element around it
                    ends = any(up.tag == name for up in _line(now))
                else:  # in a drawing a block of the page
                    ends = unshown == "svg" and name in _BLOCKS and name != "title"
                if not ends and name not in _RAW:
                    continue
                if ends:
                    unshown, open_unshown = "", 0
            if token[1]:
                if name in _SPACE:
                    self._held.append(" ")
                    continue
                up = now
                while up is not None and up.tag != name:
                    up = up.parent
                if up is not None:
                    self._flush(now)
                    now = up.parent
                continue
            if name in _RAW:
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                again = re.compile(rf"<{name}\b", re.I).search(html, at) if self_closed else None
                if self_closed and (close is None or again is not None and again.start() < close.start()):
                    continue
                at = close.end() if close else at if name == "iframe" else len(html)
                continue
            if name in _UNSHOWN:
                if name not in closed:
                    closed[name] = _closed_tags(html, name)
                if not self_closed and token.start() in closed[name]:
                    unshown, open_unshown = name, 1
                continue
            if name in _SPACE:
                self._held.append(" ")
                continue
            block = name in _BLOCKS
            sign, named, hidden = name, 0, False
            if len(token[3]) > 1:
                sign, named, hidden = self._attributes(name, token[3])
            if not block and (not (named or hidden) or name in _VOID):
                continue
            self._flush(now)
            now = self._closed(now, name)
            if name in _VOID:
                continue
            page_header = name == "header" and not any(p.tag in ("article", "main") for p in _line(now))
            node = Node(name, sign, now, now.dropped or hidden or name in _ASIDE or page_header, named, len(self.nodes))
            now.children.append(node)
            self.nodes.append(node)
            now = node
        self._flush(now)

    @staticmethod
    def _closed(now, name):
        """The node that a new element goes into: paragraphs end at blocks, list items at list items."""
        ends = _CLOSES.get(name, ())
        if name in _BLOCKS and now.tag == "p":
            now = now.parent
        for up in _line(now):
            if up.tag in ends:
                return up.parent
            if up.tag in ("ul", "ol", "table", "dl", "div", "article", "section", "nav", "body"):
                break
        return now

    def _name(self):
        """Hands names down. An element around the page's heading, its main part or its first article is layout,
        whatever its name."""
        first = {}
        for node in self.nodes:
            if node.tag in ("h1", "main", "article") and not node.dropped:
                first.setdefault(node.tag, node)
        for node in first.values():
            for up in _line(node.parent):
                up.named = 0
        for node in self.nodes[1:]:
            if node.named == 1 and repeats(node):
                node.named = 2
            node.named = max(node.named, node.parent.named)

    @staticmethod
    def _attributes(name, text):
        """Sign, whether the element is named as something else, whether it is hidden."""
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(text)}
        label = " ".join(found.get(k, "") for k in ("class", "id")).strip().lower()
        hidden = ("hidden" in found or found.get("aria-hidden") == "true"
                  or "display:none" in found.get("style", "").replace(" ", "").lower())
        names = f"{found.get('class', '')} {'' if name in _TITLED else found.get('id', '')} {found.get('role', '')}".lower().split()
        if name in ("html", "body", "main"):
            named, hidden = 0, False
        elif name == "article":
            named = 2 if {"comment", "reply"} & set(names) else 0
        else:
            named = max((_named(set(re.split("[_-]+", n))) for n in names), default=0)
        return (f"{name}.{label}" if label else name), named, hidden


def _named(words: set[str]) -> int:
    if not words & _ROLES or not words <= _ROLES | _HOLDERS:
        return 0
    return 2 if words & _FURNITURE else 1


def repeats(node: Node) -> bool:
    """Whether the element is a list of like parts: most of its elements have one sign, which is no mere paragraph."""
    signs = Counter(c.sign for c in node.children)
    sign, n = max(signs.items(), key=lambda x: (x[1], x[0]), default=("", 0))
    like = [c for c in node.children if c.sign == sign]
    return n >= 2 and 2 * n > len(node.children) and ("." in sign or sign == "li" or all(c.children for c in like))


def _closed_tags(html: str, name: str) -> set[int]:
    """Where the opening tags of this name start that have a closing tag of their own."""
    opened, out = [], set()
    for tag in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", html, re.I):
        if not tag[1]:
            opened.append(tag.start())
        elif opened:
            out.add(opened.pop())
    return out


def _line(node):
    while node is not None:
        yield node
        node = node.parent


def paths(page: Page, numbers: dict[tuple, int]) -> frozenset[int]:
    """The kinds of places on a page: the tags and names on the way to a node, without numbers and titles of sections."""
    at = [0]
    for node in page.nodes[1:]:
        if node.tag in ("html", "head", "body", "title"):
            at.append(at[node.parent.index])
            continue
        step = node.tag if node.tag in _TITLED else re.sub(r"(?<=\s)\S*\d\S*|(?<=\.)\S*\d\S*", "", node.sign).strip()
        at.append(numbers.setdefault((at[node.parent.index], step), len(numbers) + 1))
    return frozenset(at) - {0}


class _Matcher:
    """The largest order-keeping match of subtrees. It depends on their shapes alone (signs in order), so every
    pair of shapes is matched once; equal shapes match as they are."""

    def __init__(self, a: Node, b: Node):
        self._numbers: dict[tuple, int] = {}
        self._inner: list[tuple[int, ...]] = []
        self._sign: list[int] = []
        self._size: list[int] = []
        self._signs: dict[str, int] = {}
        self.shape: dict[int, int] = {}
        self._weights: dict[tuple[int, int], int] = {}
        self._picks: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for root in (a, b):
            order = [root]
            for node in order:
                order += node.children
            for node in reversed(order):
                self._add(node)

    def _add(self, node):
        sign = self._signs.setdefault(node.sign, len(self._signs))
        inner = tuple(self.shape[id(c)] for c in node.children)
        number = self._numbers.setdefault((sign, inner), len(self._size))
        if number == len(self._size):
            self._inner.append(inner)
            self._sign.append(sign)
            self._size.append(1 + sum(self._size[c] for c in inner))
        self.shape[id(node)] = number

    def _known(self, p: int, q: int) -> int | None:
        """The weight of two shapes, or None if their children must be matched first."""
        if self._sign[p] != self._sign[q]:
            return 0
        if p == q:
            return self._size[p]
        if not self._inner[p] or not self._inner[q]:
            return 1
        return self._weights.get((p, q))

    def weight(self, p: int, q: int) -> int:
        todo = [(p, q)]
        while todo:
            u, v = todo[-1]
            if self._known(u, v) is not None:
                todo.pop()
                continue
            x, y = self._ends(u, v)
            by_sign: dict[int, list[int]] = {}
            for d in dict.fromkeys(y):
                if self._inner[d]:
                    by_sign.setdefault(self._sign[d], []).append(d)
            open_pairs = [(c, d) for c in dict.fromkeys(x) if self._inner[c]
                          for d in by_sign.get(self._sign[c], ()) if self._known(c, d) is None]
            if open_pairs:
                todo += open_pairs
                continue
            todo.pop()
            self._match(u, v, x, y)
        return self._known(p, q)

    def _ends(self, u, v):
        """Children of both without those at the end that are equal; these match each other in a largest match."""
        x, y = self._inner[u], self._inner[v]
        n = 0
        while n < min(len(x), len(y)) and x[-1 - n] == y[-1 - n]:
            n += 1
        return x[:len(x) - n], y[:len(y) - n]

    def _match(self, u, v, x, y):
        """Fills in the weight of two shapes and the places of matched children, in memory of some rows."""
        kinds, place = np.unique(np.array(y, np.int64), return_inverse=True)
        kind_signs, kinds = np.array([self._sign[k] for k in kinds.tolist()], np.int64), kinds.tolist()
        held: dict[int, np.ndarray] = {}

        def weights(c):
            if c not in held:
                if len(held) * len(y) > 1 << 20:
                    held.clear()
                row = (kind_signs == self._sign[c]).astype(np.int64)
                if self._inner[c]:
                    for k in np.flatnonzero(row).tolist():
                        row[k] = self._known(c, kinds[k])
                held[c] = row[place]
            return held[c]

        def below(row, c):
            w = weights(c)
            best = np.concatenate(([0], np.maximum(row[1:], np.where(w > 0, row[:-1] + w, 0))))
            return np.maximum.accumulate(best)

        n, m = len(x), len(y)
        step = isqrt(n) + 1
        row = np.zeros(m + 1, np.int64)
        marks = [row]
        for i, c in enumerate(x, 1):
            row = below(row, c)
            if i % step == 0:
                marks.append(row)
        tail = len(self._inner[u]) - n
        self._weights[u, v] = 1 + int(row[-1]) + sum(self._size[c] for c in self._inner[u][n:])
        pairs = [(n + k, m + k) for k in range(tail - 1, -1, -1)]
        i, j = n, m
        while i and j:
            base = (i - 1) // step
            rows = [marks[base]]
            for c in x[base * step:i]:
                rows.append(below(rows[-1], c))
            while j and i > base * step:
                now, above, w = rows[i - base * step], rows[i - 1 - base * step], weights(x[i - 1])[j - 1]
                if w and now[j] == above[j - 1] + w:
                    pairs.append((i - 1, j - 1))
                    i, j = i - 1, j - 1
                elif now[j] == above[j]:
                    i -= 1
                else:
                    j -= 1
        self._picks[u, v] = pairs[::-1]

    def pairs(self, p: int, q: int) -> list[tuple[int, int]]:
        """Places of the children that match; the weight of the two shapes is known."""
        if p == q:
            return [(i, i) for i in range(len(self._inner[p]))]
        return self._picks.get((p, q), [])


def match_trees(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the size of the largest order-keeping match of two trees, and its pairs of
    nodes. Roots with different signs do not match. Exact for child lists of any length and any depth."""
    matcher = _Matcher(a, b)
    p, q = matcher.shape[id(a)], matcher.shape[id(b)]
    size, pairs = matcher.weight(p, q), []
    todo = [(a, b)] if size else []
    while todo:
        u, v = todo.pop()
        pairs.append((u, v))
        todo += [(u.children[i], v.children[j]) for i, j in matcher.pairs(matcher.shape[id(u)], matcher.shape[id(v)])]
    return size, pairs


def aligned(a: Node, b: Node) -> dict[int, int]:
    """Index of a node of ``a`` to the index of the matched node of ``b``."""
    return {u.index: v.index for u, v in match_trees(a, b)[1]}
