"""HTML extraction by wrapper induction.

Pages of one host are dealt to layouts by the places they share. Pages of a layout are aligned with typical
pages of it (the one of median size, and more until every place that half of the pages have is on one) by simple
tree matching. Aligned nodes whose text stays the same over the pages are template; nodes whose text
varies are slots. The article is the element that holds most of the varying text, narrowed or widened to
``article`` or ``main`` elements (all siblings that vary). Hosts with few pages have no evidence; there
``article`` and ``main`` decide, and an element beside them that holds most of the text stays. An ``article`` or ``main``
with the page's heading is the article whatever stands beside it, and so is one beside a list of like parts. Its blocks
are the result, but for template nodes and for elements that are something else by their tag (menus, forms and the like),
hidden, or named as something else (sidebar, advert, comments); names that also stand on article text (notice, reply)
count inside the article's element only where the text is template too or the element is a list of like parts.

Template text within the article stays where pages are versions of one text: their ``h1`` does not vary and more than
half of the article is the same on all of them.

A host with more than ``CHUNK`` pages or ``CHUNK_BYTES`` of html is split by a hash of the page into chunks of about that
size, each of which induces its own wrapper, so no task ever holds more. Pages are shuffled once.

Defined results: null or empty html gives the empty text. A null or odd url counts as a host of its
own name. A host with fewer than ``MIN_PAGES`` different pages has no template. Copies of a page vote once.
Repeated rows give repeated results. Deep, broken or unclosed markup loses no text. Other columns are
left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrag.llm.common import read_table
from corrag.llm.pagetree import Node, Page, aligned, paths, repeats
from corrag.session import staged

#: Pages of a host that one wrapper is induced from, about.
CHUNK = 1000
#: Bytes of html that one wrapper is induced from, about.
CHUNK_BYTES = 16 << 20
#: Different pages below which no node counts as template.
MIN_PAGES = 8
#: Share of pages in which a template node has the same text.
CONSTANT = 0.9
#: Share of the varying text that the article's element holds.
FOCUS = 0.6
#: Share of places that pages of one layout have in common, at least more than this.
LAYOUT = 0.5
_WHOLE = ("", "html", "body")


def _articles(page: Page, weight: dict[int, float]) -> list[Node]:
    """The outermost ``article`` elements with text of weight, or else the ``main`` elements."""
    mass = _mass(page, weight)
    for tag in ("article", "main"):
        found = [n for n in page.nodes if n.tag == tag and not n.dropped and not n.named and mass[n.index] > 0
                 and not any(up.tag == tag for up in _above(n.parent))]
        if found:
            return found
    return []


def _headed(page: Page, articles: list[Node], root: Node) -> list[Node]:
    """The ``articles`` that hold a heading of the page's highest rank, unless ``root`` holds one too."""
    headings = [n for n in page.nodes if n.tag in ("h1", "h2") and n.text and not n.dropped and not n.named]
    top = min((n.tag for n in headings), default="")
    around = [{id(up) for up in _above(n)} for n in headings if n.tag == top]
    if any(id(root) in up for up in around):
        return []
    return [n for n in articles if any(id(n) in up for up in around)]


def _above(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def _mass(page: Page, weight: dict[int, float]) -> Counter:
    """The weight of every element with all that is in it."""
    mass: Counter = Counter(weight)
    for node in reversed(page.nodes):
        if node.parent is not None and mass[node.index]:
            mass[node.parent.index] += mass[node.index]
    return mass


def _focus(page: Page, weight: dict[int, float]) -> Node:
    """The deepest element with children that holds ``FOCUS`` of the weight."""
    mass = _mass(page, weight)
    now = page.nodes[0]
    while True:
        inner = [c for c in now.children if c.children and not c.dropped and not c.named and mass[c.index] >= FOCUS * mass[0]]
        if not inner or not mass[0]:
            return now
        now = max(inner, key=lambda c: mass[c.index])


def _shared(a: frozenset, b: frozenset) -> float:
    return len(a & b) / (len(a | b) or 1)


def _texts(page: Page) -> tuple[str, ...]:
    return tuple(t for _, t in page.blocks)


def layouts(pages: list[Page]) -> list[tuple[list[Page], list[frozenset]]]:
    """The pages by layout, each with the places on it. Layouts of too few pages go to the nearest large one."""
    numbers: dict[tuple, int] = {}
    by_places: dict[frozenset, list[Page]] = {}
    for page in pages:
        by_places.setdefault(paths(page, numbers), []).append(page)
    groups: dict[frozenset, list[frozenset]] = {}
    for places in sorted(by_places, key=lambda x: (-len(by_places[x]), -len(x), sorted(x))):
        near = max(groups, key=lambda x: _shared(x, places), default=None)
        if near is None or _shared(near, places) <= LAYOUT and near != places:
            groups[places] = [places]
        else:
            groups[near].append(places)
    large = [x for x, inner in groups.items() if len({_texts(p) for y in inner for p in by_places[y]}) >= MIN_PAGES]
    large = large or list(groups)[:1]
    for x in [x for x in groups if x not in large]:
        groups[max(large, key=lambda y: _shared(x, y))] += groups.pop(x)
    return [([p for x in inner for p in by_places[x]], [x for x in inner for _ in by_places[x]]) for inner in groups.values()]


class Wrapper:
    """What the pages of one layout have in common."""

    def __init__(self, pages: list[Page], places: list[frozenset]):
        known = {id(p): x for p, x in zip(pages, places)}
        different = list({_texts(p): p for p in pages}.values())
        by_size = sorted(different, key=lambda p: (len(p.nodes), sum(len(t) for _, t in p.blocks), _texts(p)))
        self.typical = [by_size[len(by_size) // 2]]
        on = Counter(place for p in different for place in known[id(p)])
        missing = {x for x, n in on.items() if 2 * n >= len(different)} - known[id(self.typical[0])]
        while missing:
            self.typical.append(max(by_size, key=lambda p: len(missing & known[id(p)])))
            missing -= known[id(self.typical[-1])]
        self.evidence = len(different) >= MIN_PAGES
        self.alignments = {id(p): self._align(p) for p in different}
        self.templates: list[dict[int, str]] = []
        for k, typical in enumerate(self.typical):
            template, varying = self._learn(k, typical, different)
            self.templates.append(template)
            if k == 0:
                self.focus = _focus(typical, varying).index

    def _align(self, page: Page) -> list[dict[int, int]]:
        return [aligned(page.nodes[0], typical.nodes[0]) for typical in self.typical]

    def _learn(self, k: int, typical: Page, different: list[Page]) -> tuple[dict[int, str], dict[int, float]]:
        """Template texts and weights of varying nodes of one typical page."""
        seen, texts = Counter(), {}
        for page in different:
            for own, index in self.alignments[id(page)][k].items():
                if page.nodes[own].text:
                    seen[index] += 1
                    texts.setdefault(index, Counter())["\n".join(page.nodes[own].text)] += 1
        template: dict[int, str] = {}
        varying: dict[int, float] = {}
        for index, n in seen.items():
            text, same = texts[index].most_common(1)[0]
            if n >= MIN_PAGES and n >= len(different) / 2 and same >= CONSTANT * n:
                template[index] = text
            elif not typical.nodes[index].dropped and not typical.nodes[index].named:
                varying[index] = sum(len(t) * c for t, c in texts[index].items()) / n
        return template, varying

    def _roots(self, page: Page, alignment: dict[int, int], constant: set[int]) -> list[Node]:
        """The elements whose text is the article: where the text varies, narrowed to ``article`` or ``main``."""
        weight = Counter()
        for node, text in page.blocks:
            if not node.dropped and not node.named and node.index not in constant:
                weight[node.index] += len(text)
        mass = _mass(page, weight)
        root = next((page.nodes[own] for own, index in alignment.items() if index == self.focus), None)
        if root is None or root.index == 0 or not mass[root.index]:
            root = _focus(page, weight)
        articles = _articles(page, weight)
        around = {up.index for up in _above(root)}
        own = next((n for n in articles if n.index in around), None)
        if own is not None:
            return [n for n in articles if n.parent is own.parent]
        inner = [n for n in articles if any(up is root for up in _above(n.parent))]
        if sum(mass[n.index] for n in inner) >= FOCUS * mass[root.index] > 0 or inner and not self.evidence and root.tag in _WHOLE:
            return inner
        headed = _headed(page, articles, root)
        if headed or articles and repeats(root):
            first = (headed or articles)[0]
            return [n for n in articles if n.parent is first.parent]
        return [root] if self.evidence else [root, *articles]

    def text(self, page: Page) -> str:
        alignments = self.alignments.get(id(page)) or self._align(page)
        constant = {own for alignment, template in zip(alignments, self.templates) for own, index in alignment.items()
                    if template.get(index, "") == "\n".join(page.nodes[own].text) != ""}
        roots = self._roots(page, alignments[0], constant)
        whole = roots[0].tag in _WHOLE  # no element of its own: names are all there is to go by
        inside = {n.index for n in roots}
        for node in page.nodes[1:]:
            if node.parent.index in inside:
                inside.add(node.index)
        kept = [(node, text) for node, text in page.blocks if node.index in inside and not node.dropped and node.named < 2
                and not (node.named and (whole or node.index in constant))]
        titles = [node for node, _ in kept if node.tag == "h1"]
        same = sum(len(text) for node, text in kept if node.index in constant)
        if 2 * same > sum(len(text) for _, text in kept) and all(node.index in constant for node in titles):
            return "\n\n".join(text for _, text in kept)
        return "\n\n".join(text for node, text in kept if node.index not in constant)


def extract_host(htmls: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    pages = {h: Page(h) for h in htmls}
    texts = {}
    for inner, places in layouts(list(pages.values())):
        wrapper = Wrapper(inner, places)
        texts.update((id(p), wrapper.text(p)) for p in inner)
    return [texts[id(pages[h])] for h in htmls]


def _extract(table: pa.Table) -> pa.Table:
    texts = extract_host(table.column("html").to_pylist())
    return pa.table({
        "page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()),
        "n_chars": pa.array(list(map(len, texts)), pa.int64())})


def dealt_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages with their host and the chunk of it that they go to."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("_host"))
    chunks = F.ceil(F.greatest(F.col("_n") / CHUNK, F.col("_bytes") / CHUNK_BYTES))
    large = staged(
        rows.groupBy("_host").agg(F.count("*").alias("_n"), F.sum(F.octet_length("html")).alias("_bytes"))
        .select("_host", chunks.alias("_chunks")).filter("_chunks > 1"), "large-hosts")  # few: broadcast if its files are small
    chunk = F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("_chunks", F.lit(1)))
    return rows.join(large, "_host", "left").withColumn("_chunk", chunk).drop("_chunks")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    dealt = dealt_pages(pages, id_col, url_col, html_col)
    return dealt.groupBy("_host", "_chunk").applyInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query_html(spark, sf_dir):
    return extract_pages(read_table(spark, sf_dir, "pages"))
