"""Pages, flat documents and extracted text lines to ordered blocks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corrag.functions.markup import HTML_BASE, clean_markup, resolve_media_url, rows_to_markdown
from corrag.functions.text import strip_ws
from corrag.operators.batches import BYTES_AT_ONCE, slices, text_sizes
from corrag.operators.topk import joined_in_order
from corrag.session import staged


BLOCK_COLUMNS = ("paper_id", "block_idx", "section_name", "text", "content_type", "media_url")

# --- Fixed values: line rules -------------------------------------------------------------
CAPTION_START = r"(?i)^\s*(figure|fig\.?)\s*\d+"
HEADING_FONT, HEADING_CHARS = 13, 120
CAPTION_GAP, CAPTION_LINES = 14.0, 8
# -----------------------------------------------------------------------------------------

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
         "track", "wbr"}
_UNSEEN = {"script", "style", "template"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# An opening tag of the key ends the listed open elements, up to the nearest boundary.
_ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BOUNDARY = {"table", "section", "article", "figure", "div", "ul", "ol", "body"}


class _Element:
    __slots__ = ("tag", "attrs", "children", "gone")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children, self.gone = tag, attrs, [], False

    def live(self):
        """Live descendants and text pieces in document order, without recursion: markup nests deep."""
        todo = self.children[::-1]
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                yield child
            elif not child.gone:
                yield child
                todo += child.children[::-1]

    def walk(self, tags: set) -> list:
        """Live descendants with one of the tags, in document order."""
        return [child for child in self.live() if isinstance(child, _Element) and child.tag in tags]

    def words(self) -> list:
        """Stripped, non-empty text pieces in document order."""
        found, todo = [], self.children[::-1]
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                if child.strip():
                    found.append(child.strip())
            elif not child.gone and child.tag not in _UNSEEN:
                todo += child.children[::-1]
        return found

    def remove(self) -> None:
        todo = [self]
        while todo:
            element = todo.pop()
            element.gone = True
            todo += [child for child in element.children if isinstance(child, _Element)]


class _Tree(HTMLParser):
    """Forgiving element tree: unknown end tags are ignored, open inline tags are closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and self.open[-1].tag in _ENDS.get(tag, ()):
            self.open.pop()
        if tag in _ENDS:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth].tag in _BOUNDARY:
                    break
                if self.open[depth].tag in _ENDS[tag]:
                    del self.open[depth:]
                    break
        element = _Element(tag, dict(attrs))
        self.open[-1].children.append(element)
        if tag not in _VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _joined(element: _Element | None) -> str:
    return " ".join(element.words()) if element is not None else ""


def _grid(table: _Element) -> list:
    return [[_joined(cell) for cell in row.walk({"th", "td"})] for row in table.walk({"tr"})]


def _raw_blocks(html: str, section_tag: str) -> Iterator[dict]:
    """Section parts before formatting: cell grids, captions, image sources, prose."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    for section in tree.root.walk({section_tag}):
        heading = next(iter(section.walk(_HEADINGS)), None)
        if heading is None:
            continue
        name = _joined(heading)
        heading.remove()
        for figure in section.walk({"figure"}):
            if figure.gone:
                continue
            caption = _joined(next(iter(figure.walk({"figcaption"})), None))
            table = next(iter(figure.walk({"table"})), None)
            image = next(iter(figure.walk({"img"})), None)
            if table is not None:
                yield {"section_name": name, "kind": "table", "text": caption, "grid": _grid(table)}
            else:
                yield {"section_name": name, "kind": "figure", "text": caption,
                       "src": image.attrs.get("src") if image is not None else None}
            figure.remove()
        for table in section.walk({"table"}):
            if not table.gone:
                yield {"section_name": name, "kind": "table", "text": "", "grid": _grid(table)}
                table.remove()
        yield {"section_name": name, "kind": "text", "text": _joined(section)}


#: The kind of a row that stands for a page that could not be read.
_ERROR = "error"

_RAW = T.StructType([
    T.StructField("paper_id", T.StringType()), T.StructField("block_idx", T.IntegerType()),
    T.StructField("section_name", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("src", T.StringType()),
    T.StructField("grid", T.ArrayType(T.ArrayType(T.StringType())))])


def extract_blocks(pages: DataFrame, root: str = "section", base: str = HTML_BASE) -> DataFrame:
    """``read_pages`` without the pages that cannot be read; these do not fail the job."""
    return page_blocks_of(read_pages(pages, root, base))


def page_blocks_of(read: DataFrame) -> DataFrame:
    """The blocks among the rows of ``read_pages``."""
    return read.filter(F.col("error").isNull()).drop("error")


def unreadable(read: DataFrame) -> DataFrame:
    """``paper_id, error`` of the pages among the rows of ``read_pages`` that could not be read."""
    return read.filter(F.col("error").isNotNull()).select("paper_id", "error")


def read_pages(pages: DataFrame, root: str = "section", base: str = HTML_BASE) -> DataFrame:
    """Headed sections of each page as text, table and figure blocks, and ``error``.

    The worker only takes the markup apart; cleaning, table markdown and link rules are column
    expressions around it. ``root`` names the element that counts as a section. A page that
    cannot be read yields one row with the message as ``error`` and nothing else.
    """
    arrow_schema = to_arrow_schema(_RAW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in batches:
            for start, end in slices(text_sizes(records.column("html")), BYTES_AT_ONCE):
                part, rows = records.slice(start, end - start), []
                for paper_id, html in zip(*(part.column(c).to_pylist() for c in ("paper_id", "html"))):
                    try:
                        found = list(_raw_blocks(html, root))
                    except Exception as broken:
                        found = [{"kind": _ERROR, "text": f"{type(broken).__name__}: {broken}"}]
                    rows += [{"paper_id": paper_id, "block_idx": i, **block} for i, block in enumerate(found)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    cleaned = pages.filter(F.col("html").isNotNull()).select(
        "paper_id", clean_markup(F.col("html")).alias("html"))
    table = rows_to_markdown(F.col("grid"))
    formatted = cleaned.mapInArrow(run, _RAW).select(
        "paper_id", "block_idx", "section_name",
        F.when(~F.col("kind").isin("table", _ERROR), F.col("text"))
        .when(F.coalesce(table, F.lit("")) == "", F.lit(""))
        .when(F.col("text") == "", table)
        .otherwise(F.concat("text", F.lit("\n\n"), table)).alias("text"),
        F.col("kind").alias("content_type"),
        F.when(F.col("kind") == "figure", resolve_media_url(F.col("src"), F.col("paper_id"), base))
        .alias("media_url"),
        F.when(F.col("kind") == _ERROR, F.col("text")).alias("error"))
    return formatted.filter((F.col("text") != "") | F.col("media_url").isNotNull() | F.col("error").isNotNull())


def documents_to_blocks(documents: DataFrame) -> DataFrame:
    """Flat text without headings: one ``Body`` block per document."""
    return documents.filter(F.col("text") != "").select(
        "paper_id", F.lit(0).alias("block_idx"), F.lit("Body").alias("section_name"), "text",
        F.lit("text").alias("content_type"), F.lit(None).cast("string").alias("media_url"))


def lines_to_blocks(lines: DataFrame, segment: int = 4096) -> DataFrame:
    """Text lines with font and position to section and figure-caption blocks.

    ``line_no`` counts the lines of a page from 0. All windows run inside segments of a page
    (captions look back at most ``CAPTION_LINES`` lines, which are repeated at a segment's
    start); one summary row per segment carries the open section across pages. So a very long
    paper is spread like many short ones. Lines inside a table are skipped unless a caption
    before them takes them in.
    """
    here = ["paper_id", "page", "_seg"]
    look_back = CAPTION_LINES - 1
    seg = F.floor(F.col("line_no") / segment).cast("int")
    tail = F.pmod(F.col("line_no"), F.lit(segment)) >= segment - look_back
    copies = lines.withColumn("_own", seg).withColumn("_seg", F.explode(
        F.when(tail, F.array(seg, seg + 1)).otherwise(F.array(seg))))

    in_order = Window.partitionBy(*here).orderBy("line_no")
    recent = in_order.rowsBetween(-look_back, 0)
    is_caption = F.col("text").rlike(CAPTION_START)
    gap = F.col("y0") - F.lag("y1").over(in_order)
    seen = (copies.withColumn("_starts", is_caption)
            .withColumn("_gap", F.coalesce(gap > CAPTION_GAP, F.lit(False)))
            .withColumn("_start", F.max(F.when(
                F.col("_starts"), F.struct(F.col("line_no").alias("at"), "in_table"))).over(recent))
            .withColumn("_broken", F.max(F.when(F.col("_gap"), F.col("line_no"))).over(recent))
            .filter(F.col("_own") == F.col("_seg")))
    in_caption = (F.col("_start").isNotNull() & ~F.col("_start.in_table")
                  & (F.coalesce(F.col("_broken"), F.lit(-1)) <= F.col("_start.at")))
    read = seen.withColumn("_caption", F.when(in_caption, F.col("_start.at"))).filter(
        F.col("_caption").isNotNull() | ~F.col("in_table"))
    place = F.shiftleft(F.col("page").cast("bigint"), 32) + F.col("line_no")
    read = read.withColumn("_at", place).withColumn("_heading", F.when(
        F.col("_caption").isNull()
        & ((F.col("max_font") >= HEADING_FONT) | F.col("is_bold"))
        & (F.length("text") < HEADING_CHARS), F.struct(F.col("_at").alias("at"), F.col("text").alias("name"))))

    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    local = read.withColumn("_local", F.last("_heading", ignorenulls=True).over(so_far))
    across = Window.partitionBy("paper_id").orderBy("page", "_seg").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = local.groupBy(*here).agg(F.max("_heading").alias("_last")).select(
        *here, F.last("_last", ignorenulls=True).over(across).alias("_carried"))
    # Staged: captions, sections, headings and leftovers below all start from these lines.
    placed = staged(local.join(carried, here, "left").select(
        "paper_id", "page", "text", "_at", "_caption", "_heading",
        F.coalesce("_local", "_carried").alias("_section")), "lines")

    figures = placed.filter(F.col("_caption").isNotNull()).withColumn(
        "_first", F.shiftleft(F.col("page").cast("bigint"), 32) + F.col("_caption"))
    captions = joined_in_order(figures, ["paper_id", "_first", "_section"], "_at", "text", " ").select(
        "paper_id", F.col("_first").alias("_emitted"),
        F.coalesce("_section.name", F.lit("Figure")).alias("section_name"),
        strip_ws(F.regexp_replace("text", r"\s+", " ")).alias("text"),
        F.lit("figure").alias("content_type"))
    prose = placed.filter(F.col("_caption").isNull() & F.col("_heading").isNull())
    # A section is closed by the next heading, so it follows the captions inside it.
    closing = placed.filter(F.col("_heading").isNotNull()).select(
        "paper_id", F.col("_heading.at").alias("_opened"))
    closing = closing.withColumn("_closed", F.lead("_opened").over(
        Window.partitionBy("paper_id").orderBy("_opened")))
    named = prose.filter(F.col("_section").isNotNull()).select(
        "paper_id", F.col("_section.at").alias("_opened"), F.col("_section.name").alias("section_name"),
        "_at", "text")
    sections = joined_in_order(named, ["paper_id", "_opened", "section_name"], "_at", "text", " ").join(
        closing, ["paper_id", "_opened"], "left").select(
        "paper_id", F.coalesce("_closed", F.lit(2**62)).alias("_emitted"), "section_name", "text",
        F.lit("text").alias("content_type"))
    found = captions.unionByName(sections)
    # Lines before the first heading count only in papers that have neither heading nor caption.
    headed = found.select("paper_id").unionByName(closing.select("paper_id"))
    unnamed = prose.filter(F.col("_section").isNull()).join(headed.distinct(), "paper_id", "left_anti")
    body = joined_in_order(unnamed, ["paper_id"], "_at", "text", " ").select(
        "paper_id", F.lit(0).cast("bigint").alias("_emitted"), F.lit("Body").alias("section_name"),
        "text", F.lit("text").alias("content_type"))
    number = Window.partitionBy("paper_id").orderBy("_emitted")
    return found.unionByName(body).select(
        "paper_id", (F.row_number().over(number) - 1).alias("block_idx"), "section_name", "text",
        "content_type", F.lit(None).cast("string").alias("media_url"))


def extract_with_fallback(html_blocks: DataFrame, line_blocks: DataFrame) -> DataFrame:
    """Per paper the blocks of its page, else those of its lines, else none."""
    spare = line_blocks.join(html_blocks.select("paper_id").distinct(), "paper_id", "left_anti")
    return html_blocks.select(*BLOCK_COLUMNS).unionByName(spare.select(*BLOCK_COLUMNS))
