"""Pages, lines, filters, chunks, feeds and evaluation sets."""

import pytest
from pyspark.sql import functions as F

from corrag.functions.markup import rows_to_markdown
from corrag.operators.blocks import extract_blocks, extract_with_fallback, lines_to_blocks
from corrag.operators.chunking import chunk_blocks, ingestion_status
from corrag.operators.filters import filter_blocks
from corrag.sources.evalsets import load_eval_dataset_json, load_qrels_json, parse_flags
from corrag.sources.feeds import parse_atom_entries
from corrag.sources.pages import load_page_files


def blocks_of(spark, html, paper="2301.00001"):
    pages = spark.createDataFrame([(paper, html)], "paper_id string, html string")
    return [tuple(r)[1:] for r in extract_blocks(pages).orderBy("block_idx").select(
        "block_idx", "section_name", "content_type", "text", "media_url").collect()]


def test_sections_tables_figures(spark):
    html = """<section><h2>Results <b>now</b></h2><p>Before.</p>
      <figure><img src="2301.00001v2/a.png"><figcaption>Fig. 1 <i>x</i></figcaption></figure>
      <figure><figcaption>Tab</figcaption><table><tr><th>a|b</th><th>c</th></tr><tr><td>1</td></tr>
      <tr></tr><tr><td>2</td><td>3</td><td>4</td></tr></table></figure>
      <table><tr><td>k</td></tr></table><p>After &amp; more<script>no()</script></p></section>
      <section><p>No heading</p></section>"""
    assert blocks_of(spark, html) == [
        ("Results now", "figure", "Fig. 1 x", "https://arxiv.org/html/2301.00001v2/a.png"),
        ("Results now", "table", "Tab\n\n| a\\|b | c |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |", None),
        ("Results now", "table", "| k |\n| --- |", None),
        ("Results now", "text", "Before. After & more", None)]


def test_nested_sections_repeat_inner_prose(spark):
    html = "<section><h2>Outer</h2><p>one</p><section><h3>Inner</h3><p>two</p></section></section>"
    assert blocks_of(spark, html) == [
        ("Outer", "text", "one Inner two", None), ("Inner", "text", "two", None)]
    html = "<section><section><h3>Only</h3><p>two</p></section></section>"
    assert blocks_of(spark, html) == [("Only", "text", "two", None)]


def test_noise_and_links(spark):
    html = ("<section><h1>S</h1><p>x​<math>P<annotation encoding='tex'>P_x</annotation></math></p>"
            "<figure><img src='https://other.org/a.png'></figure>"
            "<figure><img src='2401.9/a.png'><figcaption>c</figcaption></figure>"
            "<figure><img src='2301.00001/../../x.png'></figure></section>")
    assert blocks_of(spark, html) == [("S", "figure", "c", None), ("S", "text", "x P", None)]


def test_broken_pages_do_not_fail(spark):
    pages = spark.createDataFrame([("a", None), ("b", "<section><h2>T<p>x<b>y</section></div>")],
                                  "paper_id string, html string")
    assert [r.paper_id for r in extract_blocks(pages).collect()] in ([], ["b"])


def test_markdown_without_header(spark):
    frame = spark.createDataFrame([([],), ([[]],), (None,)], "g array<array<string>>")
    assert [r[0] for r in frame.select(rows_to_markdown(F.col("g"))).collect()] == ["", "", ""]


LINES = "paper_id string, page int, line_no int, text string, max_font double, is_bold boolean, y0 double, y1 double, in_table boolean"


def line(no, text, font=10.0, bold=False, y=None, table=False, page=0, paper="p"):
    y0 = float(no * 12 if y is None else y)
    return (paper, page, no, text, font, bold, y0, y0 + 10, table)


def found(spark, lines, segment=4096):
    frame = spark.createDataFrame(lines, LINES)
    return [tuple(r) for r in lines_to_blocks(frame, segment).orderBy("paper_id", "block_idx").select(
        "section_name", "content_type", "text").collect()]


@pytest.mark.parametrize("segment", [4096, 8])
def test_line_rules(spark, segment):
    lines = [line(0, "lost"), line(1, "Intro", 14.0), line(2, "a"), line(3, "b", table=True), line(4, "x" * 130, 20.0),
             line(5, "Figure 1 shows"), line(6, "more"), line(7, "in table", table=True), line(8, "far", y=200),
             line(9, "fig. 2", y=212), line(10, "Fig 3", y=224), line(11, "tail", y=236), line(12, "Next", bold=True, y=300),
             line(0, "over the page", page=1)]
    assert found(spark, lines, segment) == [
        ("Intro", "figure", "Figure 1 shows more in table"), ("Intro", "figure", "fig. 2"),
        ("Intro", "figure", "Fig 3 tail"), ("Intro", "text", "a " + "x" * 130 + " far"),
        ("Next", "text", "over the page")]


@pytest.mark.parametrize("segment", [4096, 9, 8])
def test_captions_end_after_eight_lines(spark, segment):
    lines = [line(0, "H", 14.0), line(1, "Figure 7")] + [line(i, f"l{i}") for i in range(2, 14)]
    assert found(spark, lines, segment) == [
        ("H", "figure", "Figure 7 l2 l3 l4 l5 l6 l7 l8"), ("H", "text", "l9 l10 l11 l12 l13")]


def test_lines_without_heading_become_body_only_without_blocks(spark):
    assert found(spark, [line(0, "a"), line(1, "b")]) == [("Body", "text", "a b")]
    assert found(spark, [line(0, "a"), line(1, "Figure 1", y=100)]) == [("Figure", "figure", "Figure 1")]


BLOCKS = "paper_id string, block_idx int, section_name string, text string, content_type string, media_url string"


def test_filter_and_fallback(spark):
    names = ["References", " Appendix A", "Abstract of references", "Funding", "Method", "Eq", "Eq"]
    frame = spark.createDataFrame(
        [("p", i, n, "$x$" if n == "Eq" else "text", "table" if i == 6 else "text", None) for i, n in enumerate(names)], BLOCKS)
    assert sorted(r.block_idx for r in filter_blocks(frame).collect()) == [2, 4, 6]
    assert sorted(r.block_idx for r in filter_blocks(frame, drop=("method",)).collect()) == [0, 1, 2, 3, 6]
    other = spark.createDataFrame([("p", 0, "L", "t", "text", None), ("q", 0, "L", "t", "text", None)], BLOCKS)
    both = extract_with_fallback(frame, other)
    assert both.filter("section_name = 'L'").select("paper_id").collect() == [("q",)]


def test_chunks_and_status(spark):
    papers = spark.createDataFrame([("p", "abs"), ("q", "none"), ("r", ""), ("s", "")], "paper_id string, abstract string")
    blocks = spark.createDataFrame([
        ("p", 0, "Body", " ".join(map(str, range(600))), "text", None),
        ("p", 1, "T", "| a |\n" * 800, "table", None), ("p", 2, "F", "cap", "figure", "u"), ("p", 3, "E", "", "text", None)], BLOCKS)
    chunks = chunk_blocks(papers, blocks).cache()
    children = {r.chunk_id: r for r in chunks.filter("chunk_type = 'child'").collect()}
    assert sorted(children) == ["p#0#0", "p#0#1", "p#1#0", "p#2#0", "p#3#0"]
    assert children["p#2#0"].media_url == "u" and children["p#2#0"].parent_chunk_id == "p#2"
    assert children["p#0#1"].token_count == 600 - 448
    parents = {r.chunk_id for r in chunks.filter("chunk_type = 'parent'").collect()}
    assert parents == {"p#0", "p#1", "p#2", "p#3"} | {f"{x}#abstract" for x in "pqrs"}
    failed = spark.createDataFrame([("r",)], "paper_id string")
    run = spark.createDataFrame([("p",), ("q",), ("r",)], "paper_id string")
    status = dict(ingestion_status(papers, chunks, failed, run).select("paper_id", "ingestion_status").collect())
    assert status == {"p": "full", "q": "abstract_only", "r": "failed", "s": "pending"}


def test_atom_feeds(spark):
    head = '<feed xmlns="http://www.w3.org/2005/Atom">'
    feeds = [
        head + "<entry><id>http://arxiv.org/abs/2301.00001v2</id><title> T </title><summary>S &lt; x</summary>"
        "<published>2023-01-01</published><author><name>A</name></author><author><name>B</name></author></entry>"
        "<entry><title>no id</title></entry><entry><id>http://arxiv.org/abs/solv-int/9901001v1</id></entry></feed>",
        head + "</feed>", "<feed><entry>"]
    frame = spark.createDataFrame([(f,) for f in feeds], "xml string")
    got = sorted(tuple(r) for r in parse_atom_entries(frame, "xml").collect())
    assert got == [("2301.00001", "T", "S < x", ["A", "B"], "2023-01-01"), ("solv-int/9901001", "", "", [], "")]


def test_evaluation_sets(spark, rows):
    raw = ['[{"query": "q", "relevant_chunk_ids": ["a", "b"]}]', 'Sure: [{"query": "r", "relevant_chunk_ids": ["c"]}] ok',
           "nothing", '[{"query": "s"}]']
    frame = spark.createDataFrame([(r,) for r in raw], "raw string")
    assert rows(load_qrels_json(frame, "raw")) == [("q", "a", 1), ("q", "b", 1), ("r", "c", 1)]
    assert [r.parsed for r in parse_flags(frame, "raw").collect()] == [True, True, False, True]
    with pytest.raises(Exception, match="not a JSON array"):
        load_qrels_json(frame, "raw", strict=True).collect()
    data = spark.createDataFrame([('x [{"question": "q", "answer": "a", "contexts": ["c"]}, {"question": "q"}]',)], "raw string")
    assert [(r.question, r.complete) for r in load_eval_dataset_json(data, "raw").collect()] == [("q", True), ("q", False)]


def test_page_files(spark, tmp_path):
    (tmp_path / "2301.00001.html").write_text("<p>\nx</p>")
    assert load_page_files(spark, str(tmp_path)).collect() == [("2301.00001", "<p>\nx</p>")]


def test_deep_markup_loses_no_page(spark):
    pages = spark.createDataFrame(
        [("a", "<section><h2>T</h2>" + "<span>" * 5000 + "deep text"), ("b", "<section><h2>U</h2><p>x</p></section>")],
        "paper_id string, html string")
    found = {(r.paper_id, r.section_name, r.text) for r in extract_blocks(pages).collect()}
    assert found == {("a", "T", "deep text"), ("b", "U", "x")}


def test_a_last_heading_leaves_no_body(spark):
    rows = [("a", 0, 0, "before", 8.0, False), ("a", 0, 1, "Heading", 15.0, False), ("b", 0, 0, "plain", 8.0, False)]
    lines = spark.createDataFrame(
        [(*r, 12.0 * r[2], 12.0 * r[2] + 4, False) for r in rows],
        "paper_id string, page int, line_no int, text string, max_font double, is_bold boolean, y0 double, y1 double, in_table boolean")
    assert [(r.paper_id, r.section_name) for r in lines_to_blocks(lines).collect()] == [("b", "Body")]
