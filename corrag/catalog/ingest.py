"""Blocks, chunks, filters, the store, feeds and index checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrag import schemas
from corrag.catalog import sqltext as sql
from corrag.catalog import tables
from corrag.catalog.registry import query
from corrag.functions.markup import resolve_media_url, rows_to_markdown
from corrag.functions.rules import canonical_paper_id, is_equation_only, safe_path_id, valid_paper_id
from corrag.functions.text import count_tokens, split_tokens, truncate_tokens, words
from corrag.operators.blocks import extract_blocks, extract_with_fallback, lines_to_blocks
from corrag.operators.chunking import ingestion_status
from corrag.operators.embedding import embed_children
from corrag.operators.filters import filter_blocks
from corrag.operators.postings import index_drift
from corrag.plans.ingest import ingest_pages, ingest_to_store
from corrag.session import new_shared_path, staged
from corrag.sources.feeds import parse_atom_entries
from corrag.sources.store import (
    read_report, read_store, upsert_paper_chunks, upsert_store, write_report, write_store)
from corrag.sources.tablelog import append_run, compact, read_table


# --- Tokens and chunks --------------------------------------------------------------------

@query("token_counts", rf"""SELECT CAST(doc_id AS VARCHAR) AS paper_id, {sql.n_tokens("text")} AS n_tokens,
  len({sql.words("text")}) AS n_words,
  md5(CASE WHEN {sql.n_tokens("text")} <= 50 THEN text
      ELSE array_to_string(regexp_extract_all(text, '\s*\S+')[1:50], '') END) AS head_md5
FROM documents""")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).select(
        "paper_id", count_tokens(F.col("text")).alias("n_tokens"), F.size(words(F.col("text"))).alias("n_words"),
        F.md5(truncate_tokens(F.col("text"), 50)).alias("head_md5"))


@query("chunk_windows", rf"""WITH {sql.children(512, 64)}
SELECT chunk_id, child_idx, {sql.n_tokens("text")} AS n_tokens, md5(text) AS text_md5 FROM children""")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf).filter("text <> ''")
    cut = docs.select("paper_id", F.posexplode(split_tokens(F.col("text"))).alias("child_idx", "text"))
    return cut.select(
        F.concat_ws("#", "paper_id", F.lit("0"), F.col("child_idx").cast("string")).alias("chunk_id"),
        "child_idx", count_tokens(F.col("text")).alias("n_tokens"), F.md5("text").alias("text_md5"))


@query("chunk_table", rf"""WITH {sql.PAPERS}, {sql.children()}
SELECT chunk_id, paper_id, 'child' AS chunk_type, 'Body' AS section_name, parent_chunk_id AS parent,
       {sql.n_tokens("text")} AS token_count, md5(text) AS text_md5 FROM children
UNION ALL SELECT paper_id || '#0', paper_id, 'parent', 'Body', '', {sql.n_tokens("text")}, md5(text)
FROM papers WHERE text <> ''
UNION ALL SELECT paper_id || '#abstract', paper_id, 'parent', 'Abstract', '', {sql.n_tokens("abstract")}, md5(abstract)
FROM papers""")
def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    return tables.chunks(tables.documents(spark, sf)).select(
        "chunk_id", "paper_id", "chunk_type", "section_name",
        F.coalesce("parent_chunk_id", F.lit("")).alias("parent"), "token_count",
        F.md5("text").alias("text_md5"))


@query("paper_status", f"""WITH {sql.children(filtered=True)}, n AS (
  SELECT paper_id, count(*) AS n_children FROM children GROUP BY paper_id)
SELECT CAST(d.doc_id AS VARCHAR) AS paper_id, coalesce(n.n_children, 0) AS n_children,
  CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN n.n_children > 0 THEN 'full' ELSE 'abstract_only' END AS ingestion_status
FROM documents d LEFT JOIN n ON n.paper_id = CAST(d.doc_id AS VARCHAR) LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def paper_status(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents count as run, the others as pending."""
    docs = tables.documents(spark, sf)
    kept = filter_blocks(tables.blocks(docs)).select("paper_id", "text", F.lit("child").alias("chunk_type"))
    chunks = kept.select("paper_id", "chunk_type", F.explode(
        split_tokens(F.col("text"), tables.CHUNK_TOKENS, tables.CHUNK_OVERLAP)))
    run = tables.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("paper_id"))
    return ingestion_status(docs, chunks, attempted=run)


# --- Filters ------------------------------------------------------------------------------

# Section names that are dropped.
_DROP = ("references", "bibliography", "acknowledgements", "acknowledgments", "funding", "appendix",
         "author contributions", "conflict of interest", "conflicts of interest", "data availability",
         "supplementary")
_STARTS = " OR ".join(f"starts_with(name, '{p}')" for p in _DROP)


@query("equation_only", f"""SELECT CAST(doc_id AS VARCHAR) AS paper_id, {sql.equation_only("text", 400)} AS equation_only
FROM documents""")
def equation_only(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).select(
        "paper_id", is_equation_only(F.col("text"), 400).alias("equation_only"))


@query("filter_blocks", f"""WITH b AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, string_split(text, chr(10))[1] AS section_name, text,
         {sql.strip("lower(string_split(text, chr(10))[1])")} AS name FROM documents WHERE text <> '')
SELECT paper_id, md5(section_name) AS section_md5 FROM b
WHERE starts_with(name, 'abstract') OR starts_with(name, 'the ')
   OR (NOT ({_STARTS} OR starts_with(name, 'is ') OR starts_with(name, 'and ')) AND NOT {sql.equation_only("text")})""")
def filter_blocks_query(spark: SparkSession, sf: str) -> DataFrame:
    """The first line names the section; common words join the drop and keep lists."""
    blocks = tables.blocks(tables.documents(spark, sf)).withColumn(
        "section_name", F.get(F.split("text", "\n"), F.lit(0)))
    kept = filter_blocks(blocks, drop=(*_DROP, "is ", "and "), keep=("abstract", "the "))
    return kept.select("paper_id", F.md5("section_name").alias("section_md5"))


# --- Pages and lines ----------------------------------------------------------------------

def _unescape(expr: str) -> str:
    """The entities that occur in the pages, spelled out for the SQL side."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"),
                         ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


_PAGE_TEXT = rf"""raw AS (
  SELECT CAST(page_id AS VARCHAR) AS paper_id,
         regexp_replace(regexp_replace(html, '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]', '', 'g'),
           '(?is)<(script|style)[^>]*>.*?</(script|style)\s*>|<!--.*?-->', '<x>', 'g') AS html FROM pages),
parts AS (
  SELECT paper_id, regexp_extract(html, '(?s)<article>.*?<h1>(.*?)</h1>', 1) AS title,
         regexp_extract(html, '(?s)<article>.*?</h1>(.*?)</article>', 1) AS body FROM raw
  WHERE regexp_matches(html, '(?s)<article>.*?<h1>')),
nodes AS (
  SELECT paper_id, unnest(regexp_split_to_array(body, '<[^>]*>')) AS node,
         generate_subscripts(regexp_split_to_array(body, '<[^>]*>'), 1) AS pos FROM parts),
trimmed AS (SELECT paper_id, pos, {sql.strip(_unescape("node"))} AS node FROM nodes),
prose AS (
  SELECT paper_id, string_agg(node, ' ' ORDER BY pos) AS text FROM trimmed WHERE node <> '' GROUP BY paper_id)"""


@query("page_blocks", f"""WITH {_PAGE_TEXT}
SELECT p.paper_id, 0 AS block_idx, {sql.strip(_unescape("p.title"))} AS section_name,
  'text' AS content_type, md5(r.text) AS text_md5
FROM parts p JOIN prose r USING (paper_id)""")
def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The headed article of every page as one prose block."""
    return extract_blocks(tables.pages(spark, sf), root="article").select(
        "paper_id", "block_idx", "section_name", "content_type", F.md5("text").alias("text_md5"))


@query("page_tables", r"""WITH links AS (
  SELECT CAST(page_id AS VARCHAR) AS paper_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs,
         regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM pages),
grid AS (SELECT paper_id, list_transform(list_zip(hrefs, texts), lambda z:
  '| ' || replace(z[1], '|', '\|') || ' | ' || replace(z[2], '|', '\|') || ' |') AS body FROM links)
SELECT paper_id, CASE WHEN len(body) = 0 THEN '| link | text |' || chr(10) || '| --- | --- |'
  ELSE '| link | text |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(body, chr(10)) END AS markdown
FROM grid""")
def page_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The link list of every page as a markdown table."""
    def cells(group: int):
        return F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(group))

    rows = F.concat(F.array(F.array(F.lit("link"), F.lit("text"))),
                    F.zip_with(cells(1), cells(2), lambda a, b: F.array(a, b)))
    return tables.pages(spark, sf).select("paper_id", rows_to_markdown(rows).alias("markdown"))


def document_lines(docs: DataFrame) -> DataFrame:
    """Documents as extracted text lines: 40 lines a page, short lines set large."""
    lines = docs.select("paper_id", F.posexplode(F.filter(
        F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")),
        lambda x: x != "")).alias("_n", "text"))
    page, line = F.floor(F.col("_n") / 40).cast("int"), (F.col("_n") % 40).cast("int")
    top = line * 12.0 + F.when(F.length("text") % 3 == 0, 5.0).otherwise(0.0)
    return lines.select(
        "paper_id", page.alias("page"), line.alias("line_no"),
        F.when(F.col("_n") % 7 == 3, F.concat(F.lit("Figure "), F.col("_n").cast("string"), F.lit(" "), F.col("text")))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.length("text") < 60, 14.0).otherwise(10.0).alias("max_font"),
        (F.length("text") % 11 == 0).alias("is_bold"), top.alias("y0"), (top + 4.0).alias("y1"),
        (F.length("text") % 13 == 0).alias("in_table"))


_LINES = r"""split AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
numbered AS (SELECT paper_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS n FROM split),
lines AS (
  SELECT paper_id, n // 40 AS page, n % 40 AS line_no, n,
         CASE WHEN n % 7 = 3 THEN 'Figure ' || CAST(n AS VARCHAR) || ' ' || t ELSE t END AS text,
         length(t) < 60 OR length(t) % 11 = 0 AS big, length(t) % 13 = 0 AS in_table,
         (n % 40) * 12.0::DOUBLE + CASE WHEN length(t) % 3 = 0 THEN 5 ELSE 0 END AS y0 FROM numbered),
marked AS (
  SELECT *, regexp_matches(text, '(?i)^\s*(figure|fig\.?)\s*\d+') AS starts,
         y0 - lag(y0 + 4) OVER (PARTITION BY paper_id, page ORDER BY line_no) > 14 AS gap FROM lines),
looked AS (
  SELECT *, max(CASE WHEN starts THEN line_no END) OVER w AS start_at,
         max(CASE WHEN gap THEN line_no END) OVER w AS broken_at FROM marked
  WINDOW w AS (PARTITION BY paper_id, page ORDER BY line_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
roles AS (
  SELECT l.*, CASE WHEN l.start_at IS NOT NULL AND NOT s.in_table AND coalesce(l.broken_at, -1) <= l.start_at
         THEN l.page * 40 + l.start_at END AS caption
  FROM looked l LEFT JOIN lines s ON s.paper_id = l.paper_id AND s.page = l.page AND s.line_no = l.start_at),
live AS (SELECT *, caption IS NULL AND big AND length(text) < 120 AS heading FROM roles
         WHERE caption IS NOT NULL OR NOT in_table),
opened AS (SELECT *, max(CASE WHEN heading THEN n END) OVER (PARTITION BY paper_id ORDER BY n
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM live),
named AS (SELECT o.*, h.text AS section_name FROM opened o LEFT JOIN live h
          ON h.paper_id = o.paper_id AND h.n = o.section),
heads AS (SELECT paper_id, n, lead(n) OVER (PARTITION BY paper_id ORDER BY n) AS closed FROM live WHERE heading),
figures AS (
  SELECT paper_id, caption AS emitted, coalesce(any_value(section_name), 'Figure') AS section_name,
         regexp_replace(string_agg(text, ' ' ORDER BY n), '\s+', ' ', 'g') AS text, 'figure' AS content_type
  FROM named WHERE caption IS NOT NULL GROUP BY paper_id, caption, section),
sections AS (
  SELECT m.paper_id, coalesce(h.closed, 9999999) AS emitted, m.section_name, m.text, 'text' AS content_type FROM (
    SELECT paper_id, section, section_name, string_agg(text, ' ' ORDER BY n) AS text FROM named
    WHERE caption IS NULL AND NOT heading AND section IS NOT NULL GROUP BY ALL) m
  JOIN heads h ON h.paper_id = m.paper_id AND h.n = m.section),
known AS (SELECT * FROM figures UNION ALL SELECT * FROM sections),
body AS (
  SELECT paper_id, 0 AS emitted, 'Body' AS section_name, string_agg(text, ' ' ORDER BY n) AS text, 'text' AS content_type
  FROM named WHERE caption IS NULL AND NOT heading AND section IS NULL
    AND paper_id NOT IN (SELECT paper_id FROM known) AND paper_id NOT IN (SELECT paper_id FROM heads)
  GROUP BY paper_id),
line_blocks AS (
  SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY emitted) - 1 AS INTEGER) AS block_idx,
         section_name, text, content_type FROM (SELECT * FROM known UNION ALL SELECT * FROM body))"""


@query("line_blocks", f"""WITH {_LINES}
SELECT paper_id, block_idx, md5(section_name) AS section_md5, content_type, md5(text) AS text_md5 FROM line_blocks""")
def line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return lines_to_blocks(document_lines(tables.documents(spark, sf))).select(
        "paper_id", "block_idx", F.md5("section_name").alias("section_md5"), "content_type",
        F.md5("text").alias("text_md5"))


@query("blocks_with_fallback", f"""WITH {_LINES},
flat AS (SELECT CAST(d.doc_id AS VARCHAR) AS paper_id, 'Body' AS section_name, 'text' AS content_type
         FROM documents d JOIN labels l USING (doc_id) WHERE d.text <> '')
SELECT paper_id, section_name = 'Body' AS is_body, content_type, count(*) AS n_blocks FROM (
  SELECT * FROM flat UNION ALL SELECT paper_id, section_name, content_type FROM line_blocks
  WHERE paper_id NOT IN (SELECT paper_id FROM flat)) GROUP BY ALL""")
def blocks_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents come as whole blocks, the others fall back to their lines."""
    docs = tables.documents(spark, sf)
    labelled = tables.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("paper_id"))
    whole = tables.blocks(docs).join(labelled, "paper_id", "left_semi")
    return extract_with_fallback(whole, lines_to_blocks(document_lines(docs))).groupBy(
        "paper_id", (F.col("section_name") == "Body").alias("is_body"), "content_type").agg(
        F.count("*").alias("n_blocks"))


@query("media_links", r"""SELECT CAST(page_id AS VARCHAR) AS paper_id,
  CASE WHEN page_id % 3 = 0 THEN 'https://arxiv.org/html/' || page_id || 'v1/' || x || '.png' ELSE '' END AS media_url
FROM (SELECT page_id, md5(url) AS x FROM pages)""")
def media_links(spark: SparkSession, sf: str) -> DataFrame:
    """Relative links inside and outside a paper's own folder, and links to other hosts."""
    pages = tables.read(spark, sf, "pages").select(
        F.col("page_id"), F.col("page_id").cast("string").alias("paper_id"), F.md5("url").alias("_x"))
    src = (F.when(F.col("page_id") % 3 == 0, F.concat("paper_id", F.lit("v1/./a/../"), "_x", F.lit(".png")))
           .when(F.col("page_id") % 3 == 1, F.concat("paper_id", F.lit("v1/../../x/"), "_x"))
           .otherwise(F.concat(F.lit("https://example.org/html/"), "paper_id")))
    return pages.select("paper_id", F.coalesce(
        resolve_media_url(src, F.col("paper_id")), F.lit("")).alias("media_url"))


# --- Ids and feeds ------------------------------------------------------------------------

_RAW_ID = r"""raw AS (SELECT doc_id, CASE doc_id % 5
    WHEN 0 THEN '2301.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || 'v' || (doc_id % 9 + 1)
    WHEN 1 THEN 'solv-int/' || lpad(CAST(doc_id AS VARCHAR), 7, '0')
    WHEN 2 THEN 'math.AG/' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || 'v2'
    WHEN 3 THEN ' 23.' || doc_id ELSE '/..' || source || '//' || doc_id || '!/' END AS id FROM documents)"""


def _raw_ids(spark: SparkSession, sf: str) -> DataFrame:
    d, text = F.col("doc_id"), F.col("doc_id").cast("string")
    long_id = F.lpad(text, 7, "0")
    return tables.read(spark, sf, "documents").select("doc_id", "text", "source", F.when(d % 5 == 0, F.concat(
        F.lit("2301."), F.lpad(text, 5, "0"), F.lit("v"), (d % 9 + 1).cast("string")))
        .when(d % 5 == 1, F.concat(F.lit("solv-int/"), long_id))
        .when(d % 5 == 2, F.concat(F.lit("math.AG/"), long_id, F.lit("v2")))
        .when(d % 5 == 3, F.concat(F.lit(" 23."), text))
        .otherwise(F.concat(F.lit("/.."), "source", F.lit("//"), text, F.lit("!/"))).alias("id"))


@query("paper_ids", rf"""WITH {_RAW_ID}
SELECT doc_id, coalesce(regexp_matches(trim(id), '^\d{{4}}\.\d{{4,5}}(v\d+)?$')
    OR regexp_matches(trim(id), '^[a-z\-]+(\.[A-Z]{{2}})?/\d{{7}}(v\d+)?$'), FALSE) AS valid,
  regexp_replace(replace(regexp_replace(id, '[^A-Za-z0-9._/-]', '', 'g'), '..', ''), '^/+|/+$', '', 'g') AS safe_id,
  regexp_replace(trim(id), 'v\d+$', '') AS canonical_id FROM raw""")
def paper_ids(spark: SparkSession, sf: str) -> DataFrame:
    link = F.concat(F.lit("http://arxiv.org/abs/"), F.trim("id"))
    return _raw_ids(spark, sf).select(
        "doc_id", valid_paper_id(F.col("id")).alias("valid"), safe_path_id(F.col("id")).alias("safe_id"),
        canonical_paper_id(link).alias("canonical_id"))


@query("atom_entries", rf"""WITH {_RAW_ID}
SELECT regexp_replace(trim(r.id), 'v\d+$', '') AS paper_id,
  {sql.strip("string_split(d.text, chr(10))[1]")} AS title, md5({sql.strip("d.text")}) AS abstract_md5,
  d.source || '|' || d.lang AS authors, '2024-01-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') AS published_date
FROM documents d JOIN raw r USING (doc_id)""")
def atom_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Every document written as a feed of one entry and read back."""
    def escaped(col):
        out = F.col(col) if isinstance(col, str) else col
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
            out = F.replace(out, F.lit(char), F.lit(entity))
        return out

    docs = _raw_ids(spark, sf).join(tables.read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    feeds = docs.select(F.concat(
        F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/'),
        escaped(F.trim("id")), F.lit("</id><title>"), escaped(F.get(F.split("text", "\n"), F.lit(0))),
        F.lit("</title><summary>"), escaped("text"), F.lit("</summary><published>2024-01-"), day,
        F.lit("</published><author><name>"), F.col("source"), F.lit("</name></author><author><name>"),
        F.col("lang"), F.lit("</name></author></entry></feed>")).alias("xml"))
    return parse_atom_entries(feeds, "xml").select(
        "paper_id", "title", F.md5("abstract").alias("abstract_md5"),
        F.array_join("authors", "|").alias("authors"), "published_date")


# --- Store --------------------------------------------------------------------------------

@query("paper_upsert", f"""WITH {sql.children()}, lab AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, quality FROM labels),
old AS (SELECT chunk_id, paper_id, 'old' AS version FROM children),
new AS (SELECT CAST(doc_id AS VARCHAR) || '#new' AS chunk_id, CAST(doc_id AS VARCHAR) AS paper_id, 'new' AS version
        FROM documents JOIN labels USING (doc_id) WHERE toxic = 0)
SELECT * FROM old WHERE paper_id NOT IN (SELECT paper_id FROM lab WHERE quality = 0)
UNION ALL SELECT n.* FROM new n WHERE n.paper_id IN (SELECT paper_id FROM lab WHERE quality = 0)""")
def paper_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled papers come in again, those of high quality are full already and stay; toxic
    ones come in without chunks."""
    docs = tables.documents(spark, sf)
    labels = tables.read(spark, sf, "labels").withColumn("paper_id", F.col("doc_id").cast("string"))
    columns = ("chunk_id", "paper_id")
    existing = tables.children(docs).select(*columns, F.lit("old").alias("version"))
    incoming = labels.filter("toxic = 0").select(
        F.concat("paper_id", F.lit("#new")).alias("chunk_id"), "paper_id", F.lit("new").alias("version"))
    status = labels.select("paper_id", F.when(F.col("quality") == 1, "full").otherwise("failed").alias("ingestion_status"))
    return upsert_paper_chunks(existing, incoming, labels, status)


@query("store_upsert_twice", f"""WITH {sql.children()}
SELECT c.chunk_id, c.paper_id, CASE WHEN l.doc_id IS NULL THEN 'Body' ELSE 'Again' END AS section_name
FROM children c LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = c.paper_id""")
def store_upsert_twice(spark: SparkSession, sf: str) -> DataFrame:
    """A bucketed store on disk; labelled papers are replaced twice, which equals once."""
    docs = tables.documents(spark, sf)
    path = new_shared_path(spark, "store")
    rows = staged(tables.children(docs), "children")
    write_store(rows, path, 16)
    run = tables.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("paper_id"))
    again = rows.withColumn("section_name", F.lit("Again")).join(run, "paper_id", "left_semi").select(*rows.columns)
    for _ in range(2):
        upsert_store(spark, path, again, run, schemas.CHUNKS, 16, force=True)
    return read_store(spark, path, schemas.CHUNKS).select("chunk_id", "paper_id", "section_name")


@query("run_log", f"""WITH {sql.children()}, flagged AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, max(toxic) AS toxic FROM labels GROUP BY ALL)
SELECT c.chunk_id, c.paper_id, CASE WHEN l.toxic IS NULL THEN 'Body' ELSE 'Again' END AS section_name
FROM children c LEFT JOIN flagged l USING (paper_id) WHERE l.toxic IS NULL OR l.toxic = 0""")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Three committed runs over one store: all documents, the labelled ones anew, the toxic ones emptied; the
    first two are compacted before the third."""
    path = new_shared_path(spark, "log")
    rows = staged(tables.children(tables.documents(spark, sf)), "children")
    labels = tables.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("paper_id"), "toxic")
    again = rows.withColumn("section_name", F.lit("Again")).join(labels, "paper_id", "left_semi").select(*rows.columns)
    append_run(spark, path, {"chunks": rows}, rows.select("paper_id"), 16)
    append_run(spark, path, {"chunks": again}, labels, 16)
    compact(spark, path, {"chunks": schemas.CHUNKS}, 16)
    append_run(spark, path, {"chunks": rows.limit(0)}, labels.filter("toxic = 1"), 16)
    return read_table(spark, path, "chunks", schemas.CHUNKS).select("chunk_id", "paper_id", "section_name")


#: Chunks of pages: the window rule of production, and one parent for each paper's (empty) abstract.
PAGE_CHUNKS = rf"""{_PAGE_TEXT},
kept AS (
  SELECT p.paper_id, len(regexp_extract_all(r.text, '\S+')) AS n FROM parts p JOIN prose r USING (paper_id)
  WHERE NOT {sql.equation_only("r.text")}),
kids AS (SELECT paper_id, n, unnest(range(0, greatest(0, n - 65) + 1, 448)) AS start FROM kept),
page_chunks AS (
  SELECT paper_id, 'parent' AS chunk_type, n AS tokens FROM kept
  UNION ALL SELECT CAST(page_id AS VARCHAR), 'parent', 0 FROM pages
  UNION ALL SELECT paper_id, 'child', least(512, n - start) FROM kids)"""


@query("page_ingest", f"""WITH {PAGE_CHUNKS}, vecs AS (SELECT paper_id, count(*) AS n_vectors FROM kids GROUP BY paper_id)
SELECT paper_id, chunk_type, count(*) AS n_chunks, CAST(sum(tokens) AS BIGINT) AS tokens, any_value(n_vectors) AS n_vectors
FROM page_chunks LEFT JOIN vecs USING (paper_id) GROUP BY paper_id, chunk_type""")
def page_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """All pages through the whole ingestion into a store; counts per paper."""
    pages = tables.pages(spark, sf)
    papers = tables.read(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("paper_id"), F.col("url").alias("title"),
        F.lit("").alias("abstract"))
    path = new_shared_path(spark, "ingest")
    ingest_to_store(spark, path, papers, pages, root="article", buckets=16)
    chunks = read_table(spark, path, "chunks", schemas.CHUNKS)
    vectors = read_table(spark, path, "vectors", schemas.VECTORS)
    return chunks.groupBy("paper_id", "chunk_type").agg(
        F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens")).join(
        vectors.groupBy("paper_id").agg(F.count("*").alias("n_vectors")), "paper_id", "left")


@query("page_quarantine", f"""WITH {PAGE_CHUNKS}
SELECT CAST(page_id AS VARCHAR) AS paper_id,
       CASE WHEN length(html) % 5 = 0 THEN 'failed' WHEN page_id::VARCHAR IN (SELECT paper_id FROM kids) THEN 'full' ELSE 'abstract_only' END
         AS ingestion_status
FROM pages""")
def page_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Status of all pages after a run in which a fifth of them has markup that cannot be read."""
    pages = tables.pages(spark, sf).withColumn(
        "html", F.when(F.length("html") % 5 == 0, F.concat("html", F.lit("<![bad[markup]]>"))).otherwise(F.col("html")))
    papers = pages.select("paper_id", F.lit("").alias("title"), F.lit("").alias("abstract"))
    return ingest_pages(papers, pages, root="article")[0].select("paper_id", "ingestion_status")


@query("index_drift", f"""WITH {sql.children()},
vec AS (
  SELECT c.chunk_id, c.paper_id FROM children c JOIN labels l ON CAST(l.doc_id AS VARCHAR) = c.paper_id
  WHERE NOT (l.toxic = 1 AND c.child_idx = 0)
  UNION ALL SELECT paper_id || '#gone', paper_id FROM (SELECT CAST(doc_id AS VARCHAR) AS paper_id FROM labels WHERE quality = 0)),
m AS (
  SELECT coalesce(c.paper_id, v.paper_id) AS paper_id, c.chunk_id IS NOT NULL AS hc, v.chunk_id IS NOT NULL AS hv,
         coalesce({sql.strip("c.text")} = '', FALSE) AS blank
  FROM children c FULL JOIN vec v ON v.chunk_id = c.chunk_id),
t AS (SELECT paper_id, count(*) FILTER (hc AND NOT hv) AS missing_vectors, count(*) FILTER (NOT hc) AS orphan_vectors,
             count(*) FILTER (blank) AS blank_text, count(*) FILTER (hv) AS n FROM m GROUP BY paper_id)
SELECT paper_id, missing_vectors, orphan_vectors, blank_text, CASE WHEN n = 0 THEN 'no_vectors'
  WHEN missing_vectors + orphan_vectors + blank_text > 0 THEN 'drift' ELSE 'in_sync' END AS status FROM t""")
def index_drift_query(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled papers have vectors; toxic ones lost their first, poor ones have a stray one."""
    chunks = staged(tables.children(tables.documents(spark, sf)), "children")
    labels = tables.read(spark, sf, "labels").withColumn("paper_id", F.col("doc_id").cast("string"))
    vectors = chunks.join(labels.select("paper_id", "toxic"), "paper_id").filter(
        ~((F.col("toxic") == 1) & F.endswith("chunk_id", F.lit("#0#0")))).select("chunk_id", "paper_id")
    stray = labels.filter("quality = 0").select(F.concat("paper_id", F.lit("#gone")).alias("chunk_id"), "paper_id")
    return index_drift(chunks, vectors.unionByName(stray))


@query("report_roundtrip", """SELECT CAST(l.quality AS VARCHAR) AS paper_id, 'mean_chars' AS metric,
  round(avg(d.n_chars), 4) AS value FROM labels l JOIN documents d USING (doc_id) GROUP BY l.quality
UNION ALL SELECT CAST(quality AS VARCHAR), 'n', CAST(count(*) AS DOUBLE) FROM labels GROUP BY quality""")
def report_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    labels, docs = tables.read(spark, sf, "labels"), tables.read(spark, sf, "documents")
    mean = labels.join(docs.select("doc_id", "n_chars"), "doc_id").groupBy("quality").agg(
        F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count("*").cast("double").alias("n"))
    scores = mean.unpivot(["quality"], ["mean_chars", "n"], "metric", "value").select(
        F.col("quality").cast("string").alias("paper_id"), "metric", "value")
    path = new_shared_path(spark, "reports")
    write_report(scores.withColumn("value", F.lit(-1.0)), path, "lengths")
    for quality in ("0", "1"):  # replaces its own paper only
        write_report(scores.filter(F.col("paper_id") == quality), path, "lengths")
    return read_report(spark, path, "lengths")
