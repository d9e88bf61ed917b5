"""Models brought by the caller: embedder, scorer, tokenizer, verdicts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrag.catalog import sqltext as sql
from corrag.catalog import tables
from corrag.catalog.registry import query
from corrag.functions.plugins import batch_scorer, batch_tokenizer, with_verdicts
from corrag.functions.rules import says_yes
from corrag.operators.chunking import child_chunks
from corrag.operators.embedding import embed
from corrag.operators.search import enrich_hits, sparse_search
from corrag.operators.selection import rerank
from corrag.operators.postings import sparse_encode_documents, sparse_encode_queries, stage_term_counts
from corrag.session import staged


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in for a hosted embedder: how often each of five letters occurs."""
    return [[float(text.count(letter)) for letter in "aeiou"] for text in texts]


@query("plugin_embedder", """SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(i AS INTEGER) AS i,
  CAST(length(text) - length(replace(text, 'aeiou'[i + 1], '')) AS DOUBLE) AS value FROM documents, range(5) r(i)""")
def plugin_embedder(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf).select("paper_id", "text")
    return embed(docs, "text", letter_counts, batch=64).select(
        "paper_id", F.posexplode_outer("dense_vector").alias("i", "value")).withColumn("value", F.col("value").cast("double"))


def length_ratio(queries: list[str], texts: list[str]) -> list[float]:
    """A stand-in for a cross-encoder: how alike the two lengths are."""
    return [min(len(q), len(t)) / max(len(q), len(t), 1) for q, t in zip(queries, texts)]


@query("plugin_scorer", f"""WITH {sql.PAPERS}, {sql.bm25("papers", "paper_id", "paper_id", "text", idf=False, avg_len="256")},
{sql.ranked("sparse", "hits", 10)},
scored AS (SELECT h.query_id, h.chunk_id, round(least(length(p.text), length(b.text)) / greatest(length(p.text), length(b.text), 1)::DOUBLE, 6) AS score
  FROM hits h JOIN papers p ON p.paper_id = h.chunk_id JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = h.query_id
  WHERE {sql.strip("p.text")} <> ''),
{sql.ranked("scored", "top", 5)} SELECT query_id, chunk_id, score, rank FROM top""")
def plugin_scorer(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf).select(F.col("paper_id").alias("chunk_id"), "paper_id", "text")
    asked = tables.questions(spark, sf)
    sparse = sparse_encode_documents(docs, avg_len=256.0, counts=stage_term_counts(docs))
    hits = staged(sparse_search(sparse_encode_queries(asked), sparse, 10), "hits")
    chunks = docs.withColumn("parent_chunk_id", F.lit(None).cast("string"))
    return rerank(enrich_hits(hits, chunks), asked, batch_scorer(length_ratio), 5).select(
        "query_id", "chunk_id", "score", "rank")


def lines_with_breaks(texts: list[str]) -> list[list[str]]:
    """A stand-in for a vocabulary: every line with its line break is a token."""
    return [re.findall(r"[^\n]*\n|[^\n]+", text) for text in texts]


@query("plugin_tokenizer", r"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS t
  FROM documents WHERE text <> ''),
w AS (SELECT *, unnest(range(0, greatest(0, len(t) - 2) + 1, 3)) AS start FROM p)
SELECT paper_id || '#0#' || CAST(start // 3 AS VARCHAR) AS chunk_id, len(t[start + 1 : start + 4]) AS token_count,
  md5(array_to_string(t[start + 1 : start + 4], '')) AS text_md5 FROM w""")
def plugin_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of four lines that share one."""
    lines = batch_tokenizer(lines_with_breaks)
    return child_chunks(tables.blocks(tables.documents(spark, sf)), 4, 1, lines, lines).select(
        "chunk_id", "token_count", F.md5("text").alias("text_md5"))


@query("plugin_verdicts", """SELECT CAST(d.doc_id AS VARCHAR) AS query_id, coalesce(l.quality = 1, FALSE) AS sufficient,
  l.doc_id IS NULL AS open FROM documents d LEFT JOIN labels l USING (doc_id)""")
def plugin_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = tables.read(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("query_id"),
        F.when(F.col("quality") == 1, "Yes, it does.").otherwise("No.").alias("verdict"))
    queries = tables.documents(spark, sf).select(F.col("paper_id").alias("query_id"))
    return with_verdicts(queries, verdicts).select(
        "query_id", F.coalesce(says_yes(F.col("verdict")), F.lit(False)).alias("sufficient"),
        F.col("verdict").isNull().alias("open"))
