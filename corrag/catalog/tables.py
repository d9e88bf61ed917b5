"""The engine's tables, built by Spark from the given ones. Every row and text is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrag.operators.blocks import documents_to_blocks
from corrag.operators.chunking import chunk_blocks
from corrag.session import widened
from corrag.sources.pages import load_documents, load_pages

CHUNK_TOKENS, CHUNK_OVERLAP = 128, 16


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """``paper_id, text, lang, source, n_chars``."""
    return load_documents(spark, f"{sf}/documents.parquet", "doc_id", "text",
                          F.col("lang"), F.col("source"), F.col("n_chars"))


def papers(docs: DataFrame) -> DataFrame:
    """Title and abstract are the first two lines; the year follows from the length."""
    lines = F.split("text", "\n")
    return docs.select(
        "paper_id", F.get(lines, F.lit(0)).alias("title"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("abstract"),
        F.concat((F.lit(2000) + F.col("n_chars") % 25).cast("string"), F.lit("-01-01")).alias("published_date"),
        F.lit("full").alias("ingestion_status"))


def blocks(docs: DataFrame) -> DataFrame:
    return documents_to_blocks(docs)


def chunks(docs: DataFrame) -> DataFrame:
    return chunk_blocks(papers(docs), blocks(docs), CHUNK_TOKENS, CHUNK_OVERLAP)


def children(docs: DataFrame) -> DataFrame:
    return chunks(docs).filter(F.col("chunk_type") == "child")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark passages as queries: ``query_id, user_message, mode``."""
    return read(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("user_message"),
        F.lit("ask").alias("mode"), F.lit(None).cast("string").alias("paper_id"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", "role",
        F.col("text").alias("content"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return load_pages(spark, f"{sf}/pages.parquet", "page_id", "html")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return widened(read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("paper_id"),
        F.col("embedding").alias("dense_vector")), "chunk_id")
