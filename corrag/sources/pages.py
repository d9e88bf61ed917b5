"""Documents, pages and extracted lines as they lie in storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrag import schemas
from corrag.session import widened


def load_pages(
    spark: SparkSession, path: str, id_col: str = "paper_id", html_col: str = "html",
) -> DataFrame:
    """Parquet of pages as ``paper_id, html``; a missing page is NULL."""
    pages = spark.read.parquet(path).select(
        F.col(id_col).cast("string").alias("paper_id"), F.col(html_col).alias("html"))
    return widened(pages, "paper_id")


def load_page_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of raw pages, one file per document, named by its id."""
    files = spark.read.text(path, wholetext=True).withColumn("_file", F.col("_metadata.file_name"))
    return files.select(
        F.regexp_replace("_file", r"\.[^.]*$", "").alias("paper_id"), F.col("value").alias("html"))


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LINES).parquet(path)


def load_documents(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                   *extra: Column) -> DataFrame:
    """Flat documents as ``paper_id, text`` and any further columns."""
    documents = spark.read.parquet(path).select(
        F.col(id_col).cast("string").alias("paper_id"), F.col(text_col).alias("text"), *extra)
    return widened(documents, "paper_id")
