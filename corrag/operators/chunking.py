"""Blocks to parent and child chunks, and the status a paper ends up with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrag.functions.text import (
    CHILD_OVERLAP, CHILD_TOKENS, Tokenizer, count_tokens, spaced_tokens, split_counted, split_tokens, tokens)

_CHUNK_COLUMNS = ("chunk_id", "paper_id", "chunk_type", "content_type", "media_url",
                  "section_name", "text", "parent_chunk_id", "token_count")


def _parent_id():
    return F.concat_ws("#", "paper_id", F.col("block_idx").cast("string"))


def block_chunks(
    blocks: DataFrame, max_tokens: int = CHILD_TOKENS, overlap: int = CHILD_OVERLAP,
    tokenizer: Tokenizer = tokens, splitter: Tokenizer = spaced_tokens,
) -> DataFrame:
    """Every block as a parent and its children: prose is cut into overlapping windows; tables and
    figures stay whole.

    A parent stands right before its children, whose texts repeat its own, so that the files of a
    table hold a text about once. The outer explode keeps the planner from adding a filter that
    would cut every text twice.
    """
    # Pieces with their white space are one token each, so a window's tokens need no second count.
    counted = tokenizer is tokens and splitter is spaced_tokens
    text, prose = F.col("text"), F.col("content_type") == "text"
    if counted:
        pieces = F.when(prose, split_counted(text, max_tokens, overlap)).otherwise(
            F.array_repeat(F.struct("text", count_tokens(text).alias("n")), 2))
    else:
        windows = F.when(prose, split_tokens(text, max_tokens, overlap, splitter)).otherwise(F.array("text"))
        pieces = F.concat(F.array("text"), F.coalesce(windows, F.array().cast("array<string>")))
    cut = blocks.select(
        "paper_id", "content_type", "media_url", "section_name", _parent_id().alias("_parent"),
        F.posexplode_outer(pieces).alias("_at", "_w"))
    piece, parent = F.col("_w.text") if counted else F.col("_w"), F.col("_at") == 0
    return cut.filter(parent | piece.isNotNull()).select(
        F.when(parent, F.col("_parent")).otherwise(
            F.concat_ws("#", "_parent", (F.col("_at") - 1).cast("string"))).alias("chunk_id"),
        "paper_id", F.when(parent, "parent").otherwise("child").alias("chunk_type"), "content_type", "media_url",
        "section_name", piece.alias("text"), F.when(~parent, F.col("_parent")).alias("parent_chunk_id"),
        (F.col("_w.n") if counted else count_tokens(piece, tokenizer)).alias("token_count"))


def child_chunks(
    blocks: DataFrame, max_tokens: int = CHILD_TOKENS, overlap: int = CHILD_OVERLAP,
    tokenizer: Tokenizer = tokens, splitter: Tokenizer = spaced_tokens,
) -> DataFrame:
    """The children of ``block_chunks``."""
    return block_chunks(blocks, max_tokens, overlap, tokenizer, splitter).filter(F.col("chunk_type") == "child")


def abstract_chunks(papers: DataFrame, tokenizer: Tokenizer = tokens) -> DataFrame:
    """One parent per paper for its abstract. It has no children and is never searched."""
    abstract = F.coalesce(F.col("abstract"), F.lit(""))
    return papers.select(
        F.concat_ws("#", "paper_id", F.lit("abstract")).alias("chunk_id"), "paper_id",
        F.lit("parent").alias("chunk_type"), F.lit("text").alias("content_type"),
        F.lit(None).cast("string").alias("media_url"), F.lit("Abstract").alias("section_name"),
        abstract.alias("text"), F.lit(None).cast("string").alias("parent_chunk_id"),
        count_tokens(abstract, tokenizer).alias("token_count"))


def chunk_blocks(
    papers: DataFrame, blocks: DataFrame, max_tokens: int = CHILD_TOKENS,
    overlap: int = CHILD_OVERLAP, tokenizer: Tokenizer = tokens,
    splitter: Tokenizer = spaced_tokens,
) -> DataFrame:
    """All chunks of the papers. Ids follow from block and window position, so a re-run
    gives the same ids. The work is row by row, and one pass over the blocks: no shuffle."""
    return (
        block_chunks(blocks, max_tokens, overlap, tokenizer, splitter).select(*_CHUNK_COLUMNS)
        .unionByName(abstract_chunks(papers, tokenizer).select(*_CHUNK_COLUMNS)))


def ingestion_status(
    papers: DataFrame, chunks: DataFrame, failed: DataFrame | None = None,
    attempted: DataFrame | None = None,
) -> DataFrame:
    """``paper_id, n_children, ingestion_status``.

    ``attempted`` names the papers that have been run (all of them when omitted); the others
    are pending. ``failed`` names those whose run broke, which wins.
    """
    counts = (chunks.filter(F.col("chunk_type") == "child")
              .groupBy("paper_id").agg(F.count("*").alias("n_children")))
    status = papers.select("paper_id").join(counts, "paper_id", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)))
    for name, marks in (("_failed", failed), ("_attempted", attempted)):
        if marks is None:
            status = status.withColumn(name, F.lit(name == "_attempted"))
        else:
            flagged = marks.select("paper_id").distinct().withColumn(name, F.lit(True))
            status = status.join(flagged, "paper_id", "left").withColumn(
                name, F.coalesce(name, F.lit(False)))
    return status.select(
        "paper_id", "n_children",
        F.when(F.col("_failed"), F.lit("failed"))
        .when(~F.col("_attempted"), F.lit("pending"))
        .when(F.col("n_children") > 0, F.lit("full"))
        .otherwise(F.lit("abstract_only")).alias("ingestion_status"))
