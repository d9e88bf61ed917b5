"""Ingestion: pages (with text lines as fallback) to the chunk, vector, term and paper tables of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrag import schemas
from corrag.operators.blocks import extract_with_fallback, lines_to_blocks, page_blocks_of, read_pages, unreadable
from corrag.operators.chunking import chunk_blocks, ingestion_status
from corrag.operators.embedding import VECTOR_COLUMNS, embed_children, embed_counts, index_children
from corrag.operators.filters import filter_blocks
from corrag.operators.postings import count_terms
from corrag.plans.corpus import Settings
from corrag.session import shuffles_dropped, staged
from corrag.sources.store import STORE_BUCKETS, papers_to_replace
from corrag.sources.tablelog import Run

#: What a run's term counts carry besides, so that vectors can be made from them.
_CARRIED = [name for name in VECTOR_COLUMNS[:-1] if name not in schemas.TERM_COUNTS.names]
_CARRYING_COUNTS = T.StructType([*schemas.TERM_COUNTS, *(schemas.VECTORS[name] for name in _CARRIED)])


def ingest_blocks(
    papers: DataFrame, blocks: DataFrame, settings: Settings = Settings(), failed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(status, chunks, vectors)`` of the papers; chunks and vectors are computed once."""
    chunks = staged(_chunks(papers, blocks, settings), "ingested")
    return ingestion_status(papers, chunks, failed), chunks, index_children(chunks, settings.embedder, settings.dim)[0]


def _chunks(papers: DataFrame, blocks: DataFrame, settings: Settings) -> DataFrame:
    return chunk_blocks(papers, filter_blocks(blocks), settings.max_tokens, settings.overlap)


def ingest_pages(
    papers: DataFrame, pages: DataFrame, lines: DataFrame | None = None,
    settings: Settings = Settings(), root: str = "section", failed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for pages, with text lines as fallback. Pages are taken apart once; a page that cannot be
    read, and has no lines to stand in, makes its paper ``failed``."""
    blocks, failed = _page_blocks(pages, lines, root, failed)
    return ingest_blocks(papers, blocks, settings, failed)


def _page_blocks(
    pages: DataFrame, lines: DataFrame | None, root: str, failed: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    """The blocks of pages, and the papers that are ``failed``."""
    read = staged(read_pages(pages, root), "blocks")
    blocks, broken = page_blocks_of(read), unreadable(read).select("paper_id")
    if lines is not None:
        spare = staged(lines_to_blocks(lines), "line-blocks")
        blocks = extract_with_fallback(blocks, spare)
        broken = broken.join(spare.select("paper_id").distinct(), "paper_id", "left_anti")
    return blocks, broken if failed is None else failed.select("paper_id").unionByName(broken)


def write_run(
    spark: SparkSession, store: str, papers: DataFrame, blocks: DataFrame, settings: Settings = Settings(),
    failed: DataFrame | None = None, buckets: int = STORE_BUCKETS,
) -> None:
    """Replace the papers of a run in the four tables of a store: chunks, terms, vectors and papers.

    All four become visible with one commit. The cost follows the run's own rows. Each table is written once,
    into the store, and those after it are made from what lies there: only blocks and papers are exchanged.
    Without a plug-in the vectors come from the term counts, so words are cut once.
    """
    run = Run(spark, store, buckets)
    run.derive("chunks", _chunks(run.gather(papers), run.gather(blocks), settings).select(*schemas.CHUNKS.names))
    chunks = run.read("chunks", schemas.CHUNKS)
    status = ingestion_status(papers, chunks, failed)
    known = papers.drop("ingestion_status").join(status.select("paper_id", "ingestion_status"), "paper_id")
    known = known.select(*(
        F.col(f.name) if f.name in known.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schemas.STORED_PAPERS))
    run.write("papers", known)
    run.derive("terms", count_terms(chunks.filter(F.col("chunk_type") == "child"), *_CARRIED))
    vectors = (embed_counts(run.read("terms", _CARRYING_COUNTS), settings.dim) if settings.embedder is None
               else embed_children(chunks, settings.embedder, dim=settings.dim))
    run.derive("vectors", vectors)
    run.commit(papers)


def ingest_to_store(
    spark: SparkSession, store: str, papers: DataFrame, pages: DataFrame,
    lines: DataFrame | None = None, settings: Settings = Settings(), root: str = "section",
    buckets: int = STORE_BUCKETS, existing_papers: DataFrame | None = None, force: bool = False,
    failed: DataFrame | None = None,
) -> None:
    """Replace the papers of this run in the tables under ``store``.

    Papers that ``existing_papers`` knows as ``full`` are not even parsed, unless forced. ``failed``
    names papers whose page could not be had; they get that status.
    """
    ids = papers_to_replace(papers, existing_papers, force)
    fresh, mine = papers.join(ids, "paper_id", "left_semi"), pages.join(ids, "paper_id", "left_semi")
    read = None if lines is None else lines.join(ids, "paper_id", "left_semi")
    blocks, failed = _page_blocks(mine, read, root, failed)
    write_run(spark, store, fresh, blocks, settings, failed, buckets)


def ingest_blocks_to_store(
    spark: SparkSession, store: str, papers: DataFrame, blocks: DataFrame, settings: Settings = Settings(),
    buckets: int = STORE_BUCKETS, existing_papers: DataFrame | None = None, force: bool = False,
) -> None:
    """The same for papers that are blocks already."""
    ids = papers_to_replace(papers, existing_papers, force)
    if force or existing_papers is None:
        fresh, mine = papers.filter(F.col("paper_id").isNotNull()), _without_others(blocks, ids)
    else:
        fresh, mine = papers.join(ids, "paper_id", "left_semi"), blocks.join(ids, "paper_id", "left_semi")
    write_run(spark, store, fresh, mine, settings, buckets=buckets)


def _without_others(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of papers in ``ids``, which are nearly all: the others are found by their ids alone and left out,
    so that texts stay where they are unless very many papers have to go."""
    with shuffles_dropped(rows.sparkSession):
        others = staged(rows.select("paper_id").distinct().join(ids, "paper_id", "left_anti"), "other-papers")
    return rows.filter(F.col("paper_id").isNotNull()).join(others, "paper_id", "left_anti")
