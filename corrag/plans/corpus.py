"""The searchable corpus: chunk, vector and term tables built from papers and blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrag import schemas
from corrag.functions.text import CHILD_OVERLAP, CHILD_TOKENS
from corrag.operators.chunking import chunk_blocks, ingestion_status
from corrag.operators.embedding import DEFAULT_DIM, Embedder, index_children
from corrag.operators.filters import filter_blocks
from corrag.operators.postings import sparse_encode_documents, term_statistics
from corrag.session import staged
from corrag.sources.store import STORE_BUCKETS
from corrag.sources.tablelog import compact, read_commits, read_table

#: The tables of a store, in the order of ``Corpus``.
TABLES = {"papers": schemas.STORED_PAPERS, "chunks": schemas.CHUNKS, "vectors": schemas.VECTORS, "terms": schemas.TERM_COUNTS}


@dataclass(frozen=True)
class Settings:
    """Knobs of chunking and embedding; the defaults are those of a production run."""

    max_tokens: int = CHILD_TOKENS
    overlap: int = CHILD_OVERLAP
    dim: int = DEFAULT_DIM
    embedder: Embedder | None = None
    avg_len: float | None = None


@dataclass(frozen=True)
class Corpus:
    papers: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    counts: DataFrame
    settings: Settings

    @property
    def children(self) -> DataFrame:
        return self.chunks.filter(F.col("chunk_type") == "child")

    @property
    def sparse(self) -> DataFrame:
        return sparse_encode_documents(
            self.children, avg_len=self.settings.avg_len, counts=self.counts)

    @property
    def statistics(self) -> DataFrame:
        return term_statistics(self.counts)

    @property
    def n_docs(self) -> Column:
        return self.children.agg(F.count("*")).scalar()


def build_corpus(papers: DataFrame, blocks: DataFrame, settings: Settings = Settings()) -> Corpus:
    """Filter, chunk, embed and index. Each table is written once and read from then on."""
    chunks = staged(chunk_blocks(papers, filter_blocks(blocks), settings.max_tokens, settings.overlap),
                    "chunks")
    vectors, counts = index_children(chunks, settings.embedder, settings.dim)
    status = ingestion_status(papers, chunks)
    known = papers.drop("ingestion_status").join(
        status.select("paper_id", "ingestion_status"), "paper_id")
    return Corpus(known, chunks, vectors, counts, settings)


def open_corpus(spark: SparkSession, store: str, settings: Settings = Settings(),
                papers: list[str] | None = None, buckets: int = STORE_BUCKETS) -> Corpus:
    """The corpus that ingestion runs have left under ``store``; nothing is computed anew.

    With ``papers`` only these are read, from their own buckets.
    """
    commits = read_commits(spark, store)  # the same for all tables
    tables = (read_table(spark, store, name, schema, papers, buckets, commits) for name, schema in TABLES.items())
    return Corpus(*tables, settings)


def compact_corpus(spark: SparkSession, store: str, buckets: int = STORE_BUCKETS) -> int | None:
    """Put the runs of a store together, so that readers list few folders and superseded rows go."""
    return compact(spark, store, TABLES, buckets)
