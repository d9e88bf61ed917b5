"""The corrective loop: bring reserve papers into the corpus where evidence falls short."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrag.functions.rules import MAX_RETRIES, wants_recent
from corrag.operators.filters import filter_blocks
from corrag.operators.chunking import chunk_blocks, ingestion_status
from corrag.operators.embedding import embed_children
from corrag.operators.postings import (
    sparse_encode_documents, sparse_encode_queries, stage_term_counts, term_statistics)
from corrag.operators.search import sparse_search
from corrag.operators.selection import CANDIDATES, select_candidates
from corrag.operators.topk import top_k
from corrag.plans.answer import Evidence, gather_evidence
from corrag.plans.corpus import Corpus
from corrag.session import staged
from corrag.sources.store import upsert_paper_chunks

RESERVE_RESULTS = 5


@dataclass(frozen=True)
class Reserve:
    """Papers that are known but not ingested: their metadata, blocks and search terms."""

    papers: DataFrame
    blocks: DataFrame
    counts: DataFrame


def build_reserve(papers: DataFrame, blocks: DataFrame) -> Reserve:
    """Index title and abstract of the reserve for text search."""
    return Reserve(papers, blocks, stage_term_counts(_reserve_texts(papers), "reserve"))


def _reserve_texts(papers: DataFrame) -> DataFrame:
    return papers.select(F.col("paper_id").alias("chunk_id"), "paper_id", F.concat_ws(
        " ", "title", "abstract").alias("text"))


def search_reserve(
    queries: DataFrame, reserve: Reserve, searches: DataFrame | None = None,
    per_search: int = RESERVE_RESULTS,
) -> DataFrame:
    """``query_id, list_no, rank, paper_id``: results of one or more searches per query.

    ``searches`` (``query_id, list_no, text``) are the texts a model wrote for a query; the
    message itself is searched without them. Queries that ask for recent work order their
    matches by date, newest first, the others by relevance.
    """
    asked = queries.select("query_id", wants_recent(F.col("user_message")).alias("_recent"), "user_message")
    if searches is None:
        texts = asked.select("query_id", F.lit(0).alias("list_no"), "_recent", F.col("user_message").alias("text"))
    else:
        texts = searches.join(asked.select("query_id", "_recent"), "query_id").select(
            "query_id", "list_no", "_recent", "text")
    # One search per query and list; the list number ends the key and has no "#" in it.
    texts = texts.withColumn("_pair", F.concat_ws("#", "query_id", F.col("list_no").cast("string")))
    known = _reserve_texts(reserve.papers)
    sparse = sparse_encode_documents(known, counts=reserve.counts)
    terms = sparse_encode_queries(
        texts.select(F.col("_pair").alias("query_id"), "text"), term_statistics(reserve.counts),
        known.agg(F.count("*")).scalar(), "text")
    recent = texts.select(F.col("_pair").alias("query_id"), "_recent")

    def found(part: DataFrame, limit: int | None) -> DataFrame:
        mine = terms.join(part.select("query_id"), "query_id", "left_semi")
        return sparse_search(mine, sparse, limit)

    relevant = found(recent.filter(~F.col("_recent")), per_search)
    # Every match competes by date, so nothing is cut by relevance first.
    dates = reserve.papers.select("paper_id", F.coalesce("published_date", F.lit("")).alias("_date"))
    matched = found(recent.filter(F.col("_recent")), None).drop("rank").join(dates, "paper_id")
    newest = top_k(matched, ["query_id"], [F.desc("_date"), F.desc("score"), F.asc("chunk_id")], per_search)
    both = relevant.select("query_id", "paper_id", "rank").unionByName(
        newest.select("query_id", "paper_id", "rank"))
    return both.select(
        F.regexp_replace("query_id", "#[^#]*$", "").alias("query_id"),
        F.substring_index("query_id", "#", -1).cast("int").alias("list_no"), "rank", "paper_id")


def ingest_into(corpus: Corpus, papers: DataFrame, blocks: DataFrame) -> Corpus:
    """The corpus with further papers; papers that are already full are left as they are.

    Only the new rows are computed and written. The large tables are not copied: old rows of
    the same papers are masked by an anti join against the short list of new ids.
    """
    settings = corpus.settings
    fresh = staged(papers.join(
        corpus.papers.filter(F.col("ingestion_status") == "full").select("paper_id"),
        "paper_id", "left_anti"), "new-papers")
    ids = fresh.select("paper_id")
    new_blocks = blocks.join(ids, "paper_id", "left_semi")
    chunks = staged(chunk_blocks(
        fresh, filter_blocks(new_blocks), settings.max_tokens, settings.overlap), "new-chunks")
    vectors = staged(embed_children(chunks, settings.embedder, dim=settings.dim), "new-vectors")
    counts = stage_term_counts(chunks.filter(F.col("chunk_type") == "child"), "new-terms")
    status = ingestion_status(fresh, chunks).select("paper_id", "ingestion_status")
    rows = staged(fresh.drop("ingestion_status").join(status, "paper_id").select(
        *corpus.papers.columns), "new-rows")

    def with_new(old: DataFrame, new: DataFrame) -> DataFrame:
        return upsert_paper_chunks(old, new, ids, force=True)

    return replace(corpus, papers=with_new(corpus.papers, rows), chunks=with_new(corpus.chunks, chunks),
                   vectors=with_new(corpus.vectors, vectors), counts=with_new(corpus.counts, counts))


@dataclass(frozen=True)
class Corrected:
    evidence: Evidence
    corpus: Corpus
    rounds: DataFrame


def corrective_search(
    queries: DataFrame, corpus: Corpus, reserve: Reserve, max_retries: int = MAX_RETRIES,
    searches: DataFrame | None = None, relevant: DataFrame | None = None,
    verdicts: DataFrame | None = None, keep: int = CANDIDATES,
) -> Corrected:
    """Grade all queries, pull in papers for those that fall short, search these again.

    The counter goes up before it is compared, so ``max_retries = 2`` means two rounds of
    ingestion and one repeated search. Different queries may want the same paper: a round
    ingests the distinct papers once. Deep-dive queries never pull in papers. Each round ends
    in staged tables, which keeps the plan short; the loop ends when no query falls short.
    """
    evidence = gather_evidence(queries, corpus, verdicts=verdicts)
    rounds = None
    for attempt in range(1, max_retries + 1):
        short = staged(evidence.grades.filter(~F.col("sufficient")).join(
            queries.filter(F.col("mode") != "deep_dive"), "query_id").select(*queries.columns), "short")
        if short.isEmpty():
            break
        wanted = staged(select_candidates(
            search_reserve(short, reserve, searches), relevant, keep).withColumn("attempt", F.lit(attempt)),
            "wanted")
        rounds = wanted if rounds is None else rounds.unionByName(wanted)
        chosen = reserve.papers.join(wanted.select("paper_id").distinct(), "paper_id", "left_semi")
        corpus = ingest_into(corpus, chosen, reserve.blocks)
        if attempt < max_retries:
            again = gather_evidence(short, corpus, verdicts=verdicts)
            evidence = merge_evidence(evidence, again, short)
    return Corrected(evidence, corpus, rounds)


def merge_evidence(old: Evidence, new: Evidence, redone: DataFrame) -> Evidence:
    """``new`` for the queries that were searched again, ``old`` for the rest."""
    ids = redone.select("query_id")

    def merged(name: str) -> DataFrame:
        kept = getattr(old, name).join(ids, "query_id", "left_anti")
        return kept.unionByName(getattr(new, name))

    return Evidence(old.queries, *(merged(n) for n in ("hits", "reranked", "selected", "sections", "grades")))
