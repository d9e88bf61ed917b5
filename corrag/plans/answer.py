"""One turn for a whole table of queries: search, rerank, diversify, expand, grade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrag.functions.rules import classify_intent, route_after_classify, route_after_grade
from corrag.operators.embedding import embed
from corrag.operators.filters import grade
from corrag.operators.prompt import build_context, citations, media_markdown
from corrag.operators.search import SEARCH_LIMIT, enrich_hits, hybrid_search
from corrag.operators.selection import (
    Scorer, attach_vectors, expand_parents, mmr_select, overlap_scorer, rerank)
from corrag.plans.corpus import Corpus
from corrag.session import staged


@dataclass(frozen=True)
class Evidence:
    """One table per step, all keyed by ``query_id``."""

    queries: DataFrame
    hits: DataFrame
    reranked: DataFrame
    selected: DataFrame
    sections: DataFrame
    grades: DataFrame


def prepare_queries(queries: DataFrame, corpus: Corpus, verdicts: DataFrame | None = None) -> DataFrame:
    """Add intent, route and query vector. ``verdicts``: ``query_id, intent_verdict``."""
    known = queries if verdicts is None else queries.join(verdicts, "query_id", "left")
    verdict = F.col("intent_verdict") if verdicts is not None else None
    labelled = known.withColumn("intent", classify_intent(F.col("user_message"), F.col("mode"), verdict))
    routed = labelled.withColumn("route", route_after_classify(F.col("intent")))
    if "query_vector" in queries.columns:
        return routed
    return embed(routed, "user_message", corpus.settings.embedder, dim=corpus.settings.dim,
                 out="query_vector")


def gather_evidence(
    queries: DataFrame, corpus: Corpus, scorer: Scorer = overlap_scorer, limit: int = SEARCH_LIMIT,
    idf: bool = True, verdicts: DataFrame | None = None,
) -> Evidence:
    """Queries must be prepared; only those routed to retrieval are searched.

    Hits are staged: they are at most ``limit`` rows per query, several later steps read
    them, and their real size lets the planner broadcast them against the chunk tables.
    """
    asked = queries.filter(F.col("route") == "retrieve")
    found = hybrid_search(
        asked, corpus.vectors, corpus.sparse, limit,
        statistics=corpus.statistics if idf else None, n_docs=corpus.n_docs if idf else None)
    hits = staged(found, "hits")
    reranked = staged(rerank(enrich_hits(hits, corpus.children), asked, scorer), "reranked")
    selected = staged(mmr_select(attach_vectors(reranked, corpus.vectors), asked), "selected")
    sections = staged(expand_parents(selected, corpus.chunks, corpus.papers), "sections")
    grades = grade(asked, selected, verdicts)
    return Evidence(queries, hits, reranked, selected, sections, grades)


def summarize(evidence: Evidence) -> DataFrame:
    """Per query: route after grading, top score, context size, sources and media."""
    about = evidence.queries.select("query_id", "mode", "intent")
    context = build_context(evidence.sections)
    cited = citations(evidence.sections, about).groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "paper_id"))),
                                 lambda c: c["paper_id"]), ",").alias("cited_papers"))
    media = media_markdown(evidence.sections).select("query_id", F.col("n_items").alias("n_media"))
    return (about.join(evidence.grades, "query_id").join(context, "query_id", "left")
            .join(cited, "query_id", "left").join(media, "query_id", "left").select(
        "query_id", "intent", "top_score", "sufficient",
        route_after_grade(F.col("mode"), F.col("sufficient")).alias("route"),
        F.coalesce("n_sections", F.lit(0)).alias("n_sections"),
        F.coalesce("context_tokens", F.lit(0)).alias("context_tokens"),
        F.md5(F.coalesce("context", F.lit(""))).alias("context_md5"),
        F.coalesce("cited_papers", F.lit("")).alias("cited_papers"),
        F.coalesce("n_media", F.lit(0)).alias("n_media")))
