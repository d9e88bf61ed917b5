"""From search hits to evidence: reranking, diversity, parents, suggestions, candidates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrag.functions.text import let, snippet, strip_ws, words
from corrag.operators.blockmatch import unit_rows
from corrag.operators.topk import top_k

Scorer = Callable[[Column, Column], Column]

RERANK_POOL, FINAL_HITS, MMR_LAMBDA = 12, 5, 0.7
MAX_PARENTS = 5
SUGGESTIONS = 5
CANDIDATES = 3


def overlap_scorer(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text holds, 0 to 1."""
    return let(F.array_distinct(words(query)), lambda terms: F.when(
        F.size(terms) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(terms, words(text))) / F.size(terms)))


def rerank(
    hits: DataFrame, queries: DataFrame, scorer: Scorer = overlap_scorer, top: int = RERANK_POOL,
) -> DataFrame:
    """Replace the score by ``scorer(query, text)`` and keep the best; blank texts go first.

    ``scorer`` is any column function, so a pandas UDF around a model fits as well.
    """
    asked = queries.select("query_id", "user_message")
    scored = (hits.drop("score", "rank")
              .filter(strip_ws(F.col("text")) != "")
              .join(asked, "query_id")
              .withColumn("score", F.round(scorer(F.col("user_message"), F.col("text")), 6))
              .drop("user_message"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], top)


def _mmr_picks(lambda_: float, top: int):
    """Greedy choice over one query's candidates; ties go to the earlier candidate."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def picks(scores: pa.Array, vectors: pa.Array) -> pa.Array:
        chosen = []
        for relevance, stored in zip(scores.to_pylist(), vectors.to_pylist()):
            sims = _pairwise(stored)
            gain = lambda_ * np.array(relevance, dtype=np.float64)
            closest, order = np.zeros(len(gain)), []
            open_ = np.ones(len(gain), dtype=bool)
            while len(order) < min(top, len(gain)):
                value = np.round(gain - (1.0 - lambda_) * closest, 9)
                best = int(np.argmax(np.where(open_, value, -np.inf)))
                closest = sims[best] if not order else np.maximum(closest, sims[best])
                open_[best] = False
                order.append(best)
            chosen.append(order)
        return pa.array(chosen, pa.list_(pa.int32()))

    return picks


def _pairwise(vectors: list) -> np.ndarray:
    """Cosines between a query's candidates; different dimensions count as 0."""
    sims = np.zeros((len(vectors), len(vectors)))
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        unit = unit_rows(np.array([vectors[p] for p in places], dtype=np.float64))
        sims[np.ix_(places, places)] = unit @ unit.T
    return sims


def mmr_select(
    hits: DataFrame, queries: DataFrame, lambda_: float = MMR_LAMBDA, top: int = FINAL_HITS,
) -> DataFrame:
    """Maximal marginal relevance over reranked hits with a ``dense_vector`` column.

    Only ``ask`` queries with a query vector and a vector on every hit are diversified; the
    rest keep their first ``top`` hits. Input is one rerank pool per query, a few rows.
    """
    asked = queries.select(
        "query_id", ((F.col("mode") == "ask") & (F.size("query_vector") > 0)).alias("_may"))
    kept = [c for c in hits.columns if c not in ("query_id", "dense_vector", "rank")]
    pools = hits.join(asked, "query_id").groupBy("query_id", "_may").agg(
        F.array_sort(F.collect_list(F.struct("rank", *kept, "dense_vector"))).alias("_pool"))
    full = F.forall("_pool", lambda h: F.coalesce(F.size(h["dense_vector"]), F.lit(0)) > 0)
    pools = pools.withColumn("_mmr", F.coalesce(F.col("_may"), F.lit(False)) & full)
    none = F.array().cast("array<double>"), F.array().cast("array<array<float>>")
    picks = _mmr_picks(lambda_, top)(
        F.when(F.col("_mmr"), F.transform("_pool", lambda h: h["score"])).otherwise(none[0]),
        F.when(F.col("_mmr"), F.transform("_pool", lambda h: h["dense_vector"])).otherwise(none[1]))
    chosen = pools.withColumn("_picks", picks).select("query_id", F.posexplode(
        F.when(F.col("_mmr"), F.transform("_picks", lambda i: F.get("_pool", i)))
        .otherwise(F.slice("_pool", 1, top))).alias("_at", "_hit"))
    return chosen.select("query_id", *(F.col("_hit")[c].alias(c) for c in kept),
                         (F.col("_at") + 1).alias("rank"))


def attach_vectors(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of the hits only; the vector table is cut down before the outer join."""
    wanted = hits.select("chunk_id").distinct()
    found = vectors.join(wanted, "chunk_id", "left_semi").select("chunk_id", "dense_vector")
    return hits.join(found, "chunk_id", "left")


def expand_parents(
    hits: DataFrame, chunks: DataFrame, papers: DataFrame, max_parents: int = MAX_PARENTS,
) -> DataFrame:
    """Distinct parent sections in the order of their best child.

    Parents or papers that are not stored take no slot: join first, then rank and cap.
    """
    wanted = hits.filter(F.col("parent_chunk_id").isNotNull()).groupBy(
        "query_id", F.col("parent_chunk_id").alias("chunk_id")).agg(F.min("rank").alias("_best"))
    parents = chunks.filter(F.col("chunk_type") == "parent").select(
        "chunk_id", "paper_id", "section_name", "text", "content_type", "media_url")
    about = papers.select("paper_id", F.col("title").alias("paper_title"), "published_date", "abstract")
    found = wanted.join(parents, "chunk_id").join(about, "paper_id")
    return top_k(found, ["query_id"], [F.asc("_best")], max_parents).select(
        "query_id", "rank", F.col("chunk_id").alias("section_id"), "paper_id", "paper_title",
        "published_date", "abstract", F.col("section_name").alias("section_title"), "text",
        "content_type", "media_url")


def suggest_papers(
    queries: DataFrame, hits: DataFrame, papers: DataFrame, own_hits: DataFrame | None = None,
    reserve_hits: DataFrame | None = None, reserve: DataFrame | None = None, n: int = SUGGESTIONS,
) -> DataFrame:
    """Related papers for queries whose evidence did not suffice.

    ``hits`` come from a search of the whole corpus. ``own_hits`` are what the queries found
    themselves: a deep-dive query that found nothing there is out of step with the index and
    gets one row with reason ``index_drift`` instead of suggestions. Queries for which the
    corpus offers nothing take the first ``n`` of ``reserve_hits``.
    """
    asked = queries.select("query_id", "mode", F.col("paper_id").alias("_own"))
    drifted = asked.limit(0) if own_hits is None else asked.filter(
        F.col("mode") == "deep_dive").join(own_hits.select("query_id").distinct(), "query_id", "left_anti")
    healthy = asked.join(drifted.select("query_id"), "query_id", "left_anti")

    def ranked(found: DataFrame, about: DataFrame, reason: str, empty_snippet: Column) -> DataFrame:
        named = about.select("paper_id", "title", F.coalesce("abstract", F.lit("")).alias("_abstract"))
        best = found.groupBy("query_id", "paper_id").agg(F.min("rank").alias("_best"))
        return top_k(best, ["query_id"], [F.asc("_best"), F.asc("paper_id")], n, "position").join(
            named, "paper_id", "left").select(
            "query_id", "position", "paper_id", F.coalesce("title", F.lit("")).alias("title"),
            F.coalesce(snippet(F.col("_abstract")), empty_snippet).alias("abstract_snippet"),
            F.lit(reason).alias("reason"))

    no_text = F.lit(None).cast("string")
    usable = hits.select("query_id", "paper_id", "rank").join(healthy, "query_id").filter(
        (F.coalesce(F.col("paper_id"), F.lit("")) != "") & ~F.col("paper_id").eqNullSafe(F.col("_own")))
    corpus = ranked(usable, papers, "corpus", no_text)
    out = corpus.unionByName(drifted.select(
        "query_id", F.lit(1).alias("position"), no_text.alias("paper_id"), F.lit("").alias("title"),
        no_text.alias("abstract_snippet"), F.lit("index_drift").alias("reason")))
    if reserve_hits is not None:
        empty = healthy.join(usable.select("query_id").distinct(), "query_id", "left_anti")
        spare = reserve_hits.join(empty.select("query_id"), "query_id", "left_semi")
        out = out.unionByName(ranked(spare, reserve, "reserve", F.lit("")))
    return out


def select_candidates(
    results: DataFrame, relevant: DataFrame | None = None, keep: int = CANDIDATES,
) -> DataFrame:
    """Papers to pull in per query, from several result lists.

    ``results``: ``query_id, list_no, rank, paper_id``. The first occurrence of a paper counts;
    the pool is the first ``2 * keep``. Papers marked in ``relevant`` are kept in order, at
    most ``keep``; a query without any mark keeps only the first of its pool.
    """
    seen = results.groupBy("query_id", "paper_id").agg(
        F.min(F.struct("list_no", "rank")).alias("_first"))
    pool = top_k(seen, ["query_id"], [F.asc("_first"), F.asc("paper_id")], 2 * keep, "pool_rank")
    if relevant is None:
        return pool.filter(F.col("pool_rank") == 1).select(
            "query_id", "paper_id", "pool_rank", F.lit(1).alias("position"))
    marks = relevant.select("query_id", "paper_id", F.lit(True).alias("_marked")).distinct()
    judged = marks.select("query_id", F.lit(True).alias("_judged")).distinct()
    kept = (pool.join(marks, ["query_id", "paper_id"], "left").join(judged, "query_id", "left")
            .filter(F.col("_marked") | (F.col("_judged").isNull() & (F.col("pool_rank") == 1))))
    return top_k(kept, ["query_id"], [F.asc("pool_rank")], keep, "position").select(
        "query_id", "paper_id", "pool_rank", "position")
