"""The evaluation suite over all judged queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrag import schemas
from corrag.operators.evaluation import TOLERANCE, build_run, comparison_report, regressions
from corrag.operators.postings import sparse_encode_queries
from corrag.operators.search import dense_search, enrich_hits, rrf_fuse, sparse_search
from corrag.operators.selection import rerank
from corrag.plans.corpus import Corpus
from corrag.session import staged
from corrag.sources.store import read_report, write_report

BASELINE = "baseline"


def retrieval_runs(queries: DataFrame, corpus: Corpus, limit: int = 30, item: str = "paper_id") -> DataFrame:
    """The runs ``dense``, ``hybrid`` and ``hybrid_rerank``, with real texts and vectors.

    Both legs are searched once and staged; the three runs share them.
    """
    dense = staged(dense_search(queries, corpus.vectors, 2 * limit), "dense")
    terms = sparse_encode_queries(queries, corpus.statistics, corpus.n_docs)
    sparse = sparse_search(terms, corpus.sparse, 2 * limit)
    hybrid = staged(rrf_fuse([dense, sparse], limit=limit), "hybrid")
    reranked = rerank(enrich_hits(hybrid, corpus.children), queries)
    return (build_run(dense.filter(F.col("rank") <= limit), "dense", item)
            .unionByName(build_run(hybrid, "hybrid", item))
            .unionByName(build_run(reranked, "hybrid_rerank", item)))


def retrieval_report(queries: DataFrame, qrels: DataFrame, corpus: Corpus) -> DataFrame:
    return comparison_report(qrels, staged(retrieval_runs(queries, corpus), "runs"))


def check_baseline(spark: SparkSession, scores: DataFrame, path: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Regressions of ``scores`` (``paper_id, metric, value``) against the saved baseline.

    Papers without a baseline save theirs on this run and have no regressions.
    """
    try:
        baseline = read_report(spark, path, BASELINE)
    except FileNotFoundError:
        baseline = spark.createDataFrame([], schemas.SCORES)
    fresh = scores.join(baseline.select("paper_id").distinct(), "paper_id", "left_anti")
    found = staged(regressions(scores, baseline, tolerance), "regressions")
    write_report(staged(fresh.select("paper_id", "metric", "value"), "baseline"), path, BASELINE, replace=False)
    return found
