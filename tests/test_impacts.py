"""The impact index against the full ranking of the same vectors."""

import random

import pytest
from pyspark.sql import functions as F

from corrag.operators import impacts
from corrag.operators.postings import sparse_encode_documents, sparse_encode_queries, stage_term_counts, term_statistics
from corrag.operators.search import hybrid_search, sparse_search, sparse_search_join
from corrag.session import new_shared_path, staged

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def corpus(spark):
    """(vectors, query terms): frequent and rare words, ties, repeated texts, empty ones, a hot paper."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, [400 / (i + 1) for i in range(40)], k=rng.choice([0, 3, 10, 40, 200]))) for _ in range(700)]
    texts += ["w0 w1"] * 60 + ["", None, "w39 w39 w39 w0"]
    docs = spark.createDataFrame([(f"c{i:04d}", "hot" if i % 3 == 0 else f"p{i % 7}", t) for i, t in enumerate(texts)],
                                 "chunk_id string, paper_id string, text string").repartition(4)
    counts = stage_term_counts(docs)
    vectors = staged(sparse_encode_documents(docs, counts=counts), "sparse")
    queries = spark.createDataFrame(
        [("a", "w0 w1 w2", None), ("b", "w39 w0", None), ("c", "w5 w6 w38", "hot"), ("d", "unknown", None), ("e", "", None),
         ("f", "w37 w36 w35 w34", None), ("g", "w0", "p1"), ("h", "w3 unknown", "nowhere")], "query_id string, user_message string, scope string")
    terms = staged(sparse_encode_queries(queries, term_statistics(counts), F.lit(len(texts))).join(
        queries.select("query_id", "scope"), "query_id"), "terms")
    return vectors, terms


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(impacts, "FIRST_BLOCK", 4)
    monkeypatch.setattr(impacts, "LARGEST_BLOCK", 16)


def index_of(spark, vectors, terms=None, range_entries=1 << 20):
    path = new_shared_path(spark, "impacts")
    original = impacts.impact_blocks
    impacts.impact_blocks = lambda v: original(v, range_entries)
    try:
        impacts.write_impacts(vectors, path, 8)
    finally:
        impacts.impact_blocks = original
    return impacts.open_impacts(spark, path, terms, 8), path


@pytest.mark.parametrize("range_entries", [1 << 20, 50])
@pytest.mark.parametrize("limit", [1, 7])
def test_equals_the_full_search(spark, corpus, rows, small_blocks, range_entries, limit):
    vectors, terms = corpus
    index, _ = index_of(spark, vectors, terms, range_entries)
    columns = "query_id", "chunk_id", "paper_id", "score", "rank"
    assert rows(impacts.impact_search(terms, index, vectors, limit), *columns) == rows(sparse_search(terms, vectors, limit), *columns)


def test_default_blocks_and_no_rows(spark, corpus, rows):
    vectors, terms = corpus
    index, _ = index_of(spark, vectors)
    assert rows(impacts.impact_search(terms, index, vectors, 5)) and impacts.impact_search(terms.limit(0), index, vectors, 5).count() == 0
    empty, _ = index_of(spark, vectors.limit(0))
    assert impacts.impact_search(terms, empty, vectors.limit(0), 5).count() == 0


def test_blocks_hold_every_entry_once_by_weight(spark, corpus, small_blocks):
    vectors, _ = corpus
    blocks = impacts.impact_blocks(vectors, 100).collect()
    want = {(r.chunk_id, t): w for r in vectors.collect() for t, w in zip(r.terms, r.weights)}
    assert {(e.chunk_id, b.term): e.weight for b in blocks for e in b.entries} == want
    assert sum(b.n for b in blocks) == len(want) and max(b.n for b in blocks) <= 16 and len({b.range for b in blocks}) > 1
    for b in blocks:
        assert b.max_weight == max(e.weight for e in b.entries) and b.n == len(b.entries)
        after = [c for c in blocks if (c.term, c.range, c.block) == (b.term, b.range, b.block + 1)]
        assert all(c.max_weight <= min(e.weight for e in b.entries) for c in after)


def test_blocks_are_skipped_and_other_terms_not_read(spark, corpus, small_blocks):
    vectors, terms = corpus
    index, path = index_of(spark, vectors, terms.filter("query_id = 'b'"))
    report = {r.query_id: r for r in impacts.impact_report(terms.filter("query_id = 'b'"), index, vectors, 1).collect()}
    assert report["b"].opened < report["b"].postings / 3 and report["b"].opened_blocks < report["b"].blocks
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket")
    assert len({r.bucket for r in index.select("bucket").distinct().collect()}) <= 2


def test_ranks_of_judged_chunks(spark, corpus, rows, small_blocks):
    vectors, terms = corpus
    index, _ = index_of(spark, vectors)
    full = {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in sparse_search_join(terms, vectors, None).collect()}
    rng = random.Random(1)
    judged = rng.sample(sorted(full), 40) + [("a", "c0700"), ("a", "c0701"), ("a", "no such chunk"), ("z", "c0001")]
    frame = spark.createDataFrame(judged + judged[:3], "query_id string, chunk_id string")
    got = {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in impacts.ranks_of(terms, index, vectors, frame).collect()}
    assert got == {pair: full[pair] for pair in set(judged) if pair in full}


def test_hybrid_search_with_the_index(spark, corpus, rows):
    vectors, _ = corpus
    dense = vectors.select("chunk_id", "paper_id", F.array(*(F.rand(i).cast("float") for i in range(4))).alias("dense_vector"))
    dense = staged(dense, "dense")
    queries = spark.createDataFrame([("a", "ask", None, "w0 w7", [1.0, 0.0, 0.5, 0.0]), ("b", "deep_dive", "p1", "w2", [0.0, 1.0, 0.0, 0.0])],
                                    "query_id string, mode string, paper_id string, user_message string, query_vector array<float>")
    index, _ = index_of(spark, vectors)
    columns = "query_id", "chunk_id", "score", "rank"
    assert rows(hybrid_search(queries, dense, vectors, 9, impacts=index), *columns) == rows(hybrid_search(queries, dense, vectors, 9), *columns)
