"""Search against brute force, reranking, diversity, parents, suggestions, candidates."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrag.operators import search
from corrag.operators.embedding import embed, embed_children
from corrag.operators.postings import (
    index_drift, sparse_encode_documents, sparse_encode_queries, stage_term_counts, term_statistics)
from corrag.operators.search import (
    ann_dense_search, ann_index, ann_recall, dense_search, enrich_hits,
    hybrid_search, rrf_fuse, sparse_search)
from corrag.operators.selection import (
    expand_parents, mmr_select, rerank, select_candidates, suggest_papers)

RNG = np.random.default_rng(3)
STORED = [(f"c{i:03d}", f"p{i % 7}", RNG.standard_normal(8).round(3).tolist()) for i in range(300)]
# A third of all rows are copies of one vector.
STORED += [(f"x{i:03d}", "hot", STORED[0][2]) for i in range(150)]
ASKED = [(f"q{i}", "p3" if i % 3 == 0 else None, RNG.standard_normal(8).tolist()) for i in range(9)]
ASKED += [("copy", None, STORED[0][2]), ("own", "hot", STORED[5][2])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(
        STORED, "chunk_id string, paper_id string, dense_vector array<float>").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id string, scope string, query_vector array<float>")


def nearest(k):
    out = set()
    for name, scope, q in ASKED:
        q = np.array(q, dtype=np.float32).astype(float)
        found = []
        for chunk, paper, v in STORED:
            if scope in (None, paper):
                v = np.array(v, dtype=np.float32).astype(float)
                found.append((-round(float(q @ v / math.sqrt((q @ q) * (v @ v))), 6), chunk))
        out |= {(name, c, i + 1) for i, (_, c) in enumerate(sorted(found)[:k])}
    return out


def test_dense_search_is_exact(asked, vectors):
    got = dense_search(asked, vectors, 7).select("query_id", "chunk_id", "rank")
    assert {tuple(r) for r in got.collect()} == nearest(7)


def test_query_tables_of_several_blocks(asked, vectors, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    got = dense_search(asked, vectors, 7).select("query_id", "chunk_id", "rank")
    assert {tuple(r) for r in got.collect()} == nearest(7)


def test_missing_and_odd_vectors(spark):
    stored = spark.createDataFrame(
        [("a", "p", [1.0, 0.0]), ("b", "p", None), ("c", "p", [1.0]), ("d", "p", [0.0, 0.0])],
        "chunk_id string, paper_id string, dense_vector array<float>")
    queries = spark.createDataFrame([("q", [2.0, 0.0]), ("n", None)], "query_id string, query_vector array<float>")
    assert [tuple(r) for r in dense_search(queries, stored, 5).orderBy("rank").select("chunk_id", "score").collect()] == [
        ("a", 1.0), ("c", 0.0), ("d", 0.0)]


def test_approximate_search_finds_subset(asked, vectors):
    exact = dense_search(asked, vectors, 5)
    close = ann_dense_search(asked, ann_index(vectors, 8, tables=10, bits=4), 8, 5, tables=10, bits=4)
    recall = [r.recall for r in ann_recall(exact, close).collect()]
    assert len(recall) == len(ASKED) and all(0 <= r <= 1 for r in recall) and sum(recall) / len(recall) > 0.6
    assert close.groupBy("query_id", "chunk_id").count().filter("count > 1").count() == 0
    one = ann_dense_search(asked, ann_index(vectors, 8, tables=1, bits=0), 8, 5, tables=1, bits=0)
    assert {tuple(r) for r in one.select("query_id", "chunk_id", "rank").collect()} == nearest(5)


WORDS = "the of model attention graph loss data Ünlü x1".split()
random.seed(5)
TEXTS = [(f"d{i:02d}", f"p{i % 4}", " ".join(random.choices(WORDS, [9, 5, 2, 2, 1, 1, 1, 1, 1], k=random.randint(0, 30))))
         for i in range(60)] + [(f"h{i}", "hot", "the the model") for i in range(30)]


def bm25(query, k, idf, avg=None, scope=None):
    docs = {d: (p, re.findall(r"[^\W_]+", t.lower())) for d, p, t in TEXTS}
    avg = avg or sum(len(w) for _, w in docs.values()) / len(docs)
    scores = []
    for d, (p, w) in docs.items():
        s = 0.0
        for term in set(query.lower().split()):
            df = sum(term in x for _, x in docs.values())
            tf = w.count(term)
            weight = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg)) if tf else 0.0
            s += weight * (math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) if idf else 1.0)
        if round(s, 6) > 0 and scope in (None, p):
            scores.append((-round(s, 6), d))
    return [d for _, d in sorted(scores)[:k]]


def test_rankings_by_a_column_come_from_one_pass(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame(
        [(f"c{i:03d}", f"p{i % 9}", " ".join(rng.choices("abcdefgh", k=12)), [None, "x", "y"][i % 3]) for i in range(120)],
        "chunk_id string, paper_id string, text string, side string").repartition(3)
    sides = docs.select("chunk_id", "side")
    terms = sparse_encode_queries(spark.createDataFrame([("1", "a b c"), ("2", "g h")], "query_id string, user_message string"))
    stored = sparse_encode_documents(docs).join(sides, "chunk_id")
    columns = ["query_id", "chunk_id", "paper_id", "score", "rank"]
    together = sparse_search(terms, stored, 4, "side")
    for side in (None, "x", "y"):
        alone = sparse_search(terms, stored.filter(F.col("side").eqNullSafe(side)).drop("side"), 4)
        got = together.filter(F.col("side").eqNullSafe(side)).select(columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, alone.select(columns).collect()))
    with pytest.raises(ValueError):
        sparse_search(terms, stored, None, "side")


@pytest.mark.parametrize("idf", [True, False])
@pytest.mark.parametrize("staged_counts", [True, False])
@pytest.mark.parametrize("joined", [True, False])
def test_sparse_search_is_exact(spark, idf, staged_counts, joined, monkeypatch):
    if joined:
        monkeypatch.setattr(search, "TERM_BLOCK", 1)
    docs = spark.createDataFrame(TEXTS, "chunk_id string, paper_id string, text string")
    queries = spark.createDataFrame(
        [("a", "The model attention", None), ("b", "unknown", None), ("c", "ünlü the", "p2"), ("d", "", None)],
        "query_id string, user_message string, scope string")
    counts = stage_term_counts(docs) if staged_counts else None
    stored = sparse_encode_documents(docs, counts=counts)
    terms = (sparse_encode_queries(queries, term_statistics(stored), F.lit(len(TEXTS))) if idf
             else sparse_encode_queries(queries)).join(queries.select("query_id", "scope"), "query_id")
    got = {}
    for r in sparse_search(terms, stored, 6).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {"a": bm25("the model attention", 6, idf), "c": bm25("ünlü the", 6, idf, scope="p2")}


def test_texts_without_words(spark):
    docs = spark.createDataFrame([("a", "p", ""), ("b", "p", "..."), ("c", "p", None)], "chunk_id string, paper_id string, text string").coalesce(1)
    queries = spark.createDataFrame([("q", "word"), ("r", "")], "query_id string, user_message string")
    assert sparse_search(sparse_encode_queries(queries), sparse_encode_documents(docs), 3).count() == 0
    assert sparse_search(sparse_encode_queries(queries.limit(0)), sparse_encode_documents(docs), 3).count() == 0
    assert [r.dense_vector for r in embed(docs, "text", dim=2).collect()] == [[0.0, 0.0]] * 3


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", "p", 1), ("q", "y", "p", 2)], "query_id string, chunk_id string, paper_id string, rank int")
    b = spark.createDataFrame([("q", "y", "p", 1), ("q", "z", "p", 2)], "query_id string, chunk_id string, paper_id string, rank int")
    got = [(r.chunk_id, r.score) for r in rrf_fuse([a, b], 60, 3).orderBy("rank").collect()]
    assert got == [("y", round(1 / 62 + 1 / 61, 9)), ("x", round(1 / 61, 9)), ("z", round(1 / 62, 9))]


def test_hybrid_keeps_deep_dives_in_their_paper(spark):
    docs = embed(spark.createDataFrame(TEXTS, "chunk_id string, paper_id string, text string"), "text", dim=16)
    queries = embed(spark.createDataFrame(
        [("a", "ask", None, "the model"), ("d", "deep_dive", "p1", "the model")],
        "query_id string, mode string, paper_id string, user_message string"), "user_message", dim=16, out="query_vector")
    hits = hybrid_search(queries, docs, sparse_encode_documents(docs), 5).collect()
    assert {r.paper_id for r in hits if r.query_id == "d"} == {"p1"}
    assert len([r for r in hits if r.query_id == "a"]) == 5 and {r.paper_id for r in hits if r.query_id == "a"} != {"p1"}


def test_embedder_plugin_keeps_rows(spark):
    calls = []

    def lengths(texts):
        assert len(texts) <= 2
        return [[float(len(t))] for t in texts]

    chunks = spark.createDataFrame(
        [(f"c{i}", "p", "s", "parent" if i == 3 else "child", "text", "x" * i) for i in range(6)],
        "chunk_id string, paper_id string, section_name string, chunk_type string, content_type string, text string")
    got = {r.chunk_id: r.dense_vector for r in embed_children(chunks, lengths, batch=2).collect()}
    assert got == {f"c{i}": [float(i)] for i in range(6) if i != 3} and not calls


def test_enrich_and_rerank(spark, rows):
    hits = spark.createDataFrame([("q", "a", "p", 9.0, 1), ("q", "b", "p", 8.0, 2), ("q", "gone", "p", 7.0, 3), ("r", "gone", "p", 1.0, 1)],
                                 "query_id string, chunk_id string, paper_id string, score double, rank int")
    chunks = spark.createDataFrame([("a", "red", "A"), ("b", "red green", "B"), ("c", "x", "C")],
                                   "chunk_id string, text string, parent_chunk_id string")
    full = enrich_hits(hits, chunks)
    assert rows(full, "query_id", "chunk_id", "text", "parent_chunk_id", "score") == [
        ("q", "a", "red", "A", 9.0), ("q", "b", "red green", "B", 8.0), ("q", "gone", "", None, 7.0), ("r", "gone", "", None, 1.0)]
    queries = spark.createDataFrame([("q", "Red green green"), ("r", "x")], "query_id string, user_message string")
    assert rows(rerank(full, queries), "query_id", "chunk_id", "score", "rank") == [("q", "a", 0.5, 2), ("q", "b", 1.0, 1)]


def mmr(spark, pool, mode="ask", lambda_=0.5, top=2, vector=(1.0, 1.0)):
    hits = spark.createDataFrame(
        [("q", c, float(s), v, i + 1) for i, (c, s, v) in enumerate(pool)],
        "query_id string, chunk_id string, score double, dense_vector array<float>, rank int")
    queries = spark.createDataFrame([("q", mode, list(vector) if vector else None)],
                                    "query_id string, mode string, query_vector array<float>")
    return [r.chunk_id for r in mmr_select(hits, queries, lambda_, top).orderBy("rank").collect()]


def test_mmr(spark):
    pool = [("A", 0.9, [1.0, 0.0]), ("B", 0.85, [1.0, 0.0]), ("C", 0.8, [0.0, 1.0])]
    assert mmr(spark, pool) == ["A", "C"]
    assert mmr(spark, pool, lambda_=1.0) == ["A", "B"]
    assert mmr(spark, pool, mode="deep_dive") == ["A", "B"]
    assert mmr(spark, pool[:2] + [("C", 0.8, None)]) == ["A", "B"]
    assert mmr(spark, pool, vector=None) == ["A", "B"]
    assert mmr(spark, [("A", 0.5, [1.0, 0.0]), ("B", 0.5, [0.0, 1.0])], top=9) == ["A", "B"]
    assert mmr(spark, [("A", 0.9, [1.0]), ("B", 0.8, [1.0, 0.0]), ("C", 0.7, [2.0])], top=3) == ["A", "B", "C"]


def test_expand_parents(spark):
    hits = spark.createDataFrame(
        [("q", 1, "P9"), ("q", 2, "P1"), ("q", 3, None), ("q", 4, "P1"), ("q", 5, "gone"), ("q", 6, "P2"), ("q", 7, "P3")],
        "query_id string, rank int, parent_chunk_id string")
    chunks = spark.createDataFrame([(f"P{i}", "p", "parent", "S", "t", "text", None) for i in (1, 2, 3)],
        "chunk_id string, paper_id string, chunk_type string, section_name string, text string, content_type string, media_url string")
    papers = spark.createDataFrame([("p", "T", "2020", "A")], "paper_id string, title string, published_date string, abstract string")
    got = expand_parents(hits, chunks, papers, 2).orderBy("rank").collect()
    assert [(r.rank, r.section_id, r.paper_title) for r in got] == [(1, "P1", "T"), (2, "P2", "T")]


def test_suggestions(spark, rows):
    queries = spark.createDataFrame([("a", "ask", None), ("d", "deep_dive", "p1"), ("e", "deep_dive", "p2"), ("f", "ask", None)],
                                    "query_id string, mode string, paper_id string")
    hits = spark.createDataFrame([("a", "p2", 1), ("a", "p1", 2), ("a", "p2", 3), ("a", "", 4), ("d", "p1", 1), ("e", "p2", 1), ("e", "p3", 2)],
                                 "query_id string, paper_id string, rank int")
    papers = spark.createDataFrame([("p1", "One", "x" * 300), ("p2", None, "")], "paper_id string, title string, abstract string")
    own = spark.createDataFrame([("e",)], "query_id string")
    spare = spark.createDataFrame([("f", "r1", 1), ("e", "r1", 1)], "query_id string, paper_id string, rank int")
    reserve = spark.createDataFrame([("r1", "Res", "")], "paper_id string, title string, abstract string")
    got = rows(suggest_papers(queries, hits, papers, own, spare, reserve))
    assert got == [("a", 1, "p2", "", None, "corpus"), ("a", 2, "p1", "One", "x" * 200, "corpus"),
                   ("d", 1, None, "", None, "index_drift"), ("e", 1, "p3", "", None, "corpus"),
                   ("f", 1, "r1", "Res", "", "reserve")]


def test_candidates(spark, rows):
    results = spark.createDataFrame(
        [("q", 0, 1, "a"), ("q", 0, 2, "b"), ("q", 1, 1, "b"), ("q", 1, 2, "c"), ("q", 1, 3, "d"), ("r", 0, 1, "z"), ("r", 0, 2, "y"), ("s", 0, 1, "m")],
        "query_id string, list_no int, rank int, paper_id string")
    marks = spark.createDataFrame([("q", "d"), ("q", "b"), ("q", "c"), ("s", "elsewhere")], "query_id string, paper_id string")
    assert rows(select_candidates(results, marks, 2), "query_id", "position", "paper_id") == [
        ("q", 1, "b"), ("q", 2, "c"), ("r", 1, "z")]
    assert rows(select_candidates(results), "query_id", "paper_id") == [("q", "a"), ("r", "z"), ("s", "m")]


def test_drift(spark, rows):
    chunks = spark.createDataFrame([("a", "p", "child", "t"), ("b", "p", "child", " \n"), ("c", "q", "child", "t"), ("d", "r", "child", "t"), ("e", "r", "parent", "t")],
                                   "chunk_id string, paper_id string, chunk_type string, text string")
    vectors = spark.createDataFrame([("a", "p"), ("b", "p"), ("z", "p"), ("d", "r")], "chunk_id string, paper_id string")
    assert rows(index_drift(chunks, vectors)) == [("p", 0, 1, 1, "drift"), ("q", 1, 0, 0, "no_vectors"), ("r", 0, 0, 0, "in_sync")]
