"""Metrics, attribution, baselines, histograms, latency."""

import math

import pytest
from pyspark.sql import functions as F

from corrag import schemas
from corrag.operators import blockmatch
from corrag.operators.evaluation import (
    attribute_answers, attribution_averages, build_run, comparison_report, grading_metrics,
    latency_report, regressions, score_bands, score_histogram, score_sheet)
from corrag.session import new_shared_path
from corrag.sources.store import read_report, write_report


def test_retrieval_metrics(spark):
    qrels = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 1), ("b", "z", 1), ("c", "w", 1), ("c", "no", 0)], "query_id string, chunk_id string, relevance int")
    runs = spark.createDataFrame(
        [("r", "a", "x", 0.9), ("r", "a", "n", 0.8), ("r", "a", "y", 0.7)]
        + [("r", "b", f"n{i}", 1.0 - i / 10) for i in range(6)] + [("r", "b", "z", 0.1)] + [("other", "c", "w", 1.0)],
        "run_name string, query_id string, chunk_id string, score double")
    got = {(r.run_name, r.metric): r.value for r in comparison_report(qrels, runs).collect()}
    ndcg = (1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert got == {("r", "recall@5"): round(1 / 3, 6), ("r", "ndcg@5"): round(ndcg / 3, 6), ("r", "mrr"): round((1 + 1 / 7) / 3, 6),
                   ("other", "recall@5"): round(1 / 3, 6), ("other", "ndcg@5"): round(1 / 3, 6), ("other", "mrr"): round(1 / 3, 6)}
    hits = spark.createDataFrame([("q", "p", 1), ("q", "p", 3)], "query_id string, paper_id string, score int")
    assert [tuple(r) for r in build_run(hits, "n", "paper_id").collect()] == [("n", "q", "p", 3.0)]


def test_grading_metrics(spark):
    def metrics(pairs):
        frame = spark.createDataFrame(pairs, "predicted boolean, label boolean")
        return {r.metric: r.value for r in grading_metrics(frame).collect()}

    assert metrics([(True, True), (False, True), (True, False), (False, False), (False, False)]) == {
        "accuracy": 0.6, "fnr": 0.5, "fpr": round(1 / 3, 6)}
    assert metrics([]) == {"accuracy": 0.0, "fnr": 0.0, "fpr": 0.0}


def test_histogram_and_bands(spark, rows):
    scores = spark.createDataFrame([(x,) for x in (0.0, 0.04, 0.05, 0.5, 1.0, None)], "score double")
    assert rows(score_histogram(scores), "bin", "n") == [(0, 2), (1, 1), (10, 1), (19, 1)]
    assert rows(score_histogram(spark.createDataFrame([(0.3,), (0.3,)], "score double")), "bin", "n") == [(0, 2)]
    assert rows(score_bands(spark.createDataFrame([(0.6,), (0.35,), (0.5,)], "score double"))) == [("between", 1), ("high", 1), ("low", 1)]


VECTORS = {"One.": [1.0, 0.0, 0.0], "Two.": [0.0, 1.0, 0.0], "Off.": [-1.0, -1.0, -1.0], "None.": [0.0, 0.0, 0.0],
           "c1": [1.0, 0.0, 0.0], "c2": [0.0, 2.0, 0.0], "c3": [0.0, 0.0, 1.0], "c1 again": [2.0, 0.0, 0.0]}


@pytest.mark.parametrize("block", [512, 1])
def test_attribution(spark, block, monkeypatch):
    monkeypatch.setattr(blockmatch.pack_blocks, "__defaults__", (block,))
    answers = spark.createDataFrame(
        [("a", "One. Two."), ("b", "One. Off. None."), ("c", "One."), ("d", "  "), ("e", "One.")], "answer_id string, answer string")
    chunks = spark.createDataFrame(
        [("a", 1, "c1"), ("a", 2, "c2"), ("a", 3, "c3"), ("b", 1, "c1"), ("b", 2, "c1 again"), ("d", 1, "c1"), ("e", 1, "c3")],
        "answer_id string, chunk_id int, text string")
    vectors = VECTORS
    out = attribute_answers(answers, chunks, embedder=lambda texts: [vectors[t] for t in texts])
    got = {r.answer_id: (r.blank_answer, r.attribution_rate, r.unattributed_sentences, r.chunk_utilization_rate) for r in out.collect()}
    assert got == {"a": (False, 1.0, [], 0.666667), "b": (False, 0.333333, ["Off.", "None."], 0.5),
                   "c": (False, 0.0, ["One."], 0.0), "d": (True, 0.0, [], 0.0), "e": (False, 0.0, ["One."], 0.0)}
    means = {r.metric: r.value for r in attribution_averages(out).collect()}
    assert means == {"attribution_rate": round(1.333333 / 4, 6), "chunk_utilization_rate": round(1.166667 / 4, 6)}
    empty = attribution_averages(out.limit(0)).collect()
    assert [r.value for r in empty] == [0.0, 0.0]


def test_sheet_and_regressions(spark, rows):
    grading = spark.createDataFrame([("accuracy", 0.9)], "metric string, value double")
    judged = spark.createDataFrame([("faithfulness", 0.4), ("faithfulness", 0.6)], "metric string, value double")
    other = spark.createDataFrame([("attribution_rate", 0.5)], "metric string, value double")
    sheet = score_sheet(grading, judged, other)
    assert rows(sheet) == [("accuracy", 0.9), ("attribution_rate", 0.5), ("faithfulness", 0.5)]
    before = spark.createDataFrame([("accuracy", 0.94), ("attribution_rate", 0.56), ("faithfulness", 0.1), ("gone", 1.0)], "metric string, value double")
    assert rows(regressions(sheet, before)) == [("attribution_rate", 0.5, 0.56)]
    path = new_shared_path(spark, "reports")
    write_report(sheet.withColumn("paper_id", F.lit("p")), path, "baseline")
    assert rows(read_report(spark, path, "baseline"), "paper_id", "metric", "value") == [("p", *r) for r in rows(sheet)]
    with pytest.raises(FileNotFoundError, match="no report 'missing'"):
        read_report(spark, path, "missing", schemas.SCORES)


def test_latency(spark, rows):
    stages = spark.createDataFrame([("rerank", 0.5), ("rerank", 0.25), ("grade", 1.0)], "stage string, seconds double")
    calls = spark.createDataFrame([("x",), ("x",)], "provider string")
    assert rows(latency_report(stages, calls)) == [("calls", "x", 2.0), ("stage", "grade", 1.0), ("stage", "rerank", 0.75)]


def test_short_passages_are_judged_too(spark, tmp_path):
    from corrag.catalog.evaluation import verbatim_qrels

    docs = [(1, "xx alpha beta gamma"), (2, "one alphabeta two"), (3, "nothing"), (4, None)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha"), (2, "alpha beta"), (3, "alpha beta gamma"), (4, "x alpha"), (5, None)], "item_id long, text string"
                          ).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.query_id, r.chunk_id) for r in verbatim_qrels(spark, str(tmp_path)).collect()}
    assert found == {("1", "1"), ("1", "2"), ("2", "1"), ("3", "1"), ("4", "1")}
