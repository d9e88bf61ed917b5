"""Work in slices: memory follows the slice, results are those of whole batches."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corrag.functions.plugins import batch_tokenizer
from corrag.operators import impacts, termmatch
from corrag.operators.batches import BYTES_AT_ONCE, slices
from corrag.operators.chunking import child_chunks
from corrag.operators.embedding import hash_vector, index_children
from corrag.operators.postings import count_terms
from corrag.operators.termmatch import scored_parts, term_block


def test_slices_hold_every_row_once():
    assert list(slices(np.array([1, 2, 3, 9, 0, 1]), 5)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(slices(np.array([], dtype=int), 5)) == [] and list(slices(np.array([7, 7]), 5)) == [(0, 1), (1, 2)]


def test_common_words_of_many_queries_are_scored_in_bounded_slices(monkeypatch):
    terms = [f"w{i}" for i in range(50)]
    queries = pa.table({"query_id": [f"q{i}" for i in range(40) for _ in terms], "term": terms * 40, "weight": [1.0] * 2000})
    records = pa.RecordBatch.from_pydict({
        "chunk_id": [f"c{i:03d}" for i in range(200)], "paper_id": ["p"] * 200, "terms": [terms] * 200, "weights": [[0.5] * 50] * 200})
    monkeypatch.setattr(termmatch, "CELLS_AT_ONCE", 10_000)
    parts = list(scored_parts(term_block(queries), records))
    assert max(len(part) * (40 * 50 + 40) for part, _, _ in parts) <= 10_000
    assert [i for _, ids, _ in parts for i in ids] == [(f"c{i:03d}", "p") for i in range(200)]
    assert all((scores == 25.0).all() for _, _, scores in parts)


def test_scores_of_pairs_are_not_multiplied_out(spark, rows):
    asked = spark.createDataFrame([(q, t, 2.0, None) for q in "abc" for t in ("x", "y")] + [("d", "x", 1.0, "other")],
                                  "query_id string, term string, _qw double, scope string")
    vectors = spark.createDataFrame([("c1", "p", ["x", "z"], [1.0, 5.0]), ("c2", "p", ["z"], [1.0]), ("c3", "p", ["y"], [1.0])],
                                    "chunk_id string, paper_id string, terms array<string>, weights array<double>")
    pairs = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("a", "c2"), ("c", "c3"), ("d", "c1"), ("e", "c1"), ("a", "c1")],
                                  "query_id string, chunk_id string")
    scores = impacts.complete_scores(asked, vectors, pairs)
    assert rows(scores) == [("a", "c1", "p", 2.0), ("b", "c1", "p", 2.0), ("c", "c3", "p", 2.0)]
    assert "Generate" not in scores._jdf.queryExecution().executedPlan().toString()


def test_a_tokenizer_sees_bounded_slices(spark):
    texts = spark.range(12, numPartitions=1).select(F.repeat(F.lit("a"), 1 << 20).alias("text"))
    cut = batch_tokenizer(lambda texts: [[str(sum(map(len, texts)))] for _ in texts])
    sizes = [int(r.n[0]) for r in texts.select(cut(F.col("text")).alias("n")).collect()]
    assert len(sizes) == 12 and max(sizes) <= BYTES_AT_ONCE


def test_words_are_hashed_as_before_and_cut_once_for_both_tables(spark, rows):
    def vector(text):
        out = np.zeros(16)
        for word in re.findall(r"\w+", text.lower()):
            digest = hashlib.md5(word.encode()).hexdigest()
            out[int(digest[:8], 16) % 16] += -1.0 if int(digest[8], 16) % 2 else 1.0
        return np.float32(out / np.linalg.norm(out) if out.any() else out).tolist()

    texts = ["One two one", "", "Über drei; zwei 3", "x " * 400]
    frame = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate([*texts, None])], "chunk_id string, text string").coalesce(1)
    got = dict(frame.select("chunk_id", hash_vector(F.col("text"), 16)).collect())
    assert got == {f"c{i}": vector(t) for i, t in enumerate([*texts, ""])}
    assert "md5" not in frame.select(hash_vector(F.col("text"), 16))._jdf.queryExecution().toString()
    chunks = frame.select("chunk_id", F.lit("p").alias("paper_id"), F.lit("S").alias("section_name"), F.lit("child").alias("chunk_type"),
                          F.lit("text").alias("content_type"), "text")
    vectors, counts = index_children(chunks, dim=16)
    assert dict(vectors.select("chunk_id", "dense_vector").collect()) == got
    ordered = F.array_sort(F.arrays_zip("terms", "tfs"))
    columns = ["chunk_id", "paper_id", "length", ordered.alias("t")]
    assert rows(counts.select(*columns)) == rows(count_terms(chunks).select(*columns))
    assert {f.rpartition("/")[0] for f in vectors.inputFiles()} == {f.rpartition("/")[0] for f in counts.inputFiles()}


def test_tokens_of_windows_are_counted_with_the_windows(spark):
    texts = ["", "  ", " a b\n c", "a " * 7, " ".join(map(str, range(23))) + "  "]
    blocks = spark.createDataFrame([(str(i), 0, "S", t, k, None) for i, t in enumerate(texts) for k in ("text", "table")],
                                   "paper_id string, block_idx int, section_name string, text string, content_type string, media_url string")
    found = child_chunks(blocks, 4, 1).collect()
    assert len(found) > 15 and all(r.token_count == len(re.findall(r"\S+", r.text)) for r in found)
    plan = child_chunks(blocks, 4, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3


def test_vectors_from_counts_equal_those_from_texts(spark):
    from corrag.operators.embedding import embed_counts

    texts = ["One two one", "", "Über drei; zwei 3 zwei zwei", "x " * 400, None, " ".join(f"w{i % 97}" for i in range(1000))]
    chunks = spark.createDataFrame([(f"c{i}", "p", "S", "child", "text", t) for i, t in enumerate(texts)],
                                   "chunk_id string, paper_id string, section_name string, chunk_type string, content_type string, text string")
    counts = count_terms(chunks, "section_name", "chunk_type", "content_type")
    got = dict(embed_counts(counts, 16).select("chunk_id", "dense_vector").collect())
    assert got == dict(index_children(chunks, dim=16)[0].select("chunk_id", "dense_vector").collect())


def test_a_parent_stands_before_its_children(spark):
    from corrag.operators.chunking import chunk_blocks

    blocks = spark.createDataFrame([("p", i, "S", t, k, None) for i, (t, k) in enumerate(
        [("a b c d e f", "text"), ("", "text"), ("a b c d e f", "table"), (None, "text"), (None, "table"), ("g", None)])],
        "paper_id string, block_idx int, section_name string, text string, content_type string, media_url string").coalesce(1)
    papers = spark.createDataFrame([("p", "x y")], "paper_id string, abstract string").coalesce(1)
    found = [(r.chunk_id, r.text, r.parent_chunk_id) for r in chunk_blocks(papers, blocks, 4, 1).collect()]
    assert found == [
        ("p#0", "a b c d e f", None), ("p#0#0", "a b c d", "p#0"), ("p#0#1", " d e f", "p#0"), ("p#1", "", None), ("p#1#0", "", "p#1"),
        ("p#2", "a b c d e f", None), ("p#2#0", "a b c d e f", "p#2"), ("p#3", None, None), ("p#4", None, None), ("p#5", "g", None),
        ("p#5#0", "g", "p#5"), ("p#abstract", "x y", None)]
