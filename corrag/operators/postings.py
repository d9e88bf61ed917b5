"""The sparse index: weighted postings, term statistics, and checks against drift."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrag.functions.text import strip_ws, words
from corrag.operators.batches import WORDS_AT_ONCE, by_slices, list_lengths
from corrag.session import staged

# --- Fixed values -------------------------------------------------------------------------
BM25_K1, BM25_B = 1.2, 0.75
# -----------------------------------------------------------------------------------------


def tally_words(found: Column) -> Column:
    """A list of words as ``terms, tfs``, counted in slices of a batch."""
    def count(lists: pa.Array) -> pa.Array:
        lengths = list_lengths(lists)
        flat = lists.flatten().dictionary_encode()
        size = max(1, len(flat.dictionary))
        rows = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        keys, counts = np.unique(
            rows * size + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
        offsets = pa.array(np.searchsorted(keys // size, np.arange(len(lengths) + 1)).astype(np.int32))
        return pa.StructArray.from_arrays([
            pa.ListArray.from_arrays(offsets, flat.dictionary.take(pa.array(keys % size))),
            pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))], ["terms", "tfs"])

    @F.arrow_udf("struct<terms:array<string>,tfs:array<int>>")
    def tally(lists: pa.Array) -> pa.Array:
        return by_slices(lists, list_lengths(lists), WORDS_AT_ONCE, count)

    return tally(found)


def count_terms(chunks: DataFrame, *also: str) -> DataFrame:
    """One row per chunk: ``chunk_id, paper_id, length, terms, tfs``, and the chunk's columns named in ``also``.

    The engine cuts the words; the worker tallies word lists in slices of a batch. The
    work is row by row, so building the index needs no shuffle.
    """
    split = chunks.select("chunk_id", "paper_id", *also, words(F.coalesce("text", F.lit(""))).alias("_words"))
    tallied = split.select(
        "chunk_id", "paper_id", *also, F.size("_words").alias("length"), tally_words(F.col("_words")).alias("_t"))
    return tallied.select("chunk_id", "paper_id", "length", "_t.terms", "_t.tfs", *also)


def stage_term_counts(chunks: DataFrame, name: str = "terms") -> DataFrame:
    """``count_terms`` written once; statistics and searches read the table."""
    return staged(count_terms(chunks), name)


def sparse_encode_documents(
    chunks: DataFrame, k1: float = BM25_K1, b: float = BM25_B, avg_len: float | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The sparse vectors ``chunk_id, paper_id, terms, weights`` (saturated term frequency).

    ``counts`` are the staged counts of the same chunks, else they are taken on the way.
    Without ``avg_len`` the corpus average is used.
    """
    counts = count_terms(chunks) if counts is None else counts
    mean = F.lit(float(avg_len)) if avg_len is not None else counts.agg(F.avg("length")).scalar()
    # By the engine: a worker for this would hold each batch besides the worker that scores it.
    relative = F.coalesce(F.try_divide(F.lit(b) * F.col("length"), mean), F.lit(float("inf")))
    base = counts.withColumn("_flat", F.lit(k1) * (F.lit(1 - b) + relative))
    weights = F.transform("tfs", lambda tf: tf * F.lit(k1 + 1) / (tf + F.col("_flat")))
    return base.select("chunk_id", "paper_id", "terms", weights.alias("weights"))


def postings(vectors: DataFrame) -> DataFrame:
    """Sparse vectors as a table ``term, chunk_id, paper_id, weight``, one row per entry."""
    entries = vectors.select("chunk_id", "paper_id", F.explode_outer(
        F.arrays_zip("terms", "weights")).alias("_p")).filter(F.col("_p").isNotNull())
    return entries.select(F.col("_p.terms").alias("term"), "chunk_id", "paper_id", F.col("_p.weights").alias("weight"))


def term_statistics(counts: DataFrame) -> DataFrame:
    """``term, doc_freq`` from term counts or sparse vectors; counted on the map side first,
    so common terms do not pile up."""
    return counts.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("doc_freq"))


def sparse_encode_queries(
    queries: DataFrame, statistics: DataFrame | None = None, n_docs: Column | None = None,
    text_col: str = "user_message",
) -> DataFrame:
    """``query_id, term, weight``: weight 1, or Okapi IDF when ``statistics`` is given."""
    terms = queries.select("query_id", F.explode_outer(
        F.array_distinct(words(F.col(text_col)))).alias("term")).filter(F.col("term").isNotNull())
    if statistics is None:
        return terms.withColumn("weight", F.lit(1.0))
    rarity = F.log(1 + (n_docs - F.col("doc_freq") + 0.5) / (F.col("doc_freq") + 0.5))
    return terms.join(statistics, "term").select("query_id", "term", rarity.alias("weight"))


def index_drift(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per paper: children without vector, vectors without chunk, children with blank text."""
    children = chunks.filter(F.col("chunk_type") == "child").select(
        "chunk_id", F.col("paper_id").alias("_chunk_paper"),
        (strip_ws(F.coalesce(F.col("text"), F.lit(""))) == "").alias("_blank"))
    indexed = vectors.select("chunk_id", F.col("paper_id").alias("_vector_paper"))
    both = children.join(indexed, "chunk_id", "full_outer").select(
        F.coalesce("_chunk_paper", "_vector_paper").alias("paper_id"),
        F.col("_chunk_paper").isNotNull().alias("_has_chunk"),
        F.col("_vector_paper").isNotNull().alias("_has_vector"),
        F.coalesce("_blank", F.lit(False)).alias("_blank"))
    totals = both.groupBy("paper_id").agg(
        F.count_if(F.col("_has_chunk") & ~F.col("_has_vector")).alias("missing_vectors"),
        F.count_if(~F.col("_has_chunk")).alias("orphan_vectors"),
        F.count_if(F.col("_blank")).alias("blank_text"),
        F.count_if(F.col("_has_vector")).alias("_vectors"))
    return totals.select(
        "paper_id", "missing_vectors", "orphan_vectors", "blank_text",
        F.when(F.col("_vectors") == 0, F.lit("no_vectors"))
        .when(F.col("missing_vectors") + F.col("orphan_vectors") + F.col("blank_text") > 0,
              F.lit("drift"))
        .otherwise(F.lit("in_sync")).alias("status"))
