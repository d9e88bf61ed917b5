"""Dense vectors for text: feature hashing by default, any batch model as a plug-in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrag.functions.text import words
from corrag.operators.batches import WORDS_AT_ONCE, by_slices, list_lengths, slices
from corrag.operators.postings import stage_term_counts, tally_words
from corrag.session import staged

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

DEFAULT_DIM = 256


def _codes(vocabulary: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of words, both taken from the word's MD5."""
    digests = b"".join(hashlib.md5(word, usedforsecurity=False).digest() for word in vocabulary.cast(pa.binary()).to_pylist())
    digests = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16)
    buckets = digests[:, :4].copy().view(">u4").ravel().astype(np.int64) % dim
    return buckets, 1.0 - 2.0 * ((digests[:, 4] >> 4) & 1)


def hash_words(found: Column, dim: int = DEFAULT_DIM) -> Column:
    """Signed feature counts of a list of words, scaled to unit length (Weinberger et al., 2009).

    The worker hashes each distinct word of a slice once and counts the slice at once. Row by
    row, so no shuffle.
    """
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(lists: pa.Array) -> pa.Array:
        return by_slices(lists, list_lengths(lists), WORDS_AT_ONCE, lambda some: _hashed(some, None, dim))

    return vectors(found)


def hash_counts(terms: Column, tfs: Column, dim: int = DEFAULT_DIM) -> Column:
    """``hash_words`` from the distinct words of a list and how often it has each: the same vector, since sums
    of whole numbers are exact."""
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(terms: pa.Array, tfs: pa.Array) -> pa.Array:
        parts = [_hashed(terms.slice(start, end - start), tfs.slice(start, end - start), dim)
                 for start, end in slices(list_lengths(terms), WORDS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else _hashed(terms, tfs, dim)

    return vectors(terms, tfs)


def _hashed(lists: pa.Array, times: pa.Array | None, dim: int) -> pa.Array:
    """Unit vectors of lists of words, each counted once or as often as ``times`` says."""
    rows, lengths = len(lists), list_lengths(lists)
    flat = lists.flatten().dictionary_encode()
    buckets, signs = _codes(flat.dictionary, dim)
    word = flat.indices.to_numpy(zero_copy_only=False)
    cells = np.repeat(np.arange(rows, dtype=np.int64), lengths) * dim + buckets[word]
    weights = signs[word] if times is None else signs[word] * times.flatten().to_numpy(zero_copy_only=False)
    matrix = np.bincount(cells, weights=weights, minlength=rows * dim)
    matrix = matrix.astype(np.float64).reshape(rows, dim)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    offsets = np.arange(0, (rows + 1) * dim, dim, dtype=np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(matrix.astype(np.float32).ravel()))


def hash_vector(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """``hash_words`` of the words of a text, which the engine cuts."""
    return hash_words(words(text), dim)


def embed(
    df: DataFrame, text_col: str, embedder: Embedder | None = None, batch: int = 128,
    dim: int = DEFAULT_DIM, out: str = "dense_vector",
) -> DataFrame:
    """Add a vector column. ``embedder`` receives at most ``batch`` texts per call."""
    if embedder is None:
        return df.withColumn(out, hash_vector(F.col(text_col), dim))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in batches:
            for start in range(0, records.num_rows, batch):
                part = records.slice(start, batch)
                vectors = embedder([t or "" for t in part.column(text_col).to_pylist()])
                column = pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, column], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


VECTOR_COLUMNS = ("chunk_id", "paper_id", "section_name", "chunk_type", "content_type", "dense_vector")


def embed_children(
    chunks: DataFrame, embedder: Embedder | None = None, batch: int = 128, dim: int = DEFAULT_DIM,
) -> DataFrame:
    """The vector table: children only, parents are never embedded."""
    children = chunks.filter(F.col("chunk_type") == "child")
    return embed(children, "text", embedder, batch, dim).select(*VECTOR_COLUMNS)


def embed_counts(counts: DataFrame, dim: int = DEFAULT_DIM) -> DataFrame:
    """The vector table of hashed words from term counts that carry its columns; no text is read."""
    return counts.select(*VECTOR_COLUMNS[:-1], hash_counts(F.col("terms"), F.col("tfs"), dim).alias("dense_vector"))


def index_children(
    chunks: DataFrame, embedder: Embedder | None = None, dim: int = DEFAULT_DIM,
) -> tuple[DataFrame, DataFrame]:
    """The vector table and the term counts of the children, staged. Without a plug-in both come
    from one pass, which cuts the words once."""
    children = chunks.filter(F.col("chunk_type") == "child")
    if embedder is not None:
        return staged(embed_children(chunks, embedder, dim=dim), "vectors"), stage_term_counts(children)
    split = children.select(*VECTOR_COLUMNS[:-1], words(F.coalesce("text", F.lit(""))).alias("_words"))
    indexed = split.select(
        *VECTOR_COLUMNS[:-1], hash_words(F.col("_words"), dim).alias("dense_vector"),
        F.size("_words").alias("length"), tally_words(F.col("_words")).alias("_t"))
    index = staged(indexed.select(*VECTOR_COLUMNS, "length", "_t.terms", "_t.tfs"), "index")
    return index.select(*VECTOR_COLUMNS), index.select("chunk_id", "paper_id", "length", "terms", "tfs")
