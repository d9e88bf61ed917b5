"""Dense, sparse and hybrid search for whole tables of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corrag.functions.vectors import cosine
from corrag.operators.blockmatch import (
    SCORE_DIGITS, BestPerQuery, matrix_of, score_block, unit_rows)
from corrag.operators.impacts import impact_search
from corrag.operators.postings import postings, sparse_encode_queries
from corrag.operators.termmatch import TERM_BLOCK, scored_parts, term_block
from corrag.operators.topk import top_k
from corrag.session import staged

SEARCH_LIMIT = 30
RRF_K = 60

# Queries of a block, which travels to the workers with the task.
QUERY_BLOCK = 4096


def _best_first(id_col: str) -> list[Column]:
    return [F.desc("score"), F.asc(id_col)]


def _hit_schema(queries: DataFrame, stored: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        *(T.StructField(c, stored.schema[c].dataType) for c in ("chunk_id", "paper_id")),
        T.StructField("score", T.DoubleType())])


def _scoped(queries: DataFrame) -> DataFrame:
    """``query_id, scope, query_vector``; scope is the one paper a query may look at."""
    scope = F.col("scope") if "scope" in queries.columns else F.lit(None).cast("string")
    return queries.select("query_id", scope.alias("scope"), "query_vector")


def query_scope(queries: DataFrame) -> DataFrame:
    """Deep-dive queries look only at their own paper, all others at everything."""
    return queries.withColumn(
        "scope", F.when(F.col("mode") == "deep_dive", F.col("paper_id").cast("string")))


def dense_search(queries: DataFrame, vectors: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Exact cosine top ``limit`` per query; ties by chunk id.

    Queries go to the vectors in blocks of about ``QUERY_BLOCK``: every task multiplies its
    batches with the block's matrix and sends on only its own best ``limit`` per query. One way
    for any number of queries; a small table is one block.
    """
    parts = [_dense_block(part, vectors, limit) for part in _blocks(_scoped(queries), QUERY_BLOCK)]
    return top_k(reduce(DataFrame.unionByName, parts), ["query_id"], _best_first("chunk_id"), limit)


def _blocks(queries: DataFrame, rows: int) -> list[DataFrame]:
    """The rows cut into parts of about ``rows`` by a hash of the query, which stays whole. They are
    staged first: a plug-in that embeds queries is called once for each, not once for each part."""
    held = staged(queries, "queries")
    n = max(1, -(-held.count() // rows))
    return [held.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def _dense_block(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` of every task for one block of queries."""
    first = queries.toArrow()
    query_ids, scopes, query_vectors = (
        first.column(c).to_pylist() for c in ("query_id", "scope", "query_vector"))
    groups: dict[tuple, list[int]] = {}
    for row, (scope, vector) in enumerate(zip(scopes, query_vectors)):
        if vector:
            groups.setdefault((scope, len(vector)), []).append(row)
    shipped = queries.sparkSession.sparkContext.broadcast([
        (scope, rows, unit_rows(np.array([query_vectors[r] for r in rows], dtype=np.float64)))
        for (scope, _), rows in groups.items()])
    schema = _hit_schema(queries, vectors)
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shipped.value
        best = [BestPerQuery(len(rows), limit) for _, rows, _ in groups]
        some_scope = any(scope is not None for scope, _, _ in groups)
        for records in batches:
            # Rows without a vector go here: as a filter the vectors would be computed twice.
            records = records.filter(pc.is_valid(records.column("dense_vector")))
            records = records.take(pc.sort_indices(records.column("chunk_id")))
            ids = list(zip(*(records.column(c).to_pylist() for c in ("chunk_id", "paper_id"))))
            vectors_here = records.column("dense_vector")
            places: dict[str, list[int]] = {}
            for at, (_, paper) in enumerate(ids if some_scope else ()):
                places.setdefault(str(paper), []).append(at)
            for (scope, rows, unit), kept in zip(groups, best):
                part, part_ids = vectors_here, ids
                if scope is not None:
                    at = places.get(scope, [])
                    part, part_ids = part.take(pa.array(at, pa.int64())), [ids[i] for i in at]
                step = max(1, 4_000_000 // len(rows))
                for start in range(0, len(part_ids), step):
                    kept.offer(score_block(matrix_of(part.slice(start, step), unit.shape[1]), unit),
                               part_ids[start:start + step])
        found = [(query_ids[rows[q]], *hit, -minus)
                 for (_, rows, _), kept in zip(groups, best)
                 for q, hits in kept.kept.items() for minus, hit in hits]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], type=field.type)
                 for i, field in enumerate(arrow_schema)], schema=arrow_schema)

    return vectors.select("chunk_id", "paper_id", "dense_vector").mapInArrow(run, schema)


def sparse_search(
    query_terms: DataFrame, vectors: DataFrame, limit: int | None = SEARCH_LIMIT, by: str | None = None,
) -> DataFrame:
    """Sum of query weight x document weight over shared terms; ties by chunk id.

    ``query_terms`` (``query_id, term, weight``) may carry a ``scope`` column (NULL: all
    papers). They go to the sparse vectors in blocks of about ``TERM_BLOCK``: a task adds up its
    chunks' scores and sends on only its own best ``limit`` per query. A ranking without a limit
    has no best rows to cut to, so it is a join on the term. With ``by``, a column of the vectors,
    each of its values has a ranking and a limit of its own, all from one pass; hits carry the column.
    """
    columns = ["query_id", "term", "weight"] + (["scope"] if "scope" in query_terms.columns else [])
    wanted = query_terms.select(*columns)
    if limit is None and by is not None:
        raise ValueError("rankings by a column need a limit")
    if limit is None:
        return sparse_search_join(wanted, vectors, None)
    keys = [by] if by else []
    parts = [_sparse_block(part, vectors, limit, keys) for part in _blocks(wanted, TERM_BLOCK)]
    return top_k(reduce(DataFrame.unionByName, parts), ["query_id", *keys], _best_first("chunk_id"), limit)


def _sparse_block(query_terms: DataFrame, vectors: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """The best ``limit`` of every task for one block of query terms."""
    shipped = query_terms.sparkSession.sparkContext.broadcast(term_block(query_terms.toArrow()))
    schema = T.StructType([*_hit_schema(query_terms, vectors), *(vectors.schema[c] for c in keys)])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shipped.value
        best: dict[tuple, BestPerQuery] = {}
        for records in batches if block.query_ids else ():
            records = records.take(pc.sort_indices(records.column("chunk_id")))
            for key, some in _apart(records, keys):
                kept = best.setdefault(key, BestPerQuery(len(block.query_ids), limit))
                for _, ids, scores in scored_parts(block, some):
                    kept.offer(scores, ids)
        found = [(block.query_ids[q], *hit, -minus, *key)
                 for key, of_key in best.items() for q, hits in of_key.kept.items() for minus, hit in hits]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], type=field.type)
                 for i, field in enumerate(arrow_schema)], schema=arrow_schema)

    return vectors.select("chunk_id", "paper_id", "terms", "weights", *keys).mapInArrow(run, schema)


def _apart(records: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each value of the column in ``keys``, in their order; without one all rows."""
    if not keys:
        yield (), records
        return
    values = records.column(keys[0]).dictionary_encode(null_encoding="encode")
    for i, value in enumerate(values.dictionary.to_pylist()):
        yield (value,), records.filter(pc.equal(values.indices, i))


def sparse_search_join(query_terms: DataFrame, vectors: DataFrame, limit: int | None) -> DataFrame:
    """The same search for query tables of any size, as a join on the term and a sum.

    Entries are placed by chunk before the join, so the sum per (query, chunk) needs no further
    exchange when the query side is broadcast, and the last one moves at most ``limit`` rows
    per query and task.
    """
    terms = query_terms.withColumnRenamed("weight", "_query_weight")
    met = postings(vectors.repartition("chunk_id")).join(terms, "term")
    if "scope" in query_terms.columns:
        met = met.filter(F.col("scope").isNull() | (F.col("scope") == F.col("paper_id").cast("string")))
    summed = met.groupBy("query_id", "chunk_id", "paper_id").agg(
        F.round(F.sum(F.col("_query_weight") * F.col("weight")), SCORE_DIGITS).alias("score"))
    return top_k(summed.filter(F.col("score") > 0), ["query_id"], _best_first("chunk_id"), limit)


def rrf_fuse(ranked: list[DataFrame], k: int = RRF_K, limit: int | None = SEARCH_LIMIT) -> DataFrame:
    """Reciprocal rank fusion (Cormack et al., 2009); an item in one list still counts."""
    lists = [df.select("query_id", "chunk_id", "paper_id", "rank") for df in ranked]
    union = lists[0]
    for other in lists[1:]:
        union = union.unionByName(other)
    fused = union.groupBy("query_id", "chunk_id", "paper_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return top_k(fused, ["query_id"], _best_first("chunk_id"), limit)


def hybrid_search(
    queries: DataFrame, vectors: DataFrame, sparse: DataFrame | None, limit: int = SEARCH_LIMIT,
    use_sparse: bool = True, rrf_k: int = RRF_K, statistics: DataFrame | None = None,
    n_docs: Column | None = None, impacts: DataFrame | None = None,
) -> DataFrame:
    """Dense and sparse top ``2 * limit`` fused to ``limit``; dense only without sparse. With ``impacts``
    (see ``operators.impacts``) the sparse leg opens only blocks of this index that can matter, and completes scores from ``sparse``.

    Queries carry ``query_id, mode, paper_id, user_message, query_vector``. The paper filter
    of deep-dive queries applies before ranking. With ``statistics`` the sparse leg weighs
    terms by IDF.
    """
    scoped = query_scope(queries)
    if not use_sparse:
        return dense_search(scoped, vectors, limit)
    terms = sparse_encode_queries(scoped, statistics, n_docs).join(
        scoped.select("query_id", "scope"), "query_id")
    found = sparse_search(terms, sparse, 2 * limit) if impacts is None else impact_search(terms, impacts, sparse, 2 * limit)
    return rrf_fuse([dense_search(scoped, vectors, 2 * limit), found], rrf_k, limit)


# --- Approximate dense search -------------------------------------------------------------

def hyperplane_bands(vector: Column, dim: int, tables: int, bits: int, seed: int = 7) -> Column:
    """One ``bits``-bit signature per table from random hyperplanes (Charikar, 2002)."""
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    powers = 2 ** np.arange(bits)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def signatures(column: pa.Array) -> pa.Array:
        sides = (matrix_of(column, dim) @ planes) >= 0
        codes = (sides.reshape(len(column), tables, bits) * powers).sum(axis=2).astype(np.int32)
        offsets = np.arange(0, (len(column) + 1) * tables, tables, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()))

    return signatures(vector)


def ann_index(vectors: DataFrame, dim: int, tables: int = 8, bits: int = 6, seed: int = 7) -> DataFrame:
    """One row per vector and table, to be stored partitioned by ``table, band``."""
    signed = vectors.filter(F.col("dense_vector").isNotNull()).withColumn(
        "bands", hyperplane_bands(F.col("dense_vector"), dim, tables, bits, seed))
    return signed.select("chunk_id", "paper_id", "dense_vector", "bands",
                         F.posexplode("bands").alias("table", "band"))


def ann_dense_search(
    queries: DataFrame, index: DataFrame, dim: int, limit: int = SEARCH_LIMIT,
    tables: int = 8, bits: int = 6, seed: int = 7,
) -> DataFrame:
    """Candidates share a band with the query; they are scored exactly and ranked.

    A candidate counts only in the first table where it meets the query, which removes
    duplicates inside the join instead of in a shuffle.
    """
    probes = _scoped(queries).withColumn(
        "_probe", hyperplane_bands(F.col("query_vector"), dim, tables, bits, seed))
    probes = probes.select("query_id", "scope", "query_vector", "_probe",
                           F.posexplode("_probe").alias("table", "band"))
    met = index.join(probes, ["table", "band"]).filter(
        F.col("scope").isNull() | (F.col("scope") == F.col("paper_id").cast("string")))
    first_table = F.array_position(
        F.zip_with("bands", "_probe", lambda a, b: a == b), True) == F.col("table") + 1
    scored = met.filter(first_table).select(
        "query_id", "chunk_id", "paper_id",
        F.round(cosine(F.col("query_vector"), F.col("dense_vector")), SCORE_DIGITS).alias("score"))
    return top_k(scored, ["query_id"], _best_first("chunk_id"), limit)


def ann_recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, per query."""
    found = approximate.select("query_id", "chunk_id", F.lit(1).alias("_found"))
    return exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.round(F.count("_found") / F.count("*"), SCORE_DIGITS).alias("recall"))


def enrich_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add text and parent; an unknown chunk gets text ``""`` and no parent.

    The chunk table is cut down to the chunks that were hit before the outer join, so it is
    never shuffled whole when the hits are small.
    """
    wanted = hits.select("chunk_id").distinct()
    known = chunks.join(wanted, "chunk_id", "left_semi").select("chunk_id", "text", "parent_chunk_id")
    return hits.join(known, "chunk_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
