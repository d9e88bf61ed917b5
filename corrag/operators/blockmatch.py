"""Exact best matches between two vector tables, block against block.

Vectors of one key are packed into blocks of bounded size. Every left block meets every right
block of its key in a row of its own, so the work of a large key spreads over the cluster,
and a block pair yields only the best rows, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK_ROWS = 512
SCORE_DIGITS = 6


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero, so their cosine is 0."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def matrix_of(vectors: pa.Array, dim: int) -> np.ndarray:
    """List column to unit rows; a vector of another dimension becomes a zero row."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0), dtype=np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == dim).all():
        return unit_rows(flat.reshape(len(lengths), dim))
    matrix = np.zeros((len(lengths), dim))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for row in np.flatnonzero(lengths == dim):
        matrix[row] = flat[starts[row]:starts[row] + dim]
    return unit_rows(matrix)


def score_block(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosines, one row per query. Rounded here so that every later ranking agrees."""
    return np.round(queries @ rows.T, SCORE_DIGITS) + 0.0


class BestPerQuery:
    """The ``k`` best (score, id) per query that a task has seen, ties by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.kept: dict[int, list] = {}

    def offer(self, scores: np.ndarray, ids: list) -> None:
        """``scores`` is queries x rows, the rows in ascending id order; ``-inf`` is no hit."""
        hopeful = (scores >= self.floor[:, None]) & (scores > -np.inf)
        for query in np.flatnonzero(hopeful.any(axis=1)):
            row = scores[query]
            places = np.flatnonzero(hopeful[query])
            # A stable sort keeps id order among equal scores.
            places = places[np.argsort(-row[places], kind="stable")][: self.k]
            kept = self.kept.get(query, []) + [(-row[p], ids[p]) for p in places]
            kept = sorted(kept)[: self.k]
            self.kept[query] = kept
            if len(kept) == self.k:
                self.floor[query] = -kept[-1][0]


def pack_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``key, id, vector`` to ``key, block, blocks, members`` with about ``block_rows`` each."""
    sizes = rows.groupBy("key").agg(
        F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    placed = rows.join(sizes, "key").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return placed.groupBy("key", "block", "blocks").agg(
        F.collect_list(F.struct("id", "vector")).alias("members"))


def _members(column: pa.Array, row: int) -> tuple[list, pa.Array]:
    members = column[row].values
    # Struct ids become tuples, which compare field by field.
    ids = [tuple(i.values()) if isinstance(i, dict) else i for i in members.field("id").to_pylist()]
    order = sorted(range(len(ids)), key=ids.__getitem__)
    return [ids[i] for i in order], members.field("vector").take(pa.array(order))


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_struct(kind):
        values = [dict(zip((f.name for f in kind), value)) for value in values]
    return pa.array(values, type=kind)


def pair_blocks(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """``key, left_id, right_id, score``: the best ``k`` right rows per left row and block pair."""
    right_blocks = right.select("key", F.col("blocks").alias("_right_blocks")).distinct()
    spread = (left.join(right_blocks, "key")
              .select("key", F.col("members").alias("left_members"),
                      F.explode(F.sequence(F.lit(0), F.col("_right_blocks") - 1)).alias("block")))
    met = spread.join(
        right.select("key", "block", F.col("members").alias("right_members")), ["key", "block"])

    def id_type(df: DataFrame) -> T.DataType:
        return df.schema["members"].dataType.elementType["id"].dataType

    schema = T.StructType([
        T.StructField("key", left.schema["key"].dataType),
        T.StructField("left_id", id_type(left)), T.StructField("right_id", id_type(right)),
        T.StructField("score", T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in batches:
            keys, found = records.column("key").to_pylist(), []
            for row in range(records.num_rows):
                left_ids, left_vectors = _members(records.column("left_members"), row)
                right_ids, right_vectors = _members(records.column("right_members"), row)
                lengths = left_vectors.value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(lengths):
                    places = np.flatnonzero(lengths == dim)
                    best = BestPerQuery(len(places), k)
                    best.offer(score_block(
                        matrix_of(right_vectors, int(dim)),
                        matrix_of(left_vectors.take(pa.array(places)), int(dim))), right_ids)
                    found += [(keys[row], left_ids[places[q]], right_id, -minus)
                              for q, kept in best.kept.items() for minus, right_id in kept]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [_column([f[i] for f in found], field.type) for i, field in enumerate(arrow_schema)],
                    schema=arrow_schema)

    return met.select("key", "left_members", "right_members").mapInArrow(run, schema)
